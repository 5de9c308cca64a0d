"""LM scoring by a class-based bigram model (Brown classes found by exchange clustering).

P(w_i | w_{i-1}) = P(c_i | g_{i-1}) P(w_i | c_i), g being the class of the word before as a context. All training documents are
counted; scoring covers all documents.

* *Vocabulary*: exact counts of all training words, in a block shuffle by word hash. The ``FREQUENT`` most frequent words
  are items of their own (a broadcast of fixed size); as contexts, other words stand for one of ``SIGNATURES`` items by their
  spelling (last bytes, length, digits, marks).
* *Items*: one pass writes each document as 16-bit items with the hashes of its other words; later passes read these, not the texts.
* *Exchange*: each round counts, over all training items, the classes before and after each item, then moves items
  one by one to the class that raises the class bigram likelihood most, updating class counts after each move.
* *All other words*: every further training word, however many there are, goes to the class that raises the likelihood most by its own
  contexts: its (class before, count) entries meet in a block shuffle by hash, and words are moved in parallel against the
  counts of the frequent ones. A word that training lacks has the class of its spelling.
* *Model*: class transitions interpolated with class frequencies, over all words' final classes; emissions with add-``DELTA``
  smoothing over the class's words and one unknown word for each class.
* *Scoring*: frequent words are scored from the items; entries of other words, with class and count, go back to their documents.

Words are told apart by 64-bit hashes. The base score is an add-one unigram model over the same counts.

Defined results: null and empty texts are one end token; repeated rows are scored alike, and counted each;
documents with a null doc_id are not held out by the rule (they train); without training documents all words are unknown and
scores are those of empty counts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm import shingling
from sluice.llm.util import CACHE_WORDS, FLUSH_ENTRIES, Scratch, blocks_of, mix, parts, read_blocks, saved, text_bytes

FREQUENT = 40_000
SIGNATURES = 4_096
CLASSES = 48
ROUNDS = 3
DELTA = 0.3
ALPHA = 4.0
FOLDS, HELD = 7, 2
END = FREQUENT + SIGNATURES
ITEMS = END + 1
N_CLASSES = CLASSES + 1
_VOCAB = np.dtype([("h", "<u8"), ("n", "<u4")])  # counts of one task
_WORDS = np.dtype([("h", "<u8"), ("n", "<u8")])  # counts of all
_MET = np.dtype([("h", "<u8"), ("row", "<u8"), ("k", "<u4"), ("left", "u1"), ("spelt", "u1"), ("train", "u1")])
_BACK = np.dtype([("row", "<u8"), ("n", "<u8"), ("k", "<u4"), ("left", "u1"), ("c", "u1")])
_CELL = np.dtype([("i", "<u4"), ("n", "<u4")])
_ITEM = np.dtype("<u2")


def held_out() -> Column:
    """The fold rule on doc_id: crc32 of its decimal text."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def spelling(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Spelling class of each word of a buffer: by its last two bytes, length, digits and marks."""
    base, end = int(offsets[0]), int(offsets[-1])
    data, starts = data[base:end], offsets[:-1] - base
    starts = starts[starts < len(data)]
    inside = shingling.PLAIN.inside[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[starts] = inside[starts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    a, b = np.flatnonzero(begins), np.flatnonzero(ends)
    digits, marks = (np.concatenate(([0], np.cumsum(t[data], dtype=np.int32))) for t in (_DIGIT, _MARK))
    shape = np.minimum(b - a + 1, 15) // 2 * 4 + (digits[b + 1] > digits[a]) * 2 + (marks[b + 1] - marks[a] > 1)
    low = _LOW[data]
    key = low[b].astype(np.uint64) | low[np.maximum(b - 1, a)].astype(np.uint64) << np.uint64(8) | shape.astype(np.uint64) << np.uint64(16)
    return (mix(key + np.uint64(1)) % np.uint64(SIGNATURES)).astype(np.int64)


_LOW = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_DIGIT = np.array([48 <= b < 58 for b in range(256)])
_MARK = np.array([not (48 <= b < 58 or 97 <= b < 123 or 65 <= b <= 90 or b >= 128 or b == 32 or 9 <= b <= 13) for b in range(256)])


def _block_batch(blocks: list[tuple[int, bytes]], **more) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"block": pa.array([b for b, _ in blocks], pa.int32()), "payload": pa.array([p for _, p in blocks], pa.binary())})


# vocabulary


def _counted(batches, n_blocks: int):
    """Counts of distinct words, as blocks by hash."""
    held, size = [], 0

    def summed():
        h, n = (np.concatenate(x) for x in zip(*held, strict=True))
        h, at = np.unique(h, return_inverse=True)
        return h, np.bincount(at, n).astype(np.int64)

    def flush(h, n):
        e = np.empty(len(h), _VOCAB)
        e["h"], e["n"] = h, n
        return _block_batch([(b, e[i].tobytes()) for b, i in blocks_of(e["h"], n_blocks)])

    for batch in batches:
        for _, _, data, offsets in shingling.slices(batch.column("text")):
            held.append(np.unique(shingling.words(data, offsets)[0], return_counts=True))
            size += len(held[-1][0])
            if size > FLUSH_ENTRIES:
                held = [summed()]
                size = len(held[0][0])
                if size > CACHE_WORDS:
                    yield flush(*held[0])
                    held, size = [], 0
    if size:
        yield flush(*summed())


def vocabulary(scratch: Scratch, train: DataFrame) -> DataFrame:
    """(block, payload of distinct words with counts, n_words, n_tokens) in the shared folder."""
    n_blocks = parts(train.sparkSession)

    def summed(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for b, p in zip(batch.column("block").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                held.setdefault(b, []).append(np.frombuffer(p, _VOCAB))
        for b, got in held.items():
            e = np.concatenate(got)
            h, at = np.unique(e["h"], return_inverse=True)
            out = np.empty(len(h), _WORDS)
            out["h"], out["n"] = h, np.bincount(at, e["n"])
            yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "payload": pa.array([out.tobytes()], pa.binary()), "n_words": pa.array([len(h)], pa.int64()), "n_tokens": pa.array([int(out["n"].sum())], pa.int64())})

    counted = train.mapInArrow(lambda it: _counted(it, n_blocks), "block int, payload binary").repartitionById(n_blocks, "block")
    return scratch.saved(counted.mapInArrow(summed, "block int, payload binary, n_words long, n_tokens long"), "vocabulary")


def _most_frequent(vocab: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the FREQUENT most frequent words, most frequent first, ties by hash."""

    def top(batches):
        for batch in batches:
            for p in batch.column("payload").to_pylist():
                e = np.frombuffer(p, _WORDS)
                e = e[np.lexsort((e["h"], -e["n"].astype(np.int64)))[:FREQUENT]]
                yield pa.RecordBatch.from_pydict({"h": pa.array(e["h"].astype(np.uint64).view(np.int64)), "n": pa.array(e["n"].astype(np.int64))})

    rows = vocab.select("payload").mapInArrow(top, "h long, n long").orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    h = rows.column("h").to_numpy().view(np.uint64)
    return h, rows.column("n").to_numpy()


# texts as items


_ENCODED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held", pa.bool_()), ("seq", pa.binary()), ("others", pa.binary())])
_ENCODED_SQL = "row long, doc_id long, held boolean, seq binary, others binary"


def _encoded(batches, words: tuple[np.ndarray, np.ndarray]):
    """Rows of documents with their items, and the hashes of their words that are no items of their own."""
    hashes, item_of = words
    task = TaskContext.get()
    row = (task.partitionId() if task else 0) << 36
    for batch in batches:
        for a, b, data, offsets in shingling.slices(batch.column("text")):
            h, counts = shingling.words(data, offsets)
            at = np.minimum(np.searchsorted(hashes, h), max(len(hashes) - 1, 0))
            known = hashes[at] == h if len(hashes) else np.zeros(len(h), bool)
            seq = np.where(known, item_of[at] if len(hashes) else 0, FREQUENT + spelling(data, offsets)).astype(_ITEM)
            cuts = np.concatenate(([0], np.cumsum(counts)))
            more = np.concatenate(([0], np.cumsum(~known)))[cuts]
            other, raw = h[~known].tobytes(), seq.tobytes()
            seqs = [raw[2 * x : 2 * y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            others = [other[8 * x : 8 * y] for x, y in zip(more[:-1].tolist(), more[1:].tolist(), strict=True)]
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + b - a), pa.int64()), part.column("doc_id"), part.column("held"), pa.array(seqs, pa.binary()), pa.array(others, pa.binary())], schema=_ENCODED)
            row += b - a


def _asked(batches, classes: np.ndarray, n_blocks: int):
    """Entries of words that are no items: (hash, row, times, class before), in blocks by hash."""
    held, size = [], 0

    def flush():
        e = np.concatenate(held)
        return _block_batch([(b, e[i].tobytes()) for b, i in blocks_of(e["h"], n_blocks)])

    for batch in batches:
        if not batch.num_rows:
            continue
        seqs = batch.column("seq").to_pylist()
        seq = _sequence(seqs)
        row = np.repeat(batch.column("row").to_numpy().astype(np.uint64), [len(x) // _ITEM.itemsize + 1 for x in seqs])
        train = np.repeat(~np.asarray(batch.column("held").to_numpy(zero_copy_only=False)), [len(x) // _ITEM.itemsize + 1 for x in seqs])
        now = seq[1:]
        at = np.flatnonzero((now >= FREQUENT) & (now < END))
        e = np.zeros(len(at), _MET)
        e["h"] = np.frombuffer(b"".join(batch.column("others").to_pylist()), "<u8")
        e["row"], e["left"], e["spelt"], e["train"] = row[at], classes[seq[at]], classes[now[at]], train[at]
        order = np.lexsort((e["left"], e["h"], e["row"]))
        e = e[order]
        first = np.flatnonzero(np.concatenate(([True], (e["h"][1:] != e["h"][:-1]) | (e["row"][1:] != e["row"][:-1]) | (e["left"][1:] != e["left"][:-1]))) if len(e) else np.empty(0, bool))
        times = np.diff(first, append=len(e))
        e = e[first]
        e["k"] = times
        held.append(e)
        size += len(e)
        if size >= FLUSH_ENTRIES // 2:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def _sequence(seqs: list[bytes]) -> np.ndarray:
    """Items of a batch's documents, with an end before the first and behind each."""
    end = np.array([END], _ITEM).tobytes()
    return np.frombuffer(end + end.join(seqs) + end, _ITEM).astype(np.int64)


# contexts and exchange


def contexts(train: DataFrame, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """before[item, class], after[item, class]: counts over all training items; fixed-size tables.

    Cells are dealt by range; a receiving task adds payload by payload into its range, so its memory has a fixed size.
    """
    sc = train.sparkSession.sparkContext
    shared = sc.broadcast(classes)
    n_blocks = 32
    size = ITEMS * N_CLASSES
    width = 2 * size // n_blocks + 1

    def run(batches):
        cls, table = shared.value, np.zeros(2 * size, np.int64)
        for batch in batches:
            seq = _sequence(batch.column("seq").to_pylist())
            c = cls[seq]
            table[:size] += np.bincount(seq[1:] * N_CLASSES + c[:-1], minlength=size)
            table[size:] += np.bincount(seq[:-1] * N_CLASSES + c[1:], minlength=size)
        at = np.flatnonzero(table)
        e = np.empty(len(at), _CELL)
        e["i"], e["n"] = at, table[at]
        cuts = np.searchsorted(at, np.arange(n_blocks + 1) * width)
        yield _block_batch([(b, e[cuts[b] : cuts[b + 1]].tobytes()) for b in range(n_blocks) if cuts[b] < cuts[b + 1]])

    def summed(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, p in zip(batch.column("block").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                e = np.frombuffer(p, _CELL)
                if b not in sums:
                    sums[b] = np.zeros(width, np.int64)
                sums[b][e["i"] - b * width] += e["n"]
        for b, n in sums.items():
            i = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"i": pa.array([(i + b * width).astype("<u4").tobytes()], pa.binary()), "n": pa.array([n[i].tobytes()], pa.binary())})

    table = np.zeros(2 * size, np.int64)
    rows = train.select("seq").mapInArrow(run, "block int, payload binary").repartition(n_blocks, "block").mapInArrow(summed, "i binary, n binary")
    for r in rows.toLocalIterator():
        table[np.frombuffer(r.i, "<u4")] = np.frombuffer(r.n, "<i8")
    shared.destroy()
    return table[:size].reshape(ITEMS, N_CLASSES), table[size:].reshape(ITEMS, N_CLASSES)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(before: np.ndarray, after: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """One round: each item, most frequent first, goes to the class with the best class bigram likelihood.

    Contexts keep the classes of the round's start; class counts follow each move.
    """
    classes = classes.copy()
    total = before.sum(axis=1)
    pair = np.zeros((N_CLASSES, N_CLASSES))  # rows: class before
    for c in range(N_CLASSES):
        pair[:, c] = before[classes == c].sum(axis=0)
    pair2 = np.zeros((N_CLASSES, N_CLASSES))
    for c in range(N_CLASSES):
        pair2[c] = after[classes == c].sum(axis=0)
    size = np.bincount(classes, total, minlength=N_CLASSES).astype(float)
    for i in np.argsort(-total, kind="stable").tolist():
        if i == END or not total[i]:
            continue
        left, right, n, own = before[i], after[i], total[i], classes[i]
        pair[:, own] -= left
        pair2[own] -= right
        size[own] -= n
        seen_l, seen_r = np.flatnonzero(left), np.flatnonzero(right)
        gain = (_xlogx(pair[seen_l] + left[seen_l, None]) - _xlogx(pair[seen_l])).sum(axis=0)
        gain += (_xlogx(pair2[:, seen_r] + right[seen_r]) - _xlogx(pair2[:, seen_r])).sum(axis=1)
        gain -= 2 * (_xlogx(size + n) - _xlogx(size))
        best = int(np.argmax(gain[:CLASSES]))
        classes[i] = best
        pair[:, best] += left
        pair2[best] += right
        size[best] += n
    return classes


@dataclass
class Clusters:
    """Classes of items, and what the frequent words (and ends) count in them."""

    classes: np.ndarray  # class of each item
    count: np.ndarray  # training count of each frequent item and of END; 0 for spellings
    pair: np.ndarray  # tokens by class before (rows) and class, of frequent words and ends
    n_tokens: int
    n_words: int


def clustered(train: DataFrame, vocab: DataFrame, n: np.ndarray, rounds: int = ROUNDS) -> Clusters:
    """Exchange over the items of encoded training documents; n: counts of the frequent words."""
    n_train = train.count()
    totals = vocab.agg(F.sum("n_words").alias("w"), F.sum("n_tokens").alias("t")).first()
    classes = np.concatenate([np.arange(FREQUENT + SIGNATURES) % CLASSES, [CLASSES]])
    for _ in range(rounds):
        classes = exchange(*contexts(train, classes), classes)
    before, _ = contexts(train, classes)
    before[FREQUENT:END] = 0
    pair = np.zeros((N_CLASSES, N_CLASSES))
    for c in range(N_CLASSES):
        pair[:, c] = before[classes == c].sum(axis=0)
    count = np.zeros(ITEMS, np.int64)
    count[: len(n)], count[END] = n, n_train
    return Clusters(classes, count, pair, int(totals.t or 0) + n_train, int(totals.w or 0) + (n_train > 0))


def best_classes(word: np.ndarray, left: np.ndarray, k: np.ndarray, n_words: int, pair: np.ndarray) -> np.ndarray:
    """The class of each of n_words words by its contexts: cells (word, class before, times), sorted by word.

    Moving a word with these contexts into class c adds the pairs' x log x less that of the class's size.
    """
    size = pair.sum(axis=0)
    total = np.bincount(word, k, minlength=n_words)
    gain = np.empty((n_words, CLASSES))
    for a in range(0, n_words, 20_000):  # a bounded table at a time
        b = min(n_words, a + 20_000)
        lo, hi = np.searchsorted(word, [a, b])
        grown = pair[left[lo:hi], :CLASSES]
        cells = _xlogx(grown + k[lo:hi, None]) - _xlogx(grown)
        part = np.zeros((b - a, CLASSES))
        np.add.at(part, word[lo:hi] - a, cells)
        part -= _xlogx(size[:CLASSES] + total[a:b, None]) - _xlogx(size[:CLASSES])
        gain[a:b] = part
    return np.argmax(gain, axis=1)


@dataclass
class Model:
    classes: np.ndarray  # class of each item
    count: np.ndarray  # training count of each frequent item and of END; 0 for spellings
    transition: np.ndarray  # log10 P(class | class before)
    denominator: np.ndarray  # log10 of each class's emission denominator
    n_tokens: int
    n_words: int


def fitted(found: Clusters, pair: np.ndarray, tokens: np.ndarray, kinds: np.ndarray) -> Model:
    """The model from the clusters and what the other words count: pairs, tokens and distinct words by class."""
    pair = found.pair + pair
    share = (pair.sum(axis=0) + 1) / (pair.sum() + N_CLASSES)
    transition = np.log10((pair + ALPHA * share) / (pair.sum(axis=1, keepdims=True) + ALPHA))
    item = (found.count > 0).astype(np.int64)
    per = np.bincount(found.classes, found.count, minlength=N_CLASSES) + tokens + DELTA * (np.bincount(found.classes, item, minlength=N_CLASSES) + kinds + 1)
    per[CLASSES] = 1.0  # the end is its class's only member
    return Model(found.classes, found.count, transition, np.log10(per), found.n_tokens, found.n_words)


# scoring


def _scored(batches, model: Model):
    """Documents with their part of the sums; words that are no items of their own come from their entries."""
    base = np.log10(model.count + 1.0)
    emit = np.log10(model.count + DELTA) - model.denominator[model.classes]
    emit[END] = 0.0
    base[FREQUENT:END] = 0.0
    known = (model.count > 0).astype(np.int64)
    for batch in batches:
        seqs = batch.column("seq").to_pylist()
        if not seqs:
            continue
        n = np.fromiter(map(len, seqs), np.int64, len(seqs)) // _ITEM.itemsize + 1
        starts = np.cumsum(n) - n
        seq = _sequence(seqs)
        c = model.classes[seq]
        seq = seq[1:]
        score = np.where((seq >= FREQUENT) & (seq < END), 0.0, model.transition[c[:-1], c[1:]] + emit[seq])
        sums = [np.add.reduceat(x, starts) for x in (known[seq], base[seq], score)]
        yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "doc_id": batch.column("doc_id"), "held": batch.column("held"), "n_tokens": pa.array(n), "n_known": pa.array(sums[0]), "base": pa.array(sums[1]), "score": pa.array(sums[2])})


_SCORED_SQL = "row long, doc_id long, held boolean, n_tokens long, n_known long, base double, score double"
_MET_SQL = "block int, payload binary, pair binary, tokens binary, kinds binary"


def _met(batches, pair: np.ndarray, n_blocks: int):
    """Entries of other words with class and count, in blocks by row; and, once, what these words count by class.

    A hash's entries meet in one task; no word here is among the most frequent ones, so none is a large part of them.
    """
    vocab, asked = [], []
    for batch in batches:
        for kind, p in zip(batch.column("kind").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            (asked if kind else vocab).append(np.frombuffer(p, _MET if kind else _WORDS))
    if not asked:
        return
    v = np.concatenate(vocab) if vocab else np.empty(0, _WORDS)
    v = v[np.argsort(v["h"])]
    place = [np.minimum(np.searchsorted(v["h"], e["h"]), max(len(v) - 1, 0)) for e in asked]
    known = [v["h"][at] == e["h"] if len(v) else np.zeros(len(e), bool) for e, at in zip(asked, place, strict=True)]
    # cells (word, class before) of training entries
    cell = [(at.astype(np.int64) * N_CLASSES + e["left"])[ok & (e["train"] > 0)] for e, at, ok in zip(asked, place, known, strict=True)]
    times = [e["k"][ok & (e["train"] > 0)] for e, ok in zip(asked, known, strict=True)]
    cell, at = np.unique(np.concatenate(cell), return_inverse=True)
    k = np.bincount(at, np.concatenate(times), minlength=len(cell))
    seen, word = np.unique(cell // N_CLASSES, return_inverse=True)
    c_of = np.zeros(len(v), np.uint8)
    if len(seen):
        c_of[seen] = best_classes(word, cell % N_CLASSES, k, len(seen), pair)
    more = np.zeros((N_CLASSES, N_CLASSES))
    np.add.at(more, (cell % N_CLASSES, c_of[cell // N_CLASSES]), k)
    tokens = np.bincount(c_of[seen], v["n"][seen], minlength=N_CLASSES).astype(np.int64)
    kinds = np.bincount(c_of[seen], minlength=N_CLASSES)
    yield pa.RecordBatch.from_pydict({"block": pa.array([None], pa.int32()), "payload": pa.array([None], pa.binary()), "pair": pa.array([more.tobytes()], pa.binary()), "tokens": pa.array([tokens.tobytes()], pa.binary()), "kinds": pa.array([kinds.astype(np.int64).tobytes()], pa.binary())})
    held, size = [], 0
    for no, (e, at, ok) in enumerate(zip(asked, place, known, strict=True), 1):
        out = np.empty(len(e), _BACK)
        out["row"], out["k"], out["left"] = e["row"], e["k"], e["left"]
        out["n"] = np.where(ok, v["n"][at], 0) if len(v) else 0
        out["c"] = np.where(ok, c_of[at], e["spelt"]) if len(v) else e["spelt"]
        held.append(out)
        size += len(out)
        if size < FLUSH_ENTRIES and no < len(asked):  # gathered before they are dealt, or each payload would give a row for each block
            continue
        out = np.concatenate(held)
        held, size = [], 0
        block = (out["row"] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(n_blocks)
        order = np.argsort(block, kind="stable")
        cuts = np.searchsorted(block[order], np.arange(n_blocks + 1))
        got = [(b, out[order[cuts[b] : cuts[b + 1]]].tobytes()) for b in range(n_blocks) if cuts[b] < cuts[b + 1]]
        none = pa.nulls(len(got), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in got], pa.int32()), pa.array([p for _, p in got], pa.binary()), none, none, none], names=["block", "payload", "pair", "tokens", "kinds"])


def _summed_rows(batches, model: Model):
    e = read_blocks(batches, _BACK)
    for_rows, at = np.unique(e["row"], return_inverse=True)
    k = e["k"].astype(float)
    score = np.log10(e["n"] + DELTA) + model.transition[e["left"], e["c"]] - model.denominator[e["c"]]
    sums = [np.bincount(at, x, minlength=len(for_rows)) for x in (k * (e["n"] > 0), k * np.log10(e["n"] + 1.0), k * score)]
    for i in range(0, len(for_rows), 20_000):
        cut = slice(i, i + 20_000)
        yield pa.RecordBatch.from_pydict({"row": pa.array(for_rows[cut].view(np.int64)), "more_known": pa.array(sums[0][cut].astype(np.int64)), "more_base": pa.array(sums[1][cut]), "more_score": pa.array(sums[2][cut])})


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs, from a written table."""
    spark = docs.sparkSession
    n_blocks = parts(spark)
    source = text_bytes(docs.withColumn("held", held_out()), "doc_id", "text", "held")
    with Scratch(spark) as scratch:
        vocab = vocabulary(scratch, source.where(~F.col("held")).select("text"))
        h, n = _most_frequent(vocab)
        order = np.argsort(h)
        words = spark.sparkContext.broadcast((h[order], order.astype(np.int64)))
        texts = scratch.saved(source.mapInArrow(lambda it: _encoded(it, words.value), _ENCODED_SQL), "encoded")
        clusters = clustered(texts.where("not held"), vocab, n)
        classes, pair = spark.sparkContext.broadcast(clusters.classes), spark.sparkContext.broadcast(clusters.pair)
        asked = texts.select("row", "held", "seq", "others").mapInArrow(lambda it: _asked(it, classes.value, n_blocks), "block int, payload binary")
        both = vocab.select("block", F.lit(0).alias("kind"), "payload").union(asked.select("block", F.lit(1).alias("kind"), "payload")).repartitionById(n_blocks, "block")
        met = scratch.saved(both.mapInArrow(lambda it: _met(it, pair.value, n_blocks), _MET_SQL), "met")
        sums = [np.zeros((N_CLASSES, N_CLASSES)), np.zeros(N_CLASSES, np.int64), np.zeros(N_CLASSES, np.int64)]
        for r in met.where("block is null").select("pair", "tokens", "kinds").toLocalIterator():  # one small row for each block
            for total, x, kind in zip(sums, r, ("<f8", "<i8", "<i8"), strict=True):
                total += np.frombuffer(x, kind).reshape(total.shape)
        model = fitted(clusters, *sums)
        shared = spark.sparkContext.broadcast(model)
        back = met.where("block is not null").select("block", "payload").repartitionById(n_blocks, "block").mapInArrow(lambda it: _summed_rows(it, shared.value), "row long, more_known long, more_base double, more_score double")
        out = texts.select("row", "doc_id", "held", "seq").mapInArrow(lambda it: _scored(it, shared.value), _SCORED_SQL).join(back, "row", "left")
        zero = F.log10(F.lit(float(model.n_tokens + model.n_words + 1)))
        return saved(
            out.select(
                "doc_id",
                F.col("held").alias("held_out"),
                "n_tokens",
                (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
                F.lit(model.n_tokens).cast("long").alias("train_tokens"),
                (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * zero).alias("base_score"),
                (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
            ),
            "scores",
        )


def perplexity(scores: DataFrame, held: bool = True) -> float:
    """Perplexity of the model over held-out (or training) documents."""
    r = scores.where(F.col("held_out") == held).agg(F.sum("score").alias("s"), F.sum("n_tokens").alias("n")).first()
    return 10 ** (-r.s / r.n)
