"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams scans every document.

Windows of ``n`` item words (a shorter item is one window) are kept as sorted hashes; a document's windows are hashed over whole
buffers of texts, looked up behind a bit filter, and hits are verified word by word. The benchmark is
broadcast in blocks of about ``block_bytes`` of text: one block for ordinary benchmarks, several
passes over the documents beyond that, merged by a row key that is written once before the passes.
Documents are never shuffled in the usual case of one block.

Defined results: null or empty text has no words and no hits; items without words are ignored;
repeated items count once by item_id; an item_id that is null is listed as an empty string;
documents with a null doc_id keep their row; an empty benchmark or table gives no hits or no rows;
columns of documents other than doc_id and text pass through untouched.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import shingling
from sluice.llm.util import saved, text_bytes

N_WORDS = 13
BLOCK_BYTES = 16 << 20
#: Bytes of the word pattern [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lowered.
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
_WORD = re.compile(rb"[^ ]+")
_WORD_OR_END = re.compile(rb"[^ \n]+")
_ALPHABET = shingling.Alphabet(_TABLE)
SCHEMA = "doc_id long, n_words long, hit_words array<long>, spans array<struct<start:long,end:long>>, items array<string>"


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Windows:
    """Windows of a block of items, as sorted hashes for each length; a window found is compared word by word.

    Some 40 bytes a window, in flat arrays, besides the items' texts.
    """

    def __init__(self, items: list[tuple[str, bytes]], n: int) -> None:
        self.names = sorted({item for item, _ in items})
        number = {item: k for k, item in enumerate(self.names)}
        self.text = b"\n".join(text.translate(_TABLE) for _, text in items)
        data = np.frombuffer(self.text, np.uint8)
        ends = np.cumsum([len(text) + 1 for _, text in items], dtype=np.int64)
        offsets = np.concatenate(([0], ends[:-1], [len(data)])) if items else np.zeros(1, np.int64)
        h, counts = shingling.words(data, offsets, _ALPHABET) if items else (np.empty(0, np.uint64), np.empty(0, np.int64))
        self.starts = np.fromiter((m.start() for m in _WORD_OR_END.finditer(self.text)), np.int64, len(h))
        first = np.cumsum(counts) - counts
        owner = np.repeat(np.array([number[item] for item, _ in items], np.int64), counts)
        text_of = np.repeat(np.arange(len(items)), counts)
        self.by_len: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in np.unique(np.minimum(counts[counts > 0], n)).tolist():
            every = shingling.runs(h, size)
            at = np.flatnonzero(text_of[: len(every)] == text_of[size - 1 :])
            if size < n:  # a shorter item is one window
                at = at[counts[text_of[at]] == size]
            at = at[np.lexsort((owner[at], every[at]))]
            hashes, owners = every[at], owner[at]
            fresh = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])))
            for k in np.flatnonzero(~np.concatenate(([True], hashes[1:] != hashes[:-1]))).tolist():
                if self.words_at(int(at[k]), size) != self.words_at(int(at[k - 1]), size):
                    raise ValueError("two windows have one hash")  # of the order of 2^-64 for each pair of windows
            hashes, owners, at = hashes[fresh], owners[fresh], at[fresh]
            heads = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
            bits = 1 << min(26, max(16, int(16 * len(heads)).bit_length()))
            filled = np.zeros(bits, bool)
            filled[(hashes[heads] & np.uint64(bits - 1)).astype(np.int64)] = True
            self.by_len[size] = (hashes[heads], np.append(heads, len(hashes)), owners, at[heads], np.packbits(filled, bitorder="little"))

    def words_at(self, word: int, size: int) -> list[bytes]:
        end = int(self.starts[word + size]) if word + size < len(self.starts) else len(self.text)
        return self.text[int(self.starts[word]) : end].split()

    def scan(self, column: pa.Array):
        """For each text of a binary column: its number of words, and the hit words (or None) with the items found."""
        for a, b, data, offsets in shingling.slices(column):
            h, counts = shingling.words(data, offsets, _ALPHABET)
            first = np.cumsum(counts) - counts
            found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
            text_of = np.repeat(np.arange(b - a), counts)
            for size, (hashes, _, _, _, bits) in self.by_len.items():
                every = shingling.runs(h, size)
                low = every & np.uint64(8 * len(bits) - 1)
                at = np.flatnonzero(bits[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8) & 1)
                at = at[text_of[at] == text_of[at + size - 1]]
                k = np.minimum(np.searchsorted(hashes, every[at]), len(hashes) - 1)
                same = hashes[k] == every[at]
                for word, window in zip(at[same].tolist(), k[same].tolist(), strict=True):
                    found[int(text_of[word])].append((size, word - int(first[text_of[word]]), window))
            for t, n_words in enumerate(counts.tolist()):
                if t not in found:
                    yield n_words, None, []
                    continue
                w = words(data[offsets[t] : offsets[t + 1]].tobytes())
                hit, owners = np.zeros(n_words, bool), set()
                for size, i, window in found[t]:
                    _, edges, names, at, _ = self.by_len[size]
                    if w[i : i + size] == self.words_at(int(at[window]), size):
                        hit[i : i + size] = True
                        owners.update(names[edges[window] : edges[window + 1]].tolist())
                yield n_words, hit if owners else None, [self.names[k] for k in sorted(owners)]


def _char_spans(text: bytes, hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words as code point spans."""
    out, start, end = [], -1, -1
    for k, m in enumerate(_WORD.finditer(text.translate(_TABLE))):
        if hit[k]:
            start, end = (m.start() if start < 0 else start), m.end()
        elif start >= 0:
            out.append((start, end))
            start = -1
    if start >= 0:
        out.append((start, end))
    return [{"start": len(text[:a].decode()), "end": len(text[:b].decode())} for a, b in out]


def _blocks(benchmark: DataFrame, n: int, block_bytes: int) -> list:
    """The benchmark's windows as broadcasts, one for each block of its text."""
    sc = benchmark.sparkSession.sparkContext
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-int(total) // block_bytes))
    out = []
    for k in range(n_blocks):
        part = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == k)
        out.append(sc.broadcast(Windows([(r.item, bytes(r.text)) for r in part.toLocalIterator()], n)))
    return out


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: n_words, hit word positions, hit spans in code points, items with occurring windows."""
    shares = _blocks(benchmark, n, block_bytes)
    source = text_bytes(docs)
    if len(shares) > 1:
        return _merged(_numbered(source, "_row"), "_row", shares).drop("_row")
    share = shares[0]

    def run(batches):
        windows = share.value
        for batch in batches:
            rows = {"doc_id": batch.column("doc_id"), "n_words": [], "hit_words": [], "spans": [], "items": []}
            texts = batch.column("text")
            for k, (n_words, hit, found) in enumerate(windows.scan(texts)):
                rows["n_words"].append(n_words)
                rows["hit_words"].append([] if hit is None else np.flatnonzero(hit).tolist())
                rows["spans"].append([] if hit is None else _char_spans(texts[k].as_py(), hit))
                rows["items"].append(found)
            yield pa.RecordBatch.from_pydict(rows, _ARROW)

    return source.mapInArrow(run, SCHEMA)


_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("hit_words", pa.list_(pa.int64())),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("items", pa.list_(pa.string())),
    ]
)


def _numbered(docs: DataFrame, key: str) -> DataFrame:
    """docs with a row key, written: the key is the same in every later pass."""
    return saved(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")


def _merged(numbered: DataFrame, key: str, shares: list) -> DataFrame:
    """The row key and the columns of scan(), one row per row, from a pass for each benchmark block.

    Each pass gives runs of hit words with their code points; runs of all blocks that meet or touch are one
    span, as if the blocks had been one. Passes behind the first only give rows with hits.
    """
    source = text_bytes(numbered, "doc_id", "text", key).withColumnRenamed(key, "row")
    run_type = "array<struct<a:long,b:long,start:long,end:long>>"
    arrow = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("a", "b", "start", "end")]))), ("items", pa.list_(pa.string()))])
    out = None
    for k, share in enumerate(shares):

        def run(batches, share=share, all_rows=k == 0):
            windows = share.value
            for batch in batches:
                rows, texts = [], batch.column("text")
                for k, (row, doc_id, (n_words, hit, found)) in enumerate(zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), windows.scan(texts), strict=True)):
                    if found or all_rows:
                        runs = []
                        if hit is not None:
                            edges = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0)).tolist()
                            runs = [{"a": a, "b": b, **s} for a, b, s in zip(edges[::2], edges[1::2], _char_spans(texts[k].as_py(), hit), strict=True)]
                        rows.append({"row": row, "doc_id": doc_id, "n_words": n_words, "runs": runs, "items": found})
                yield pa.RecordBatch.from_pylist(rows, arrow)

        got = source.mapInArrow(run, f"row long, doc_id long, n_words long, runs {run_type}, items array<string>")
        out = got if out is None else out.unionByName(got)
    per = saved(out, "scans").groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )

    def joined(batches):
        for batch in batches:
            hit_words, spans = [], []
            for runs in batch.column("runs").to_pylist():
                met: list[dict] = []
                for r in runs:
                    if met and r["a"] <= met[-1]["b"]:
                        if r["b"] > met[-1]["b"]:
                            met[-1]["b"], met[-1]["end"] = r["b"], r["end"]
                    else:
                        met.append(dict(r))
                hit_words.append([i for r in met for i in range(r["a"], r["b"])])
                spans.append([{"start": r["start"], "end": r["end"]} for r in met])
            rows = {"row": batch.column("row"), "doc_id": batch.column("doc_id"), "n_words": batch.column("n_words"), "hit_words": hit_words, "spans": spans, "items": batch.column("items")}
            yield pa.RecordBatch.from_pydict(rows, pa.schema([pa.field("row", pa.int64()), *_ARROW]))

    return per.mapInArrow(joined, f"row long, {SCHEMA}").withColumnRenamed("row", key)


def verdicts(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS, share: int = 20, **how) -> DataFrame:
    """Per document the digest columns; contaminated if one word in ``share`` or more is hit."""
    got = scan(docs, benchmark, n, **how)
    n_hit = F.size("hit_words").cast("long")
    return got.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def cleaned(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS, share: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents without benchmark text: contaminated ones go, hit spans of the others are cut out.

    The columns of docs stay; n_chars follows the text where it is there. With one benchmark block one pass and no
    shuffle; with more, hits of all blocks are merged by row and brought back to the documents. Words left and right of a cut
    stay apart if white space or marks stand there, as they do around words; windows they form anew are not scanned again.
    """
    shares = _blocks(benchmark, n, block_bytes)
    at = docs.columns.index("text")
    chars_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1
    width = len(docs.columns)

    def cut(batch, hits):
        """The batch's columns of docs, without contaminated rows; hits: (n_words, n_hit, function giving spans) by row."""
        keep, texts = [], []
        for k, (text, (n_words, n_hit, spans)) in enumerate(zip(batch.column(at).to_pylist(), hits, strict=True)):
            if n_hit and share * n_hit >= n_words:
                continue
            keep.append(k)
            if n_hit:
                for s in reversed(spans()):
                    text = text[: s["start"]] + text[s["end"] :]
            texts.append(text)
        schema = pa.schema([batch.schema.field(i) for i in range(width)])
        columns = list(batch.take(pa.array(keep, pa.int64())).columns)[:width]
        columns[at] = pa.array(texts, schema.field(at).type)
        if chars_at >= 0:
            old = columns[chars_at].to_pylist()
            columns[chars_at] = pa.array([len(t) if t is not None else o for t, o in zip(texts, old, strict=True)], schema.field(chars_at).type)
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches):
        windows = shares[0].value

        def hits(batch):
            column = batch.column(at)
            texts = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).fill_null(b"")
            for k, (n_words, hit, _) in enumerate(windows.scan(texts)):
                yield n_words, 0 if hit is None else int(hit.sum()), lambda k=k, hit=hit: _char_spans(texts[k].as_py(), hit)

        for batch in batches:
            yield cut(batch, hits(batch))

    if len(shares) == 1:
        return docs.mapInArrow(run, docs.schema)
    key = "_row"
    while key in docs.columns:
        key += "_"
    numbered = _numbered(docs, key)
    hit = _merged(numbered, key, shares).where(F.size("hit_words") > 0)
    hit = hit.select(F.col(key).alias("_key"), F.col("n_words").alias("_n_words"), F.size("hit_words").cast("long").alias("_n_hit"), F.col("spans").alias("_spans"))
    met = numbered.join(hit, numbered[key] == hit["_key"], "left")
    met = met.select(*[numbered[c] for c in docs.columns], hit["_n_words"], hit["_n_hit"], hit["_spans"])

    def run_met(batches):
        for batch in batches:
            n_words, n_hit, spans = (batch.column(width + k).to_pylist() for k in range(3))
            yield cut(batch, ((w, h or 0, lambda s=s: s) for w, h, s in zip(n_words, n_hit, spans, strict=True)))

    return met.mapInArrow(run_met, docs.schema)
