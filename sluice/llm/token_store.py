"""Token ids in a content-addressed store.

Layout below one folder, all Parquet:

* ``rows/kind=chunks`` (key, n_ids, ids): runs of token ids, of 16 bits where they fit, each content stored once under the
  sha256 of its ids as little-endian unsigned 32-bit integers. Chunk borders are content-defined: a chunk ends after an id whose rolling
  hash over the last ``WINDOW`` ids has its high ``BITS`` bits zero if it has ``MIN_IDS`` ids or more, or after ``MAX_IDS`` ids.
* ``recipes`` (doc_id, n_tokens, ids_crc32, root_sha256, chunks array, part) in ascending doc_id order by
  file: the manifest. ``root_sha256`` is a Merkle root over the document's chunk hashes. ``rows/kind=docs``
  has the same before ordering.

Texts are cut at lone spaces, where the byte-level pre-tokenizer cuts as well. Pieces are hashed over whole buffers of texts and
looked up in a worker's table of pieces; each new piece is encoded with the tokenizers library, many in one call. Ids
equal those of encoding whole texts (tested).

Defined results: null and empty texts give the end id alone; repeated rows and doc_ids each keep a
recipe; null doc_ids come first; special-token strings inside a text
become their ids, as the library's plain call gives them; an empty table
gives an empty store; other columns of the input are not stored.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm import shingling
from sluice.llm.shingling import powers
from sluice.llm.util import mix, parts, scratch_dir, text_bytes

END_ID = 0
WINDOW = 4
BITS = 9
MIN_IDS = 64
MAX_IDS = 2048
#: Slots of a worker's table of pieces, and the pieces it holds before it is emptied; longer pieces are encoded each time.
SLOTS = 1 << 22
MAX_PIECES = 1_500_000
MAX_PIECE_IDS = 200
#: New pieces encoded in one call.
JOINED = 2000
#: Bytes of text hashed at a time.
WINDOW_BYTES = 1 << 19
_MULTIPLIER = 0x9E3779B97F4A7C15
_SEEDS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))
_R = 0xA0761D6478BD642D
#: Bytes beside which a lone space is surely a place where the pre-tokenizer cuts.
_SURE = np.array([0x21 <= b <= 0x7E or b >= 0x80 for b in range(256)])
#: White space beyond ASCII, in UTF-8, and the marks 0x1C to 0x1F: texts that have any are encoded as they are.
#: The set in front lets the search skip all other bytes.
_ODD = re.compile(rb"[\x1c-\x1f\xc2\xe1-\xe3](?:(?<=[\x1c-\x1f])|(?<=\xc2)[\x85\xa0]|(?<=\xe1)\x9a\x80|(?<=\xe2)(?:\x80[\x80-\x8a\xa8\xa9\xaf]|\x81\x9f)|(?<=\xe3)\x80\x80)")


class Encoder:
    """Encodes buffers of texts; pieces between lone spaces are encoded once, while the table holds them."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings that the library takes out of a text before it cuts pre-tokens.
        added = {k: str(t.content) for k, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = [x.encode() for x in added.values()]
        # one character of a byte-level token is one byte
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, k in vocabulary.items():
            self.bytes_of[k] = len(added[k].encode()) if k in added else len(token)
        self.powers, self.back = (powers(x, WINDOW_BYTES) for x in (_R, pow(_R, -1, 1 << 64)))
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(SLOTS, np.uint64)
        self.at = np.zeros(SLOTS, np.uint32)
        self.size = np.zeros(SLOTS, np.uint8)
        self.ids = np.zeros(1 << 16, "<u4")
        self.n_pieces = self.n_ids = 0

    def __call__(self, text: str) -> bytes:
        raw = text.encode()
        return self.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tobytes()

    def direct(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in found]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a buffer, and how many each has."""
        base, end = int(offsets[0]), int(offsets[-1])
        data = data[base:end]
        offsets = offsets - base
        full = np.flatnonzero(np.diff(offsets))
        counts = np.zeros(len(offsets) - 1, np.int64)
        if not full.size:
            return np.empty(0, "<u4"), counts
        text_starts = offsets[full]
        odd = np.zeros(len(full), bool)
        for m in _ODD.finditer(data):
            odd[np.searchsorted(text_starts, m.start(), "right") - 1] = True
        cut = np.zeros(len(data) + 1, bool)
        sure = _SURE[data]
        cut[1:-2] = (data[1:-1] == 0x20) & sure[:-2] & sure[2:]
        cut[text_starts] = True
        # a space at a text's end or behind its start has a neighbour in another text
        last = offsets[full + 1] - 1
        cut[last[last > text_starts]] = False
        starts = np.flatnonzero(cut[:-1])
        owner = np.searchsorted(text_starts, starts, "right") - 1
        if odd.any():
            keep = ~odd[owner] | np.isin(starts, text_starts)
            starts, owner = starts[keep], owner[keep]
        ends = np.append(starts[1:], len(data))
        direct = odd[owner] | (ends - starts > 4096)
        slots = np.full(len(starts), -1, np.int64)
        hashes = self._hashes(data, starts, ends, direct)
        while True:
            self._find(hashes, slots, direct)
            new = np.flatnonzero((slots < 0) & ~direct)
            if not new.size:
                break
            _, first = np.unique(hashes[new], return_index=True)
            new = new[first]
            if self.n_pieces + len(new) > MAX_PIECES and self.n_pieces:
                self._clear()
                slots[:] = -1
                continue
            direct[self._learn(data, hashes, starts, ends, new)] = True
            long = set(hashes[new[direct[new]]].tolist())
            if long:
                direct |= np.isin(hashes, np.array(sorted(long), np.uint64)) & (slots < 0)
        sizes = np.where(direct, 0, self.size[np.maximum(slots, 0)]).astype(np.int64)
        apart = {}
        which = np.flatnonzero(direct)
        if which.size:
            for k, ids in zip(which.tolist(), self.direct([data[starts[k] : ends[k]].tobytes() for k in which.tolist()]), strict=True):
                apart[k] = ids
                sizes[k] = len(ids)
        before = np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        from_ = np.where(direct, 0, self.at[np.maximum(slots, 0)]).astype(np.int64)
        out = self.ids[np.minimum(np.repeat(from_ - before, sizes) + np.arange(total), len(self.ids) - 1)]
        for k, ids in apart.items():
            out[before[k] : before[k] + len(ids)] = ids
        counts[full] = np.add.reduceat(sizes, np.flatnonzero(np.append(True, owner[1:] != owner[:-1])))
        return out, counts

    def _hashes(self, data, starts, ends, direct) -> np.ndarray:
        out = np.zeros(len(starts), np.uint64)
        a = 0
        while a < len(starts):
            if direct[a]:
                a += 1
                continue
            b = int(np.searchsorted(ends, starts[a] + WINDOW_BYTES, "right"))
            stop = a + int(np.argmax(direct[a:b])) if direct[a:b].any() else b
            base = int(starts[a])
            values = _SEEDS[data[base : int(ends[stop - 1])]] * self.powers[: int(ends[stop - 1]) - base]
            at = starts[a:stop] - base
            out[a:stop] = np.add.reduceat(values, at) * self.back[at]
            a = stop
        return mix(out + (ends - starts).astype(np.uint64)) | np.uint64(1)

    def _find(self, hashes, slots, direct) -> None:
        open_ = np.flatnonzero((slots < 0) & ~direct)
        at = (hashes[open_] >> np.uint64(20)).astype(np.int64) & (SLOTS - 1)
        while open_.size:
            key = self.keys[at]
            same = key == hashes[open_]
            slots[open_[same]] = at[same]
            more = ~same & (key != 0)
            open_, at = open_[more], (at[more] + 1) & (SLOTS - 1)

    def _learn(self, data, hashes, starts, ends, new: np.ndarray) -> np.ndarray:
        """Encode new pieces and put them into the table; returns those that are too long for it."""
        # " a" and " b" joined are cut at the space again, so one call encodes many; others are encoded alone
        joined = (data[starts[new]] == 0x20) & (ends[new] - starts[new] > 1) & _SURE[data[ends[new] - 1]]
        some = new[joined]
        text, reach = _gathered(data, starts[some], ends[some])
        special = self._special_in(text, reach)
        alone = np.append(new[~joined], some[special])
        if special.any():
            some = some[~special]
            text, reach = _gathered(data, starts[some], ends[some])
        order, found, counts = [], [], []
        for at in range(0, len(some), JOINED):
            want = reach[at : at + JOINED]
            from_ = int(reach[at - 1]) if at else 0
            (ids,) = self.direct([text[from_ : int(want[-1])].tobytes()])
            reached = np.cumsum(self.bytes_of[ids]) + from_
            last = np.searchsorted(reached, want)
            if len(ids) and last[-1] == len(ids) - 1 and (reached[last] == want).all():
                order.append(some[at : at + JOINED])
                found.append(ids)
                counts.append(np.diff(last, prepend=-1))
            else:
                alone = np.append(alone, some[at : at + JOINED])
        if alone.size:
            each = self.direct([data[a:b].tobytes() for a, b in zip(starts[alone].tolist(), ends[alone].tolist(), strict=True)])
            order.append(alone)
            found += each
            counts.append(np.array([len(x) for x in each], np.int64))
        of, ids, sizes = np.concatenate(order), np.concatenate(found), np.concatenate(counts)
        long = sizes > MAX_PIECE_IDS
        if long.any():
            ids = ids[np.repeat(~long, sizes)]
        kept, sizes = of[~long], sizes[~long]
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self._put(hashes[kept], self.n_ids + np.cumsum(sizes) - sizes, sizes)
        self.n_ids += len(ids)
        self.n_pieces += len(kept)
        return of[long]

    def _special_in(self, text: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Which of the pieces that end at reach hold a special-token string or a part of one."""
        out = np.zeros(len(reach), bool)
        for x in self.special:
            for m in re.finditer(re.escape(x), text):
                a, b = np.searchsorted(reach, [m.start(), m.end() - 1], "right")
                out[a : b + 1] = True
        return out

    def _put(self, hashes, at, sizes) -> None:
        """Put distinct hashes that the table lacks into its free slots."""
        slots = (hashes >> np.uint64(20)).astype(np.int64) & (SLOTS - 1)
        while hashes.size:
            free = self.keys[slots] == 0
            # of several that meet in one slot the last one written has it
            self.keys[slots[free]] = hashes[free]
            got = free & (self.keys[slots] == hashes)
            self.at[slots[got]], self.size[slots[got]] = at[got], sizes[got]
            hashes, slots, at, sizes = hashes[~got], (slots[~got] + 1) & (SLOTS - 1), at[~got], sizes[~got]


def _gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of pieces one behind the other, and where each ends."""
    sizes = ends - starts
    reach = np.cumsum(sizes)
    return data[np.repeat(starts - (reach - sizes), sizes) + np.arange(int(sizes.sum()))], reach


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def marks(ids: np.ndarray) -> np.ndarray:
    """Ends of windows of WINDOW ids whose rolling hash lets a chunk end there, over any run of ids."""
    n = len(ids)
    if n < WINDOW:
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(_MULTIPLIER)
        x ^= x >> np.uint64(29)
        h = x[WINDOW - 1 :].copy()
        power = np.uint64(1)
        for k in range(WINDOW - 2, -1, -1):
            power = power * np.uint64(0x100000001B3)
            h += x[k : k + n - WINDOW + 1] * power
    return np.flatnonzero((h >> np.uint64(64 - BITS)) == 0) + WINDOW


def cuts(n: int, ends: list[int]) -> list[int]:
    """Ends of the chunks of a stream of n ids with these marks."""
    out, last = [], 0
    for e in [*ends, n]:
        while e - last > MAX_IDS:
            last += MAX_IDS
            out.append(last)
        if e - last >= MIN_IDS or e == n > last:
            out.append(e)
            last = e
    return out


def merkle_root(digests: list[bytes]) -> bytes:
    """Root over leaf digests; an odd one out moves up unchanged."""
    level = digests or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        pairs = [hashlib.sha256(b"".join(level[i : i + 2])).digest() for i in range(0, len(level) - 1, 2)]
        level = pairs + ([level[-1]] if len(level) % 2 else [])
    return level[0]


_ROWS = pa.schema([("kind", pa.string()), ("key", pa.binary()), ("doc_id", pa.int64()), ("n_ids", pa.int64()), ("crc32", pa.int64()), ("refs", pa.list_(pa.binary())), ("ids", pa.binary())])
_ROWS_SQL = "kind string, key binary, doc_id long, n_ids long, crc32 long, refs array<binary>, ids binary"
#: Chunk hashes a map task remembers, to send each chunk once.
SEEN = 200_000


def packed(ids: np.ndarray) -> bytes:
    """Chunk bytes as stored: ids of 16 bits where they fit (leading byte 2), else of 32 (4). Parquet compresses them."""
    small = ids.size and int(ids.max()) < 1 << 16
    return (b"\x02" + ids.astype("<u2").tobytes()) if small else (b"\x04" + ids.astype("<u4").tobytes())


def unpacked(data: bytes) -> bytes:
    """Little-endian unsigned 32-bit ids of a stored chunk."""
    return np.frombuffer(data, "<u2", offset=1).astype("<u4").tobytes() if data[0] == 2 else data[1:]


def encoded(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Rows of documents (hash list, count, crc, Merkle root as key) and rows of chunks, repeats dropped by task."""

    def run(batches):
        tool = encoder(tokenizer_path)
        seen: set[bytes] = set()
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for a, b, data, offsets in shingling.slices(batch.column("text")):
                found, counts = tool.encode(data, offsets)
                # each text's ids and the end id
                sizes = counts + 1
                ids = np.full(int(sizes.sum()), END_ID, "<u4")
                ids[np.arange(len(found)) + np.repeat(np.arange(len(counts)), counts)] = found
                ends, starts = marks(ids), np.cumsum(sizes) - sizes
                lo, hi = np.searchsorted(ends, starts + WINDOW), np.searchsorted(ends, starts + sizes, "right")
                rows = []
                for doc_id, at, size, x, y in zip(doc_ids[a:b], starts.tolist(), sizes.tolist(), lo.tolist(), hi.tolist(), strict=True):
                    mine = ids[at : at + size]
                    raw = mine.tobytes()
                    refs, last = [], 0
                    for e in cuts(size, (ends[x:y] - at).tolist() if size > WINDOW else []):
                        refs.append(digest := hashlib.sha256(raw[4 * last : 4 * e]).digest())
                        if digest not in seen:
                            if len(seen) >= SEEN:
                                seen.clear()
                            seen.add(digest)
                            rows.append(("chunks", digest, None, e - last, None, None, packed(mine[last:e])))
                        last = e
                    rows.append(("docs", merkle_root(refs), doc_id, size, zlib.crc32(raw), refs, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROWS, strict=True)], schema=_ROWS)

    return text_bytes(docs).mapInArrow(run, _ROWS_SQL)


def _first_of_each(batches):
    """Drop chunks that this partition has had; all rows of a hash are in one partition."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for k, (kind, key) in enumerate(zip(batch.column("kind").to_pylist(), batch.column("key").to_pylist(), strict=True)):
            if kind == "docs":
                keep.append(k)
            elif key not in seen:
                seen.add(key)
                keep.append(k)
        if keep:
            yield batch.take(pa.array(keep, pa.int64()))


def write(docs: DataFrame, path: str, tokenizer_path: str) -> None:
    """Encode docs into a store at path: one pass and one shuffle for chunks, one small one that orders recipes."""
    spark = docs.sparkSession
    # documents go by a hash of their id, so that copies, which share a Merkle root, spread out
    deal = F.when(F.col("kind") == "docs", F.xxhash64("doc_id")).otherwise(F.xxhash64("key"))
    rows = encoded(docs, tokenizer_path).repartition(parts(spark), deal).mapInArrow(_first_of_each, _ROWS_SQL)
    rows.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/rows")
    done = spark.read.schema(_ROWS_SQL).parquet(f"{path}/rows").where("kind = 'docs'")
    order = done.select("doc_id", F.col("n_ids").alias("n_tokens"), F.col("crc32").alias("ids_crc32"), F.col("key").alias("root_sha256"), F.col("refs").alias("chunks"))
    order = order.repartitionByRange(parts(spark), "doc_id", "root_sha256").sortWithinPartitions("doc_id", "root_sha256")
    order.withColumn("part", F.spark_partition_id()).write.option("compression", "zstd").parquet(f"{path}/recipes")


def recipes(spark: SparkSession, path: str) -> DataFrame:
    """Recipes with each document's start: ids of all documents before it in ascending doc_id order.

    Prefix sums run within the store's partitions; one small row per partition carries the rest.
    """
    stored = spark.read.parquet(f"{path}/recipes")
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    w = Window.partitionBy("part").orderBy("doc_id", "root_sha256").rowsBetween(Window.unboundedPreceding, -1)
    slim = stored.select("part", "doc_id", "n_tokens", "ids_crc32", "root_sha256", "chunks")
    return slim.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(w), F.lit(0))).drop("before", "part")


def chunk_facts(spark: SparkSession, path: str) -> DataFrame:
    """Per stored chunk: its hash, count and crc, from its bytes; a chunk whose bytes don't give its name fails."""

    def run(batches):
        for batch in batches:
            keys, counts, crcs = batch.column("key").to_pylist(), [], []
            for key, data in zip(keys, batch.column("ids").to_pylist(), strict=True):
                raw = unpacked(data)
                if hashlib.sha256(raw).digest() != key:
                    raise ValueError(f"chunk {key.hex()} is damaged")
                counts.append(len(raw) // 4)
                crcs.append(zlib.crc32(raw))
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(keys, pa.binary()), "n": pa.array(counts, pa.int64()), "crc": pa.array(crcs, pa.int64())})

    rows = spark.read.schema(_ROWS_SQL).parquet(f"{path}/rows").where("kind = 'chunks'")
    return rows.select("key", "ids").mapInArrow(run, "chunk binary, n long, crc long")


def _shift(n_bytes: int) -> int:
    """x^(8 n) modulo the crc polynomial, bit-reversed: what n bytes behind a crc multiply it by."""
    if n_bytes not in _SHIFTS:
        if len(_SHIFTS) > 100_000:
            _SHIFTS.clear()
        out, square, n = 1 << 31, 1 << 23, n_bytes
        while n:
            if n & 1:
                out = _product(out, square)
            square = _product(square, square)
            n >>= 1
        _SHIFTS[n_bytes] = out
    return _SHIFTS[n_bytes]


_SHIFTS: dict[int, int] = {}


def _product(a: int, b: int) -> int:
    """Product of two bit-reversed polynomials modulo the crc polynomial."""
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = (a << 1) & 0xFFFFFFFF
        b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
    return out


def crc_of_joined(crcs: list[int], sizes: list[int]) -> int:
    """crc32 of concatenated byte strings from their crcs and sizes."""
    out = 0
    for c, n in zip(crcs, sizes, strict=True):
        out = _product(out, _shift(n)) ^ c if out else c
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and n_chunks from the files.

    Counts and crcs come from the chunks' bytes: each chunk is read once, checked against its name, and
    reduced to (count, crc); documents combine these in recipe order, and their Merkle roots are checked.
    Chunk bytes are not shuffled.
    """
    r = recipes(spark, path).withColumn("row", F.xxhash64("start", "doc_id"))
    refs = r.select("row", F.posexplode("chunks").alias("k", "chunk"))
    facts = chunk_facts(spark, path)
    # left join: a missing chunk shows as a null count and fails below
    met = refs.join(facts, "chunk", "left").groupBy("row").agg(F.collect_list(F.struct("k", F.coalesce("n", F.lit(-1)).alias("n"), F.coalesce("crc", F.lit(-1)).alias("crc"))).alias("met"))
    both = r.join(met, "row").select("doc_id", "start", "n_tokens", "ids_crc32", "root_sha256", "chunks", "met")

    def run(batches):
        for batch in batches:
            rows = batch.to_pydict()
            counts, crcs = [], []
            for root, chunks, met in zip(rows["root_sha256"], rows["chunks"], rows["met"], strict=True):
                met = sorted((m["k"], m["n"], m["crc"]) for m in met)
                if any(m[1] < 0 for m in met) or merkle_root(chunks) != root:
                    raise ValueError("a chunk is missing or a manifest is damaged")
                counts.append(sum(m[1] for m in met))
                crcs.append(crc_of_joined([m[2] for m in met], [4 * m[1] for m in met]))
            if counts != rows["n_tokens"] or crcs != rows["ids_crc32"]:
                raise ValueError("reconstructed ids differ from the manifest")
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "start": batch.column("start"), "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64()), "n_chunks": pa.array([len(c) for c in rows["chunks"]], pa.int64())}
            )

    return both.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, n_chunks long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and the document's ids, rebuilt from chunks."""
    r = recipes(spark, path).withColumn("row", F.xxhash64("start", "doc_id"))
    refs = r.select("row", F.posexplode("chunks").alias("k", "chunk"))
    rows = spark.read.schema(_ROWS_SQL).parquet(f"{path}/rows").where("kind = 'chunks'").select(F.col("key").alias("chunk"), "ids")
    met = refs.join(rows, "chunk").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("met"))

    def run(batches):
        for batch in batches:
            ids = [np.frombuffer(b"".join(unpacked(m["ids"]) for m in met), "<u4").tolist() for met in batch.column("met").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "start": batch.column("start"), "ids": pa.array(ids, pa.list_(pa.int64()))})

    return r.join(met, "row").select("doc_id", "start", "met").mapInArrow(run, "doc_id long, start long, ids array<long>")


def stored(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """Write docs to a store (in the shared scratch folder if no path is given) and read it back."""
    spark = docs.sparkSession
    path = path or f"{scratch_dir(spark)}/tokens"
    write(docs, path, tokenizer_path)
    return read(spark, path)
