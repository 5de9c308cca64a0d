"""Exact similarity join on word shingles (Jaccard 0.8 or more) by a grouped prefix join.

Shingles of a document are ordered by a global order, rare before frequent; two documents that link share a
shingle among their first n - ceil(0.8 n) + 1, their prefixes.

1. *Frequencies*: each map task sends the shingles of its distinct sets, packed by flushes, to the shingles' hash ranges,
   where exact document frequencies are counted. Shingles of two or more sets go back to their flush; those of one can't
   be shared. Nothing of this is broadcast, and blocks stay the same size as the input grows.
2. *Prefixes*: behind its unshared shingles, which come first in the order, a set's prefix has its rarest shared ones. A set
   whose prefix is all unshared links with no other text and is done. Others send (shingle, set id, size, place, sketch).
3. *Groups and candidates*: in a shingle's bucket, sets with the same prefix and size form one group. Group pairs
   pass exact size and place filters and are expanded to members, whose sketches (parity of shingles over 1,024 bits: its differing
   bits never exceed the symmetric difference) must be near enough. In buckets over ``FULL`` sets only ``CENTRAL`` sets are first
   paired with the rest.
4. *Verification*: sets of candidates are recomputed from the texts (a bit table of a bounded size tells
   which), joined to the pairs and intersected.
5. *The rest of large buckets*: where verified links leave a bucket in several components, pairs across components
   are tried under the same filters, in tiles of ``TILE`` sets, and verified as well. So no link between different texts that
   could join two components is lost, and no bucket's pairs are all emitted.
6. *Components*: smallest doc_id by alternating large-star and small-star steps on the links, on disk.

Shingles are 64-bit hashes of words' 64-bit hashes; copies of a set are found by a 64-bit set hash.

Defined results: null, empty and blank texts have an empty set and link with nothing; texts below five words are
one shingle; repeated rows with one doc_id share their component if their texts link; rows with a null doc_id keep a row and a null
component if alone, else the smallest doc_id linked; an empty table gives no rows; other columns are ignored by linked().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import shingling
from sluice.llm.util import Scratch, blocks_of, mix, parts, saved, text_bytes

WORDS = 5
PERCENT = 80
#: Sets up to which a bucket's pairs are all tried at once, and central sets tried in larger ones.
FULL = 16
CENTRAL = 2
#: Shingles and sets that a map task packs before it sends them.
FLUSH_SHINGLES = 1_000_000
FLUSH_SETS = 1 << 16
#: Most bits of the table that tells candidates from other sets: 32 MB.
TABLE_BITS = 1 << 28
SKETCH_BYTES = 128
TILE = 1024
_MEMBER = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("row", "<i8"), ("n", "<u4"), ("sid", "<u8")])
_SET = np.dtype([("sid", "<u8"), ("n", "<u4"), ("sketch", "u1", SKETCH_BYTES)])
_SHARED = np.dtype([("token", "<u8"), ("df", "<u4"), ("at", "<u2")])
_ENTRY = np.dtype([("token", "<u8"), ("sid", "<u8"), ("group", "<u8"), ("n", "<u4"), ("at", "<u4"), ("sketch", "u1", SKETCH_BYTES)])


def set_id(s: np.ndarray) -> int:
    """Hash of a set: of its sorted bytes."""
    return xxhash.xxh3_64_intdigest(s.tobytes(), 7)


def _sketch(s: np.ndarray) -> np.ndarray:
    """Parity of shingles over 1,024 bits."""
    return np.packbits((np.bincount((s >> np.uint64(54)).astype(np.int64), minlength=8 * SKETCH_BYTES) & 1).astype(np.uint8))


def _prefix_size(n: np.ndarray) -> np.ndarray:
    """Shingles of which linked sets share one at least."""
    return n - -(-n * PERCENT // 100) + 1


def _size_ok(n, m):
    """Whether sizes n <= m or m <= n can give the similarity."""
    return 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)


def _overlap_needed(n, m):
    """Least intersection of linked sets of sizes n and m: ceil(p (n + m) / (100 + p))."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def _place_ok(n, i, m, j):
    """A pair's first shared shingle has at most this overlap; later ones may fail, the first one's bucket emits it."""
    return 1 + np.minimum(n - i - 1, m - j - 1) >= _overlap_needed(n, m)


def _near(x: np.ndarray, y: np.ndarray, n, m):
    """|x ^ y| of linked sets is at most (100 - p) / (100 + p) of n + m; sketches differ in no more bits."""
    differ = np.bitwise_count(x.view("<u8") ^ y.view("<u8")).sum(axis=-1).astype(np.int64)
    return differ * (100 + PERCENT) <= (100 - PERCENT) * (n + m)


# 1. frequencies

#: Rows of the two block shuffles: the partition a row goes to, the flush it is of, what it holds.
_PACKED = pa.schema([("block", pa.int32()), ("flush", pa.int64()), ("kind", pa.string()), ("payload", pa.binary()), ("places", pa.binary())])
_PACKED_SQL = "block int, flush long, kind string, payload binary, places binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PACKED, strict=True)], schema=_PACKED)


def _home(flush: int, n_blocks: int) -> int:
    return xxhash.xxh64_intdigest(flush.to_bytes(8, "little")) % n_blocks


def _sent(batches, n_blocks: int):
    """Shingles of distinct sets by block (kind shingles), and the flush's rows (members) and sets (sets)."""
    task = TaskContext.get()
    flush = (task.partitionId() if task else 0) << 32
    members, sets, tokens, size, seen = [], [], [], 0, {}

    def flushed():
        home = _home(flush, n_blocks)
        if members:
            yield _batch([(home, flush, "members", b"".join(members), None)])
        if not tokens:
            return
        yield _batch([(home, flush, "sets", b"".join(x.tobytes() for x in sets), None)])
        every = np.concatenate(tokens)
        places = np.repeat(np.arange(len(tokens), dtype="<u2"), [len(x) for x in tokens])
        rows, held = [], 0
        for b, i in blocks_of(every, n_blocks):
            # the hash range and 48 bits tell shingles apart
            rows.append((b, flush, "shingles", every[i].view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), places[i].tobytes()))
            held += len(i)
            if held > 500_000:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    for batch in batches:
        ids = batch.column("doc_id")
        known = np.asarray(ids.is_valid().to_numpy(zero_copy_only=False))
        numbers = ids.fill_null(0).to_numpy(zero_copy_only=False)
        row = batch.column("row").to_numpy(zero_copy_only=False)
        for a, b, data, offsets in shingling.slices(batch.column("text")):
            met = np.zeros(b - a, _MEMBER)
            met["doc_id"], met["known"], met["row"] = numbers[a:b], known[a:b], row[a:b]
            for k, s in enumerate(shingling.shingles(data, offsets, WORDS)):
                if not s.size:
                    continue
                sid = set_id(s)
                met["n"][k], met["sid"][k] = len(s), sid
                if sid in seen:
                    continue
                seen[sid] = None
                one = np.empty(1, _SET)
                one["sid"], one["n"], one["sketch"] = sid, len(s), _sketch(s)
                sets.append(one)
                tokens.append(s)
                size += len(s)
            members.append(met.tobytes())
            if size >= FLUSH_SHINGLES or len(tokens) >= FLUSH_SETS - 20_000 or len(members) > 2_000:
                yield from flushed()
                flush += 1
                members, sets, tokens, size = [], [], [], 0
                if len(seen) > 200_000:
                    seen.clear()
    yield from flushed()


def _counted(batches, n_blocks: int):
    """Shingles of two or more sets, with their document frequency, back to their flush."""
    at, tokens, places = [], [], []
    for batch in batches:
        for flush, kind, payload, where in zip(*(batch.column(c).to_pylist() for c in ("flush", "kind", "payload", "places")), strict=True):
            if kind != "shingles":
                yield _batch([(_home(flush, n_blocks), flush, kind, payload, None)])
                continue
            raw = np.zeros((len(payload) // 6, 8), np.uint8)
            raw[:, :6] = np.frombuffer(payload, np.uint8).reshape(-1, 6)
            at.append(flush)
            tokens.append(raw.view("<u8").ravel())
            places.append(np.frombuffer(where, "<u2"))
    if not tokens:
        return
    sizes = [len(x) for x in tokens]
    every = np.concatenate(tokens)
    tokens.clear()
    order = np.argsort(every)
    in_order = every[order]
    edges = np.flatnonzero(np.concatenate(([True], in_order[1:] != in_order[:-1], [True])))
    df = np.empty(len(every), "<u4")
    df[order] = np.repeat(np.diff(edges), np.diff(edges)).astype("<u4")
    del order, in_order
    salt = np.uint64(TaskContext.get().partitionId() if TaskContext.get() else 0) << np.uint64(48)  # 48 bits are told apart by the range
    start = 0
    for flush, size, where in zip(at, sizes, places, strict=True):
        shared = np.flatnonzero(df[start : start + size] > 1)
        if shared.size:
            out = np.empty(len(shared), _SHARED)
            out["token"], out["df"], out["at"] = every[start + shared] | salt, df[start + shared], where[shared]
            yield _batch([(_home(flush, n_blocks), flush, "shared", out.tobytes(), None)])
        start += size


# 2. prefixes


def _prefixes(batches, n_blocks: int):
    """Rows of documents (doc_id, n, sid) and prefix entries of sets that may link, by block."""
    held: dict[int, dict[str, list[bytes]]] = {}
    for batch in batches:
        for flush, kind, payload in zip(*(batch.column(c).to_pylist() for c in ("flush", "kind", "payload")), strict=True):
            held.setdefault(flush, {}).setdefault(kind, []).append(payload)
    while held:
        got = held.popitem()[1]
        for payload in got.get("members", []):
            m = np.frombuffer(payload, _MEMBER)
            none = pa.nulls(len(m), pa.int32()), pa.nulls(len(m), pa.binary())
            n = m["n"].astype(np.int64)
            yield pa.RecordBatch.from_arrays([*none, pa.array(m["doc_id"].astype(np.int64), mask=m["known"] == 0), pa.array(m["row"].astype(np.int64)), pa.array(n), pa.array(m["sid"].astype(np.uint64).view(np.int64), mask=n == 0)], schema=_OUT)
        if "shared" not in got:
            continue
        sets = np.concatenate([np.frombuffer(x, _SET) for x in got["sets"]])
        e = np.concatenate([np.frombuffer(x, _SHARED) for x in got["shared"]])
        e = e[np.lexsort((e["token"], e["df"], e["at"]))]
        at = e["at"].astype(np.int64)
        n = sets["n"].astype(np.int64)
        shared = np.bincount(at, minlength=len(sets))
        alone = n - shared  # unshared shingles, first in the order
        need = np.clip(_prefix_size(n) - alone, 0, shared)
        rank = np.arange(len(e)) - (np.cumsum(shared) - shared)[at]
        e, rank = e[rank < need[at]], rank[rank < need[at]]
        at = e["at"].astype(np.int64)
        out = np.empty(len(e), _ENTRY)
        out["token"], out["sid"], out["n"], out["at"], out["sketch"] = e["token"], sets["sid"][at], n[at], alone[at] + rank, sets["sketch"][at]
        # sets with unshared shingles are groups of their own
        same = np.zeros(len(sets), np.uint64)
        np.add.at(same, at, mix(e["token"] + np.uint64(1)))
        group = np.where(alone == 0, mix(same + n.astype(np.uint64)), sets["sid"])
        out["group"] = group[at]
        for b, i in blocks_of(mix(out["token"]), n_blocks):
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([out[i].tobytes()], pa.binary()), *(pa.nulls(1, pa.int64()) for _ in range(4))], schema=_OUT)


_OUT = pa.schema([("block", pa.int32()), ("payload", pa.binary()), ("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("sid", pa.int64())])
_OUT_SQL = "block int, payload binary, doc_id long, row long, n long, sid long"


# 3. candidates

_FOUND = pa.schema([("token", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("at", pa.int64()), ("grp", pa.int64()), ("sketch", pa.binary())])
_FOUND_SQL = "token long, a long, b long, n long, at long, grp long, sketch binary"


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).astype(np.uint64).view(np.int64))


def _pair_rows(pairs: list[np.ndarray]):
    """Distinct pairs of set ids as rows, the smaller number first."""
    if not pairs:
        return
    both = np.unique(np.concatenate(pairs))
    for k in range(0, len(both), 100_000):
        part = both[k : k + 100_000]
        none = pa.nulls(len(part), pa.int64())
        yield pa.RecordBatch.from_arrays([none, _long(part["a"]), _long(part["b"]), none, none, none, pa.nulls(len(part), pa.binary())], schema=_FOUND)


def _as_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), np.dtype([("a", "<u8"), ("b", "<u8")]))
    out["a"], out["b"] = np.minimum(a, b), np.maximum(a, b)
    return out


def _passing(e: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Pairs of entries of a bucket that pass the filters: of their groups (size, place), then of the members (sketch)."""
    n, m = e["n"][left].astype(np.int64), e["n"][right].astype(np.int64)
    ok = e["group"][left] == e["group"][right]
    ok |= _size_ok(n, m) & _place_ok(n, e["at"][left].astype(np.int64), m, e["at"][right].astype(np.int64))
    left, right, n, m = left[ok], right[ok], n[ok], m[ok]
    ok = _near(e["sketch"][left], e["sketch"][right], n, m)
    return _as_pairs(e["sid"][left[ok]], e["sid"][right[ok]])


def _candidates(batches):
    """Pairs of set ids, and the entries of buckets that are not fully paired."""
    got = [np.frombuffer(x, _ENTRY) for batch in batches for x in batch.column("payload").to_pylist()]
    if not got:
        return
    e = np.concatenate(got)
    got.clear()
    order = np.lexsort((e["sid"], e["group"], e["token"]))
    token, sid = e["token"][order], e["sid"][order]
    fresh = np.ones(len(e), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])
    e = e[order[fresh]]
    edges = np.flatnonzero(np.concatenate(([True], e["token"][1:] != e["token"][:-1], [True])))
    size = np.repeat(np.diff(edges), np.diff(edges))
    pairs = []
    small = e[size <= FULL]
    for d in range(1, FULL):  # neighbours at distance d in small buckets
        left = np.flatnonzero(small["token"][d:] == small["token"][:-d]) if len(small) > d else np.empty(0, np.int64)
        if not left.size:
            break
        for k in range(0, len(left), 200_000):
            pairs.append(_passing(small, left[k : k + 200_000], left[k : k + 200_000] + d))
        pairs = [np.unique(np.concatenate(pairs))]
    wide = np.diff(edges) > FULL
    for a, b in zip(edges[:-1][wide].tolist(), edges[1:][wide].tolist(), strict=True):
        bucket = e[a:b]
        m = len(bucket)
        for c in np.argsort(bucket["at"], kind="stable")[:CENTRAL].tolist():
            for k in range(0, m, 200_000):
                other = np.arange(k, min(m, k + 200_000))
                other = other[other != c]
                pairs.append(_passing(bucket, np.full(len(other), c), other))
        for k in range(0, m, 20_000):
            x = bucket[k : k + 20_000]
            sketch = pa.array([bytes(v) for v in x["sketch"]], pa.binary())
            yield pa.RecordBatch.from_arrays([_long(x["token"]), _long(x["sid"]), pa.nulls(len(x), pa.int64()), _long(x["n"]), _long(x["at"]), _long(x["group"]), sketch], schema=_FOUND)
        if len(pairs) > 1000:
            pairs = [np.unique(np.concatenate(pairs))]
    yield from _pair_rows(pairs)


# 4. verification


def _bit_table(ids: DataFrame, column: str) -> tuple[bytes, int]:
    """A table with one bit set for each of distinct ids, and its size: 32 bits an id, at most TABLE_BITS. False positives only cost work."""
    bits_of = 1 << 16
    while bits_of < min(TABLE_BITS, 32 * ids.count()):
        bits_of *= 2
    pieces = 16
    width = bits_of // pieces
    places = ids.select(F.pmod(F.xxhash64(column), F.lit(bits_of)).alias("p"))

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            p = batch.column("p").to_numpy(zero_copy_only=False)
            for k in np.unique(p // width).tolist():
                bits = held.setdefault(k, np.zeros(width // 8, np.uint8))
                q = p[p // width == k] - k * width
                np.bitwise_or.at(bits, q >> 3, (1 << (q & 7)).astype(np.uint8))
        for k, bits in held.items():
            yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})

    dealt = places.repartition(pieces, F.floor(F.col("p") / width))
    out = bytearray(bits_of // 8)
    for r in dealt.mapInArrow(run, "k int, bits binary").toLocalIterator():
        out[r.k * width // 8 : (r.k + 1) * width // 8] = r.bits
    return bytes(out), bits_of


def sets_of(source: DataFrame, ids: DataFrame) -> DataFrame:
    """(sid, s: sorted shingles as bytes) of documents whose set is among ids (or, rarely, is not)."""
    table = source.sparkSession.sparkContext.broadcast(_bit_table(ids, "sid"))

    def run(batches):
        seen: set[int] = set()
        bits, bits_of = table.value
        for batch in batches:
            for _, _, data, offsets in shingling.slices(batch.column("text")):
                sids, found = [], []
                for s in shingling.shingles(data, offsets, WORDS):
                    if not s.size:
                        continue
                    raw = s.tobytes()
                    sid = _signed(xxhash.xxh3_64_intdigest(raw, 7))
                    p = _spark_xxhash64(sid) % bits_of
                    if not bits[p >> 3] >> (p & 7) & 1 or sid in seen:
                        continue
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(sid)
                    sids.append(sid)
                    found.append(raw)
                if sids:
                    yield pa.RecordBatch.from_pydict({"sid": pa.array(sids, pa.int64()), "s": pa.array(found, pa.binary())})

    return source.select("text").mapInArrow(run, "sid long, s binary").dropDuplicates(["sid"])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _spark_xxhash64(value: int) -> int:
    """Spark's xxhash64 of one long: the public XXH64 with seed 42 over 8 bytes."""
    return _signed(xxhash.xxh64_intdigest((value & (1 << 64) - 1).to_bytes(8, "little"), 42))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that link."""
    a = sets.select(F.col("sid").alias("a"), F.col("s").alias("sa"))
    b = sets.select(F.col("sid").alias("b"), F.col("s").alias("sb"))

    def run(batches):
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)):
                p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * both >= PERCENT * (len(p) + len(q) - both):
                    keep.append(k)
            if keep:
                yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


# 5. the rest of large buckets


def _across(scratch: Scratch, rest: DataFrame, component: DataFrame) -> DataFrame:
    """Pairs across components within unfinished buckets that pass the filters."""
    entries = scratch.saved(rest.join(component, "sid", "left").withColumn("c", F.coalesce("c", F.col("sid"))), "rest")
    open_ = entries.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("least"), F.max("c").alias("most")).where("least < most")
    # entries of a token are salted, and the token's row repeated for each salt, so no bucket meets in one task
    salts = 16
    open_ = open_.select("token", F.ceil(F.col("m") / TILE).alias("tiles"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    marked = entries.withColumn("salt", F.pmod(F.xxhash64("sid", F.lit(1)), F.lit(salts))).join(open_, ["token", "salt"])
    # each entry goes to the tiles of its row: (own, k) and (k, own)
    own = F.pmod(F.xxhash64("sid"), F.col("tiles"))
    tiles = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda k: F.struct(F.least(own, k).alias("x"), F.greatest(own, k).alias("y")))
    spread = marked.select("token", "sid", "c", "n", "at", "grp", "sketch", F.explode(tiles).alias("t"), own.alias("own"))

    def tile(table: pa.Table) -> pa.Table:
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        e = np.empty(len(table), _ENTRY)
        for name, column in (("sid", "sid"), ("group", "grp"), ("n", "n"), ("at", "at")):
            e[name] = table.column(column).to_numpy().astype(np.int64).view(np.uint64)
        e["sketch"] = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH_BYTES)
        c, mine = table.column("c").to_numpy(), table.column("own").to_numpy()
        out = [np.empty(0, np.dtype([("a", "<u8"), ("b", "<u8")]))]
        cols = np.flatnonzero(mine == y)
        for i in np.flatnonzero(mine == x).tolist():
            j = cols[c[cols] != c[i]]
            j = j[j > i] if x == y else j
            if j.size:
                out.append(_passing(e, np.full(len(j), i), j))
        got = np.concatenate(out)
        return pa.table({"a": _long(got["a"]), "b": _long(got["b"])})

    return spread.select("token", "t.x", "t.y", "sid", "c", "own", "n", "at", "grp", "sketch").groupBy("token", "x", "y").applyInArrow(tile, "a long, b long").distinct()


# 6. components


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, c): the smallest node reachable, for nodes of edges (a, b). Alternating stars; each step's edges are on disk."""
    held = Scratch(scratch.spark)
    e = held.saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    rows = e.count()
    for _ in range(60):
        if not rows:
            break
        # large star: neighbours above a node link to the least node around it
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: neighbours below a node, and the node, link to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("x"), "m").where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()
        after = Scratch(scratch.spark)
        new = after.saved(small, "edges")
        rows_before, rows = rows, new.count()
        # both hold distinct rows: the same if as many, and none is new
        same = rows == rows_before and new.join(e, ["u", "v"], "left_anti").isEmpty()
        held.__exit__()
        held, e = after, new
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    out = scratch.saved(e.select(F.col("u").alias("node"), F.col("v").alias("c")).union(e.select(F.col("v").alias("node"), F.col("v").alias("c")).distinct()), "components")
    held.__exit__()
    return out


def linked(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of docs, from a table written for the caller.

    With ``row``, the name of a column of longs that tells rows apart, also that column and first_row: the row of the component
    that has its smallest doc_id (nulls last), then the smallest number; null without words.
    """
    spark = docs.sparkSession
    source = text_bytes(docs.withColumn("row", F.col(row) if row else F.lit(0).cast("long")), "doc_id", "text", "row")
    n_blocks = parts(spark)
    with Scratch(spark) as scratch:
        sent = source.mapInArrow(lambda it: _sent(it, n_blocks), _PACKED_SQL).repartitionById(n_blocks, "block")
        counted = sent.mapInArrow(lambda it: _counted(it, n_blocks), _PACKED_SQL).repartitionById(n_blocks, "block")
        rows = scratch.saved(counted.mapInArrow(lambda it: _prefixes(it, n_blocks), _OUT_SQL), "prefixes")
        found = rows.where("block is not null").select("block", "payload").repartitionById(n_blocks, "block").mapInArrow(_candidates, _FOUND_SQL)
        found = scratch.saved(found, "candidates")
        pairs = scratch.saved(found.where("b is not null").select("a", "b").distinct(), "pairs")
        rest = found.where("b is null").select("token", F.col("a").alias("sid"), "n", "at", "grp", "sketch")
        ids = pairs.select(F.explode(F.array("a", "b")).alias("sid")).union(rest.select("sid"))
        sets = scratch.saved(sets_of(source, scratch.saved(ids.distinct(), "ids")), "sets")
        links = scratch.saved(verified(pairs, sets), "links")
        component = components(scratch, links)
        if not rest.isEmpty():
            more = scratch.saved(_across(scratch, rest, component.withColumnRenamed("node", "sid")), "across")
            links = links.union(scratch.saved(verified(more, sets), "links"))
            component = components(scratch, links)
        members = rows.where("block is null").select("doc_id", "row", "n", "sid")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "row"))
        named = members.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"), first.alias("first"))
        # smallest doc_id of each component, by set id
        of = named.join(component.withColumnRenamed("node", "sid"), "sid", "left").withColumn("c", F.coalesce("c", F.col("sid")))
        best = of.groupBy("c").agg(F.min("least").alias("component_id"), F.min("first").alias("first"))
        by_sid = scratch.saved(of.select("sid", "c").join(best, "c").select("sid", "component_id", F.col("first.row").alias("first_row")), "by_sid")
        full = members.where("n > 0").join(by_sid, "sid", "left").select("doc_id", "n", "component_id", "row", "first_row")
        empty = members.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), "row", F.lit(None).cast("long").alias("first_row"))
        out = full.union(empty).withColumnRenamed("n", "n_shingles")
        return saved(out.withColumnRenamed("row", row) if row else out.drop("row", "first_row"), "linked")
