"""Line dedup by hashes of least passages, in DataFrame functions only.

Texts are cut into lines: at line feeds and behind a sentence end before a space, so that a passage inside a
physical line is met too. Each line has a 64-bit hash and a word count. From each line on, and up to each line, the
shortest run of lines with ``min_words`` words is a window, and its lines' hashes make one hash.

Equal runs of at least ``min_words`` words are made of equal windows, and each of their lines lies in one. So a line is
deleted if a window it lies in stood before, at any earlier place: in an earlier row (by doc_id) or further up in the
row. The first occurrence of a passage always stays, whatever other places hold single lines of it.

Defined results: null and empty text has no lines and stays as it is; lines without words are never deleted nor
counted, and end no run if equal; repeated rows with one doc_id are told apart by the hash of their text, and of equal rows
all stay (one document is not its own copy); documents with a null doc_id come first; an empty table gives no rows;
other columns are kept by deduped().
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.util import SPACE, Scratch, saved

MIN_WORDS = 30
#: Where lines end. The break itself stays with the line before it.
BREAK = r"(?<=[\n ])(?:(?<=\n)|(?<=[.!?] ))"
#: The same places, with the break taken out of the line.
BREAK_OUT = r"[\n ](?:(?<=\n)|(?<=[.!?] ))"
#: Texts without these have only single spaces and line feeds between words.
UNEVEN = ("\t", "\x0b", "\f", "\r", "  ")
#: Distances of the passes that add up words before lines: as many as the longest array needs.
STEPS = [1 << k for k in range(31)]


def lines(text: Column) -> Column:
    return F.split(text, BREAK)


def _row() -> Column:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("th"))


def _hashed(docs: DataFrame, min_words: int) -> DataFrame:
    """row, windows: hash w, first line s and line e behind the last."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = F.split(text, BREAK_OUT)
    uneven = lambda x: F.struct(F.xxhash64(F.btrim(x, F.lit(" \t\n\x0b\f\r"))).alias("h"), F.regexp_count(x, F.lit(f"[^{SPACE}]+")).alias("n"))
    # hash and count of an even text's line are the same, without a pattern for each line
    spaces = lambda x: F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))
    even = lambda x: F.struct(F.xxhash64(x).alias("h"), F.when(x == "", 0).otherwise(spaces(x) + 1).alias("n"))
    is_uneven = reduce(or_, (text.contains(F.lit(x)) for x in UNEVEN))
    df = docs.select(_row().alias("row"), F.when(is_uneven, F.transform(bare, uneven)).otherwise(F.transform(F.transform(bare, lambda x: F.trim(x)), even)).alias("ls"))
    # _l: each word's line; _b: words before each line and, last, all. The work goes by lines, not by words: sums are made in
    # passes of doubled distances, as many as the lines need. Columns that lambdas look into are used twice in each step, or
    # Spark would compute them again for each element
    counts = F.transform("ls", lambda x: F.least(x["n"], F.lit(min_words)))
    further = lambda c, d: F.when(F.size(c) > d, F.zip_with(c, F.concat(F.array_repeat(F.lit(0), d), F.slice(c, 1, F.size(c) - d)), lambda x, y: x + y)).otherwise(c)
    sums = F.aggregate(F.array(*[F.lit(d) for d in STEPS]), counts, further)
    words = F.flatten(F.transform("ls", lambda x, i: F.array_repeat(i, F.least(x["n"], F.lit(min_words)))))
    gaps = F.exists("ls", lambda x: x["n"] == 0)
    df = df.select("row", F.transform("ls", lambda x: x["h"]).alias("_h"), words.alias("_l"), F.concat(F.array(F.lit(0)), sums).alias("_b"), gaps.alias("_g"))
    total = F.size("_l")
    run = lambda s, e: F.struct(F.xxhash64(F.slice("_h", s + 1, e - s)).alias("w"), s.alias("s"), e.alias("e"))
    kept = lambda *xs: F.filter(F.concat(*xs), lambda x: x.isNotNull())
    # rows whose lines all have words: the first lines, up to the one with the last place where a window fits, begin one each, and
    # the last ones, from the one with the min_words-th word, end one each
    ends = F.transform(F.slice("_b", 1, F.get("_l", total - min_words) + 1), lambda b: F.get("_l", b + (min_words - 1)) + 1)
    starts = F.transform(F.slice("_b", F.get("_l", F.lit(min_words - 1)) + 2, F.size("_b")), lambda b: F.get("_l", b - min_words))
    # other rows: for each line, null without words or without a window
    filled = lambda i: F.get("_b", i) < F.get("_b", i + 1)
    on = lambda i: F.get("_l", F.get("_b", i) + (min_words - 1)) + 1
    back = lambda i: F.get("_l", F.get("_b", i + 1) - min_words)
    fore = F.transform("_h", lambda _, i: F.when(filled(i) & (F.get("_b", i) + min_words <= total), run(i, on(i))))
    hind = F.transform("_h", lambda _, i: F.when(filled(i) & (F.get("_b", i + 1) >= min_words), run(back(i), i + 1)))
    full, some = ~F.col("_g") & (total >= min_words), F.col("_g")
    df = df.select("row", "_h", "_l", "_b", "_g", F.when(full, ends).alias("_e"), F.when(full, starts).alias("_s"), F.when(some, fore).alias("_f"), F.when(some, hind).alias("_r"))
    first = F.zip_with(F.sequence(F.lit(0), F.size("_e") - 1), "_e", run)
    last = F.zip_with("_s", F.sequence(F.size("_h") - F.size("_s") + 1, F.size("_h")), lambda s, e: F.when(F.get("_e", s) == e, None).otherwise(run(s, e)))
    # lines without words lengthen the window beside them
    f = F.transform("_f", lambda x, i: F.when(x.isNotNull(), x).when(F.get("_b", i) + min_words <= total, _longer(F.get("_f", F.get("_l", F.get("_b", i))), i, None)))
    r = F.transform("_r", lambda x, i: F.when(x.isNotNull() & (F.get("_f", x["s"])["e"] == x["e"]), None).when(x.isNotNull(), x).when(F.get("_b", i + 1) >= min_words, _longer(F.get("_r", F.get("_l", F.get("_b", i + 1) - 1)), None, i + 1)))
    return df.select("row", F.when(F.col("_e").isNotNull(), kept(first, last)).when(some, kept(f, r)).otherwise(F.array()).alias("windows"))


def _longer(x: Column, s: Column | None, e: Column | None) -> Column:
    """Window x from line s on or up to line e, the lines more being without words."""
    more = s - x["s"] if s is not None else e - x["e"]
    return F.when(more == 0, None).otherwise(F.struct(F.xxhash64(x["w"], more).alias("w"), (x["s"] if s is None else s).alias("s"), (x["e"] if e is None else e).alias("e")))


def ranges(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """row and the line ranges to delete, for rows that have any, as a written table; ranges of a row do not meet."""
    with Scratch(docs.sparkSession) as scratch:
        return saved(_ranges(scratch.saved(_hashed(docs, min_words), "windows")), "ranges")


def _ranges(windows: DataFrame) -> DataFrame:
    marks = windows.select("row", F.explode("windows").alias("m")).select("row", "m.w", "m.s", "m.e")
    first = marks.groupBy("w").agg(F.min(F.struct("row", "s")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("w", "first")
    later = marks.join(first, "w").where(F.struct("row", "s") > F.col("first"))
    got = later.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("rs"))
    r = "struct<s:int,e:int>"
    none = F.struct(F.array().cast(f"array<{r}>").alias("done"), F.lit(-1).alias("s"), F.lit(-1).alias("e"))
    last = lambda t: F.struct(t["s"].alias("s"), t["e"].alias("e"))
    step = lambda t, x: F.when(x["s"] <= t["e"], F.struct(t["done"].alias("done"), t["s"].alias("s"), F.greatest(t["e"], x["e"]).alias("e"))).otherwise(F.struct(F.concat(t["done"], F.array(last(t))).alias("done"), x["s"].alias("s"), x["e"].alias("e")))
    met = F.aggregate("rs", none, step, lambda t: F.filter(F.concat(t["done"], F.array(last(t))), lambda x: x["s"] >= 0))
    return got.select("row", met.alias("ranges"))


def deduped(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Columns of docs with text cut, and n_lines, n_deleted."""
    cut = ranges(docs, min_words)
    columns = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    # the columns of docs go as one struct, whatever their names
    keyed = docs.select(F.struct(*columns).alias("doc"), _row().alias("row"))
    both = keyed.join(cut.hint("shuffle_hash"), "row", "left")
    text = F.coalesce(F.col("doc.text").cast("string"), F.lit(""))
    cut_rows = F.col("ranges").isNotNull()
    both = both.withColumn("ls", F.when(cut_rows, lines(text)))
    both = both.withColumn("ks", F.filter("ls", lambda x, i: ~F.exists("ranges", lambda r: (r["s"] <= i) & (i < r["e"]))))
    new = F.when(cut_rows, F.array_join("ks", "")).otherwise(F.col("doc.text"))
    # other rows need only their number of lines, which the cheaper pattern gives as well
    n_lines = F.when(cut_rows, F.size("ls")).otherwise(F.size(F.split(text, BREAK_OUT)))
    n_deleted = F.when(cut_rows, F.size("ls") - F.size("ks")).otherwise(0)
    return both.select(*[new.alias("text") if c == "text" else F.col("doc")[c].alias(c) for c in columns], n_lines.cast("long").alias("n_lines"), n_deleted.cast("long").alias("n_deleted"))
