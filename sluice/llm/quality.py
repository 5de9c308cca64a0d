"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base rules reject documents outright. Beyond them, documents are rejected by cutoffs on three scores
(``SCORES``), chosen per stratum (language) on labelled documents: a cutoff is *valid* if the share of good
documents it would reject is at most ``alpha`` with confidence 1 - ``delta``, by the exact binomial tail.
All strata, scores and candidate cutoffs are tested together, each at delta / (number of tests) (Bonferroni),
so all chosen cutoffs hold at once with probability 1 - delta. Of a score's valid cutoffs the lowest is
found, then relaxed to the highest that rejects as many labelled bad documents, so that clean documents
keep their distance. ``alpha`` is shared out over the scores. A stratum with too few labels gets no cutoff.

Candidates are the fixed grids ``GRID``, chosen without looking at any label, so all labelled documents are the holdout: each
document counts once in each test, and the number of tests is that of the full grid over all strata with labels.

Defined results: null or empty text has no words and fails the base rule; a null language is a stratum;
documents without a label only receive cutoffs; repeated labels, and repeated rows of one document, count once (a document
labelled both good and bad once as each); without labels, or with an empty table, only the base rules reject; other columns
are kept by measures() if named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.util import SPACE, native_words, saved

ALPHA = 0.03
DELTA = 0.05
#: Candidate cutoffs; a document is rejected if its score is above the cutoff.
GRID = {
    "symbol_share": (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.75, 1.0),
    "dup_line_share": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.7),
    "repeat_share": (0.05, 0.1, 0.15, 0.2, 0.3, 0.4),
}
SCORES = tuple(GRID)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_FOUND = "struct<h:bigint,i:int>"


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, kept columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; no shuffle.

    Three-word windows are 64-bit hashes. Documents whose windows are all different, which a hash set
    shows, need no more; for others windows are sorted with their places within the row.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", *keep, text.alias("_t"), native_words(text).alias("_w"))
    bare = F.translate("_t", " \t\n\x0b\f\r", "")
    # lines with a word, trimmed of nothing: equal lines are equal texts
    lines = F.filter(F.split("_t", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    n = F.size("_w")
    counted = base.select(
        "doc_id",
        *keep,
        "_w",
        n.cast("long").alias("n_words"),
        F.char_length(bare).cast("long").alias("word_chars"),
        (F.char_length("_t") - F.char_length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("_l"),
        F.when(
            n >= 3,
            F.zip_with(
                F.zip_with(F.slice("_w", F.lit(1), n - 2), F.slice("_w", F.lit(2), n - 2), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
                F.slice("_w", F.lit(3), n - 2),
                lambda ab, c: F.xxhash64(ab["a"], ab["b"], c),
            ),
        ).otherwise(F.array().cast("array<bigint>")).alias("_h"),
    )
    counted = counted.withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long")).drop("_l", "_w")
    repeats = F.size("_h") != F.size(F.array_distinct("_h"))
    placed = F.when(repeats, F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.lit(None))
    counted = counted.withColumn("_s", placed).drop("_h")
    # a window equals the one before or behind it in sorted order: positions of repeated windows
    m = F.size("_s")
    none = F.array(F.lit(None).cast(_FOUND))
    before = F.concat(none, F.slice("_s", F.lit(1), m - 1))
    behind = F.concat(F.slice("_s", F.lit(2), m - 1), none)
    near = F.zip_with(before, behind, lambda a, b: F.struct(a["h"].alias("a"), b["h"].alias("b")))
    at = F.filter(
        F.zip_with("_s", near, lambda x, y: F.when((x["h"] == y["a"]) | (x["h"] == y["b"]), x["i"])), lambda i: i.isNotNull()
    )
    counted = counted.withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(at))).drop("_s")
    # words covered: three for the last window, else at most three until the next one
    k = F.size("_p")
    covered = F.aggregate(
        F.zip_with(F.slice("_p", F.lit(1), k - 1), F.slice("_p", F.lit(2), k - 1), lambda a, b: F.least(b - a, F.lit(3))), F.lit(3), lambda s, x: s + x
    )
    return counted.withColumn("n_repeat_words", F.when(F.coalesce(k, F.lit(0)) > 0, covered).otherwise(0).cast("long")).drop("_p")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def scores() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbol_share": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") * 10 / words,
        "repeat_share": F.col("n_repeat_words") / words,
    }


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed from its terms' ratios. k and n are longs, k >= 0, n >= 0.

    In logarithms: terms start at n ln(1 - p) and each adds ln((n - i + 1) / i * p / (1 - p)). Sums stop at
    k, which for any cutoff that can be valid is at most about p n; beyond that the tail exceeds one half.
    """
    start = n.cast("double") * F.lit(_ln(1 - p))
    odds = p / (1 - p)
    zero = F.struct(start.alias("ln"), start.alias("sum"))

    def add(s: Column, i: Column) -> Column:
        ln = s["ln"] + F.log((n - i + 1).cast("double") / i * F.lit(odds))
        top = F.greatest(s["sum"], ln)
        total = top + F.log(F.exp(s["sum"] - top) + F.exp(ln - top))
        return F.struct(ln.alias("ln"), total.alias("sum"))

    terms = F.when((k > 0) & (k.cast("double") <= n.cast("double") * p), F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    summed = F.exp(F.aggregate(terms, zero, add, lambda s: s["sum"]))
    return F.when(k.cast("double") > n.cast("double") * p, F.lit(1.0)).otherwise(summed)


def _ln(x: float) -> float:
    import math

    return math.log(x)


def cutoffs(measured: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, score, cutoff) chosen on labelled documents that pass the base rules; see the module."""
    known = labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").distinct()
    one = measured.where(~base_failed()).select("doc_id", stratum, "n_words", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = one.join(known, "doc_id").distinct()
    grid = F.array(*[F.struct(F.lit(s).alias("score"), F.lit(float(c)).alias("cutoff"), (scores()[s] > F.lit(float(c))).alias("over")) for s in SCORES for c in GRID[s]])
    cells = saved(got.select(F.col(stratum).alias("stratum"), "quality", F.explode(grid).alias("g")).groupBy("stratum", "g.score", "g.cutoff").agg(
        F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("n_good"),
        F.sum(F.when((F.col("quality") == 1) & F.col("g.over"), 1).otherwise(0)).alias("good_over"),
        F.sum(F.when((F.col("quality") == 0) & F.col("g.over"), 1).otherwise(0)).alias("bad_over"),
    ), "cells")
    tests = max(1, cells.count())  # each stratum has a cell for each cutoff of the grid
    each = alpha / len(SCORES)
    tail = binomial_tail(F.col("good_over"), F.col("n_good"), each)
    valid = cells.withColumn("tail", tail).where((F.col("tail") <= delta / tests) & (F.col("bad_over") > 0))
    best = valid.groupBy("stratum", "score").agg(F.max(F.struct("bad_over", "cutoff")).alias("b"))
    return best.select("stratum", "score", F.col("b.cutoff").alias("cutoff"))


def verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Measures, base_failed, kept, and the score that rejected (null if none)."""
    measured = saved(measures(docs, stratum), "measures")
    return decided(measured, cutoffs(measured, labels, stratum, alpha, delta), stratum)


def decided(measured: DataFrame, chosen: DataFrame, stratum: str) -> DataFrame:
    by = saved(chosen.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("score", "cutoff"))).alias("cutoffs")), "cutoffs")
    out = measured.join(by, measured[stratum].eqNullSafe(by["stratum"]), "left").drop("stratum")
    rejecting = F.array_compact(F.array(*[F.when(v > F.try_element_at("cutoffs", F.lit(s)), F.lit(s)) for s, v in scores().items()]))
    out = out.withColumn("base_failed", base_failed()).withColumn("rejected_by", F.get(rejecting, F.lit(0)))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull()).drop("cutoffs")
