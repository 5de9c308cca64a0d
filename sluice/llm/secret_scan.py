"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

Base patterns find spans as regular expressions do. The models add spans of kind ``model``: candidates are
runs of ``[A-Za-z0-9+/_=-]`` of at least ``MIN_CHARS`` characters with a digit or both letter cases that touch no
base span; one is reported if the log-likelihood ratio of the random over the ordinary first-order
character model is at least ``MIN_RATIO`` a character. Both models are trained from labelled samples over the whole
corpus: random ones are the values the base patterns found (each distinct value once) and ``SAMPLES`` strings made by
a rule (base64 of sha256 of numbers), ordinary ones are the
distinct identifier-like words of the corpus: whole tokens of letters, ``_`` and ``-`` that are no value of a base match. With add-one smoothing over the ``len(ALPHABET)``-letter alphabet the tables have a fixed size.
Only DataFrame functions run: matches come from one regular expression per kind, their places from the
lengths of what lies between them.

Defined results: null and empty texts have no spans; copies of a secret are found wherever they stand;
without ordinary identifiers the models add nothing; repeated rows keep their rows; an empty table gives
no rows; other columns don't matter. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.util import saved

#: Base patterns, and characters a match (assign: its group 2) must have.
PATTERNS = {
    "assign": ("(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6),
    "access": ("AKIA[A-Z0-9]{16,}", 20),
    "hex": ("[0-9a-f]{24,}", 24),
}
KINDS = tuple(PATTERNS)
MIN_CHARS = 20
MIN_RATIO = 0.1
SAMPLES = 2_000
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{MIN_CHARS},}}"
#: Whole tokens only: letters within a random string are no identifier.
ORDINARY = "(?<![A-Za-z0-9+/_=.-])[A-Za-z][A-Za-z_-]{7,}(?![A-Za-z0-9+/_=-])"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET)
_SPANS = "array<struct<start:int,end:int>>"


def spans(found: Column, gaps: Column) -> Column:
    """Spans of matches from the matches and what lies between them, by a running sum."""
    steps = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(F.char_length(g).alias("g"), F.char_length(m).alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))

    def add(s: Column, x: Column) -> Column:
        a = s["at"] + x["g"]
        b = a + x["m"]
        return F.struct(b.alias("at"), F.concat(s["spans"], F.array(F.struct(a.alias("start"), b.alias("end")))).alias("spans"))

    return F.aggregate(steps, start, add, lambda s: s["spans"])


def _named(no: int, kind: str):
    return lambda s, v: F.struct(s["start"].alias("start"), F.lit(no).alias("no"), F.lit(kind).alias("kind"), s["end"].alias("end"), v.alias("value"))


def _at_least(n: int):
    return lambda x: F.char_length(x["value"]) >= n


def scanned(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, base spans, their values, candidates and ordinary identifiers. No shuffle."""
    df = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    patterns = {k: p for k, (p, _) in PATTERNS.items()} | {"model": CANDIDATE}
    empty = F.array().cast("array<string>")
    df = df.select("*", *[F.regexp_extract_all("_t", F.lit(p), F.lit(0)).alias(f"_m_{k}") for k, p in patterns.items()])
    # values are extracted from the matches, not again from the text
    value = F.transform("_m_assign", lambda m: F.regexp_extract(m, PATTERNS["assign"][0], 2))
    ordinary = F.array_distinct(F.regexp_extract_all("_t", F.lit(ORDINARY), F.lit(0)))
    df = df.select(
        "doc_id",
        *[f"_m_{k}" for k in patterns],
        F.when(F.size("_m_assign") > 0, value).otherwise(empty).alias("_v_assign"),
        *[F.when(F.size(f"_m_{k}") > 0, spans(F.col(f"_m_{k}"), F.split("_t", p))).otherwise(F.array().cast(_SPANS)).alias(f"_s_{k}") for k, p in patterns.items()],
        ordinary.alias("ordinary"),
    )
    base = []
    for no, (kind, (_, least)) in enumerate(PATTERNS.items()):
        values = F.col(f"_v_{kind}") if kind == "assign" else F.col(f"_m_{kind}")
        base.append(
            F.filter(
                F.zip_with(f"_s_{kind}", values, _named(no, kind)),
                _at_least(least),
            )
        )
    candidates = F.filter(
        F.zip_with("_s_model", "_m_model", _named(len(KINDS), "model")),
        lambda x: x["value"].rlike("[0-9]") | (x["value"].rlike("[a-z]") & x["value"].rlike(".[A-Z]")),
    )
    df = df.select("doc_id", F.array_sort(F.concat(*base)).alias("base"), candidates.alias("candidates"), "ordinary")
    free = F.filter("candidates", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"])))
    return df.withColumns(
        {
            "candidates": F.when(F.size("candidates") > 0, free).otherwise(F.col("candidates")),
            "ordinary": F.when(F.size("base") > 0, F.array_except("ordinary", F.transform("base", lambda b: F.rtrim(b["value"], F.lit("."))))).otherwise(F.col("ordinary")),
        }
    )


def pair_counts(words: DataFrame) -> DataFrame:
    """Counts of adjacent character pairs (as numbers below SIZE squared) in the distinct words of column word."""
    # the distinct words are shared out; pairs are summed before the second shuffle, to at most SIZE squared rows a task
    place = lambda i: F.instr(F.lit(ALPHABET), F.substring("word", i, F.lit(1))) - 1
    pairs = F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: place(i) * SIZE + place(i + 1))
    out = words.where("char_length(word) >= 2").distinct().select(F.explode(pairs).alias("pair"))
    return out.where((F.col("pair") >= 0)).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def trained(scan: DataFrame) -> list[float] | None:
    """Log-likelihood ratios (random over ordinary) of all SIZE squared pairs; None without ordinary identifiers."""
    tables = []
    clean = f"^[{ALPHABET.replace('-', '')}-]+$"
    made = scan.sparkSession.range(SAMPLES).select(F.rtrim(F.base64(F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256))), F.lit("=")).alias("word"))
    for words in (
        scan.select(F.explode(F.transform("base", lambda b: b["value"])).alias("word")).where(F.col("word").rlike(clean)).union(made),
        scan.select(F.explode("ordinary").alias("word")),
    ):
        counts = [0] * (SIZE * SIZE)
        for r in pair_counts(words).toLocalIterator():  # at most SIZE squared rows
            counts[r.pair] = r.n
        tables.append(counts)
    if not any(tables[0]) or not any(tables[1]):
        return None
    import math

    out = []
    for a in range(SIZE):
        row = [t[a * SIZE : (a + 1) * SIZE] for t in tables]
        totals = [sum(r) + SIZE for r in row]
        out += [math.log((row[0][b] + 1) / totals[0]) - math.log((row[1][b] + 1) / totals[1]) for b in range(SIZE)]
    return out


def ratio(word: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio a pair."""
    values = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")
    place = lambda i: F.instr(F.lit(ALPHABET), F.substring(word, i, F.lit(1)))
    n = F.char_length(word) - 1
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda s, i: s + F.element_at(values, ((place(i) - 1) * SIZE + place(i + 1)).cast("int")))
    return total / n


def found(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans with values) and extra (model spans with values), one row per row of docs."""
    scan = saved(scanned(docs), "secrets")
    table = trained(scan)
    extra = F.filter("candidates", lambda c: ratio(c["value"], table) >= MIN_RATIO) if table else F.filter("candidates", lambda c: F.lit(False))
    return scan.select("doc_id", "base", extra.alias("extra"))


def listed(found_spans: Column) -> Column:
    """kind:start:end of spans in order, comma-joined."""
    return F.array_join(F.transform(F.array_sort(found_spans), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
