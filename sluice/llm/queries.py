"""Queries of the corpus operators over the standard tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import brown_lm, chat_format, decontaminate, html_extract, jaccard_join, line_dedup, mixing, quality, secret_scan, token_store
from sluice.llm.util import table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _is(value: str) -> Callable:
    return lambda x: x == value


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduped(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op4_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.scored(table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.rendered(table(spark, sf_dir, "conversations"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secret_scan.found(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda b: b["kind"])
    counts = [F.size(F.filter(kinds, _is(k))).cast("long").alias(f"n_{k}") for k in secret_scan.KINDS]
    return got.select(
        "doc_id",
        *counts,
        F.sha2(secret_scan.listed(F.col("base")), 256).alias("base_sha256"),
        secret_scan.listed(F.concat("base", "extra")).alias("spans"),
        F.size("extra").cast("long").alias("n_model"),
    )


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf_dir, "pages"), "page_id", "url")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_token_store": op2_token_store,
    "op3_source_mix": op3_source_mix,
    "op4_brown_lm": op4_brown_lm,
    "op5_chat_format": op5_chat_format,
    "op6_secret_scan": op6_secret_scan,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_decontaminate": op8_decontaminate,
    "op9_html_extract": op9_html_extract,
    "op10_quality_rules": op10_quality_rules,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The other queries hold models, tokens or a hash order, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op5_chat_format": """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, count(*) AS n_turns, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS xs FROM t GROUP BY conv_id),
f AS (SELECT xs, n_turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY xs, n_turns),
k AS (SELECT xs, unnest(range(1, n_turns)) AS n FROM f),
p AS (SELECT DISTINCT xs[1:n] AS xs FROM k)
SELECT conv_id, n_turns, n_copies,
       array_to_string(list_transform(xs, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || chr(10)), '') || '<|end|>' AS text
FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.xs = f.xs)""",
    "op7_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, len(w) AS n_words, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
g AS (SELECT doc_id, n_words, p, string_agg(word, ' ') OVER f AS g, count(*) OVER f AS m FROM x
      WINDOW f AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
s AS (SELECT DISTINCT doc_id, g FROM g WHERE m = 5 OR (p = 1 AND n_words < 5)),
n AS (SELECT doc_id, count(*) AS n, sha256(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY doc_id),
r AS (SELECT k, n, min(doc_id) AS rep FROM n GROUP BY k, n),
rs AS (SELECT r.rep, r.n, s.g FROM r JOIN s ON s.doc_id = r.rep),
both_ AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS c FROM rs a JOIN rs b ON a.g = b.g AND a.rep < b.rep
         WHERE 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY ALL),
l AS (SELECT a, b FROM both_ WHERE 100 * c >= 80 * (na + nb - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT rep AS a, rep AS b FROM r UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.k = n.k LEFT JOIN c ON c.a = r.rep""",
    "op8_decontaminate": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id, '') AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bx AS (SELECT item, least(13, len(w)) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM b),
bg AS (SELECT item, n, string_agg(word, ' ') OVER f AS g, count(*) OVER f AS m FROM bx
       WINDOW f AS (PARTITION BY item ORDER BY p ROWS BETWEEN CURRENT ROW AND n - 1 FOLLOWING)),
win AS (SELECT DISTINCT item, n, g FROM bg WHERE m = n),
sizes AS (SELECT DISTINCT n FROM win),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
g AS (SELECT doc_id, n, p, string_agg(word, ' ') OVER f AS g, count(*) OVER f AS m FROM x CROSS JOIN sizes
      WINDOW f AS (PARTITION BY doc_id, n ORDER BY p ROWS BETWEEN CURRENT ROW AND n - 1 FOLLOWING)),
hits AS (SELECT g.doc_id, g.p, g.n, win.item FROM g JOIN win ON win.n = g.n AND win.g = g.g AND g.m = g.n),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id""",
}
