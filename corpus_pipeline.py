"""Corpus pipeline: quality rules, near duplicates, decontamination, mixing, token store.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a DataFrame; all but the last
return the columns of documents. Stages are written as Parquet and read again between them.

1. quality_rules: documents that base rules or risk-controlled cutoffs reject go, row by row: rows of one doc_id, language and
   text share a verdict, others don't, null doc_ids included. Null and empty texts fail the base rules.
2. near_duplicates: of each component of 5-word shingle links (Jaccard 0.8), exact copies and repeated rows included, one row
   stays: that of the smallest doc_id (null last; among texts of one doc_id by their hash). Documents without words are all kept.
3. decontamination: documents with one word in 20 or more in benchmark windows go; smaller hits are cut out of the text.
4. source_mix: documents the mix takes no copies of go; those it takes twice stand twice, repeats with the same doc_id.
5. token_store: every row is encoded, stored, and read back; null texts are empty.

An empty table gives no rows in every stage; more columns than those of documents pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import decontaminate, jaccard_join, mixing, quality, token_store
from sluice.llm.queries import tokenizer_path
from sluice.llm.util import Scratch, saved, scratch_dir, table


def _keyed(docs: DataFrame, *of: str) -> tuple[DataFrame, str]:
    """docs with a hash of the columns named and of the text, and its name: rows that agree in these get one verdict."""
    key = "_key"
    while key in docs.columns:
        key += "_"
    told = [x for c in of for x in (F.col(c).isNull(), F.col(c))]
    return docs.withColumn(key, F.xxhash64(*told, F.col("text").isNull(), F.col("text"))), key


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed, key = _keyed(docs, "doc_id", "lang")
    measured = saved(quality.measures(keyed, "lang", key), "measures")
    chosen = quality.cutoffs(measured, table(spark, sf_dir, "labels"))
    rejected = quality.decided(measured, chosen, "lang").where(~F.col("kept")).select(key).distinct()
    return keyed.join(rejected, key, "left_anti").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed, key = _keyed(docs, "doc_id")
    linked = jaccard_join.linked(keyed, key).where("n_shingles > 0")
    gone = linked.where(F.col(key) != F.col("first_row")).select(key).distinct()
    # rows of one doc_id and text have one key: of those that stay, one row is chosen, whatever their other columns
    repeated = saved(linked.where(F.col(key) == F.col("first_row")).groupBy(key).count().where("count > 1").select(key), "repeated")
    kept = keyed.join(gone.union(repeated), key, "left_anti").select(docs.columns)
    if repeated.isEmpty():
        return kept
    return kept.union(keyed.join(repeated, key, "left_semi").dropDuplicates([key]).select(docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # rows of one doc_id, source and size are drawn alike; without the size, rows of one doc_id would multiply each other
    taken = mixing.mixed(docs).where("copies > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "copies").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").cast("string").eqNullSafe(F.col("_source")) & (mixing.word_count(F.col("text")) == F.col("_size"))
    met = docs.join(taken, same)
    return met.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(docs.columns)


def token_store_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_store.stored(docs, tokenizer_path(), f"{scratch_dir(spark)}/tokens")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_store", token_store_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again, and goes once the next one is there."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        here = Scratch(spark)
        docs = here.saved(stage(spark, docs, sf_dir), name)
        if before:
            before.__exit__()
        before = here
    return docs


#: Tokenization and the order sample are not expressed in SQL; tests/llm holds each stage and the chain against brute force.
ORACLE_SQL = None
