"""Queries over the standard tables for each operator, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import ingest_queries
from sluice.functions import names
from sluice.operators import merge, split, state
from sluice.sources import insert_dump, tabular


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _literal(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))


def _dump(df: DataFrame, table: str, values: list[Column], columns: list[str], bucket: Column) -> DataFrame:
    """Files (path, content), each one INSERT of many rows in order of the first column."""
    row = F.concat(F.lit("("), F.concat_ws(", ", *[F.coalesce(v, F.lit("NULL")) for v in values]), F.lit(")"))
    got = df.select(bucket.cast("string").alias("b"), F.struct(df[df.columns[0]].alias("k"), row.alias("r")).alias("x")).groupBy("b").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    head = f"-- dump\nINSERT INTO `{table}` ({', '.join(f'`{c}`' for c in columns)}) VALUES\n"
    body = F.concat(F.lit(head), F.array_join(F.transform("xs", lambda x: x["r"]), ",\n"), F.lit(";\n"))
    return got.select(F.concat(F.lit(f"/in/{table}_"), F.lpad("b", 9, "0"), F.lit(".sql")).alias("path"), body.cast("binary").alias("content"))


def _merged(files: DataFrame) -> DataFrame:
    """Rows of dumps (path, content) of one directory, merged by table."""
    rows, firsts = (read(files).withColumn("dir", F.lit("")) for read in (insert_dump.read_rows, insert_dump.first_rows))
    return merge.merged(rows, merge.first_schema(merge.keyed(firsts)))


def insert_roundtrip_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders rendered as dumps, parsed, merged and typed again."""
    o = _table(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long").cast("string")
    values = [F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), _literal(F.col("o_orderstatus")), cents, _literal(F.date_format("o_orderdate", "yyyy-MM-dd")), _literal(F.col("o_orderpriority"))]
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_cents", "o_orderdate", "o_orderpriority"]
    files = _dump(o.select("o_orderkey", *[c for c in o.columns if c != "o_orderkey"]), "orders", values, columns, F.floor(F.col("o_orderkey") / 20_000))
    v = lambda k: F.element_at("values", k + 1)
    return _merged(files).select(v(0).cast("long").alias("o_orderkey"), v(1).cast("long").alias("o_custkey"), v(2).alias("o_orderstatus"), v(3).cast("long").alias("o_cents"), v(4).alias("o_orderdate"), v(5).alias("o_orderpriority"))


def insert_merge_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation and region rendered as two dumps of one table, merged in path order under the first header."""
    r = _table(spark, sf_dir, "region")
    n = _table(spark, sf_dir, "nation")
    a = _dump(r, "place", [F.col("r_regionkey").cast("string"), _literal(F.col("r_name"))], ["id", "name"], F.lit(1))
    b = _dump(n, "place", [F.col("n_nationkey").cast("string"), _literal(F.col("n_name"))], ["code", "label"], F.lit(2))
    got = _merged(a.union(b))
    return got.select("base", F.array_join("header", ",").alias("header"), "path", F.col("row").cast("long").alias("row"), F.element_at("values", 1).alias("id"), F.element_at("values", 2).alias("name"))


def insert_width_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of 1 to 4 values (part key mod 4 + 1) under a header of three: short padded, wide dropped."""
    p = _table(spark, sf_dir, "part").select("p_partkey")
    k = F.pmod(F.col("p_partkey"), F.lit(4)).cast("int") + 1
    row = F.concat(F.lit("("), F.array_join(F.array_repeat(F.col("p_partkey").cast("string"), k), ","), F.lit(")"))
    files = p.groupBy(F.floor(F.col("p_partkey") / 250).alias("b")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("r")))).alias("xs"))
    body = F.concat(F.lit("INSERT INTO w (a, b, c) VALUES "), F.array_join(F.transform("xs", lambda x: x["r"]), ","), F.lit(";"))
    return _merged(files.select(F.concat(F.lit("/in/"), F.col("b").cast("string")).alias("path"), body.cast("binary").alias("content"))).select(*[F.element_at("values", i + 1).alias(c) for i, c in enumerate("abc")])


#: Names and whether they carry personal data, tables' columns and whether they do; judged by hand.
_NAMES = [("users", True), ("order_state", False), ("OrderState", False), ("customer_email", True), ("settings", False), ("user_id", True), ("customerGuid", True), ("passport_no", True), ("ssn_id", True), ("e-mail", True), ("created_at", False), ("product_name", False), ("product name", False), ("фамилия", True), ("ИНН", True), ("emailvalid", True), ("zip code", True), ("qty", False), ("", False), ("file.hash", False), ("hash", True), ("date-of birth", True), ("date__of__birth", True), ("DateOfBirth", True), ("价格", False), ("姓名", True)]
_TABLES = [("id,status,created_at", False), ("email", False), ("email,phone", True), ("user_id,email", False), ("national_id,email", True), ("passport_id,ssn_id", True), ("email,EMAIL", False), ("email,e_mail", True), ("id,email1,phone", True), ("userId2,email", False), ("customer_uuid,phone", False), ("employeeid,accountid,email", False), ("emailvalid,phoneNo", True), ("customer_ids,email", True), ("driverLicenseId,qty,phone", True), ("settings,email,productname", False)]


def names_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary matches of names."""
    k = F.col("p_partkey") % len(_NAMES) + 1
    name = F.element_at(F.array(*[F.lit(n) for n, _ in _NAMES]), k.cast("int"))
    return _table(spark, sf_dir, "part").select("p_partkey", name.alias("name")).select("p_partkey", "name", names.matches(F.col("name")).alias("personal"))


def tables_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on tables by at least two columns."""
    k = F.col("p_partkey") % len(_TABLES) + 1
    columns = F.element_at(F.array(*[F.lit(c) for c, _ in _TABLES]), k.cast("int"))
    return _table(spark, sf_dir, "part").select("p_partkey", columns.alias("columns")).select("p_partkey", "columns", names.columns_match_udf()(F.split("columns", ",")).alias("by_columns"))


def file_base_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File bases of page addresses."""
    return _table(spark, sf_dir, "pages").select("page_id", names.file_base(F.col("url")).alias("base"))


def name_limit_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of up to 400 characters, limited with a hash."""
    long = F.repeat("p_brand", (F.pmod("p_partkey", F.lit(60)) + 1).cast("int"))
    return _table(spark, sf_dir, "part").select("p_partkey", names.limited_name(long).alias("base"))


def csv_encode_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as CSV records."""
    line = merge.csv_line(F.array(F.col("doc_id").cast("string"), F.col("source"), F.col("text")))
    return _table(spark, sf_dir, "documents").select("doc_id", line.alias("line"))


def split_part_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and key range of each part of orders, 4,000 rows a part."""
    got = merge.numbered(_table(spark, sf_dir, "orders").select("o_orderkey"), [], ["o_orderkey"], 4000)
    return got.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


def split_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ship modes of lineitem statuses whose rows exceed a threshold, with their part counts."""
    got = split.parts(_table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey"), ["l_returnflag"], ["l_orderkey"], 20_000, 10_000)
    return got.groupBy("l_returnflag").agg(F.max("part").cast("long").alias("n_parts"))


def line_records_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents without trailing blank ones."""
    return _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(split.lines(F.col("text"))).alias("k", "line")).select("doc_id", F.col("k").cast("long").alias("k"), "line")


def delimiter_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimiter and field count of rendered header lines."""
    n = _table(spark, sf_dir, "nation")
    pick = F.element_at(F.array(F.lit(","), F.lit(";"), F.lit("\t")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    # other delimiters stand inside quotes, and every fourth line has an empty field
    l = F.concat_ws("|", F.lit('"a,b;c;d"'), F.col("n_name"), F.when(F.col("n_nationkey") % 4 == 0, "").otherwise("key"), F.repeat(F.lit("x|"), (F.col("n_nationkey") % 5).cast("int")), F.lit("z"))
    lines = n.select("n_nationkey", l.alias("l")).select("n_nationkey", F.replace("l", F.lit("|"), pick).alias("line"))

    def run(batches):
        for b in batches:
            got = [tabular.sniff(x) for x in b.column("line").to_pylist()]
            yield pa.RecordBatch.from_pydict({"n_nationkey": b.column("n_nationkey"), "delimiter": pa.array([g and g[0] for g in got], pa.string()), "n_fields": pa.array([g and len(g[1]) for g in got], pa.int64())})

    return lines.mapInArrow(run, "n_nationkey int, delimiter string, n_fields long")


def state_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages still open: folders are market segments, done those of a first letter."""
    folders = _table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("top_folder"))
    done = folders.distinct().where("top_folder < 'C'").withColumn("stage", F.lit("convert"))
    return state.open_stages(folders, done)


def folder_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters and result of each folder: users of events are folders, event kinds outcomes."""
    kind = F.element_at(F.array(*map(F.lit, ("created", "skipped", "rejected", "failed"))), (F.pmod(F.col("event_id"), F.lit(97)) % 4 + 1).cast("int"))
    units = _table(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(50)).cast("string").alias("top_folder"), F.when(F.pmod("event_id", F.lit(7)) == 0, kind).otherwise("created").alias("outcome"))
    return state.summary(units)


def collision_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Producers of one target after the first."""
    p = _table(spark, sf_dir, "part")
    return merge.refused_targets(p.select(F.col("p_brand").alias("target"), (F.col("p_size") % 3).cast("long").alias("rank"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("path")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (insert_roundtrip_orders, insert_merge_places, insert_width_rules, names_match, tables_match, file_base_urls, name_limit_hash, csv_encode_documents, split_part_sizes, split_gate, line_records_documents, delimiter_sniff, state_antijoin, folder_summary, collision_reject)
}
QUERIES |= ingest_queries.QUERIES



_LABELLED = lambda rows: ", ".join(f"({k}, '{n}', {str(y).lower()})" for k, (n, y) in enumerate(rows))
ORACLE_SQL: dict[str, str] = {
    "insert_roundtrip_orders": "SELECT o_orderkey, o_custkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS o_cents, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders",
    "insert_merge_places": "SELECT 'place' AS base, 'id,name' AS header, '/in/place_000000001.sql' AS path, row_number() OVER (ORDER BY r_regionkey) - 1 AS row, CAST(r_regionkey AS VARCHAR) AS id, r_name AS name FROM region UNION ALL SELECT 'place', 'id,name', '/in/place_000000002.sql', row_number() OVER (ORDER BY n_nationkey) - 1, CAST(n_nationkey AS VARCHAR), n_name FROM nation",
    "insert_width_rules": "SELECT CAST(p_partkey AS VARCHAR) AS a, CASE WHEN p_partkey % 4 >= 1 THEN CAST(p_partkey AS VARCHAR) ELSE '' END AS b, CASE WHEN p_partkey % 4 >= 2 THEN CAST(p_partkey AS VARCHAR) ELSE '' END AS c FROM part WHERE p_partkey % 4 < 3",
    "names_match": f"SELECT p_partkey, n AS name, y AS personal FROM part JOIN (VALUES {_LABELLED(_NAMES)}) v(k, n, y) ON k = p_partkey % {len(_NAMES)}",
    "tables_match": f"SELECT p_partkey, n AS columns, y AS by_columns FROM part JOIN (VALUES {_LABELLED(_TABLES)}) v(k, n, y) ON k = p_partkey % {len(_TABLES)}",
    "file_base_urls": r"""SELECT page_id, CASE WHEN b = '' THEN 'table' WHEN upper(split_part(b, '.', 1)) IN ('CON', 'PRN', 'AUX', 'NUL') OR regexp_matches(upper(split_part(b, '.', 1)), '^(COM|LPT)[1-9]$') THEN '_' || b ELSE b END AS base FROM (SELECT page_id, regexp_replace(regexp_replace(coalesce(url, ''), '[<>:"/\\|?*\x00-\x1f\x7f-\x{9f}]', '_', 'g'), '[ .]+$', '') AS b FROM pages)""",
    "name_limit_hash": "SELECT p_partkey, CASE WHEN length(n) <= 251 THEN n ELSE substr(n, 1, 234) || '~' || substr(sha256(n), 1, 16) END AS base FROM (SELECT p_partkey, repeat(p_brand, CAST(p_partkey % 60 + 1 AS INT)) AS n FROM part)",
    "csv_encode_documents": """SELECT doc_id, '"' || CAST(doc_id AS VARCHAR) || '","' || replace(coalesce(source, ''), '"', '""') || '","' || replace(coalesce(text, ''), '"', '""') || '"' || chr(10) AS line FROM documents""",
    "split_part_sizes": "SELECT part, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 4000 + 1 AS part FROM orders) GROUP BY part",
    "split_gate": "SELECT l_returnflag, CASE WHEN count(*) > 20000 THEN CAST(ceil(count(*) / 10000.0) AS BIGINT) ELSE 1 END AS n_parts FROM lineitem GROUP BY l_returnflag",
    "line_records_documents": r"""SELECT doc_id, generate_subscripts(ls, 1) - 1 AS k, unnest(ls) AS line FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '(\n[ \t\x0b\f]*)+$', '') AS t FROM documents) WHERE regexp_replace(t, '[ \t\x0b\f]', '', 'g') <> '')""",
    "delimiter_sniff": "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN ',' WHEN 1 THEN ';' ELSE chr(9) END AS delimiter, CAST(5 + n_nationkey % 5 AS BIGINT) AS n_fields FROM nation",
    "state_antijoin": "SELECT DISTINCT c_mktsegment AS top_folder, stage FROM customer, (VALUES ('convert'), ('split')) s(stage) WHERE NOT (stage = 'convert' AND c_mktsegment < 'C')",
    "folder_summary": "WITH u AS (SELECT CAST(user_id % 50 AS VARCHAR) AS top_folder, CASE WHEN event_id % 7 = 0 THEN ['created', 'skipped', 'rejected', 'failed'][CAST(event_id % 97 % 4 + 1 AS INT)] ELSE 'created' END AS o FROM events), c AS (SELECT top_folder, count(*) AS n_units, count(*) FILTER (o = 'created') AS n_created, count(*) FILTER (o = 'skipped') AS n_skipped, 0::BIGINT AS n_unwanted, count(*) FILTER (o = 'rejected') AS n_rejected, count(*) FILTER (o = 'failed') AS n_failed FROM u GROUP BY 1) SELECT *, CASE WHEN n_failed > 0 THEN 'failed' WHEN n_rejected > 0 THEN 'partial' WHEN n_created > 0 THEN 'created' WHEN n_skipped > 0 THEN 'skipped' ELSE 'empty' END AS result FROM c",
    "collision_reject": "SELECT target, rank, path FROM (SELECT p_brand AS target, CAST(p_size % 3 AS BIGINT) AS rank, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS path, row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 3, p_partkey) AS k FROM part) WHERE k > 1",
}
ORACLE_SQL |= ingest_queries.ORACLE_SQL
