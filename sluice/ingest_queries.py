"""Queries of the ingestion operators over the standard tables, and the same in DuckDB SQL with expectations of its own."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import names
from sluice.operators import merge, publish, state
from sluice.operators.stored import scratch_dir, stored
from sluice.sources import files, insert_dump, mixed, records


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))


def _sql_list(values: list) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


# listing

_ENDS = [".sql", ".SQL", ".xlsx", ".Xls", ".csv", ".TXT", ".sqlx", ""]


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths made from documents, below a root whose name holds signs of patterns."""
    d = F.col("doc_id")
    name = F.when(d % 50 == 7, F.lit("ReadMe.txt")).when(d % 50 == 11, F.lit("_LOG.txt")).when(d % 50 == 13, F.lit("_convert_done_.txt")).otherwise(F.concat(F.lit("f"), d.cast("string"), _pick(_ENDS, d % 8)))
    folder = F.concat(F.when(d % 5 == 0, F.lit("")).otherwise(F.concat(F.coalesce("source", F.lit("none")), F.lit("/"))), F.when((d % 3 == 0) & (d % 5 != 0), F.concat("lang", F.lit("/"))).otherwise(F.lit("")))
    return files.described(_table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("file:/in/a (1)+b/"), folder, name).alias("path")), "/in/a (1)+b")


_LISTED = f"""WITH n AS (SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN 'ReadMe.txt' WHEN doc_id % 50 = 11 THEN '_LOG.txt' WHEN doc_id % 50 = 13 THEN '_convert_done_.txt' ELSE 'f' || doc_id || {_sql_list(_ENDS)}[doc_id % 8 + 1] END AS name,
 CASE WHEN doc_id % 5 = 0 THEN '' ELSE coalesce(source, 'none') END AS top, CASE WHEN doc_id % 3 = 0 AND doc_id % 5 <> 0 THEN lang ELSE '' END AS sub FROM documents),
f AS (SELECT doc_id, top AS top_folder, CASE WHEN sub = '' THEN top ELSE top || '/' || sub END AS dir, lower(split_part(name, '.', -1)) AS kind, name FROM n
 WHERE doc_id % 50 NOT IN (7, 11, 13) AND doc_id % 8 < 6),
l AS (SELECT doc_id, top_folder, dir, kind, CASE WHEN dir = '' THEN name ELSE dir || '/' || name END AS rel, CASE kind WHEN 'sql' THEN 0 WHEN 'xlsx' THEN 1 WHEN 'xls' THEN 1 ELSE 2 END AS rank FROM f)"""


def list_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds, directories, tops and ranks of inputs; service files and other kinds are none."""
    return _listing(spark, sf_dir).select("doc_id", "rel", "kind", "dir", "top_folder", "rank")


def folder_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top folders in the order in which paths meet them."""
    return files.by_top(_listing(spark, sf_dir))


def directory_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of inputs within their directory, by rank and path."""
    return files.by_directory(_listing(spark, sf_dir)).select("doc_id", "dir", "place")


# dumps

#: (text with @ for the row's key, table, status, rows, surplus rows): what becomes of each form, by the rules of the grammar.
_FORMS = [
    ("INSERT INTO a.b.`t@` (x, y) VALUES (1, 2), (3), (4, 5, 6);", "t@", "ok", 2, 1),
    ("insert or replace into t VALUES (@),(@)", "t", "ok", 2, 0),
    ("INSERT OR FAIL INTO t VALUES (@);", "", "rejected", 0, 0),
    ("INSERT LOW_PRIORITY IGNORE t (`a`) VALUE (@);", "t", "ok", 1, 0),
    ("INSERT DELAYED INTO t PARTITION (p0, p1(x)) VALUES (@);", "t", "ok", 1, 0),
    ("INSERT INTO t SET a = @;", "t", "skipped", 0, 0),
    ("INSERT INTO t (a) SELECT @;", "t", "skipped", 0, 0),
    ("INSERT INTO t () VALUES ();", "t", "skipped", 0, 0),
    ("INSERT INTO t (a,,b) VALUES (@, 1);", "t", "rejected", 0, 0),
    ("INSERT INTO t VALUES (@), (2, 'x", "t", "cut", 1, 0),
    ("INSERT INTO t VALUES (@),", "t", "cut", 1, 0),
    ("INSERT INTO t VALUES (@", "t", "rejected", 0, 0),
    ("INSERT INTO t VALUES (@) (2);", "t", "rejected", 0, 0),
    ("INSERT INTO t VALUES (@), (2) ON DUPLICATE KEY UPDATE a = 1;", "t", "ok", 2, 0),
    ("INSERT INTO t VALUES (@) RETURNING id;", "t", "ok", 1, 0),
    ("INSERT INTO t VALUES ;", "t", "skipped", 0, 0),
    ("INSERT INTO t VALUES (@ -- c\n, 2), (3 -- c\n 4);", "t", "rejected", 0, 0),
    ("INSERT INTO t (a) VALUES (1, 2), (@, 4);", "t", "rejected", 0, 2),
    ("INSERT INTO t VALUES (@),(2;", "t", "cut", 1, 0),
    ("INSERT INTO 5t VALUES (@);", "", "rejected", 0, 0),
]


def _dumps(spark: SparkSession, sf_dir: str, forms: list[str]) -> DataFrame:
    k = F.col("p_partkey")
    text = F.replace(_pick(forms, k % len(forms)), F.lit("@"), k.cast("string"))
    return _table(spark, sf_dir, "part").select(F.concat(F.lit("/in/"), k.cast("string"), F.lit(".sql")).alias("path"), text.cast("binary").alias("content"))


def _key() -> Column:
    return F.regexp_extract("path", "([0-9]+)[.]sql$", 1).cast("long").alias("k")


def dump_fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of statements of many forms, one a file."""
    got = mixed.read_reports(_dumps(spark, sf_dir, [f[0] for f in _FORMS]))
    return got.select(_key(), "table", "status", "n_rows", "n_surplus")


_SEEKS = [
    ("-- INSERT INTO a VALUES (1)\n/* INSERT INTO b VALUES (1) */ INSERT INTO c VALUES (@);", "c"),
    ("SELECT 'INSERT INTO a VALUES (1)'; $q$ INSERT INTO a VALUES (1) $q$ INSERT INTO d VALUES (@)", "d"),
    ("SELECT 'open; INSERT INTO a VALUES (@);", ""),
    ("GRANT INSERT, DELETE ON t TO u; [INSERT INTO a VALUES (1)] INSERT INTO e VALUES (@);", "e"),
    ("https://x.example/q `f` (a) VALUES (@);", "f"),
    ("see http://x.example t for values (@); `INSERT` \"INSERT INTO g VALUES (1)\";", ""),
    ("INSERT INTO h VALUES (@); CREATE TABLE x (a int) INSERT INTO i VALUES (1);", "h,i"),
]


def dump_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of the statements with rows that stand among comments, literals and other statements."""
    got = insert_dump.read_rows(_dumps(spark, sf_dir, [s[0] for s in _SEEKS]))
    return got.groupBy(_key()).agg(F.array_join(F.array_sort(F.collect_set("table")), ",").alias("tables"))


def dump_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and kinds of values of all shapes."""
    p = _table(spark, sf_dir, "part")
    text = F.replace("p_name", F.lit("'"), F.lit("''"))
    row = F.concat(F.lit("INSERT INTO v VALUES (N'"), text, F.lit("', 'a''b\\'c\\\\d\\n', NuLL, , \"x\"\"y\", f("), F.col("p_size").cast("string"), F.lit(", ')'), X'0f', -1.5e3 /* c */, "), F.col("p_partkey").cast("string"), F.lit(");"))
    got = insert_dump.read_rows(p.select(F.concat(F.lit("/in/"), F.col("p_partkey").cast("string"), F.lit(".sql")).alias("path"), row.cast("binary").alias("content")))
    return got.select(_key(), F.to_json(F.transform("cells", lambda c: F.coalesce(c["text"], F.lit("<none>")))).alias("texts"), F.array_join(F.transform("cells", lambda c: c["kind"]), ",").alias("kinds"))


def dump_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as few large dumps, their rows dealt out in pieces before values are parsed; row numbers follow the statement."""
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    row = F.concat(F.lit("("), F.col("o_orderkey").cast("string"), F.lit(", '"), F.col("o_orderpriority"), F.lit("')"))
    some = o.groupBy(F.floor(F.col("o_orderkey") / 40_000).alias("b")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("r")))).alias("xs"))
    body = F.concat(F.lit("INSERT INTO o (k, p) VALUES "), F.array_join(F.transform("xs", lambda x: x["r"]), ",\n"), F.lit(";"))
    got = insert_dump.read_rows(some.select(F.concat(F.lit("/in/"), F.col("b").cast("string")).alias("path"), body.cast("binary").alias("content")), spread=8)
    return got.select("path", "row", F.element_at("cells", 1)["text"].cast("long").alias("k"), F.element_at("cells", 2)["text"].alias("p"))


# delimited tables, books, records

def _delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as delimited files named .sql: short rows, wide ones, blank lines, quoted fields with line feeds, one malformed row each."""
    c = _table(spark, sf_dir, "customer")
    k, d = F.col("c_custkey"), _pick([",", ";", "\t"], F.col("c_custkey") % 3)
    quoted = F.concat(F.lit('"'), F.col("c_name"), d, F.lit('\n""x"""'))
    line = F.when(k % 7 == 0, F.concat(k.cast("string"), F.lit("\n\n"))).when(k % 11 == 0, F.concat(k.cast("string"), d, F.lit("a"), d, F.lit("b"), d, F.lit("c"))).when(k % 13 == 0, F.concat(k.cast("string"), d, F.lit('a"b"'), d)).otherwise(F.concat(k.cast("string"), d, quoted, d, F.lit(" "), F.col("c_mktsegment")))
    some = c.groupBy((F.floor(k / 3000) * 3 + k % 3).alias("b"), d.alias("d")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("l")))).alias("xs"))
    text = F.concat(F.lit("﻿\n \n"), F.concat(F.lit(" id "), F.col("d"), F.lit("label"), F.col("d"), F.lit("seg")), F.lit("\r\n"), F.array_join(F.transform("xs", lambda x: x["l"]), "\n"), F.lit("\n"))
    return some.select(F.concat(F.lit("/in/customers_"), F.col("b").cast("string"), F.lit(".sql")).alias("path"), text.cast("binary").alias("content"))


def tabular_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of delimited files: short ones padded, wide and malformed ones dropped."""
    got = mixed.read_rows(_delimited(spark, sf_dir))
    text = lambda i: F.element_at("cells", i)["text"]
    return got.select("table", F.array_join("columns", "|").alias("header"), text(1).cast("long").alias("id"), text(2).alias("label"), text(3).alias("seg"))


def tabular_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows kept and dropped by file."""
    return mixed.read_reports(_delimited(spark, sf_dir)).select("table", "status", "n_rows", "n_surplus")


#: (first line, whether a table, rows kept): header-only files are tables, SQL is none, and files without a good row are none.
_SNIFFS = [("email,phone\n", True, 0), ("desc,price\n1,2\n", True, 1), ("SELECT a, b\n1,2\n", False, 0), ("-- x,y\n1,2\n", False, 0), ("a;b,c;d\n1;2\n", True, 1), ("lonely\n1\n", False, 0), ("a,b\n1,2,3\n", False, 0), (",x\n1,2\n", False, 0), ('"q, r",b\n"1","2"\n\n3\n', True, 2)]


def tabular_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether files named .sql are tables, and how many rows they keep."""
    got = mixed.read_reports(_dumps(spark, sf_dir, [s[0] for s in _SNIFFS])).where("status = 'ok'")
    return got.select(_key(), "n_rows")


def personal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dumps and delimited files that a reader keeps by their names alone, before values are read."""
    forms = [f"INSERT INTO {t} ({c}) VALUES ({', '.join('@' for _ in c.split(','))});" if c else f"INSERT INTO {t} VALUES (@);" for t, c, _ in _PERSONAL] + ["email,phone\n@,1\n", "qty,price\n@,1\n"]
    got = mixed.read_reports(_dumps(spark, sf_dir, forms), names.table_wanted())
    return got.select(_key(), "status", "n_rows")


#: (table, columns, whether they carry personal data).
_PERSONAL = [
    ("orders", "id,status,created_at", False),
    ("t", "email", False),
    ("t", "email,phone", True),
    ("t", "user_id,email", False),
    ("t", "customerid,email", False),
    ("t", "customerGuid,phone", False),
    ("t", "national_id,email", True),
    ("t", "passport_id,ssn_id", True),
    ("t", "email,EMAIL", False),
    ("t", "email,e_mail", True),
    ("customers", "", True),
    ("settings", "id,value", False),
    ("t", "product_name,file_hash,order_state", False),
    ("t", "id,email1,phone", True),
    ("user_profiles", "id", True),
]


def _book(rows: list[tuple[str, str]], extra: int) -> bytes:
    """An XLSX book: the sheets a (inline texts, a blank row inside, blank ones at the end), empty, and as many more as asked."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda r, t: f'<c r="{r}" t="inlineStr"><is><t>{escape(t)}</t></is></c>'
    body = f'<row r="1">{cell("A1", "key")}{cell("C1", "name")}</row>' + "".join(f'<row r="{k}"><c r="A{k}"><v>{a}</v></c>{cell(f"C{k}", b)}{cell(f"D{k}", "w") if k == 3 else ""}</row>' for k, (a, b) in enumerate(rows, 3)) + f'<row r="{len(rows) + 4}"/>'
    sheets = [("a/1", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>"), *[(f"e{k}", f"<worksheet {ns}><sheetData/></worksheet>") for k in range(1 + extra)]]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" r:id="r{i}"/>' for i, (n, _) in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, (_, x) in enumerate(sheets):
            z.writestr(f"xl/worksheets/s{i}.xml", x)
    return out.getvalue()


def workbook_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation as one book for each region; those of region 4 have too many sheets."""
    n = _table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n")))).alias("xs"))

    def run(batches):
        for b in batches:
            made = [_book([(str(x["k"]), x["n"]) for x in xs], 4 if r == 4 else 0) for r, xs in zip(b.column("n_regionkey").to_pylist(), b.column("xs").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"path": pa.array([f"/in/end._{r}.xlsx" for r in b.column("n_regionkey").to_pylist()]), "content": pa.array(made, pa.binary())})

    got = mixed.read_rows(n.mapInArrow(run, "path string, content binary"))
    return got.select("table", F.array_join("columns", "|").alias("header"), "row", F.array_join(F.transform("cells", lambda c: c["text"]), "|").alias("values"))


def _csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as CSV files of 64 ids each with blank records before, among and behind the data."""
    d = _table(spark, sf_dir, "documents").where("text is not null")
    record = F.concat(F.col("doc_id").cast("string"), F.lit(',"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"\r\n'), F.when(F.col("doc_id") % 5 == 0, F.lit(" \n")).otherwise(F.lit("")))
    some = d.groupBy(F.floor(F.col("doc_id") / 64).alias("b")).agg(F.array_sort(F.collect_list(F.struct("doc_id", record.alias("r")))).alias("xs"))
    text = F.concat(F.lit("\n\t\nid,text\n"), F.array_join(F.transform("xs", lambda x: x["r"]), ""), F.lit("\n \n"))
    return some.select(F.concat(F.lit("/in/"), F.col("b").cast("string"), F.lit(".csv")).alias("path"), text.cast("binary").alias("content"))


def csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of CSV files with line feeds in quotes: whose they are, and a digest of their bytes."""
    got = records.read_records(_csv_files(spark, sf_dir)).where(F.octet_length("record") > 2)
    return got.select(F.split(F.col("record").cast("string"), ",")[0].cast("long").alias("doc_id"), F.col("header").cast("string").alias("header"), F.md5("record").alias("md5"))


def txt_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Physical lines of documents as .txt files."""
    d = _table(spark, sf_dir, "documents").select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".TXT")).alias("path"), F.col("text").cast("binary").alias("content"))
    got = records.read_records(d)
    return got.select(F.regexp_extract("path", "([0-9]+)", 1).cast("long").alias("doc_id"), F.col("row").alias("k"), F.regexp_replace(F.col("record").cast("string"), "[\r\n]+$", "").alias("line"))


def record_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and bytes of the parts of CSV files of more than 30 records, 25 a part; blank inner records count."""
    got = records.part_lines(_csv_files(spark, sf_dir), threshold=30, chunk=25)
    return got.groupBy("path", "part").agg(F.sum((F.col("row") >= 0).cast("long")).alias("n"), F.sum((F.col("row") < 0).cast("long")).alias("n_headers"), F.sum(F.octet_length("line")).alias("bytes"))


# output and state

def published_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier as dumps of three directories, merged, split in parts of 30 and published; read back line by line."""
    s = _table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    row = F.concat(F.lit("("), k.cast("string"), F.lit(", '"), F.col("s_name"), F.lit("\"', NULL)"))
    some = s.groupBy((k % 3).alias("d")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", row.alias("r")))).alias("xs"))
    body = F.concat(F.lit("INSERT INTO `sup?` (k, n, z) VALUES "), F.array_join(F.transform("xs", lambda x: x["r"]), ","))
    given = some.select(F.concat(F.lit("/in/d"), F.col("d").cast("string"), F.lit("/x.sql")).alias("path"), body.cast("binary").alias("content"))
    items = stored(mixed.read(given), "items")
    reports, rows = (files.described(x(items), "/in") for x in (mixed.reports, mixed.rows))
    heads = stored(merge.heads(reports), "heads")
    out = f"{scratch_dir(spark)}/published"
    publish.publish(publish.lines(merge.merged(rows, heads), heads, threshold=30, chunk=20), out)
    got = spark.read.option("recursiveFileLookup", "true").text(out)
    return got.select(F.regexp_extract(F.input_file_name(), "(d[0-9]/[^/]*)$", 1).alias("file"), F.col("value").alias("line"))


def width_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a table's first header has no room for, by the statement they are of."""
    p = _table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    text = F.when(k % 10 == 0, F.concat(F.lit("INSERT INTO w (a, b) VALUES ("), k.cast("string"), F.lit(", 1)"))).when(k % 10 < 5, F.lit("INSERT INTO w (a, b, c) VALUES (1, 2, 3), (4, 5, 6)")).otherwise(F.lit("INSERT INTO w VALUES (1), (1, 2, 3), (2, 2)"))
    given = p.select(F.concat(F.lit("/in/"), (F.floor(k / 10)).cast("string"), F.lit("/"), F.lpad((k % 10).cast("string"), 2, "0"), F.lit(".sql")).alias("path"), text.cast("binary").alias("content"))
    items = stored(mixed.read(given), "items")
    heads = stored(merge.heads(files.described(mixed.reports(items), "/in")), "heads")
    lost = merge.too_wide(files.described(mixed.rows(items), "/in").where("dir <> ''"), heads)
    return lost.select("dir", F.regexp_extract("path", "([0-9]+)[.]sql$", 1).cast("long").alias("k"), "n_lost", "n_rows", "rejected")


def state_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State from list files: names of nations, with marks, repeats and a torn end; names are folded."""
    n = _table(spark, sf_dir, "nation")
    file = _pick(list(files.STATE_LISTS), F.col("n_nationkey") % 4)
    some = n.groupBy(file.alias("f")).agg(F.array_sort(F.collect_list("n_name")).alias("xs"))
    text = F.concat(F.lit("﻿"), F.array_join(F.concat("xs", "xs"), "\r\n"), F.lit("\n\nTORN"))
    return state.decoded(some.select(F.concat(F.lit("/in/"), F.col("f")).alias("path"), text.alias("text")), fold=True)


def state_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is recorded for folders (customers' nations) by their failures and outputs."""
    c = _table(spark, sf_dir, "customer")
    per = c.groupBy(F.when(F.col("c_nationkey") == 3, "").otherwise(F.col("c_nationkey").cast("string")).alias("top_folder")).agg(
        F.sum((F.col("c_custkey") % 40 == 0).cast("long")).alias("convert_files"), F.sum((F.col("c_custkey") % 50 == 0).cast("long")).alias("split_files"), F.sum((F.col("c_custkey") % 90 == 0).cast("long")).alias("failures"), F.max(F.col("c_custkey") % 100 == 99).alias("blocked")
    )
    done = state.outcomes(per)
    fit = state.source_status(per)
    return done.join(fit, "top_folder")


def empty_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders without inputs that have passed the stages still open."""
    n = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("top_folder"), "n_nationkey")
    units = n.where("n_nationkey % 3 = 0")
    return state.empty_tops(n, units, n.where("n_nationkey % 5 = 1"), n.where("n_nationkey % 7 = 2").select("top_folder", F.lit("split").alias("stage")))


def sheet_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File bases of a book's parts: the key's name with its part number."""
    p = _table(spark, sf_dir, "part")
    return p.select("p_partkey", names.part_name(names.limited_name(names.file_base(F.concat("p_brand", F.repeat(F.lit("é"), (F.col("p_partkey") % 300).cast("int"))))), F.col("p_size")).alias("name"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (list_inputs, folder_order, directory_order, dump_fates, dump_seek, dump_cells, dump_pieces, tabular_rows, tabular_counts, tabular_sniff, personal_filter, workbook_rows, csv_records, txt_records, record_parts, published_csv, width_lost, state_lists, state_outcome, empty_tops, sheet_names)
}


def _forms(rows: list[tuple]) -> str:
    shown = lambda x: ("true" if x else "false") if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({k}, " + ", ".join(map(shown, r)) + ")" for k, r in enumerate(rows))


_DELIMITED = """SELECT 'customers_' || CAST(c_custkey // 3000 * 3 + c_custkey % 3 AS VARCHAR) AS "table", CAST(c_custkey AS BIGINT) AS id, c_custkey % 7 = 0 AS short, c_custkey % 7 <> 0 AND (c_custkey % 11 = 0 OR c_custkey % 13 = 0) AS bad, c_name || [',', ';', chr(9)][c_custkey % 3 + 1] || chr(10) || '"x"' AS label, ' ' || c_mktsegment AS seg FROM customer"""

ORACLE_SQL: dict[str, str] = {
    "list_inputs": f"{_LISTED} SELECT doc_id, rel, kind, dir, top_folder, rank FROM l",
    "folder_order": f"{_LISTED} SELECT top_folder, row_number() OVER (ORDER BY min(rel)) AS place, count(*) AS n_files FROM l GROUP BY top_folder",
    "directory_order": f"{_LISTED} SELECT doc_id, dir, row_number() OVER (PARTITION BY dir ORDER BY rank, rel) AS place FROM l",
    "dump_fates": f"""SELECT p_partkey AS k, replace(t, '@', CAST(p_partkey AS VARCHAR)) AS "table", status, CAST(n AS BIGINT) AS n_rows, CAST(s AS BIGINT) AS n_surplus FROM part JOIN (VALUES {_forms([f[1:] for f in _FORMS])}) v(f, t, status, n, s) ON f = p_partkey % {len(_FORMS)}""",
    "dump_seek": f"SELECT p_partkey AS k, t AS tables FROM part JOIN (VALUES {_forms([s[1:] for s in _SEEKS])}) v(f, t) ON f = p_partkey % {len(_SEEKS)} WHERE t <> ''",
    "dump_cells": r"""SELECT p_partkey AS k, CAST(to_json([p_name, 'a''b''c\d\n', '<none>', '<none>', 'x"y', 'f(' || p_size || ', '')'')', 'X''0f''', '-1.5e3', CAST(p_partkey AS VARCHAR)]) AS VARCHAR) AS texts, 'text,text,null,missing,text,text,text,text,text' AS kinds FROM part""",
    "dump_pieces": "SELECT '/in/' || CAST(o_orderkey // 40000 AS VARCHAR) AS path, row_number() OVER (PARTITION BY o_orderkey // 40000 ORDER BY o_orderkey) - 1 AS row, o_orderkey AS k, o_orderpriority AS p FROM orders",
    "tabular_rows": f"""SELECT "table", 'id|label|seg' AS header, id, CASE WHEN short THEN '' ELSE label END AS label, CASE WHEN short THEN '' ELSE seg END AS seg FROM ({_DELIMITED}) WHERE NOT bad""",
    "tabular_counts": f"""SELECT "table", 'ok' AS status, count(*) FILTER (NOT bad) AS n_rows, count(*) FILTER (bad) AS n_surplus FROM ({_DELIMITED}) GROUP BY 1""",
    "tabular_sniff": f"SELECT p_partkey AS k, CAST(n AS BIGINT) AS n_rows FROM part JOIN (VALUES {_forms([s[1:] for s in _SNIFFS])}) v(f, t, n) ON f = p_partkey % {len(_SNIFFS)} WHERE t",
    "personal_filter": f"SELECT p_partkey AS k, CASE WHEN y THEN 'ok' ELSE 'skipped' END AS status, CAST(CASE WHEN y THEN 1 ELSE 0 END AS BIGINT) AS n_rows FROM part JOIN (VALUES {_forms([(p[2],) for p in _PERSONAL] + [(True,), (False,)])}) v(f, y) ON f = p_partkey % {len(_PERSONAL) + 2}",
    "workbook_rows": """WITH b AS (SELECT 'end._' || n_regionkey || '_a_1' AS "table", row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS row, n_nationkey || '||' || n_name AS v FROM nation WHERE n_regionkey <> 4)
SELECT "table", 'key||name|' AS header, row, v || '|' || CASE WHEN row = 1 THEN 'w' ELSE '' END AS values FROM b UNION ALL SELECT DISTINCT "table", 'key||name|', 0, '|||' FROM b""",
    "csv_records": """SELECT doc_id, 'id,text' || chr(10) AS header, md5(doc_id || ',"' || replace(text, '"', '""') || '"' || chr(13) || chr(10)) AS md5 FROM documents WHERE text IS NOT NULL""",
    "txt_records": r"""SELECT doc_id, generate_subscripts(ls, 1) - 1 AS k, unnest(ls) AS line FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '(\n[ \t\x0b\f]*)+$', '') AS t FROM documents) WHERE regexp_replace(t, '[ \t\x0b\f\n]', '', 'g') <> '')""",
    "record_parts": """WITH d AS (SELECT doc_id, doc_id // 64 AS b, strlen(doc_id || ',"' || replace(text, '"', '""') || '"') + 2 AS n, row_number() OVER (PARTITION BY doc_id // 64 ORDER BY doc_id DESC) AS back FROM documents WHERE text IS NOT NULL),
r AS (SELECT b, doc_id, 0 AS s, n FROM d UNION ALL SELECT b, doc_id, 1, 2 FROM d WHERE doc_id % 5 = 0 AND back > 1),
p AS (SELECT b, n, row_number() OVER (PARTITION BY b ORDER BY doc_id, s) - 1 AS k, count(*) OVER (PARTITION BY b) AS m FROM r)
SELECT '/in/' || b || '.csv' AS path, k // 25 + 1 AS part, count(*) AS n, CAST(1 AS BIGINT) AS n_headers, CAST(sum(n) + 8 AS BIGINT) AS bytes FROM p WHERE m > 30 GROUP BY 1, 2""",
    "published_csv": """WITH r AS (SELECT s_suppkey % 3 AS d, s_suppkey AS k, s_name, row_number() OVER (PARTITION BY s_suppkey % 3 ORDER BY s_suppkey) - 1 AS i, count(*) OVER (PARTITION BY s_suppkey % 3) AS m FROM supplier),
p AS (SELECT 'd' || d || '/sup_' || CASE WHEN m > 30 AND i >= 20 THEN '_' || (i // 20 + 1) ELSE '' END || '.csv' AS file, '"' || k || '","' || s_name || '""' || '",' || '""' AS line FROM r)
SELECT * FROM p UNION ALL SELECT DISTINCT file, '"k","n","z"' FROM p""",
    "width_lost": "WITH p AS (SELECT p_partkey // 10 AS d, p_partkey % 10 AS k FROM part), f AS (SELECT d, min(k) AS k0 FROM p GROUP BY d), w AS (SELECT d, k, CASE WHEN k0 = 0 THEN 2 WHEN k0 < 5 THEN 3 ELSE 1 END AS w FROM p JOIN f USING (d)), l AS (SELECT d, k, CASE WHEN k = 0 THEN 1 WHEN k < 5 THEN 2 ELSE 3 END AS n, CASE WHEN k = 0 THEN CASE WHEN w < 2 THEN 1 ELSE 0 END WHEN k < 5 THEN CASE WHEN w < 3 THEN 2 ELSE 0 END ELSE CASE WHEN w < 2 THEN 2 WHEN w < 3 THEN 1 ELSE 0 END END AS lost FROM w) SELECT CAST(d AS VARCHAR) AS dir, k, CAST(lost AS BIGINT) AS n_lost, CAST(n AS BIGINT) AS n_rows, lost = n AS rejected FROM l WHERE lost > 0",
    "state_lists": "SELECT lower(n_name) AS top_folder, ['convert', 'convert', 'split', 'split'][n_nationkey % 4 + 1] AS stage, ['done', 'passed', 'done', 'passed'][n_nationkey % 4 + 1] AS outcome FROM nation",
    "state_outcome": "WITH f AS (SELECT CASE WHEN c_nationkey = 3 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END AS top_folder, count(*) FILTER (c_custkey % 40 = 0) AS c, count(*) FILTER (c_custkey % 50 = 0) AS s, count(*) FILTER (c_custkey % 90 = 0) AS x, bool_or(c_custkey % 100 = 99) AS b FROM customer GROUP BY 1), o AS (SELECT top_folder, 'convert' AS stage, c AS n, c + s > 0 AS eligible FROM f WHERE x = 0 AND NOT b AND top_folder <> '' UNION ALL SELECT top_folder, 'split', s, c + s > 0 FROM f WHERE x = 0 AND NOT b AND top_folder <> '') SELECT top_folder, stage, CASE WHEN n > 0 THEN 'done' ELSE 'passed' END AS outcome, eligible FROM o",
    "empty_tops": "SELECT n_name AS top_folder, s AS stage, 'passed' AS outcome FROM nation, (VALUES ('convert'), ('split')) v(s) WHERE n_nationkey % 3 <> 0 AND n_nationkey % 5 <> 1 AND NOT (s = 'split' AND n_nationkey % 7 = 2)",
    "sheet_names": "WITH n AS (SELECT p_partkey, p_brand || repeat('é', CAST(p_partkey % 300 AS INT)) AS n, p_size AS s FROM part), l AS (SELECT p_partkey, s, CASE WHEN length(n) <= 251 THEN n ELSE substr(n, 1, 234) || '~' || substr(sha256(n), 1, 16) END AS n FROM n), t AS (SELECT *, CASE WHEN s <= 1 THEN '' ELSE '_' || s END AS e FROM l) SELECT p_partkey, CASE WHEN length(n) + length(e) <= 251 THEN n || e ELSE substr(n, 1, CAST(234 - length(e) AS INT)) || '~' || substr(sha256(n), 1, 16) || e END AS name FROM t",
}
