import io
import struct
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice import queries
from sluice.functions import names
from sluice.operators import merge, split, state
from sluice.plans import ingest
from sluice.sources import biff, files, insert_dump, mixed
from sluice.sources.workbook import Unsupported, sheets

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "columns, expected",
    [(["email"], False), (["email", "phone"], True), (["user_id", "email"], False), (["national_id", "email"], True), (["passport_id", "ssn_id"], True), (["email", "EMAIL"], False), (["customer_uuid", "phone"], False), (["company_id", "settings_id"], False), ([], False), (None, False)],
)
def test_columns(columns, expected):
    assert names.columns_match(columns) is expected


def test_file_base(spark):
    given_ = ["CON", "end.", "a/b\\c", "", None, "com1.x", "orders"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in given_], "n string").select(names.file_base(F.col("n"))).collect()]
    assert got == ["_CON", "end", "a_b_c", "table", "table", "_com1.x", "orders"]
    assert len(names.limited("😀" * 200).encode("utf-16-le")) // 2 <= 251


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=80), st.booleans())
def test_records_keep_bytes(data, quoted):
    assert b"".join(split.raw_records(data, quoted)) == data


def test_split():
    assert split.split_bytes(b"\nh\na\nb\nc\n\n", 2, 2) == [b"h\na\nb\n", b"h\nc\n"]
    assert split.split_bytes(b"a\nb\nc\n", 2, 2, "none") == [b"a\nb\n", b"c\n"]
    assert split.split_bytes(b'h\n"a\nb"\n', 2, 2) == [b'h\n"a\nb"\n']


def test_ingest(spark, tmp_path):
    (tmp_path / "A").mkdir()
    (tmp_path / "A" / "a.SQL").write_text("INSERT INTO users (id, email) VALUES (1, 'x@example.test'), (2, NULL, 3);")
    (tmp_path / "A" / "b.sql").write_text("INSERT INTO users (k, mail, more) VALUES (3, 'y', 'wide'), (4); INSERT INTO qty (a) VALUES (1);")
    rows = ingest.dump_rows(spark, str(tmp_path))
    got = merge.merged(rows).orderBy("base", "path", "offset", "row").collect()
    assert [(r.base, r["values"]) for r in got] == [("qty", ["1"]), ("users", ["1", "x@example.test"]), ("users", ["4", ""])]
    assert {r.table for r in ingest.classified(rows, "drop").collect()} == {"qty"}


def test_convert(spark, tmp_path):
    """Files with headers, parts, refused and lost rows, state and a second run that has nothing to do."""
    root, out = tmp_path / "in", tmp_path / "out"
    for d in ("A", "B", "C", "E"):
        (root / d).mkdir(parents=True)
    (root / "A" / "a.SQL").write_text("INSERT INTO users (id, email) VALUES (1, 'x\ny'), (2, NULL, 3), (3);INSERT INTO `B_s0` VALUES (9)")
    (root / "A" / "b.sql").write_text("INSERT INTO users (k, mail, more) VALUES (3, 'y', 'wide'), (4);INSERT INTO users (k, mail, more) VALUES (3, 'y', 'wide');")
    (root / "A" / "B.xlsx").write_bytes(book(1))
    (root / "B" / "t.sql").write_text("id;name\n")
    (root / "B" / "big.sql").write_text("INSERT INTO n VALUES " + ",".join(f"({k})" for k in range(7)))
    (root / "C" / "bad.sql").write_text("INSERT INTO x VALUES (1) (2);")
    (root / "loose.sql").write_text("INSERT INTO l (a) VALUES (1);")
    (root / "_convert_passed_.txt").write_text("\ufeffE\r\ntorn", encoding="utf-8", newline="")
    got = ingest.convert(spark, str(root), str(out), threshold=5, chunk=3)
    texts = {str(p.relative_to(out)): p.read_text() for p in out.rglob("*.csv")}
    assert texts == {
        "A/users.csv": '"id","email"\n"1","x\ny"\n"3",""\n"4",""\n',
        "A/B_s0.csv": '"9"\n',
        "B/t.csv": '"id","name"\n',
        "B/n.csv": '"0"\n"1"\n"2"\n',
        "B/n_2.csv": '"3"\n"4"\n"5"\n',
        "B/n_3.csv": '"6"\n',
        "l.csv": '"a"\n"1"\n',
    }
    assert sorted(texts) == got.files and [r.rank for r in got.refused.collect()] == [1] and got.failures == 3
    assert sorted((r.n_lost, r.rejected) for r in got.lost.collect()) == [(1, False), (1, True)]
    assert (root / "_convert_done_.txt").read_text() == "B\n"
    assert (root / "_convert_passed_.txt").read_bytes() == "\ufeffE\r\ntorn".encode() and (root / "_splitter_passed_.txt").read_text() == "E\n"
    assert not list(root.glob("*.lock")) and not list(out.glob("_stage*"))
    (root / "_splitter_passed_.txt").write_text("B\nE\n")
    again = ingest.convert(spark, str(root), str(out), threshold=5, chunk=3)
    assert {r.top_folder for r in again.reports.collect()} == {"A", "C", ""}
    with state.RootLock(spark, str(root)), pytest.raises(BlockingIOError):
        ingest.convert(spark, str(root), str(out))
    # part names that are taken keep a table whole
    (out / "B" / "n_02.csv").write_text("mine")
    (root / "_splitter_passed_.txt").unlink()
    ingest.convert(spark, str(root), str(out), threshold=5, chunk=3)
    assert (out / "B" / "n.csv").read_text().count("\n") == 7 and (out / "B" / "n_02.csv").read_text() == "mine"


def test_state_lists(spark, tmp_path):
    (tmp_path / "_convert_done_.txt").write_bytes(b"OLD\nPARTIAL")
    rows = [("Alpha", "convert", "done"), ("OLD", "convert", "done"), ("Alpha", "split", "passed")]
    state.append(spark, str(tmp_path), spark.createDataFrame(rows, "top_folder string, stage string, outcome string"))
    assert (tmp_path / "_convert_done_.txt").read_text() == "OLD\nAlpha\n" and (tmp_path / "_splitter_passed_.txt").read_text() == "Alpha\n"
    got = state.read_lists(spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == {("OLD", "convert", "done"), ("Alpha", "convert", "done"), ("Alpha", "split", "passed")}
    assert [r.top_folder for r in state.completed(got).collect()] == ["Alpha"]
    assert {r.top_folder for r in state.read_lists(spark, str(tmp_path), fold=True).collect()} == {"old", "alpha"}
    with pytest.raises(ValueError):
        state.append(spark, str(tmp_path), spark.createDataFrame([("a\nb", "split", "done")], "top_folder string, stage string, outcome string"))


def test_nothing_left_to_do(spark, tmp_path):
    (tmp_path / "in" / "A").mkdir(parents=True)
    (tmp_path / "in" / "A" / "a.sql").write_text("INSERT INTO t VALUES (1);")
    for name in ("_convert_done_.txt", "_splitter_passed_.txt"):
        (tmp_path / "in" / name).write_text("A\n")
    got = ingest.convert(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert got.files == [] and got.failures == 0 and got.reports.count() == 0


def test_personal_only(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sql").write_text("INSERT INTO users (a) VALUES (1); INSERT INTO qty (n, m) VALUES (1, 2); INSERT INTO t (email, phone) VALUES (1, 2);")
    (tmp_path / "in" / "q.sql").write_text("n,m\n1,2\n")
    (tmp_path / "in" / "z.sql").write_text("email,phone\n1,2\n")
    got = ingest.convert(spark, str(tmp_path / "in"), str(tmp_path / "out"), personal_only=True)
    assert got.files == ["t.csv", "users.csv", "z.csv"]
    assert {r.table: r.status for r in got.reports.collect()} == {"users": "ok", "qty": "skipped", "t": "ok", "q": "skipped", "z": "ok"}


def test_split_files(spark, tmp_path):
    (tmp_path / "in" / "d").mkdir(parents=True)
    (tmp_path / "in" / "d" / "a.csv").write_bytes(b'\n\nh,i\r\n"1\n",2\r\n\r\n3,4\r5,6\n7\n\n')
    (tmp_path / "in" / "d" / "b.TXT").write_bytes(b"".join(b'%d "\n' % k for k in range(6)))
    (tmp_path / "in" / "small.csv").write_text("h\n1\n")
    (tmp_path / "out" / "d").mkdir(parents=True)
    got, failed = ingest.split_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), threshold=3, chunk=3)
    out = tmp_path / "out" / "d"
    assert got == ["d/a.csv", "d/a_2.csv", "d/b.TXT", "d/b_2.TXT"] and failed == []
    assert (out / "a.csv").read_bytes() == b'h,i\r\n"1\n",2\r\n\r\n3,4\r\n' and (out / "a_2.csv").read_bytes() == b"h,i\r\n5,6\n7\n"
    assert (out / "b_2.TXT").read_bytes() == b'3 "\n4 "\n5 "\n'
    (out / "b.TXT").write_text("x")
    got, failed = ingest.split_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), threshold=3, chunk=3)
    assert got == [] and len(failed) == 1 and failed[0].endswith("a.csv") or got


def test_walk(spark, tmp_path):
    root = tmp_path / "a (1)+b"
    for d in ("Top", "Done", "Empty"):
        (root / d).mkdir(parents=True)
    (root / "Top" / "_x.SQL").write_text("")
    (root / "Top" / "y.sqlx").write_text("")
    (root / "Top" / "link.sql").symlink_to(root / "Top" / "_x.SQL")
    (root / "Done" / "z.csv").write_text("")
    (root / "_log.txt").write_text("")
    (root / "r.txt").write_text("x")
    got = files.walk(spark, str(root), ["Done"])
    assert sorted((r.rel, r.kind, r.dir, r.top_folder, r.rank) for r in got.where("reason is null").collect()) == [("Top/_x.SQL", "sql", "Top", "Top", 0), ("r.txt", "txt", "", "", 2)]
    assert [(r.reason, r.top_folder, r.blocks) for r in files.skips(got).collect()] == [("link, not followed", "Top", False)]
    done = spark.createDataFrame([("Done",)], "top_folder string")
    assert {(r.rel, r.top_folder) for r in files.inputs(spark, str(root), done).collect()} == {("r.txt", "")}
    with pytest.raises(FileNotFoundError):
        files.walk(spark, str(root / "no"))
    with pytest.raises(NotADirectoryError):
        files.inputs(spark, str(root / "r.txt"))


def test_numbered_parts_are_exact(spark):
    """Parts stay exact though range bounds are sampled, with a payload column."""
    df = spark.range(300_000).select(F.xxhash64("id").alias("k"), F.repeat(F.lit("x"), 20).alias("p")).repartition(7)
    got = merge.numbered(df, [], ["k"], 20_000).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("a"), F.max("k").alias("b")).orderBy("part").collect()
    assert [r.n for r in got] == [20_000] * 15 and all(x.b < y.a for x, y in zip(got, got[1:], strict=False))


@pytest.fixture
def plain_joins(spark):
    """Joins that Spark neither broadcasts by itself nor deals anew, in many more partitions than rows of a key fall in by chance."""
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "32"}
    old = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_rows_of_one_key_stay_apart(spark, plain_joins, monkeypatch):
    """A table of all rows is merged, counted and split without one task that has them all, by either way to join its header."""
    row = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(199)), lambda k: F.concat(F.lit("("), F.col("id") * 200 + k, F.when(k % 50 == 7, ", 1, 1").otherwise(", 1"), F.lit(")"))), ",")
    text = F.concat(F.lit("INSERT INTO t "), F.when(F.col("id") == 0, "(a, b) ").otherwise(""), F.lit("VALUES "), row, F.lit("; INSERT INTO u VALUES (1)"))
    given_ = spark.range(0, 16, 1, 8).select(F.format_string("/in/%02d.sql", "id").alias("path"), text.cast("binary").alias("content"))
    rows, firsts = (x(given_).withColumn("dir", F.lit("")) for x in (insert_dump.read_rows, insert_dump.first_rows))
    schema = merge.first_schema(merge.keyed(firsts))
    assert sorted(schema.collect()) == sorted(merge.first_schema(merge.keyed(rows)).collect())
    said = []
    for few in (merge.FEW, 0):
        monkeypatch.setattr(merge, "FEW", few)
        for given_schema in (schema, None):
            got = merge.merged(rows, given_schema)
            n = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(n) == 16 * 196 + 16 and max(n) < sum(n) / 2
        said.append((sorted(map(repr, got.select(*sorted(got.columns)).collect())), sorted(map(tuple, merge.too_wide(rows, schema).collect()))))
    assert said[0] == said[1] and len(said[0][1]) == 15 and {x[4:] for x in said[0][1]} == {(4, 200, False)}
    cut = split.parts(merge.merged(rows, schema), list(merge.KEY), ["path", "offset", "row"], 16, 1000)
    n = [r["count"] for r in cut.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(n) == 16 * 196 + 16 and max(n) < sum(n) / 2
    assert {tuple(r) for r in cut.groupBy("base", "part").count().collect()} == {("u", 1, 16), ("t", 1, 1000), ("t", 2, 1000), ("t", 3, 1000), ("t", 4, 136)}


def test_first_rows(spark):
    """Those that read_rows() gives first, of statements whose first rows are too wide too."""
    texts = ["INSERT INTO a (x) VALUES (1, 2), (3), (4);INSERT INTO b VALUES (5), (6", "INSERT INTO c (x) VALUES (1, 2);INSERT INTO d VALUES ;", "INSERT INTO e VALUES ();INSERT INTO f VALUES (1) (2);", ""]
    given_ = spark.createDataFrame([(str(k), t.encode()) for k, t in enumerate(texts)], "path string, content binary")
    at = lambda r: (r.path, r.offset)
    rows = sorted(insert_dump.read_rows(given_).collect(), key=lambda r: (*at(r), r.row))
    firsts = sorted(insert_dump.first_rows(given_).collect(), key=at)
    assert firsts == [r for k, r in enumerate(rows) if not k or at(rows[k - 1]) != at(r)]
    assert [(r.table, r.row) for r in firsts] == [("a", 1), ("b", 0), ("e", 0)]


def test_limited_names(spark):
    given_ = ["x" * 251, "x" * 252, "😀" * 130, "a" + "😀" * 130, "é" * 400, "b" * 249 + "😀"]
    rows = spark.createDataFrame([(x, s) for x in given_ for s in ("", "_12")], "n string, s string")
    for r in rows.select("n", "s", names.limited_name(F.col("n"), F.col("s")).alias("got")).collect():
        assert r.got == names.limited(r.n, r.s)


def test_cli(spark, tmp_path):
    from sluice import cli

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sql").write_text("INSERT INTO t VALUES (1);")
    assert cli.main(["--help"]) == 0 and cli.main([]) == 2
    assert cli.main([str(tmp_path / "no"), str(tmp_path / "out")]) == 1
    assert cli.main([str(tmp_path / "in"), str(tmp_path / "out")]) == 0
    (tmp_path / "in" / "b.sql").write_text("INSERT INTO t VALUES (1) x;")
    assert cli.main([str(tmp_path / "in"), str(tmp_path / "out")]) == 3


def book(n_sheets):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        listed = "".join(f'<sheet name="s{i}" sheetId="{i}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" r:id="r{i}"/>' for i in range(n_sheets))
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>{listed}</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(n_sheets)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id</t></si></sst>")
        for i in range(n_sheets):
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>n</t></is></c></row><row r="3"><c r="A3"><v>7</v></c></row><row r="4"/></sheetData></worksheet>')
    return out.getvalue()


def test_workbook():
    assert list(sheets(book(1))) == [("s0", [["id", "", "n"], ["", "", ""], ["7", "", ""]])]
    with pytest.raises(Unsupported):
        list(sheets(book(6)))
    with pytest.raises(Unsupported):
        list(sheets(b"GIF89a"))


def old_book(sheets, strings=(), filler=0):
    """An XLS book: sheets of (row, column, value) cells; long books lie in sectors, short ones in the file's small stream."""
    rec = lambda k, b=b"": struct.pack("<HH", k, len(b)) + b
    bof = rec(0x809, struct.pack("<HHHHII", 0x600, 5, 0, 0, 0, 0))
    text = lambda t, n="<H": struct.pack(n, len(t)) + (b"\x01" + t.encode("utf-16-le") if any(ord(c) > 255 for c in t) else b"\x00" + t.encode("latin-1"))
    table = struct.pack("<II", len(strings), len(strings)) + b"".join(text(t) for t in strings)
    cut = len(table) - 3  # the last string goes on in a continuation, which repeats its flags
    shared = rec(0xFC, table[:cut]) + rec(0x3C, b"\x00" + table[cut:]) if strings else b""
    bodies = []
    for cells in sheets:
        out = bof
        for r, c, v in cells:
            at = struct.pack("<HHH", r, c, 0)
            if isinstance(v, bool):
                out += rec(0x205, at + struct.pack("<BB", v, 0))
            elif isinstance(v, tuple):  # a formula with a text result
                out += rec(0x06, at + b"\x00" * 6 + b"\xff\xff" + b"\x00" * 6) + rec(0x207, text(v[0]))
            elif isinstance(v, list):
                out += rec(0xBD, struct.pack("<HH", r, c) + b"".join(struct.pack("<HI", 0, ((x << 2) | 2) & 0xFFFFFFFF) for x in v) + struct.pack("<H", c + len(v) - 1))
            elif isinstance(v, float):
                out += rec(0x203, at + struct.pack("<d", v))
            elif isinstance(v, int):
                out += rec(0xFD, at + struct.pack("<I", v))
            else:
                out += rec(0x204, at + text(v))
        bodies.append(out + rec(0x0A))
    size = lambda k: len(rec(0x85, struct.pack("<IBB", 0, 0, 0) + text(f"s{k}", "<B")))
    head = len(bof) + sum(map(size, range(len(sheets)))) + len(shared) + 4
    places = [head + sum(map(len, bodies[:k])) for k in range(len(bodies))]
    book = bof + b"".join(rec(0x85, struct.pack("<IBB", p, 0, 0) + text(f"s{k}", "<B")) for k, p in enumerate(places)) + shared + rec(0x0A) + b"".join(bodies) + b"\0" * filler
    small = len(book) < 4096
    n = -(-len(book) // 512)
    end, free = 0xFFFFFFFE, 0xFFFFFFFF
    chain = lambda a, k: [*range(a + 1, a + k), end]
    fat = [0xFFFFFFFD, end, *chain(2, n), end]  # sectors: table, directory, the book, and the small table
    fat += [free] * (128 - len(fat))
    entry = lambda name, kind, start, length: (name + "\0").encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<IIII", start, length, 0, 0)[:12]
    dirs = (entry("Root Entry", 5, 2 if small else end, n * 512 if small else 0) + entry("Workbook", 2, 0 if small else 2, len(book))).ljust(512, b"\0")
    head = biff.SIGNATURE + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIIIIIIIII", 0, 1, 1, 0, 4096, 2 + n if small else end, 1 if small else 0, end, 0, 0) + struct.pack("<108I", *[free] * 108)
    minis = chain(0, -(-len(book) // 64)) if small else []
    return head + struct.pack("<128I", *fat) + dirs + book.ljust(n * 512, b"\0") + struct.pack("<128I", *minis, *[free] * (128 - len(minis)))


def test_old_workbook():
    cells = [(0, 0, 0), (0, 2, "é日"), (2, 0, [7, -8]), (2, 2, 1.5), (3, 0, True), (3, 1, ("sum",)), (3, 2, 1)]
    want = [["shared", "", "é日"], ["", "", ""], ["7", "-8", "1.5"], ["TRUE", "sum", "long one"]]
    for filler in (0, 5000):
        assert list(sheets(old_book([cells, []], ("shared", "long one"), filler))) == [("s0", want)]
    with pytest.raises(Unsupported):
        list(sheets(old_book([cells] * 6, ("shared", "long one"))))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 5000), st.binary(min_size=1, max_size=8))
def test_damaged_old_workbook(at, junk):
    data = bytearray(old_book([[(0, 0, 0), (1, 1, [1, 2])]], ("a", "bcdef")))
    data[at : at + len(junk)] = junk[: max(0, len(data) - at)]
    name, _, _, _, status, _ = list(mixed._sheets("b", bytes(data)))[0] if list(mixed._sheets("b", bytes(data))) else ("", [], [], 0, "ok", None)
    assert status in ("ok", "rejected")


def test_plan_reads_tables_and_books(spark, tmp_path):
    """A delimited file named .sql and a book give rows; what cannot be read gives a report."""
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "t.sql").write_text('\ufeff\nid,name\n1,"x\ny"\n2\n1,2,3\n', encoding="utf-8")
    (tmp_path / "a" / "d.sql").write_text("INSERT INTO d (k) VALUES (5);")
    (tmp_path / "a" / "B.XLSX").write_bytes(book(2))
    (tmp_path / "a" / "old.xls").write_bytes(b"\xd0\xcf\x11\xe0")
    (tmp_path / "a" / "bad.xlsx").write_bytes(b"PK\x03\x04broken")
    got = {(r.table, r.row): (r.columns, [c.text for c in r.cells]) for r in ingest.dump_rows(spark, str(tmp_path)).collect()}
    assert got[("t", 0)] == (["id", "name"], ["1", "x\ny"]) and got[("t", 1)][1] == ["2", ""] and got[("d", 0)] == (["k"], ["5"])
    assert got[("B_s1", 1)] == (["id", "", "n"], ["7", "", ""]) and len(got) == 7
    said = {r.table: (r.status, r.n_rows, r.n_surplus) for r in ingest.dump_reports(spark, str(tmp_path)).collect()}
    assert said["t"] == ("ok", 2, 1) and said["B_s0"] == ("ok", 2, 0) and said["old"][0] == said["bad"][0] == "rejected" and len(said) == 6


@pytest.fixture(scope="module")
def con():
    import duckdb

    out = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages".split():
        out.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_match_sql(spark, con, name):
    a, b = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    c = sorted(a.columns)
    assert c == sorted(b.columns)
    x, y = (sorted(map(repr, d[c].astype(object).values.tolist())) for d in (a, b))
    assert len(x) == len(y) and x == y
