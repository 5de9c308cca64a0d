from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.sources.insert_dump import statements
from sluice.sources.tabular import parse, sniff, split_strict


def rows(text):
    return [[c[1] for c in r] for s in statements(text.encode()) for r in s.rows]


def test_literals_and_kinds():
    (s,) = statements(rb"insert into d.`t` (a, [b], x.c) values ('it''s', N'q\'z', NULL), (1,, f(2,'),(')), (0x1F, 'a\n', -1.5);")
    assert s.table == "t" and s.columns == ["a", "b", "c"]
    assert s.rows[0] == [("text", "it's"), ("text", "q'z"), ("null", None)]
    assert s.rows[1] == [("text", "1"), ("missing", None), ("text", "f(2,'),(')")]
    assert s.rows[2] == [("text", "0x1F"), ("text", "a\\n"), ("text", "-1.5")]


def test_decoys_and_quiet_skips():
    text = "-- INSERT INTO a VALUES (1)\n/* INSERT INTO b VALUES (1) */ SELECT 'INSERT INTO c VALUES (1)';$$INSERT INTO d VALUES (1)$$; GRANT INSERT, DELETE ON t TO u; INSERT INTO t SET a = 1; INSERT INTO t SELECT 1; INSERT INTO e VALUES (7);"
    got = list(statements(text.encode()))
    assert [s.table for s in got if s.rows] == ["e"]
    assert all(s.quiet for s in got if not s.rows)


def test_surplus_cut_and_rejected():
    (s,) = statements(b"INSERT INTO t (a,b) VALUES (1,2),(1,2,3),(4,5);")
    assert len(s.rows) == 2 and s.surplus == 1
    (s,) = statements(b"INSERT INTO t VALUES (1),(2),\n(3, 'x")
    assert s.status == "cut" and len(s.rows) == 2
    (s,) = statements(b"INSERT INTO t VALUES (1) (2);")
    assert s.status == "rejected" and not s.rows and "byte" in s.reason
    assert rows("INSERT INTO t VALUES (1) ON DUPLICATE KEY UPDATE a = 2; INSERT INTO u VALUES (2) RETURNING id;") == [["1"], ["2"]]


def test_filter_skips_bodies():
    got = list(statements(b"INSERT INTO a VALUES (1); INSERT INTO b VALUES (2);", lambda t, c: t == "b"))
    assert [(s.table, s.status) for s in got] == [("a", "skipped"), ("b", "ok")]


cell = st.one_of(st.none(), st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\\\x00"), max_size=12))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(cell, min_size=2, max_size=2), min_size=1, max_size=6))
def test_round_trip(table):
    shown = lambda c: "NULL" if c is None else "'" + c.replace("'", "''") + "'"
    text = "INSERT INTO t (a, b) VALUES " + ",".join("(" + ", ".join(map(shown, r)) + ")" for r in table) + ";"
    assert rows(text) == table


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=200))
def test_any_bytes_end(data):
    for s in statements(b"INSERT INTO t VALUES (" + data):
        assert s.status in ("ok", "cut", "rejected", "skipped")


def test_tabular():
    assert sniff("email,phone") == (",", ["email", "phone"])
    assert sniff("a;b;c,d") == (";", ["a", "b", "c,d"])
    assert sniff("SELECT a, b") is None and sniff("-- x,y") is None
    assert sniff("desc,price") == (",", ["desc", "price"])
    assert split_strict('a"b,c', ",") is None
    t = parse('email,phone\n"a\nb",1\n\nx\n1,2,3\n')
    assert t.rows == [["a\nb", "1"], ["x", ""]] and t.dropped == 1


def test_odd_quotes_stay_linear():
    import time

    began = time.time()
    t = parse("a,b\n" + '"x,y\n' * 100_001)
    assert time.time() - began < 10 and (t is None or t.dropped)


def fates(text):
    return [(s.table, s.status, [[c[1] for c in r] for r in s.rows]) for s in statements(text.encode())]


def test_bounds_of_statements():
    # an open literal runs to the end; identifiers don't start with digits; a semicolon ends a body at any depth
    assert fates("SELECT 'abc; INSERT INTO x VALUES (1);") == []
    assert [f[1] for f in fates("INSERT INTO 5t VALUES (1);")] == ["rejected"]
    assert fates("INSERT INTO t VALUES (1),(2;\nINSERT INTO u VALUES (3);") == [("t", "cut", [["1"]]), ("u", "ok", [["3"]])]
    assert fates("INSERT INTO t VALUES (1),(2),;INSERT INTO u VALUES ([a;b], $q$;)$q$);")[0][:2] == ("t", "cut")
    assert fates("INSERT INTO u VALUES (x[1;2]), (3);") == [("u", "ok", [["x[1;2]"], ["3"]])]
    # a line comment ends a value
    assert fates("INSERT INTO t VALUES (1 -- one\n, 2);") == [("t", "ok", [["1", "2"]])]
    assert fates("INSERT INTO t VALUES (0),(1 -- one\n + 2);")[0][1] == "rejected"
    assert fates("INSERT INTO t VALUES (f(1 -- 2, 3\n));") == [("t", "ok", [["f(1 -- 2, 3\n)"]])]
    # all rows too wide
    assert fates("INSERT INTO t (a) VALUES (1,2),(3,4);") == [("t", "rejected", [])]


def test_web_address_for_the_keyword():
    text = "-- http://a.b t VALUES (0)\nhttps://x.example/q?1 `t` (a, b) VALUES (1, 'x;'), (2, 'y');\nsee http://x.example t VALUE (3); CREATE TABLE http://x t (a int);"
    assert fates(text) == [("t", "ok", [["1", "x;"], ["2", "y"]])]
    assert list(statements(text.encode(), links=False)) == []


def test_pieces_hold_all_rows(monkeypatch):
    from sluice.sources import insert_dump

    monkeypatch.setattr(insert_dump, "PIECE", 40)
    text = "INSERT INTO t (a, b) VALUES " + ", ".join(f"({k}, 'v''{k}(),;')" if k % 7 else f"({k}, /* odd */ f({k}, [x;y]))" for k in range(200)) + ";INSERT INTO u VALUES (1)"
    (s, u) = insert_dump.outline(text.encode())
    assert len(s.pieces) > 20 and (s.status, u.status) == ("ok", "ok")
    got = [(first + k, row[0][1]) for first, a, b in s.pieces for k, row in enumerate(insert_dump.piece_rows(text.encode()[a:b], 2))]
    assert got == [(k, str(k)) for k in range(200)]
