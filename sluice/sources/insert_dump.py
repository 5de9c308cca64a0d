"""INSERT statements of SQL dumps, parsed from bytes.

``outline(data)`` finds statements and the byte ranges of their rows without reading values; ``statements(data)`` parses the values
too; ``read_rows`` and ``read_reports`` make DataFrames. A statement's fate is known from its outline, so its rows are parsed in
pieces of about ``PIECE`` bytes, by one task as they come or, with ``spread``, by as many tasks as there are pieces.
Scanning is by compiled patterns over bytes, one match for an ordinary row. A file is one row of binaryFile (2 GB at most).
Cells stay text: kind is text, null or missing.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that begin a statement and so end an INSERT body, and modifiers of INSERT.
STATEMENT_WORDS = frozenset(b"INSERT CREATE UPDATE DELETE ALTER DROP REPLACE TRUNCATE USE LOCK UNLOCK BEGIN COMMIT WITH".split())
MODIFIERS = frozenset(b"IGNORE DELAYED LOW_PRIORITY HIGH_PRIORITY".split())
QUIET = frozenset({"no VALUES", "INSERT ... SET", "INSERT ... SELECT", "empty column list", "no rows", "not an INSERT"})
MAX_CELL = 64 << 20

_STRING = rb"'(?:[^'\\]|\\.|'')*+'"
_DOUBLE = rb'"(?:[^"\\]|\\.|"")*+"'
_OPEN = rb"'(?:[^'\\]|\\.|'')*+(?:'|\\?\Z)|" + rb'"(?:[^"\\]|\\.|"")*+(?:"|\\?\Z)|`(?:[^`]|``)*+(?:`|\Z)|\[[^\]]*+(?:\]|\Z)'
_SKIP = re.compile(
    rb"\s+|--[^\n]*|/\*.*?(?:\*/|\Z)|" + _OPEN + rb"|\$([A-Za-z_0-9]{0,64})\$.*?(?:\$\1\$|\Z)"
    rb"|(?P<url>https?://[^\s;]*)|(?P<word>[A-Za-z_@\x80-\xff][A-Za-z_@0-9$\x80-\xff]*)|(?P<other>.)",
    re.DOTALL,
)
_BLANK = re.compile(rb"(?:\s+|--[^\n]*(?:\n|\Z)|/\*.*?\*/)*", re.DOTALL)
_IDENT = re.compile(rb"`(?:[^`]|``)*`|\"(?:[^\"]|\"\")*\"|'(?:[^']|'')*'|\[[^\]]*\]|[A-Za-z_@\x80-\xff][A-Za-z_@0-9$\x80-\xff]*")
_WORD = re.compile(rb"[A-Za-z_]+")
_LITERAL = re.compile(rb"[NnEe]?(" + _STRING + rb")|(" + _DOUBLE + rb")", re.DOTALL)
_RAW = re.compile(rb"(?P<end>[,)])|(?P<open>\()|/\*.*?(?:\*/|\Z)|(?P<line>--)|" + _STRING + rb"|" + _DOUBLE + rb"|`(?:[^`]|``)*+`|[^,()'\"`/\-]+|(?P<quote>['\"`])|.", re.DOTALL)
#: A row without comments, brackets, dollar quotes and semicolons outside strings, its parentheses at most three deep, and what follows it.
_PART = rb"[^()'\"`;\[$/\-]++|" + _STRING + rb"|" + _DOUBLE + rb"|-(?!-)|/(?!\*)"
_PART = rb"(?:" + _PART + rb"|\((?:" + _PART + rb"|\((?:" + _PART + rb")*+\))*+\))*+"
_ROW = re.compile(rb"\(" + _PART + rb"\)\s*+(,\s*+(?=\())?", re.DOTALL)
#: An ordinary value and what ends it.
_VALUE = re.compile(rb"\s*+(?:[NnEe]?'((?:[^'\\]|\\.|'')*+)'|(-?[^,()'\"`/\-]*+))\s*+([,)])", re.DOTALL)
_ESCAPE = re.compile(rb"''|\\(['\\])")
_ESCAPE2 = re.compile(rb"\"\"|\\([\"\\])")
#: Bytes looked ahead for the header behind a web address, and bytes of rows parsed at a time.
LOOK_AHEAD = 64 << 10
PIECE = 4 << 20


class _End(Exception):
    """The data ended inside a construct."""


class _Bad(Exception):
    """The construct is malformed."""

    def __init__(self, reason: str, at: int = -1) -> None:
        super().__init__(reason)
        self.reason, self.at = reason, at


@dataclass
class Statement:
    offset: int
    line: int
    table: str = ""
    columns: list[str] = field(default_factory=list)
    values_offset: int = -1
    status: str = "ok"  # ok, cut, rejected, skipped
    reason: str = ""
    surplus: int = 0
    rows: list[list[tuple[str, str | None]]] = field(default_factory=list)
    #: (number of the first row, start, end) of runs of complete rows.
    pieces: list[tuple[int, int, int]] = field(default_factory=list)
    n_tuples: int = 0

    @property
    def quiet(self) -> bool:
        return self.reason in QUIET


def clean_identifier(raw: bytes) -> str:
    """Quotes, brackets and slashes go anywhere; blanks around too."""
    return raw.translate(None, b"`\"'[]\\/").strip().decode("utf-8", "replace")


def _blank(data: bytes, at: int) -> int:
    return _BLANK.match(data, at).end()


def _path(data: bytes, at: int) -> tuple[bytes, int]:
    """Last part of a dotted identifier, and where it ends."""
    while True:
        m = _IDENT.match(data, at)
        if not m:
            raise _Bad("identifier expected", at)
        at = _blank(data, m.end())
        if data[at : at + 1] != b".":
            return m[0], at
        at = _blank(data, at + 1)


def _group_end(data: bytes, at: int) -> int:
    """End of a balanced group that starts at an opening parenthesis."""
    depth = 0
    for m in _SKIP.finditer(data, at):
        depth += (m[0] == b"(") - (m[0] == b")")
        if depth == 0:
            return m.end()
    raise _End


def _column_list(data: bytes, at: int) -> tuple[list[str], int]:
    out, at = [], _blank(data, at + 1)
    if data[at : at + 1] == b")":
        return [], at + 1
    while True:
        name, at = _path(data, at)
        out.append(clean_identifier(name))
        sep, at = data[at : at + 1], at + 1
        if sep == b")":
            return out, at
        if sep != b",":
            raise _Bad("column list: comma expected", at - 1)
        at = _blank(data, at)


def _cell(data: bytes, at: int) -> tuple[tuple[str, str | None], int]:
    """One value, up to its comma or closing parenthesis."""
    at = _blank(data, at)
    m = _LITERAL.match(data, at)
    if m:
        end = _blank(data, m.end())
        if data[end : end + 1] in (b",", b")"):
            raw = m[1] or m[2]
            text = _ESCAPE.sub(lambda x: x[1] or b"'", raw[1:-1]) if m[1] else _ESCAPE2.sub(lambda x: x[1] or b'"', raw[1:-1])
            return ("text", text.decode("utf-8", "replace")), end
        if end >= len(data):
            raise _End
    depth, pieces, start = 0, [], at
    m = _RAW.match(data, at)
    while m:
        if m["quote"]:
            raise _End  # an open literal runs to the end
        got, at = m[0], m.end()
        if m["open"]:
            depth += 1
        elif m["end"] and depth == 0:
            return _raw_cell(pieces), m.start()
        elif m["line"] and depth == 0:  # a line comment ends the value
            end = _blank(data, m.start())
            if end >= len(data):
                raise _End
            if data[end : end + 1] not in (b",", b")"):
                raise _Bad("comma expected", end)
            return _raw_cell(pieces), end
        elif got == b")":
            depth -= 1
        if not got.startswith(b"/*"):
            pieces.append(got)
        if at - start > MAX_CELL:
            raise _Bad("value too long", start)
        m = _RAW.match(data, at)
    raise _End


def _raw_cell(pieces: list[bytes]) -> tuple[str, str | None]:
    text = b"".join(pieces).strip()
    if not text:
        return "missing", None
    return ("null", None) if text.upper() == b"NULL" else ("text", text.decode("utf-8", "replace"))


def _tuple(data: bytes, at: int) -> tuple[list[tuple[str, str | None]], int]:
    """Values of a row that starts behind its opening parenthesis; () has none."""
    first = _blank(data, at)
    if data[first : first + 1] == b")":
        return [], first + 1
    out = []
    while True:
        m = _VALUE.match(data, at)
        if not m:
            cell, at = _cell(data, at)
        else:
            text, raw, _ = m.groups()
            at = m.start(3)
            if raw is None:
                cell = "text", (_ESCAPE.sub(lambda x: x[1] or b"'", text) if b"'" in text or b"\\" in text else text).decode("utf-8", "replace")
            else:
                raw = raw.strip()
                cell = ("text", raw.decode("utf-8", "replace")) if raw and raw.upper() != b"NULL" else ("null" if raw else "missing", None)
        out.append(cell)
        if data[at : at + 1] == b")":
            return out, at + 1
        at += 1


def _header(data: bytes, at: int, s: Statement, linked: bool = False) -> int:
    """Parse up to VALUES; where the body starts. linked: a web address stood for INSERT INTO."""
    into = linked
    while not linked:
        at = _blank(data, at)
        w = _WORD.match(data, at)
        word = w[0].upper() if w else b""
        if word == b"INTO":
            into, at = True, w.end()
            break
        if word == b"OR":
            at = _blank(data, w.end())
            w = _WORD.match(data, at)
            if not w or w[0].upper() not in (b"REPLACE", b"IGNORE"):
                raise _Bad("unknown INSERT OR", at)
            at = w.end()
        elif word in MODIFIERS:
            at = w.end()
        else:
            break
    at = _blank(data, at)
    if not into and not _IDENT.match(data, at):
        raise _Bad("not an INSERT", at)
    name, at = _path(data, at)
    s.table = clean_identifier(name)
    w = _WORD.match(data, at)
    if w and w[0].upper() == b"PARTITION":
        at = _blank(data, w.end())
        at = _blank(data, _group_end(data, at))
    if data[at : at + 1] == b"(":
        s.columns, at = _column_list(data, at)
        if not s.columns:
            raise _Bad("empty column list", at)
        at = _blank(data, at)
    w = _WORD.match(data, at)
    word = w[0].upper() if w else b""
    if word in (b"VALUES", b"VALUE"):
        return w.end()
    raise _Bad({b"SET": "INSERT ... SET", b"SELECT": "INSERT ... SELECT", b"WITH": "INSERT ... SELECT"}.get(word, "no VALUES"), at)


def _outlined(data: bytes, at: int, s: Statement) -> int:
    """Find the ranges of rows; where the statement ends. Values are read only in rows that _ROW doesn't know."""
    at = _blank(data, at)
    first, start, limit = 0, at, -1  # limit: the body's end, looked for where a row isn't ordinary
    whole = data

    def keep(end: int) -> None:
        if s.n_tuples > first:
            s.pieces.append((first, start, end))

    while True:
        m = _ROW.match(data, at)
        if m:
            s.n_tuples += 1
            end, at = (m.start(1) if m[1] else m.end()), m.end()
            if m[1]:
                if at - start >= PIECE:
                    keep(end)
                    first, start = s.n_tuples, at
                continue
        else:
            if limit < 0:
                limit = _body_end(data, at)
                data = data[:limit] if limit < len(data) else data
            if data[at : at + 1] != b"(":
                if at >= len(data) and (s.n_tuples or limit >= len(whole)):
                    keep(at)
                    raise _End
                if not s.n_tuples:
                    return at
                raise _Bad("row expected", at)
            row_at = at
            try:
                _, at = _tuple(data, at + 1)
            except _End:
                keep(row_at)
                raise
            s.n_tuples += 1
            end = at
        at = _blank(data, at)
        if data[at : at + 1] != b",":
            break
        at = _blank(data, at + 1)
        if at - start >= PIECE:
            keep(end)
            first, start = s.n_tuples, at
    keep(end)
    data = whole
    w = _WORD.match(data, at)
    if at >= len(data) or data[at : at + 1] == b";":
        return at + 1
    if w and w[0].upper() in (b"ON", b"RETURNING"):
        return _statement_end(data, w.end())
    if w and w[0].upper() in STATEMENT_WORDS:
        return at
    raise _Bad("unexpected text behind the rows", at)


def _body_end(data: bytes, at: int) -> int:
    """Where a body ends at the latest: at a ``;`` at any depth, or at a statement word outside parentheses."""
    depth = 0
    for m in _SKIP.finditer(data, at):
        got = m[0]
        if got == b";":
            return m.start()
        depth = max(0, depth + (got == b"(") - (got == b")"))
        if depth == 0 and m["word"] and got.upper() in STATEMENT_WORDS:
            return m.start()
    return len(data)


def _statement_end(data: bytes, at: int) -> int:
    """Behind the next ``;`` at any depth, or at the next statement word outside parentheses."""
    end = _body_end(data, at)
    return end + 1 if data[end : end + 1] == b";" else end


def _linked(data: bytes, at: int) -> bool:
    """Whether a whole ``table [(columns)] VALUES`` stands behind a web address, as in dumps where it overwrote the keyword."""
    probe = data[at : at + LOOK_AHEAD]
    try:
        _, end = _path(probe, _blank(probe, 0))
        if probe[end : end + 1] == b"(":
            _, end = _column_list(probe, end)
            end = _blank(probe, end)
    except (_Bad, _End):
        return False
    w = _WORD.match(probe, end)
    return bool(w) and w[0].upper() == b"VALUES"


def outline(data: bytes, wanted: Callable[[str, list[str]], bool] | None = None, links: bool = True) -> Iterator[Statement]:
    """INSERT statements in order, with the ranges of their rows. ``wanted`` decides by table and columns before any row is looked at.

    A truncated statement keeps its complete rows and is ``cut``; a malformed one loses all its rows and is ``rejected``. With ``links``
    a web address in place of the keyword counts if a header follows it.
    """
    at, counted, line = (3 if data.startswith(b"\xef\xbb\xbf") else 0), 0, 1
    while True:
        for m in _SKIP.finditer(data, at):
            if m["word"] and m["word"].upper() == b"INSERT" or m["url"] and links and _linked(data, m.end()):
                break
        else:
            return
        line += data.count(b"\n", counted, m.start())
        counted = m.start()
        s, at = Statement(m.start(), line), m.end()
        try:
            at = _header(data, at, s, bool(m["url"]))
            s.values_offset = at
            if wanted and not wanted(s.table, s.columns):
                s.status, s.reason = "skipped", "not wanted"
                at = _statement_end(data, at)
            else:
                at = _outlined(data, at, s)
                if not s.n_tuples:
                    s.status, s.reason = "skipped", "no rows"
        except _End:
            s.status, s.reason = ("cut", "data ends inside the statement") if s.n_tuples else ("rejected", "data ends inside the statement")
            at = max(at, _statement_end(data, s.values_offset if s.values_offset >= 0 else at))
        except _Bad as e:
            where = e.at if e.at >= 0 else at
            s.pieces, s.n_tuples = [], 0
            s.status = "skipped" if e.reason in QUIET else "rejected"
            s.reason = e.reason if s.status == "skipped" else f"{e.reason} (line {data.count(b'\n', 0, where) + 1}, byte {where})"
            at = max(at, _statement_end(data, min(where, len(data)))) if s.status == "rejected" else max(at, where)
        yield s


def piece_rows(data: bytes, width: int) -> Iterator[list[tuple[str, str | None]] | None]:
    """Rows of a range that outline() gave; None for one wider than the statement's own columns."""
    at = 0
    while at < len(data) and data[at : at + 1] == b"(":
        row, at = _tuple(data, at + 1)
        yield None if width and len(row) > width else row
        at = _blank(data, at)
        if data[at : at + 1] != b",":
            return
        at = _blank(data, at + 1)


def statements(data: bytes, wanted: Callable[[str, list[str]], bool] | None = None, links: bool = True) -> Iterator[Statement]:
    """The statements of outline() with their rows. One whose rows are all too wide keeps none and is rejected."""
    for s in outline(data, wanted, links):
        for _, a, b in s.pieces:
            for row in piece_rows(data[a:b], len(s.columns)):
                if row is None:
                    s.surplus += 1
                else:
                    s.rows.append(row)
        if s.surplus and not s.rows and s.status in ("ok", "cut"):
            s.status, s.reason = "rejected", "all rows are wider than the columns"
        yield s


ROWS = "path string, offset long, row long, table string, columns array<string>, cells array<struct<kind:string,text:string>>"
REPORTS = "path string, offset long, line long, table string, columns array<string>, status string, reason string, quiet boolean, n_rows long, n_surplus long"
_BATCH = 5_000
_PIECES = "path string, offset long, first long, table string, columns array<string>, body binary"


def row_pieces(path: str, data: bytes, wanted=None) -> Iterator[tuple]:
    """(path, offset, number of the first row, table, columns, bytes) of the rows of a file, piece by piece."""
    for s in outline(data, wanted):
        for first, a, b in s.pieces:
            yield path, s.offset, first, s.table, s.columns, data[a:b]


def _parsed(pieces) -> Iterator[pa.RecordBatch]:
    """Rows of pieces, given out as they are parsed."""
    held = []
    for path, offset, first, table, columns, body in pieces:
        for k, row in enumerate(piece_rows(body, len(columns))):
            if row is None:
                continue
            held.append((path, offset, first + k, table, columns, [{"kind": c, "text": t} for c, t in row]))
            if len(held) >= _BATCH:
                yield _rows(held)
                held = []
    if held:
        yield _rows(held)


def read_rows(files: DataFrame, wanted: Callable[[str, list[str]], bool] | None = None, spread: int = 0) -> DataFrame:
    """Rows of all statements of files (path, content); row is the place of the tuple in its statement.

    With ``spread`` the pieces of rows are dealt out to so many partitions before values are parsed, for a few large files.
    """
    source = files.select("path", F.col("content").cast("binary").alias("content"))

    def whole(batches):
        yield from _parsed(piece for path, data in _files(batches) for piece in row_pieces(path, data, wanted))

    return dealt(source, lambda path, data: row_pieces(path, data, wanted), spread) if spread else source.mapInArrow(whole, ROWS)


def first_rows(files: DataFrame, wanted: Callable[[str, list[str]], bool] | None = None) -> DataFrame:
    """Of each statement the first row that read_rows() gives; values of other rows are not read."""

    def firsts(batches):
        for path, data in _files(batches):
            for s in outline(data, wanted):
                rows = ((first + k, row) for first, a, b in s.pieces for k, row in enumerate(piece_rows(data[a:b], len(s.columns))) if row is not None)
                for k, row in itertools.islice(rows, 1):
                    yield path, s.offset, k, s.table, s.columns, [{"kind": c, "text": t} for c, t in row]

    def run(batches):
        for held in itertools.batched(firsts(batches), _BATCH):
            yield _rows(held)

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, ROWS)


def dealt(source: DataFrame, pieces_of: Callable, spread: int) -> DataFrame:
    """Rows of files by way of a shuffle of their pieces."""

    def cut(batches):
        for path, data in _files(batches):
            for p in pieces_of(path, data):
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(p, _PIECE_TYPES, strict=True)], names=[x.split()[0] for x in _PIECES.split(", ")])

    def parse(batches):
        yield from _parsed(tuple(r.values()) for batch in batches for r in batch.to_pylist())

    pieces = source.mapInArrow(cut, _PIECES)
    return pieces.repartition(spread, F.xxhash64("path", "offset", "first")).mapInArrow(parse, ROWS)


def read_reports(files: DataFrame, wanted: Callable[[str, list[str]], bool] | None = None) -> DataFrame:
    """One row for each statement met."""

    def run(batches):
        for path, data in _files(batches):
            got = [(path, s.offset, s.line, s.table, s.columns, s.status, s.reason, s.quiet, len(s.rows), s.surplus) for s in statements(data, wanted)]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), _REPORT_TYPES, strict=True)], names=[x.split()[0] for x in REPORTS.split(", ")])

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, REPORTS)


_PIECE_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.binary()]
_REPORT_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64()]
_ROW_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))]


def _files(batches) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            yield path, content or b""


def _rows(held: Sequence[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _ROW_TYPES, strict=True)], names=["path", "offset", "row", "table", "columns", "cells"])
