"""Rows of every readable input file, by what it holds: INSERT statements, a delimited table named .sql, or an XLSX book.

A .sql file is a table if its first line that is not blank is a header to ``tabular.sniff``; it is not read as statements then. Tables are named by
their file, sheets by book and sheet with their first row as header. What cannot be read gives no rows and a report with status ``rejected``.

``read`` gives everything in one pass as items: rows, units (statements, tables, sheets), and counts of rows by unit;
``rows`` and ``reports`` pick from a stored table of items, so that a file is parsed once.
"""

from __future__ import annotations

import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.names import sheet_base
from sluice.sources import insert_dump, tabular, workbook

#: Names of files that read_rows() and read_reports() take.
GLOB = "*.{[sS][qQ][lL],[xX][lL][sS],[xX][lL][sS][xX]}"
_LINE = re.compile(rb"[^\n]*")


def _first_line(data: bytes) -> str:
    """The first line that is not blank; empty if there is none or it is too long for a header."""
    at = 3 if data.startswith(b"\xef\xbb\xbf") else 0
    while at < len(data):
        line = _LINE.match(data, at)[0]
        if line.strip():
            return line.decode("utf-8", "replace").rstrip("\r") if len(line) <= tabular.MAX_RECORD else ""
        at += len(line) + 1
    return ""


def _is_table(data: bytes) -> bool:
    line = _first_line(data)
    return bool(line) and tabular.sniff(line) is not None


def _tables(path: str, data: bytes, wanted: Callable | None) -> Iterator[tuple[str, list[str], list[list[str]], int, str, str | None]] | None:
    """(name, columns, rows, rows dropped, status, reason) of a file's tables, or None for a file of statements."""
    stem, kind = re.fullmatch(r"(.*?)(?:\.([^.]*))?", path.rsplit("/", 1)[-1]).groups()
    if (kind or "").lower() in ("xlsx", "xls"):
        return _sheets(stem, data)
    if not _is_table(data):
        return None
    if wanted:
        found = tabular.sniff(_first_line(data))
        if found and not wanted(stem, found[1]):
            return iter([(stem, found[1], [], 0, "skipped", "not wanted")])
    t = tabular.parse(data.decode("utf-8", "replace"))
    return iter([(stem, t.columns, t.rows, t.dropped, "ok", None) if t else (stem, [], [], 0, "rejected", "no row of the table can be read")])


def _sheets(stem: str, data: bytes):
    try:
        got = [(sheet_base(stem, name), rows[0], rows[1:], 0, "ok", None) for name, rows in workbook.sheets(data)]
    except (ValueError, KeyError, IndexError, TypeError, AttributeError, NotImplementedError, RuntimeError, EOFError, zipfile.BadZipFile, zlib.error, struct.error, ElementTree.ParseError) as e:
        got = [(stem, [], [], 0, "rejected", f"{type(e).__name__}: the book cannot be read" if not isinstance(e, workbook.Unsupported) else str(e))]
    return iter(got)


ITEMS = "item string, path string, offset long, row long, table string, columns array<string>, cells array<struct<kind:string,text:string>>, line long, status string, reason string, n_rows long, n_surplus long, width long, body binary"
_ITEM_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())])), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
_NAMES = [x.split()[0] for x in ITEMS.split(", ")]
_BATCH = 5_000


def _units(path: str, data: bytes, wanted: Callable | None) -> Iterator[tuple]:
    """A file's units, the rows of tables and sheets, and pieces of statements whose values are not parsed yet."""
    tables = _tables(path, data, wanted)
    if tables is None:
        for s in insert_dump.outline(data, wanted):
            yield "unit", path, s.offset, None, s.table, s.columns, None, s.line, s.status, s.reason or None, None, None, len(s.columns) or None, None
            for first, a, b in s.pieces:
                yield "piece", path, s.offset, first, s.table, s.columns, None, None, None, None, None, None, None, data[a:b]
        return
    for n, (name, columns, rows, lost, status, why) in enumerate(tables):
        yield "unit", path, n, None, name, columns, None, 1, status, why, None, None, len(columns) or None, None
        yield "count", path, n, None, name, None, None, None, None, None, len(rows), lost, None, None
        for k, row in enumerate(rows):
            yield "row", path, n, k, name, columns, [{"kind": "text", "text": x} for x in row], None, None, None, None, None, None, None


def _parsed(items) -> Iterator[tuple]:
    """Items with pieces replaced by their rows and a count."""
    for x in items:
        if x[0] != "piece":
            yield x
            continue
        _, path, offset, first, name, columns, *_, body = x
        n = lost = 0
        width = None
        for k, row in enumerate(insert_dump.piece_rows(body, len(columns))):
            if row is None:
                lost += 1
                continue
            if not first + k:
                width = len(row)
            n += 1
            yield "row", path, offset, first + k, name, columns, [{"kind": c, "text": t} for c, t in row], None, None, None, None, None, None, None
        yield "count", path, offset, None, name, None, None, None, None, None, n, lost, width, None


def _batches(items) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for x in items:
        held.append(x)
        size += len(x[-1]) if x[-1] else 0
        if len(held) >= _BATCH or size > insert_dump.PIECE:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _ITEM_TYPES, strict=True)], names=_NAMES)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _ITEM_TYPES, strict=True)], names=_NAMES)


def read(files: DataFrame, wanted: Callable[[str, list[str]], bool] | None = None, spread: int = 0) -> DataFrame:
    """Items of all files (path, content). ``wanted`` decides on statements and delimited tables before their values are read.

    With ``spread``, statements' rows are dealt out to so many partitions in pieces before values are parsed, for a few large files.
    """
    source = files.select("path", F.col("content").cast("binary").alias("content"))

    def whole(batches):
        yield from _batches(_parsed(u for path, data in insert_dump._files(batches) for u in _units(path, data, wanted)))

    def cut(batches):
        yield from _batches(u for path, data in insert_dump._files(batches) for u in _units(path, data, wanted))

    def parse(batches):
        yield from _batches(_parsed(tuple(r.values()) for batch in batches for r in batch.to_pylist()))

    if not spread:
        return source.mapInArrow(whole, ITEMS)
    return source.mapInArrow(cut, ITEMS).repartition(spread, F.xxhash64("path", "offset", "row")).mapInArrow(parse, ITEMS)


def rows(items: DataFrame) -> DataFrame:
    """Rows of items, as insert_dump.read_rows() gives them; offset is the number of the sheet."""
    return items.where("item = 'row'").select("path", "offset", "row", "table", "columns", "cells")


def reports(items: DataFrame) -> DataFrame:
    """One row for each statement, table or sheet met, and for each file that cannot be read; width is that of the first row without columns."""
    n = items.where("item = 'count'").groupBy("path", "offset").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_surplus").alias("n_surplus"), F.max("width").alias("w"))
    units = items.where("item = 'unit'").select("path", "offset", "line", "table", "columns", "status", "reason", "width")
    got = units.join(n, ["path", "offset"], "left").withColumns({"n_rows": F.coalesce("n_rows", F.lit(0)), "n_surplus": F.coalesce("n_surplus", F.lit(0)), "width": F.coalesce("width", "w")})
    wide = F.col("status").isin("ok", "cut") & (F.col("n_rows") == 0) & (F.col("n_surplus") > 0)
    got = got.withColumn("reason", F.when(wide, "all rows are wider than the columns").otherwise(F.col("reason"))).withColumn("status", F.when(wide, "rejected").otherwise(F.col("status")))
    quiet = F.coalesce(F.col("reason").isin(*sorted(insert_dump.QUIET)), F.lit(False))
    return got.select("path", "offset", "line", "table", "columns", "status", "reason", quiet.alias("quiet"), "n_rows", "n_surplus", "width")


def read_rows(files: DataFrame, wanted: Callable[[str, list[str]], bool] | None = None, spread: int = 0) -> DataFrame:
    return rows(read(files, wanted, spread))


def read_reports(files: DataFrame, wanted: Callable[[str, list[str]], bool] | None = None) -> DataFrame:
    return reports(read(files, wanted))
