"""Records of foreign .csv and .txt files, with their bytes, as a DataFrame.

In ``header`` mode the first record that is not blank is the header; blank ones before it go. In ``none`` mode all records are data;
``lines`` reads physical lines. Blank records at the end go, inner ones stay and count.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.split import CHUNK, THRESHOLD, TooLong, is_empty, raw_records
from sluice.sources.insert_dump import _files

SCHEMA = "path string, row long, header binary, record binary, error string"
_TYPES = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.string()]
_BATCH = 10_000


def data_records(data: bytes, mode: str) -> Iterator[tuple[bytes, bytes]]:
    """(header, record) of a file's data records; nothing for a file without any."""
    head, blank = (None, []) if mode == "header" else (b"", [])
    for record in raw_records(data.removeprefix(b"\xef\xbb\xbf"), mode != "lines"):
        if is_empty(record):
            if head is not None:
                blank.append(record)
        elif head is None:
            head = record
        else:
            for x in blank:
                yield head, x
            blank = []
            yield head, record


def read_records(files: DataFrame, mode: str = "header") -> DataFrame:
    """path, row (from 0), header, record of files (path, content). A file with an overlong record has one row with an error."""

    def run(batches):
        held: list[tuple] = []

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _TYPES, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for path, data in _files(batches):
            how = "lines" if path.lower().endswith(".txt") else mode
            try:
                for _ in data_records(data, how):
                    pass
            except TooLong as e:
                held.append((path, 0, None, None, str(e)))
                continue
            for k, (head, record) in enumerate(data_records(data, how)):
                held.append((path, k, head, record, None))
                if len(held) >= _BATCH:
                    yield out()
                    held = []
        if held:
            yield out()

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, SCHEMA)


LINES = "path string, part long, row long, line string, error string"
_LINE_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]


def part_lines(files: DataFrame, mode: str = "header", threshold: int = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """Lines of the parts of files (path, content) with more data rows than the threshold; others give none.

    A line is a record, its line feed included, with the header as row -1 of each part; records that end in a lone carriage return go
    together with the next one, and a last record without an end gets a line feed. A file is counted and numbered by the task that
    reads it, up to the threshold first.
    """

    def run(batches):
        for path, data in _files(batches):
            how = "lines" if path.lower().endswith(".txt") else mode
            held: list[tuple] = []
            try:
                n = sum(1 for _ in zip(data_records(data, how), range(threshold + 1), strict=False))
                if n > threshold:
                    for _ in data_records(data, how):  # an overlong record further on leaves the file whole
                        pass
            except TooLong as e:
                yield _lines([(path, 1, 0, None, str(e))])
                continue
            if n <= threshold:
                continue
            open_ = b""
            for k, (head, record) in enumerate(data_records(data, how)):
                part = k // chunk + 1
                if k % chunk == 0 and head:
                    held.append((path, part, -1, head if head.endswith(b"\n") else head + b"\n", None))
                open_ += record
                if open_.endswith(b"\n") or (k + 1) % chunk == 0:
                    held.append((path, part, k, open_ if open_.endswith(b"\n") else open_ + b"\n", None))
                    open_ = b""
                if len(held) >= _BATCH:
                    yield _lines(held)
                    held = []
            if open_:
                held.append((path, part, k, open_ + b"\n", None))
            if held:
                yield _lines(held)

    got = files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, LINES.replace("line string", "line binary"))
    return got.withColumn("line", F.col("line").cast("string"))


def _lines(held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _LINE_TYPES, strict=True)], names=[x.split()[0] for x in LINES.split(", ")])
