"""Splitting large tables into parts, and byte-exact records of CSV and text files."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators.merge import numbered

THRESHOLD = 4_000_000
CHUNK = 2_000_000
MAX_RECORD = 64 << 20
_PLAIN = re.compile(rb"[^\r\n]*(?:\r\n|\r|\n|\Z)")
_QUOTED = re.compile(rb'(?:[^\r\n"]|"[^"]*(?:"|\Z))*(?:\r\n|\r|\n|\Z)')
_EMPTY = re.compile(rb"[ \t\x0b\f]*[\r\n]*\Z")


class TooLong(ValueError):
    pass


def raw_records(data: bytes, quoted: bool) -> Iterator[bytes]:
    """Records with their line ends; joined they are the data again. In quoted mode a quote anywhere opens or closes."""
    at, pattern = 0, _QUOTED if quoted else _PLAIN
    while at < len(data):
        m = pattern.match(data, at)
        if m.end() - at > MAX_RECORD:
            raise TooLong(f"record at byte {at}")
        yield m[0]
        at = m.end()


def is_empty(record: bytes) -> bool:
    return bool(_EMPTY.match(record))


def split_bytes(data: bytes, threshold: int = THRESHOLD, chunk: int = CHUNK, mode: str = "header") -> list[bytes]:
    """Parts of a file with more than ``threshold`` rows, of at most ``chunk`` each; mode header, none, or lines.

    A header is copied to each part; blank records before it and at the end go, inner ones stay and count.
    """
    records = list(raw_records(data.removeprefix(b"\xef\xbb\xbf"), mode != "lines"))
    while records and is_empty(records[-1]):
        records.pop()
    head = b""
    if mode == "header":
        while records and is_empty(records[0]):
            records.pop(0)
        head = records.pop(0) if records else b""
    if len(records) <= threshold:
        return [data]
    return [head + b"".join(records[k : k + chunk]) for k in range(0, len(records), chunk)]


def exceeds(df: DataFrame, threshold: int = THRESHOLD) -> bool:
    """Whether df has more rows than the threshold, reading no more than needed."""
    return df.limit(threshold + 1).count() > threshold


def parts(df: DataFrame, keys: list[str], order: list[str], threshold: int = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """Adds part: 1 for keys up to the threshold, else by chunks in order."""
    return numbered(df, keys, order, chunk, threshold)


def lines(text: Column) -> Column:
    """Lines of a text without trailing blank ones; inner blank lines stay."""
    cut = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"(\n[ \t\x0b\f]*)+$", "")
    return F.when(F.regexp_replace(cut, r"[ \t\x0b\f]", "") == "", F.array().cast("array<string>")).otherwise(F.split(cut, "\n"))
