"""Delimited text with a dump's file name: sniffing, strict fields, joined records.

A record is a line, joined with following ones while its quotes are open, up to ``MAX_RECORD``. Fields are strict: a quote may stand
only around a whole field, doubled inside.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

MAX_RECORD = 1 << 20
#: Delimiters in order of preference, and words that begin SQL rather than a header.
DELIMITERS = (",", ";", "\t")
SQL_WORDS = frozenset(
    "INSERT CREATE UPDATE DELETE WITH BEGIN ALTER DROP REPLACE TRUNCATE SELECT SET CALL GRANT REVOKE LOAD EXEC EXECUTE MERGE USE PRAGMA DECLARE IF COPY PRINT SHOW EXPLAIN DESCRIBE DESC LOCK UNLOCK DO".split()
)
_FIRST_WORD = re.compile(r"\s*([A-Za-z]+)\s*(\S?)")


def split_strict(record: str, delimiter: str) -> list[str] | None:
    """Fields of a record, or None if a quote is out of place."""
    d = re.escape(delimiter)
    out, at, n = [], 0, len(record)
    quoted, plain = re.compile(rf'"((?:[^"]|"")*)"(?={d}|\Z)'), re.compile(rf'[^"{d}]*(?={d}|\Z)')
    while True:
        m = quoted.match(record, at) or plain.match(record, at)
        if not m:
            return None
        out.append(m[1].replace('""', '"') if m.re is quoted else m[0])
        at = m.end()
        if at >= n:
            return out
        at += 1


def looks_like_sql(line: str) -> bool:
    bare = line.lstrip("﻿ \t")
    if bare.startswith(("--", "/*", "#")):
        return True
    m = _FIRST_WORD.match(bare)
    return bool(m) and m[1].upper() in SQL_WORDS and m[2] not in DELIMITERS[:1]


def sniff(line: str) -> tuple[str, list[str]] | None:
    """(delimiter, header) of a first line: most non-empty fields, at least two; ties go to the earlier delimiter."""
    if len(line.encode()) > MAX_RECORD or looks_like_sql(line):
        return None
    best: tuple[int, str, list[str]] | None = None
    for d in DELIMITERS:
        fields = split_strict(line, d)
        n = sum(bool(f.strip()) for f in fields or [])
        if n >= 2 and (best is None or n > best[0]):
            best = (n, d, [f.strip() for f in fields])
    return best[1:] if best and best[2][-1] != "" or best and best[0] >= 2 else None


@dataclass
class Table:
    delimiter: str
    columns: list[str]
    rows: list[list[str]] = field(default_factory=list)
    dropped: int = 0


def records(lines: list[str]) -> Iterator[tuple[str, bool]]:
    """(record, whether its quotes close). A record that never closes yields its first line alone, and what was looked at is read again
    line by line, so the work stays linear."""
    at, alone_until = 0, -1
    while at < len(lines):
        record, end, size = lines[at], at + 1, len(lines[at])
        odd = record.count('"') % 2
        if odd and at >= alone_until:
            pieces = [record]
            while odd and end < len(lines) and size <= MAX_RECORD:
                pieces.append(lines[end])
                size += len(lines[end]) + 1
                odd ^= lines[end].count('"') % 2
                end += 1
            if odd:
                alone_until, end = end, at + 1
            else:
                record = "\n".join(pieces)
        yield record, not record.count('"') % 2
        at = end


def parse(text: str) -> Table | None:
    """A table, or None if the text is not one. Short rows are padded; wide or malformed ones dropped and counted."""
    lines = text.lstrip("﻿").replace("\r\n", "\n").split("\n")
    first = next((k for k, x in enumerate(lines) if x.strip()), None)
    found = sniff(lines[first]) if first is not None else None
    if not found:
        return None
    out = Table(*found)
    for record, closed in records(lines[first + 1 :]):
        if not record.strip():
            continue
        fields = split_strict(record, out.delimiter) if closed else None
        if fields is None or len(fields) > len(out.columns):
            out.dropped += 1
        else:
            out.rows.append(fields + [""] * (len(out.columns) - len(fields)))
    return out if out.rows or not out.dropped else None
