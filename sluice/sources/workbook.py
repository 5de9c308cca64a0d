"""XLSX and XLS workbooks as rows, with the standard library only.

Books over ``MAX_SHEETS`` sheets, or unpacking to over ``MAX_UNPACKED`` bytes, are refused. Values are the stored text of cells:
formulas give their last value, booleans TRUE or FALSE. Trailing empty rows of a sheet go, inner ones stay.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from sluice.sources import biff

MAX_SHEETS = 5
MAX_UNPACKED = 4 << 30
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


class Unsupported(ValueError):
    pass


def _text(node: ElementTree.Element) -> str:
    """Text of a shared or inline string, without phonetic hints."""
    return "".join(t.text or "" for child in node if child.tag != f"{_MAIN}rPh" for t in child.iter(f"{_MAIN}t")) or "".join(t.text or "" for t in node.findall(f"{_MAIN}t"))


def _column(reference: str) -> int:
    out = 0
    for ch in re.match("[A-Z]*", reference)[0]:
        out = out * 26 + ord(ch) - 64
    return out - 1


def _old_sheets(data: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    listed, found = biff.names_and_rows(data)
    if len(listed) > MAX_SHEETS:
        raise Unsupported(f"over {MAX_SHEETS} sheets")
    for name, cells in found:
        full = [r for r, c in cells.items() if any(c.values())]
        if full:
            width = max(k + 1 for r in full for k in cells[r])
            yield name, [[cells.get(r, {}).get(k, "") for k in range(width)] for r in range(max(full) + 1)]


def sheets(data: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    """(sheet name, rows) of a book; sheets without rows are left out."""
    if data[:8] == biff.SIGNATURE:
        yield from _old_sheets(data)
        return
    if data[:4] != b"PK\x03\x04":
        raise Unsupported("neither an XLSX nor an XLS file")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if sum(i.file_size for i in z.infolist()) > MAX_UNPACKED:
            raise Unsupported("unpacks to too much")
        names = set(z.namelist())
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        listed = [(s.get("name", ""), s.get(_REL, "")) for s in book.iter(f"{_MAIN}sheet")]
        if len(listed) > MAX_SHEETS:
            raise Unsupported(f"over {MAX_SHEETS} sheets")
        relations = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        shared = [_text(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
        for name, rel in listed:
            target = relations.get(rel, "")
            target = target[1:] if target.startswith("/") else f"xl/{target}"
            if "worksheets" not in target or target not in names:
                continue  # a chart sheet counts but has no rows
            rows: list[list[str]] = []
            with z.open(target) as f:
                for _, row in ElementTree.iterparse(f):
                    if row.tag != f"{_MAIN}row":
                        continue
                    at = int(row.get("r", len(rows) + 1))
                    rows.extend([] for _ in range(at - 1 - len(rows)))
                    cells: list[str] = []
                    for c in row.findall(f"{_MAIN}c"):
                        k = _column(c.get("r", "")) if c.get("r") else len(cells)
                        cells.extend("" for _ in range(k - len(cells)))
                        value, kind = c.findtext(f"{_MAIN}v") or "", c.get("t")
                        if kind == "s":
                            value = shared[int(value)] if value else ""
                        elif kind == "inlineStr":
                            value = _text(c.find(f"{_MAIN}is"))
                        elif kind == "b":
                            value = "TRUE" if value == "1" else "FALSE"
                        cells.append(value)
                    rows.append(cells)
                    row.clear()
            while rows and not any(rows[-1]):
                rows.pop()
            if rows:
                width = max(map(len, rows))
                yield name, [r + [""] * (width - len(r)) for r in rows]
