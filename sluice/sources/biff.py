"""XLS books (BIFF8 in a compound file), after the published formats: sheets as rows of text, with the standard library only."""

from __future__ import annotations

import struct
from collections.abc import Iterator

#: The compound file's first bytes, the end of a chain, record numbers, and what error cells show.
SIGNATURE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
_END = 0xFFFFFFFA
_BOF, _EOF, _SHEET, _SST, _CONTINUE, _PASSWORD = 0x809, 0x0A, 0x85, 0xFC, 0x3C, 0x2F
_SHARED, _NUMBER, _RK, _MANY, _FORMULA, _TEXT, _BOOL, _LABEL, _RICH = 0xFD, 0x203, 0x27E, 0xBD, 0x06, 0x207, 0x205, 0x204, 0xD6
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}
MAX_BYTES = 256 << 20


def stream(data: bytes, names: tuple[str, ...]) -> bytes:
    """The first of the named streams of a compound file."""
    shift, small_shift = struct.unpack_from("<HH", data, 30)
    n_fat, first_dir = struct.unpack_from("<I", data, 44)[0], struct.unpack_from("<I", data, 48)[0]
    cutoff, first_small, n_small, first_more, n_more = struct.unpack_from("<5I", data, 56)
    width = 1 << shift
    sector = lambda k: data[(k + 1) * width : (k + 2) * width]
    tables = list(struct.unpack_from("<109I", data, 76))
    for _ in range(n_more):
        if first_more >= _END:
            break
        more = struct.unpack(f"<{width // 4}I", sector(first_more))
        tables += more[:-1]
        first_more = more[-1]
    fat: list[int] = []
    for k in tables[:n_fat]:
        if k < _END:
            fat += struct.unpack(f"<{width // 4}I", sector(k))

    def chain(k: int, of: list[int]) -> Iterator[int]:
        for _ in range(len(of)):
            if k >= _END:
                return
            yield k
            k = of[k]

    whole = lambda k: b"".join(map(sector, chain(k, fat)))
    entries = whole(first_dir)
    root = found = None
    for at in range(0, len(entries) - 127, 128):
        name = entries[at : at + max(0, struct.unpack_from("<H", entries, at + 64)[0] - 2)].decode("utf-16-le", "replace")
        kind, start, size = entries[at + 66], *struct.unpack_from("<II", entries, at + 116)
        if kind == 5:
            root = start
        elif kind == 2 and name in names and found is None:
            found = start, size
    if found is None:
        raise ValueError("no workbook in the file")
    start, size = found
    if size >= cutoff:
        return whole(start)[:size]
    raw = b"".join(map(sector, chain(first_small, fat))) if n_small else b""
    small = list(struct.unpack(f"<{len(raw) // 4}I", raw))
    inner, part = whole(root), 1 << small_shift
    return b"".join(inner[k * part : (k + 1) * part] for k in chain(start, small))[:size]


def _records(book: bytes, at: int) -> Iterator[tuple[int, bytes]]:
    while at + 4 <= len(book):
        kind, size = struct.unpack_from("<HH", book, at)
        yield kind, book[at + 4 : at + 4 + size]
        at += 4 + size


class _Pieces:
    """A record and its continuations, read as one; characters that go on in a continuation begin with a byte of flags."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.pieces, self.k, self.at = pieces, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if self.at >= len(self.pieces[self.k]):
                self.k, self.at = self.k + 1, 0
            got = self.pieces[self.k][self.at : self.at + n - len(out)]
            out += got
            self.at += len(got)
        return out

    def characters(self, n: int, wide: bool) -> str:
        out = ""
        while len(out) < n:
            if self.at >= len(self.pieces[self.k]):
                self.k, self.at = self.k + 1, 1
                wide = bool(self.pieces[self.k][0] & 1)
            left = (len(self.pieces[self.k]) - self.at) // (1 + wide)
            count = min(n - len(out), max(left, 1))
            out += self.take(count * (1 + wide)).decode("utf-16-le" if wide else "latin-1", "surrogatepass" if wide else "strict")
        return out


def _strings(pieces: list[bytes]) -> list[str]:
    p = _Pieces(pieces)
    _, n = struct.unpack("<II", p.take(8))
    out = []
    for _ in range(n):
        size, flags = struct.unpack("<HB", p.take(3))
        runs = struct.unpack("<H", p.take(2))[0] if flags & 8 else 0
        more = struct.unpack("<I", p.take(4))[0] if flags & 4 else 0
        out.append(p.characters(size, bool(flags & 1)).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace"))
        p.take(4 * runs + more)
    return out


def _string(body: bytes, at: int, count: str = "<H") -> str:
    n, size = struct.unpack_from(count, body, at)[0], struct.calcsize(count)
    wide, at = body[at + size] & 1, at + size + 1
    return body[at : at + n * (1 + wide)].decode("utf-16-le" if wide else "latin-1", "replace")


def number_text(x: float) -> str:
    return str(int(x)) if x == x and abs(x) < 1e15 and x == int(x) else repr(x)


def _rk(x: int) -> str:
    value = float((x if x < 1 << 31 else x - (1 << 32)) >> 2) if x & 2 else struct.unpack("<d", struct.pack("<Q", (x & ~3) << 32))[0]
    return number_text(value / 100 if x & 1 else value)


def names_and_rows(data: bytes) -> tuple[list[tuple[str, bool]], Iterator[tuple[str, dict[int, dict[int, str]]]]]:
    """(name, whether a worksheet) of all sheets, and (name, cells by row and column) of worksheets."""
    if len(data) > MAX_BYTES:
        raise ValueError("the book is too large")
    book = stream(data, ("Workbook", "Book"))
    listed, pieces, last = [], [], 0
    for kind, body in _records(book, 0):
        if kind == _BOF and struct.unpack_from("<H", body)[0] != 0x600:
            raise ValueError("the book is older than BIFF8")
        if kind == _PASSWORD:
            raise ValueError("the book is encrypted")
        if kind == _SHEET:
            listed.append((struct.unpack_from("<I", body)[0], body[5] == 0, _string(body, 6, "<B")))
        elif kind == _SST or kind == _CONTINUE and last == _SST:
            pieces.append(body)
            kind = _SST
        elif kind == _EOF:
            break
        last = kind
    shared = _strings(pieces) if pieces else []
    return [(name, fine) for _, fine, name in listed], ((name, _cells(book, at, shared)) for at, fine, name in listed if fine)


def _cells(book: bytes, at: int, shared: list[str]) -> dict[int, dict[int, str]]:
    out: dict[int, dict[int, str]] = {}
    depth, waiting = 0, None
    for kind, body in _records(book, at):
        if kind == _BOF:
            depth += 1
        elif kind == _EOF:
            depth -= 1
            if not depth:
                break
        elif depth > 1:  # a chart within the sheet
            continue
        elif kind == _TEXT and waiting:
            out.setdefault(waiting[0], {})[waiting[1]] = _string(body, 0)
        elif kind in (_SHARED, _NUMBER, _RK, _MANY, _FORMULA, _BOOL, _LABEL, _RICH):
            row, column = struct.unpack_from("<HH", body)
            cells = out.setdefault(row, {})
            if kind == _SHARED:
                cells[column] = shared[struct.unpack_from("<I", body, 6)[0]]
            elif kind == _NUMBER:
                cells[column] = number_text(struct.unpack_from("<d", body, 6)[0])
            elif kind == _RK:
                cells[column] = _rk(struct.unpack_from("<I", body, 6)[0])
            elif kind == _MANY:
                for k in range((len(body) - 6) // 6):
                    cells[column + k] = _rk(struct.unpack_from("<I", body, 6 + 6 * k)[0])
            elif kind in (_LABEL, _RICH):
                cells[column] = _string(body, 6)
            elif kind == _BOOL:
                cells[column] = ERRORS.get(body[6], "#ERR") if body[7] else ("TRUE" if body[6] else "FALSE")
            elif body[12:14] != b"\xff\xff":
                cells[column] = number_text(struct.unpack_from("<d", body, 6)[0])
            elif body[6] == 0:
                waiting = row, column
                continue
            else:
                cells[column] = {1: "TRUE" if body[8] else "FALSE", 2: ERRORS.get(body[8], "#ERR")}.get(body[6], "")
            waiting = None
    return out
