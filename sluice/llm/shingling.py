"""Hashes of words and word shingles, computed over whole buffers of texts with numpy.

A word's hash is the sum of T[byte] * R^k over its bytes (k from its start, modulo 2^64, A-Z lowered by T), mixed. Buffers are
read in pieces of ``PIECE`` bytes whatever the texts' lengths, so memory stays the same for very long texts and words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from sluice.llm.util import mix

#: Bytes hashed at a time.
PIECE = 1 << 19
#: An odd number whose powers have a long period: R - 1 is divisible by 4 and by no higher power of 2.
_R = 0xD1342543DE82EF95
_SEEDS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Alphabet:
    """Which bytes make words, and each byte's number T. folded: bytes as they count, 0x20 for those between words."""

    def __init__(self, folded: bytes) -> None:
        self.inside = np.array([b != 0x20 for b in folded])
        self.numbers = np.where(self.inside, _SEEDS[list(folded)], np.uint64(0))


#: White space ends words, A-Z count as a-z.
PLAIN = Alphabet(bytes(0x20 if 0x09 <= b <= 0x0D else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = powers(_R, PIECE)
_BACK = powers(pow(_R, -1, 1 << 64), PIECE)


def words(data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet = PLAIN) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts in one buffer, and each text's number of words. offsets: starts, and the end behind the last."""
    found, at = [], []
    carry, open_from = 0, -1  # sum so far, and start, of a word that a piece's end cuts
    base, end = int(offsets[0]), int(offsets[-1])
    for a in range(base, end, PIECE):
        b = min(end, a + PIECE)
        piece = data[a:b]
        inside = alphabet.inside[piece]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        lo, hi = np.searchsorted(offsets, [a, b])
        first = offsets[lo:hi] - a  # texts that start in this piece: words never reach over
        begins[first] = inside[first]
        goes_on = open_from >= 0 and bool(inside[0]) and not (first.size and first[0] == 0)
        if goes_on:
            begins[0] = False
        starts = np.flatnonzero(begins)
        values = alphabet.numbers[piece] * _POWERS[: len(piece)]
        if open_from >= 0:
            if goes_on:
                head = int(values[: starts[0] if starts.size else len(values)].sum())
                carry = (carry + head * pow(_R, a - open_from, 1 << 64)) % (1 << 64)
            # a word that fills the piece goes on, unless a text starts inside or a space ends it
            if goes_on and not starts.size and inside.all() and b < end:
                continue
            found.append(np.array([carry], np.uint64))
            at.append(np.array([open_from], np.int64))
            open_from = -1
        if starts.size:
            sums = np.add.reduceat(values, starts) * _BACK[starts]
            if b < end and inside[-1]:
                carry, open_from = int(sums[-1]), a + int(starts[-1])
                sums, starts = sums[:-1], starts[:-1]
            found.append(sums)
            at.append(starts + a)
    if open_from >= 0:
        found.append(np.array([carry], np.uint64))
        at.append(np.array([open_from], np.int64))
    hashes = np.concatenate(found) if found else np.empty(0, np.uint64)
    places = np.concatenate(at) if at else np.empty(0, np.int64)
    counts = np.diff(np.searchsorted(places, offsets))
    return mix(hashes), counts


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, whatever texts they are of."""
    n = len(h) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    factors = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    out = h[:n] * factors[0]
    for k in range(1, size):
        out += h[k : k + n] * factors[k]
    return mix(out)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words has one shingle, one without words none."""
    h, counts = words(data, offsets)
    every = runs(h, size)
    at = 0
    for c in counts.tolist():
        if c >= size:
            s = np.sort(every[at : at + c - size + 1])
            fresh = np.empty(len(s), bool)
            fresh[0] = True
            np.not_equal(s[1:], s[:-1], out=fresh[1:])
            yield s if fresh.all() else s[fresh]
        elif c:
            yield runs(h[at : at + c], c) + np.uint64(c)
        else:
            yield np.empty(0, np.uint64)
        at += c


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, buffer, offsets) of runs of rows of about ``most`` bytes; column: binary without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1)
        yield a, b, raw, ends[a : b + 1]
        a = b
