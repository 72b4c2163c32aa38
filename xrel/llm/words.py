"""Words of Arrow text columns as NumPy arrays: places, hashes and shingles, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# Words between ASCII white space.
BETWEEN_SPACES = bytes(0 if b == 32 or 9 <= b <= 13 else 1 for b in range(256))
# Runs of digits, lower-case letters and everything beyond ASCII.
LETTERS_DIGITS = bytes(1 if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256))
SLICE_BYTES = 1 << 20
# Words are hashed in blocks of so many bytes, whose arrays stay near the processor.
HASHED_BYTES = 1 << 16
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values (the finaliser of a well-known generator)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them), at most `limit` bytes unless one row is longer."""
    if pa.types.is_dictionary(column.type):
        column = column.cast(pa.string())
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    bounds, data = column.buffers()[1:]
    n = len(column)
    if n == 0 or bounds is None:
        return
    offsets = np.frombuffer(bounds, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    if column.null_count:
        # What lies behind a null is not text.
        sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
        if sizes.sum() != offsets[-1] - offsets[0]:
            column = column.fill_null("")
            yield from text_slices(column, limit)
            return
    view = memoryview(data) if data is not None else memoryview(b"")
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, bytes(view[offsets[at] : offsets[end]]), offsets[at : end + 1] - offsets[at]
        at = end


@dataclass
class Words:
    data: bytes
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray  # row of each word within the slice
    first: np.ndarray  # first word of each row, and the number of words

    def hashes(self) -> np.ndarray:
        """A 64-bit hash per word, in blocks so that memory stays bounded for long texts."""
        raw = np.frombuffer(self.data, np.uint8)
        out = np.empty(len(self.start), np.uint64)
        at = 0
        while at < len(out):
            stop = max(at + 1, int(np.searchsorted(self.end, self.start[at] + HASHED_BYTES, "right")))
            lo, hi = int(self.start[at]), int(self.end[stop - 1])
            powers, inverse = _powers(hi - lo + 1)
            sums = np.zeros(hi - lo + 1, np.uint64)
            terms = raw[lo:hi].astype(np.uint64)
            terms += np.uint64(1)
            terms *= powers[: hi - lo]
            np.cumsum(terms, out=sums[1:])
            s, e = self.start[at:stop] - lo, self.end[at:stop] - lo
            out[at:stop] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
            at = stop
        return out

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].decode()


_TABLES: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand and kept in the worker."""
    if not _TABLES or len(_TABLES[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        inverse = pow(int(_P), -1, 1 << 64)
        tables = []
        for p in (int(_P), inverse):
            table = np.full(size, p, np.uint64)
            table[0] = 1
            tables.append(np.cumprod(table))
        if size > 8 * SLICE_BYTES:
            return tables[0], tables[1]
        _TABLES[:] = tables
    return _TABLES[0], _TABLES[1]


def scan(data: bytes, offsets: np.ndarray, table: bytes) -> Words:
    """Runs of the bytes that `table` marks, never across rows."""
    n = len(data)
    mask = np.frombuffer(data.translate(table), np.uint8).astype(bool)
    begins, ends = mask.copy(), mask.copy()
    if n:
        begins[1:] &= ~mask[:-1]
        ends[:-1] &= ~mask[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        begins[edges] |= mask[edges]
        ends[edges - 1] |= mask[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return Words(data, start, end, row, np.searchsorted(start, offsets))


def shingles(h: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of all runs of `size` words within one row."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, size):
        out *= _Q
        out += h[j : j + n]
    whole = np.flatnonzero(row[:n] == row[size - 1 :])
    return whole, mix(out[whole] + np.uint64(size))


def joined_hash(h: np.ndarray) -> np.uint64:
    """The hash of a run as shingles() gives it."""
    return shingles(h, np.zeros(len(h), np.int64), len(h))[1][0]
