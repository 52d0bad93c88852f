"""Vectorised text primitives over Arrow batches.

A batch's strings are one byte buffer with offsets, so words, lines and their
hashes come from whole-array operations; no Python object is made per word.
Buffers are worked through in pieces of a few MB to keep memory bounded.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 4 << 20
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

#: 0x20 and 0x09-0x0D
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


BYTE_CODE = mix(np.arange(1, 257, dtype=U))


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        steps = np.full(size, base, U)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps)
    return have[:n]


class PrefixHash:
    """Polynomial hashes of any slice of a code array in constant time each."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(codes * powers(_BASE, n), out=self.sums[1:])
        self.back = powers(_INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Raw hashes: sums of code[i] * base**(i - start)."""
        return (self.sums[end] - self.sums[start]) * self.back[start]


def shifted(n: np.ndarray) -> np.ndarray:
    """base**n, to join raw hashes: h(ab) = h(a) + h(b) * shifted(len(a))."""
    top = int(n.max()) + 1 if len(n) else 1
    return powers(_BASE, top)[n]


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of at most ``limit`` bytes, or of one longer row. Nulls read as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "")
        if not pa.types.is_large_string(text.type):
            text = text.cast(pa.large_string())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
        at = 0
        while at < len(text):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            own = offsets[at : to + 1]
            yield batch.slice(at, to - at), data[own[0] : own[-1]], own - own[0]
            at = to


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside``, cut at row ends, and each row's first run."""
    n = len(inside)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = offsets[:-1][offsets[:-1] < n]
    first[at] = inside[at]
    at = offsets[1:][offsets[1:] > 0] - 1
    last[at] = inside[at]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word, and each row's first word (one more entry than rows)."""
    start, end, bounds = spans(~space[data], offsets)
    codes = (BYTE_CODE[LOWER] if lower else BYTE_CODE)[data]
    return mix(PrefixHash(codes).of(start, end) + (end - start).astype(U)), start, end, bounds


_STEPS = mix(np.arange(1, 65, dtype=U) * U(0x2545F4914F6CDD1D)) | U(1)


def shingles(h: np.ndarray, bounds: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of k words inside a row, and the rows they belong to.

    A row with 1 to k-1 words gives its whole sequence as one shingle; a row
    without words gives none."""
    n = np.diff(bounds)
    row = np.repeat(np.arange(len(n)), n)
    full = np.arange(len(h)) + k <= bounds[1:][row] if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(full)
    total = np.zeros(len(at), U)
    for j in range(k):
        total += h[at + j] * _STEPS[j]
    short = np.flatnonzero((n > 0) & (n < k))
    rest = n[short].astype(U) * U(0x9FB21C651E98DF25)
    for j in range(k - 1):
        has = n[short] > j
        rest[has] += h[bounds[short[has]] + j] * _STEPS[j]
    return mix(np.concatenate([total, rest])), np.concatenate([row[at], short])


def distinct_sets(values: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of every row, sorted, and the rows' bounds in them."""
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[new], np.searchsorted(row[new], np.arange(rows + 1))
