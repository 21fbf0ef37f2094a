"""Vectorised work on the words of an Arrow string column.

A word is a maximal run of bytes other than space and ``\\t\\n\\v\\f\\r``; A-Z
are lower-cased. Words get 64-bit polynomial hashes computed for a whole chunk
of texts by prefix sums, without a Python object for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in chunks of about so many bytes; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        tables = []
        for base in (_BASE, _BASE_INV):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        if size > 8 * CHUNK_BYTES:
            return tables[0], tables[1]  # for one very long text: not kept
        _powers[:] = tables
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the len + 1 offsets into them; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def chunks(at: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes."""
    first, n = 0, len(at) - 1
    while first < n:
        last = int(np.searchsorted(at, at[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


class Words:
    """The words of the texts ``first..last`` of a buffer.

    ``row``: each word's text, counted from ``first``; ``start`` and ``end``:
    byte positions in ``raw``; ``hash``: of the lower-cased word.
    """

    def __init__(self, raw: np.ndarray, at: np.ndarray, first: int, last: int, fold: np.ndarray = _LOWER, gap: np.ndarray = _SPACE):
        lo, hi = int(at[first]), int(at[last])
        self.raw, self.rows = raw, last - first
        piece = raw[lo:hi]
        solid = ~gap[piece]
        n = len(piece)
        if n == 0:
            self.row = np.zeros(0, np.int64)
            self.start = self.end = self.row
            self.hash = np.zeros(0, np.uint64)
            return
        bounds = at[first : last + 1] - lo
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        opens = solid.copy()
        opens[1:] &= ~solid[:-1] | edge[1:n]
        closes = solid.copy()
        closes[:-1] &= ~solid[1:] | edge[1:n]
        start = np.flatnonzero(opens)
        end = np.flatnonzero(closes) + 1
        up, down = _power_tables(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[fold[piece]] * up[:n], out=total[1:])
        self.hash = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
        self.row = np.searchsorted(bounds, start, side="right") - 1
        self.start, self.end = start + lo, end + lo

    def per_row(self) -> np.ndarray:
        """Number of words of each text."""
        return np.bincount(self.row, minlength=self.rows)

    def word(self, k: int) -> str:
        return self.raw[self.start[k] : self.end[k]].tobytes().decode(errors="replace")


_ROLL = np.uint64(0xD6E8FEB86659FD93)


def shingles(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text.

    Returns (row, hash, first word) sorted by row and hash. A text of fewer
    than ``width`` words, but at least one, has its whole sequence as its only
    shingle; a text without words has none.
    """
    h, row = words.hash, words.row
    count = words.per_row()
    if not len(h):
        return row, h, row
    begin = np.concatenate(([0], np.cumsum(count)))[:-1]
    place = np.arange(len(h)) - begin[row]
    left = count[row] - place
    value = h.copy()
    reach = np.minimum(count, width)[row]
    for k in range(1, width):
        if len(h) > k:
            on = np.flatnonzero((reach[:-k] > k) & (left[:-k] > k))
            value[on] = value[on] * _ROLL + h[on + k]
    keep = np.flatnonzero((left >= width) | (place == 0))
    value = mix(value[keep] + reach[keep].astype(np.uint64))
    who = row[keep]
    order = np.lexsort((value, who))
    value, who, keep = value[order], who[order], keep[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (who[1:] != who[:-1])
    return who[fresh], value[fresh], keep[fresh]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
