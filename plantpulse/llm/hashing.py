"""Vectorised hashing of the words of Arrow string columns. Pure functions on numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in slices of about this many bytes, so that arrays stay small.
SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: Byte translation: A-Z to lower case.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: White space that separates words: space and the control characters 9 to 13.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: All ASCII characters but letters and digits.
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all others (splitmix finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse, modulo 2**64."""
    if len(_POWERS["up"]) <= n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, factor in (("up", _BASE), ("down", inverse)):
            steps = np.full(max(n, SLICE_BYTES) + 1, factor, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][: n + 1], _POWERS["down"][: n + 1]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    where = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), where


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows; a long text is a run of its own."""
    if len(column) == 0:
        return
    data, offsets = string_buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Words:
    """Words of a run of texts: where they start and end, and a 64-bit hash of each.

    ``first[d]`` to ``first[d + 1]`` are the words of text ``d``. Words are runs of bytes outside
    ``separators``; bytes are translated by ``fold`` before hashing. Two words have the same hash if they are
    equal, and else with probability 2**-64.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, fold: np.ndarray = FOLD):
        n = len(data)
        inside = ~separators[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        up, self._down = _powers(n)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum((fold[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=self._sums[1:])
        self.hashes = self.span(self.starts, self.ends)

    def span(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from each start to its end."""
        raw = (self._sums[ends] - self._sums[starts]) * self._down[starts]
        return mix(raw ^ ((ends - starts).astype(np.uint64) << np.uint64(40)))


_ROLES = mix(np.arange(1, 65, dtype=np.uint64) * _BASE) | np.uint64(1)


def combine(*parts: np.ndarray | np.uint64) -> np.ndarray:
    """Hash of a sequence of 64-bit values; order counts."""
    total = parts[0] * _ROLES[0]
    for role, part in zip(_ROLES[1:], parts[1:]):
        total = total + part * role
    return mix(total ^ (np.uint64(len(parts)) << np.uint64(57)))


def shingles(words: Words, size: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of ``size`` words; a shorter text is one
    run as a whole, one without words has none."""
    h, first = words.hashes, words.first
    many = len(h) - size + 1
    runs = combine(*(h[k : k + many] for k in range(size))) if many > 0 else h[:0]
    for d in range(len(first) - 1):
        a, b = first[d], first[d + 1]
        if b - a >= size:
            yield np.unique(runs[a : b - size + 1])
        elif b > a:
            yield combine(*(h[k : k + 1] for k in range(a, b)))
        else:
            yield h[:0]


def rows_of_lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list column from one array per row."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat).cast(kind))


def runs(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size`` values from each start on; all of them must exist."""
    up, down = _powers(len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[starts + size] - sums[starts]) * down[starts] ^ np.uint64(size))
