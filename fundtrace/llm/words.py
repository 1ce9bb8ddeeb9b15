"""Words of a text column as 64-bit hashes, found with numpy in the column's own UTF-8 buffer.

A word is a maximal run of bytes that are no separators. Its hash is a polynomial over per-byte random
numbers, taken from one prefix sum per block, so no Python string is made. Blocks end at separators
and hold about ``BLOCK`` bytes: a very long text takes no more working memory than many short ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LANES = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_U = np.uint64


def separators(characters: bytes) -> np.ndarray:
    """Lookup table that marks the given bytes."""
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


SPACES = separators(b"\x20\x09\x0a\x0b\x0c\x0d")
# Everything in ASCII but letters and digits.
PUNCTUATION = separators(bytes(b for b in range(128) if not chr(b).isalnum()))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


class _Powers:
    """Powers of the multiplier and of its inverse, made where they are used and never sent along."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def __getstate__(self) -> dict:
        return {"up": np.zeros(0, np.uint64), "down": np.zeros(0, np.uint64)}

    def tables(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < size:
            size = max(size, BLOCK + (BLOCK >> 2))
            up, down = np.full(size, _MULTIPLIER, _U), np.full(size, pow(_MULTIPLIER, -1, 1 << 64), _U)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)
        return self.up, self.down


_POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (starting at 0) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _blocks(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about BLOCK bytes that end where no word goes on."""
    begin, size = 0, len(data)
    while begin < size:
        end = begin + BLOCK
        if end >= size:
            yield begin, size
            return
        row_end = int(offsets[np.searchsorted(offsets, end)])
        at = end
        while at < row_end:
            found = np.flatnonzero(separator[data[at : min(at + 65536, row_end)]])
            if len(found):
                row_end = at + int(found[0])
                break
            at += 65536
        yield begin, min(row_end, size)
        begin = row_end


def positions(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACES):
    """Per block: its begin, its end, and the begins and ends of the words in it."""
    for begin, end in _blocks(data, offsets, separator):
        part = separator[data[begin:end]]
        before, after = np.empty(end - begin, bool), np.empty(end - begin, bool)
        before[0] = after[-1] = True
        before[1:], after[:-1] = part[:-1], part[1:]
        rows = offsets[np.searchsorted(offsets, begin, "right") : np.searchsorted(offsets, end, "left")] - begin
        before[rows], after[rows - 1] = True, True
        yield begin, end, np.flatnonzero(before & ~part) + begin, np.flatnonzero(after & ~part) + begin + 1


class Words:
    """Words of a column: ``hashes``, ``begin`` and ``end`` (byte positions), and per row ``bounds``."""

    def __init__(self, column: pa.Array, separator: np.ndarray = SPACES, lower: np.ndarray | None = LOWER, prefixes=()):
        self.data, self.offsets = buffers(column)
        hashes, begins, ends = [], [], []
        parts: list[list[np.ndarray]] = [[] for _ in prefixes]
        for a, b, starts, stops in positions(self.data, self.offsets, separator):
            up, down = _POWERS.tables(b - a + 1)
            block = self.data[a:b] if lower is None else lower[self.data[a:b]]
            total = np.empty(b - a + 1, _U)
            total[0] = 0
            np.cumsum(_BYTE[block] * up[: b - a], dtype=_U, out=total[1:])
            hashes.append(mix((total[stops - a] - total[starts - a]) * down[starts - a]))
            for k, length in enumerate(prefixes):
                cut = np.minimum(starts + length, stops) - a
                parts[k].append(mix((total[cut] - total[starts - a]) * down[starts - a] + _LANES[length]))
            begins.append(starts)
            ends.append(stops)
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, _U)
        self.begin = np.concatenate(begins) if begins else np.zeros(0, np.int64)
        self.end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        self.prefixes = [np.concatenate(p) if p else np.zeros(0, _U) for p in parts]
        self.bounds = np.searchsorted(self.begin, self.offsets).astype(np.int64)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``size`` words and, per run, whether it lies within one row."""
        count = len(self.hashes) - size + 1
        if count <= 0:
            return np.zeros(0, _U), np.zeros(0, bool)
        total = np.zeros(count, _U)
        for k in range(size):
            total += self.hashes[k : k + count] * _LANES[k]
        row_end = np.repeat(self.bounds[1:], np.diff(self.bounds))[:count]
        return mix(total), np.arange(count) + size <= row_end
