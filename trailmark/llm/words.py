"""Hashes of all words of an Arrow string column, with numpy over the raw UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=2)
def _letters(seed: int) -> np.ndarray:
    """A random 64-bit value per byte value."""
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=U)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = max(n, CHUNK + 1)
        known = np.empty(size, U)
        known[0], known[1:] = 1, U(base)
        known = _POWERS[base] = np.multiply.accumulate(known)
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64): every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows one after the other, and where each row starts (one more at the end)."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), at
    return np.frombuffer(data, np.uint8), at


# A-Z to a-z; in lower_latin also the capitals of Latin-1, whose second UTF-8 byte lies 32 below.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower(data: np.ndarray, latin: bool) -> np.ndarray:
    out = _LOWER[data]
    if latin and len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][capital] += 32
    return out


def separators(kind: str) -> np.ndarray:
    """Which byte values end a word: ``space`` (0x20, 0x09-0x0D) or ``punctuation`` (ASCII but letters and digits)."""
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    if kind == "punctuation":
        table[:128] = [not chr(i).isalnum() for i in range(128)]
    return table


def words(column: pa.Array, kind: str, *, latin: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per row with its number: word hashes, and each word's first and past-the-end byte in its row.

    Work memory is a few arrays of ``CHUNK`` bytes (longer only for one longer word) and the row's own words.
    """
    data, at = utf8(column)
    table, letters = separators(kind), _letters(7)
    row, parts = 0, []

    def flush(upto: int):
        nonlocal row, parts
        while row < upto:
            mine = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)]
            yield row, mine[0], mine[1] - at[row], mine[2] - at[row]
            row, parts = row + 1, []

    position, end = int(at[0]), int(at[-1])
    while position < end:
        stop = min(position + CHUNK, end)
        if stop < end:
            cut = stop
            while cut > position and not table[data[cut - 1]]:
                back = max(position, cut - 4096)
                hit = np.flatnonzero(table[data[back:cut]])
                cut = back + int(hit[-1]) + 1 if len(hit) else back
                if len(hit):
                    break
            if cut == position:  # one word fills the chunk: take it to its end
                cut = stop
                while cut < end and not table[data[cut]]:
                    ahead = min(end, cut + 4096)
                    hit = np.flatnonzero(table[data[cut:ahead]])
                    cut = cut + int(hit[0]) if len(hit) else ahead
            stop = cut
        raw = data[position:stop]
        inside = ~table[raw]
        borders = at[np.searchsorted(at, position, "left") : np.searchsorted(at, stop, "left")] - position
        before = np.empty(len(raw), bool)
        before[0], before[1:] = False, inside[:-1]
        before[borders] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty(len(raw), bool)
        after[-1], after[:-1] = False, inside[1:]
        after[borders[borders > 0] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        sums = np.empty(len(raw) + 1, U)
        sums[0] = 0
        np.cumsum(letters[lower(raw, latin)] * powers(_BASE, len(raw)), out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * powers(_INVERSE, len(raw))[starts] + (ends - starts).astype(U))
        owner = np.searchsorted(at, starts + position, "right") - 1
        low = 0
        for r in range(int(owner[0]) if len(owner) else row, (int(owner[-1]) if len(owner) else row - 1) + 1):
            high = int(np.searchsorted(owner, r, "right"))
            if high > low:
                yield from flush(r)
                parts.append((hashes[low:high], starts[low:high] + position, ends[low:high] + position))
            low = high
        position = stop
    yield from flush(len(at) - 1)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words."""
    if len(hashes) < n:
        return np.zeros(0, U)
    out = np.zeros(len(hashes) - n + 1, U)
    for i in range(n):
        out = out * U(_BASE) + hashes[i : len(hashes) - n + 1 + i]
    return mix(out)
