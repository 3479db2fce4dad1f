"""Content-defined runs of windows in long sequences, found with rolling hashes.

A window is ``length`` consecutive symbols. Of the ``gram`` long strings in a window, the one with the least hash is its
anchor (the leftmost of equals), so equal windows have equal anchors at equal places. Consecutive windows with the same anchor
occurrence form a run. Whatever is asked about windows can first be asked about anchors, then about whole runs, and only
for what is left about single windows: about one row for every (length - gram) / 2 symbols.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from wardline.llm.common import worker_cache

U = np.uint64
#: Odd multipliers of the two rolling hashes; together they are one hash of 128 bits.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Symbols handled at a time; longer sequences are cut into overlapping pieces.
PIECE = 1 << 20
PLACE_BITS = 21


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of each number, so that the order of the hashes is unlike that of the values."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xA0761D6478BD642F)
    return x ^ (x >> U(32))


class Powers:
    """Powers of a base and of its inverse, as far as they were needed."""

    def __init__(self, base: int):
        self.base, self.inverse = U(base), U(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, U)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            grow = lambda b: np.concatenate([np.ones(1, U), np.full(size - 1, b, U)]).cumprod(dtype=U)
            self.up, self.down = grow(self.base), grow(self.inverse)


def powers() -> list[Powers]:
    return worker_cache("powers", lambda: [Powers(b) for b in BASES])


class Runs(NamedTuple):
    """Parallel arrays: first window, number of windows, hash of the anchor, hash of all symbols of the run (two halves)."""

    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray


class Rolling:
    """Hashes of any stretch of a sequence of 64-bit symbols (at most PIECE and a window long)."""

    def __init__(self, symbols: np.ndarray):
        self.n, self.symbols = len(symbols), symbols
        self.sums: list[np.ndarray | None] = [None, None]

    def sum(self, half: int) -> np.ndarray:
        """Running sums of one half, made when first asked for."""
        if self.sums[half] is None:
            p = powers()[half]
            p.reach(self.n + 1)
            s = np.zeros(self.n + 1, U)
            np.cumsum((self.symbols if half == 0 else mixed(self.symbols)) * p.up[: self.n], out=s[1:])
            self.sums[half] = s
        return self.sums[half]

    def stretch(self, half: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        s = self.sum(half)
        return (s[end] - s[start]) * powers()[half].down[start]

    def every(self, half: int, length: int, first: int, last: int) -> np.ndarray:
        """Hashes of all stretches of one length that start from first to last - 1."""
        s = self.sum(half)
        return (s[first + length : last + length] - s[first:last]) * powers()[half].down[first:last]

    def runs(self, length: int, gram: int) -> Runs:
        windows = self.n - length + 1
        if windows <= 0:
            none = np.zeros(0, U)
            return Runs(none.astype(np.int64), none.astype(np.int64), none, none, none)
        grams = mixed(self.every(0, gram, 0, self.n - gram + 1))
        least = (grams & ~U((1 << PLACE_BITS) - 1)) | np.arange(len(grams), dtype=U)
        span, width = 1, length - gram + 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: windows], least[width - span : width - span + windows])
        place = (least & U((1 << PLACE_BITS) - 1)).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        end = np.append(start[1:], windows)
        low = mixed(self.stretch(0, start, end + length - 1))
        return Runs(start, end - start, grams[place[start]], low, mixed(self.stretch(1, start, end + length - 1)))


def pieces(symbols: np.ndarray, length: int):
    """(offset, Rolling) of overlapping pieces that together hold every window once."""
    for offset in range(0, max(1, len(symbols) - length + 1), PIECE):
        yield offset, Rolling(symbols[offset : offset + PIECE + length - 1])
