"""Recompression of token sequences: rounds that name runs, then pairs, alike wherever the tokens are alike.

A symbol's name is a hash of what it stands for, so every task gives equal runs and pairs the same name. Each round replaces runs of
one symbol, then pairs whose first symbol has the coin 0 and whose second has the coin 1; coins are hashes of names and rounds.
Each symbol keeps the stretch of tokens that its name and borders depend on. Where a stretch lies inside a window, the symbol is
inside every other window of the same tokens too, at the same place.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ROUNDS = 3
JOINED = 3


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b + np.uint64(0x632BE59BD9B4E019)))


@dataclass
class Symbols:
    """Symbols in order: name, first and last + 1 token of the stretch they depend on, and the piece they belong to. A stretch that
    leaves its piece ends one token outside of it."""

    name: np.ndarray
    low: np.ndarray
    high: np.ndarray
    piece: np.ndarray


def _around(s: Symbols, first: np.ndarray, last: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches that take in the symbols before `first` and after `last`, or pass the piece's border."""
    n, piece = len(s.name), s.piece[first]
    prev, after = np.maximum(first - 1, 0), np.minimum(last + 1, n - 1)
    low = np.where((first > 0) & (s.piece[prev] == piece), s.low[prev], begin[piece] - 1)
    high = np.where((last < n - 1) & (s.piece[after] == piece), s.high[after], end[piece] + 1)
    return low, high


def recompress(tokens: np.ndarray, lengths: np.ndarray, rounds: int = ROUNDS) -> Symbols:
    """Symbols of pieces of `lengths` tokens (uint64) that lie one after the other."""
    end = np.cumsum(lengths)
    begin = end - lengths
    at = np.arange(len(tokens))
    s = Symbols(tokens, at, at + 1, np.repeat(np.arange(len(lengths)), lengths))
    for r in range(rounds):
        if not len(s.name):
            break
        same = (s.name[1:] == s.name[:-1]) & (s.piece[1:] == s.piece[:-1])
        first = np.flatnonzero(np.r_[True, ~same])
        count = np.diff(np.r_[first, len(s.name)])
        last = first + count - 1
        low, high = _around(s, first, last, begin, end)
        name = s.name[first]
        s = Symbols(np.where(count > 1, join(name, count.astype(np.uint64)), name), np.minimum(low, s.low[first]), np.maximum(high, s.high[last]), s.piece[first])

        coin = (mix(s.name + np.uint64((r + 1) * 0xA0761D6478BD642F % 2**64)) >> np.uint64(17)) & np.uint64(1)
        pair = np.r_[(coin[:-1] == 0) & (coin[1:] == 1) & (s.piece[1:] == s.piece[:-1]), False]
        second = np.r_[False, pair[:-1]]
        i = np.arange(len(coin))
        low, high = _around(s, i, i, begin, end)
        low = np.where((coin == 1) & ~second, np.minimum(s.low, low), s.low)
        high = np.where((coin == 0) & ~pair, np.maximum(s.high, high), s.high)
        other = np.minimum(i + 1, len(i) - 1)
        s = Symbols(np.where(pair, join(s.name, s.name[other]), s.name)[~second], low[~second], np.where(pair, s.high[other], high)[~second], s.piece[~second])
    return s


def anchors(s: Symbols, joined: int = JOINED) -> Symbols:
    """Every `joined` neighbouring symbols of a piece, as one symbol."""
    n = len(s.name) - joined + 1
    if n <= 0:
        return Symbols(s.name[:0], s.low[:0], s.high[:0], s.piece[:0])
    name = s.name[:n]
    for k in range(1, joined):
        name = join(name, s.name[k:k + n])
    ok = s.piece[:n] == s.piece[joined - 1:]
    return Symbols(name[ok], s.low[:n][ok], s.high[joined - 1:][ok], s.piece[:n][ok])


def chosen(a: Symbols, starts: np.ndarray, width: int) -> np.ndarray:
    """For each window, the anchor of least name among those whose stretch lies inside; -1 where there is none."""
    if not len(a.name):
        return np.full(len(starts), -1)
    first = np.searchsorted(a.low, starts, "left")
    stop = np.searchsorted(a.high, starts + width, "right")
    size = stop - first
    out = np.full(len(starts), -1)
    level, least, step = 0, np.arange(len(a.name)), 1
    while True:
        here = (size >= step) & (size < 2 * step)
        x, y = least[first[here]], least[stop[here] - step]
        out[here] = np.where(a.name[y] < a.name[x], y, x)
        if not (size >= 2 * step).any():
            return out
        right = np.minimum(np.arange(len(least)) + step, len(least) - 1)
        least = np.where(a.name[least[right]] < a.name[least], least[right], least)
        level, step = level + 1, step * 2


def window_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    """A hash of every `width` tokens in a row, from hashes of 1, 2, 4, .. tokens."""
    n = len(tokens) - width + 1
    if n <= 0:
        return tokens[:0]
    level, size, out, done = mix(tokens + np.uint64(0x1234567)), 1, None, 0
    while size <= width:
        if width & size:
            part = level[done:done + n]
            out = part if out is None else join(out, part)
            done += size
        level, size = join(level[:-size], level[size:]), size * 2
    return out
