"""Bloom filters that Spark tasks build in pieces: which hashes occur, and which occur more than once.

The filter's size follows the number of hashes up to `max_bits` (2^28 bits, 32 MiB, by default). That bound is also the bound
of what is collected and broadcast. Past it the filter lets more rows through; whoever uses it sends what passes to an exact
step, so results never depend on it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

SEGMENT = 1 << 16
MAX_BITS = 1 << 28


def positions(h: np.ndarray, bits: int, k: int) -> np.ndarray:
    """k bit positions of each 64-bit hash, as rows of k."""
    a = h.astype(np.int64).view(np.uint64)
    b = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    b ^= b >> np.uint64(29)
    step = b | np.uint64(1)
    return (a[:, None] + np.arange(k, dtype=np.uint64)[None, :] * step[:, None] + b[:, None]) & np.uint64(bits - 1)


def set_bits(bitmap: np.ndarray, pos: np.ndarray) -> None:
    """Sets sorted positions in a packed bitmap."""
    if len(pos):
        byte = (pos >> np.uint64(3)).astype(np.int64)
        one = np.left_shift(np.uint8(1), (pos & np.uint64(7)).astype(np.uint8)).astype(np.uint8)
        first = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
        bitmap[byte[first]] |= np.bitwise_or.reduceat(one, first)


def get_bits(bitmap: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return (bitmap[(pos >> np.uint64(3)).astype(np.int64)] >> (pos & np.uint64(7)).astype(np.uint8)) & 1


@dataclass(frozen=True)
class Filter:
    """A filter on the executors. `held` is a Spark broadcast of the packed bits, None where nothing was added."""

    held: Any
    bits: int
    k: int

    def has(self, h: Column) -> Column:
        """True where the hash may have been added; False is certain."""
        if self.held is None:
            return F.lit(False)
        held, bits, k = self.held, self.bits, self.k

        @F.pandas_udf("boolean")
        def test(v: pd.Series) -> pd.Series:
            return pd.Series(contains(held.value, v.to_numpy(np.int64), bits, k))

        return test(h)


def contains(packed: bytes, h: np.ndarray, bits: int, k: int) -> np.ndarray:
    bitmap = np.frombuffer(packed, np.uint8)
    return get_bits(bitmap, positions(h, bits, k).reshape(-1)).reshape(-1, k).all(axis=1)


def build(hashes: DataFrame, n: int, repeated: bool = False, bits_per_key: int = 16, k: int = 4, max_bits: int = MAX_BITS) -> Filter:
    """The filter over the one column `h` (long, not null) of `hashes`, about `n` rows. With `repeated` it keeps only the bits
    that two or more rows have set: a hash passes if another row with the same bits exists. An empty table gives a filter
    that passes nothing. Each task holds two bitmaps and sends their non-zero segments, compressed; equal segments meet in one
    task, are merged as a stream, and the driver takes `max_bits / 8` bytes at most."""
    bits = SEGMENT
    while bits < min(n * bits_per_key, max_bits):
        bits *= 2

    def fill(batches: Iterator[dict]) -> Iterator[dict]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for b in batches:
            pos, seen = np.unique(positions(b["h"].to_numpy(zero_copy_only=False), bits, k).reshape(-1), return_counts=True)
            if repeated:
                set_bits(twice, pos[(seen > 1) | (get_bits(once, pos) == 1)])
            set_bits(once, pos)
        blocks = once.reshape(-1, SEGMENT // 8)
        for part in np.array_split(np.flatnonzero(blocks.any(axis=1)), max(1, len(blocks) // 512)):
            yield {"seg": part, "once": [zlib.compress(blocks[i].tobytes(), 1) for i in part],
                   "twice": [zlib.compress(twice.reshape(blocks.shape)[i].tobytes(), 1) for i in part]}

    def merge(batches: Iterator[dict]) -> Iterator[dict]:
        now, once, twice = -1, np.zeros(0, np.uint8), np.zeros(0, np.uint8)

        def done() -> dict:
            return {"seg": [now], "bits": [zlib.compress((twice if repeated else once).tobytes(), 1)]}

        for b in batches:
            for seg, x, y in zip(b["seg"].to_pylist(), b["once"].to_pylist(), b["twice"].to_pylist(), strict=True):
                x, y = np.frombuffer(zlib.decompress(x), np.uint8), np.frombuffer(zlib.decompress(y), np.uint8)
                if seg != now:
                    if now >= 0:
                        yield done()
                    now, once, twice = seg, np.zeros(SEGMENT // 8, np.uint8), np.zeros(SEGMENT // 8, np.uint8)
                twice = twice | y | (once & x)
                once = once | x
        if now >= 0:
            yield done()

    pieces = arrow_map(hashes.select("h"), fill, "seg int, once binary, twice binary")
    merged = arrow_map(pieces.repartition("seg").sortWithinPartitions("seg"), merge, "seg int, bits binary")
    packed, found = bytearray(bits // 8), False
    for r in merged.collect():
        at, found = r.seg * (SEGMENT // 8), True
        packed[at:at + SEGMENT // 8] = zlib.decompress(bytes(r.bits))
    return Filter(hashes.sparkSession.sparkContext.broadcast(bytes(packed)) if found else None, bits, k)
