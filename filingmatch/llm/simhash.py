"""Near-duplicates by SimHash with deletion-variant signatures.

A fingerprint has 64 bits over the XXH64 (seed 42) of a text's word shingles, repeats included; a bit is 1 if it is set in over
half of them. Fingerprints within `2` bits are linked. Cut into two halves, two such fingerprints have one half that differs by
one bit at most, so for each half and each of its 32 places the half without that bit is an index key, and linked fingerprints
share a key. Equal keys meet (equal fingerprints have become one before), the full distance is verified, and of each key only
links that join something new are kept: no group sends all its pairs. Keys with more than `most` fingerprints are never held
in memory; they are indexed again by whole fingerprints with two bits deleted, whose groups have four members at most and
need no verification. Links become components.

A null text or one without words has fingerprint zero and is linked like any other; fewer words than a shingle make one. Rows
with a null id belong to the component of their text, whose id is null only if no member has one. Repeated rows come out
repeated. An empty table gives no rows. Other columns do not matter.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import bits
from .common import arrow_map, join_back
from .components import components

NEAR = 2
MOST = 2048


def fingerprint(text: bytes, words: int = 3) -> int:
    """Unsigned 64-bit fingerprint of UTF-8 text. bytes.lower and bytes.split touch A-Z and ASCII white space only."""
    w = text.lower().split()
    if not w:
        return 0
    parts = zip(*[w[i:] for i in range(words)], strict=False) if len(w) >= words else [w]
    digest, join = xxhash.xxh64_digest, b" ".join
    h = np.frombuffer(b"".join([digest(join(p), 42) for p in parts]), np.uint8).reshape(-1, 8)
    ones = sum(np.unpackbits(h[i:i + 65536], axis=1).sum(axis=0, dtype=np.int64) for i in range(0, len(h), 65536))
    return struct.unpack(">Q", np.packbits(ones * 2 > len(h)).tobytes())[0]


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and `fp`, the fingerprint as a signed long."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            fp = np.array([fingerprint(t or b"", words) for t in b["t"].to_pylist()], np.uint64).view(np.int64)
            yield {"doc_id": b["doc_id"], "fp": fp}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("t")), run, "doc_id long, fp long")


def _variants(batches: Iterator[dict]) -> Iterator[dict]:
    """(key, fp): number of the half, deleted place and the rest of the half."""
    place = np.arange(32, dtype=np.uint64)
    for b in batches:
        fp = b["fp"].to_numpy(zero_copy_only=False)
        for part in np.array_split(fp, len(fp) // 4096 + 1):
            u = part.view(np.uint64)
            keys = [(np.uint64(s) << np.uint64(37)) | (place << np.uint64(32)) | (((u[:, None] >> np.uint64(32 * s)) & np.uint64(0xFFFFFFFF)) & ~(np.uint64(1) << place))
                    for s in (0, 1)]
            yield {"key": np.concatenate(keys, axis=1).reshape(-1).view(np.int64), "fp": np.repeat(part, 64)}


def _apart(key: np.ndarray, xor: np.ndarray) -> np.ndarray:
    """Whether pairs under a key are linked and counted there: pairs whose half is equal share all 32 places and count at 0."""
    at = ((key >> 32) & 31) + 32 * (key >> 37)
    differ = (xor.view(np.uint64) >> at.view(np.uint64)) & np.uint64(1)
    return (np.bitwise_count(xor.view(np.uint64)) <= NEAR) & ((differ == 1) | (at % 32 == 0))


def _forest(key: int, fp: np.ndarray) -> list[tuple[int, int]]:
    """Links among the fingerprints of one key that keep them as connected as all their links do."""
    out, label = [], np.arange(len(fp))
    for j in range(1, len(fp)):
        near = np.flatnonzero(_apart(np.full(j, key, np.int64), fp[:j] ^ fp[j]))
        if len(near):
            groups, first = np.unique(label[near], return_index=True)
            out += [(int(fp[near[i]]), int(fp[j])) for i in first]
            label[:j][np.isin(label[:j], groups)] = j
    return out


def _links(most: int):
    def groups(key: np.ndarray, fp: np.ndarray) -> Iterator[dict]:
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        two = start[size == 2]
        good = two[_apart(key[two], fp[two] ^ fp[two + 1])]
        yield {"a": fp[good], "b": fp[good + 1], "key": np.full(len(good), -1)}
        for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            got = _forest(int(key[s]), fp[s:s + n])
            if got:
                a, b = zip(*got, strict=True)
                yield {"a": a, "b": b, "key": [-1] * len(a)}

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        """Streams sorted keys; a key with more than `most` members is passed on, row by row, as (fp, fp, key)."""
        keys, fps, wide = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for b in batches:
            keys = np.concatenate([keys, b["key"].to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, b["fp"].to_numpy(zero_copy_only=False)])
            while len(keys):
                n = int(np.searchsorted(keys, keys[0], "right"))
                if keys[0] == wide or n > most:
                    wide = keys[0]
                    yield {"a": fps[:n], "b": fps[:n], "key": keys[:n]}
                    keys, fps = keys[n:], fps[n:]
                    continue
                runs = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                big = np.flatnonzero(np.diff(np.r_[runs, len(keys)]) > most)
                end = int(runs[big[0]]) if len(big) else int(runs[-1])
                if end:
                    yield from groups(keys[:end], fps[:end])
                    keys, fps = keys[end:], fps[end:]
                if not len(big):
                    break
        if len(keys):
            yield from groups(keys, fps)

    return run


def _two_deleted(batches: Iterator[dict]) -> Iterator[dict]:
    """Members of a wide key as whole fingerprints with two places deleted: this half's place and one of the other half, and,
    under place 0 only, two places of the other half."""
    for b in batches:
        for fp, key in zip(b["a"].to_pylist(), b["key"].to_pylist(), strict=True):
            at, other = ((key >> 32) & 31) + 32 * (key >> 37), 32 * (1 - (key >> 37))
            pairs = [(at, other + j) for j in range(32)]
            if at % 32 == 0:
                pairs += [(other + i, other + j) for i in range(32) for j in range(i)]
            mask = np.array([(1 << i) | (1 << j) for i, j in pairs], np.uint64)
            yield {"rest": (np.array([fp]).view(np.uint64) & ~mask).view(np.int64), "mask": mask.view(np.int64), "fp": [fp] * len(pairs)}


def _first_to_each(batches: Iterator[dict]) -> Iterator[dict]:
    now = first = None
    for b in batches:
        out = []
        for rest, mask, fp in zip(b["rest"].to_pylist(), b["mask"].to_pylist(), b["fp"].to_pylist(), strict=True):
            if (rest, mask) != now:
                now, first = (rest, mask), fp
            elif fp != first:
                out.append((first, fp))
        yield {"a": [x[0] for x in out], "b": [x[1] for x in out]}


def near_links(fps: DataFrame, most: int = MOST) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough to connect all that are within two bits of each other."""
    index = arrow_map(fps.select("fp"), _variants, "key long, fp long")
    found, _ = stored(arrow_map(index.repartition("key").sortWithinPartitions("key"), _links(most), "a long, b long, key long"), "links")
    wide = arrow_map(found.where("key >= 0"), _two_deleted, "rest long, mask long, fp long")
    more = arrow_map(wide.repartition("rest", "mask").sortWithinPartitions("rest", "mask"), _first_to_each, "a long, b long")
    return found.where("key < 0").select("a", "b").unionByName(more)


def fingerprint_groups(rows: DataFrame, most: int = MOST) -> DataFrame:
    """One row per distinct fingerprint of `rows` (doc_id, fp): fp, n rows, component_id, `root` (the component's smallest
    fingerprint) and `members` (its rows)."""
    fps, _ = stored(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")), "fingerprints")
    roots, _ = stored(components(near_links(fps, most)).withColumnRenamed("node", "fp"), "roots")
    linked = fps.join(roots, "fp")
    whole = linked.groupBy("root").agg(F.min("first_id").alias("component_id"), F.sum("n").alias("members"), F.count(F.lit(1)).alias("k"))
    whole, _ = stored(whole, "components")
    placed = join_back(linked.select("fp", "n", "root"), whole, "root", "k").select("fp", "n", "component_id", "root", "members")
    alone = fps.join(roots, "fp", "left_anti").select("fp", "n", F.col("first_id").alias("component_id"), F.col("fp").alias("root"), F.col("n").alias("members"))
    return stored(placed.unionByName(alone), "groups")[0]


def near_duplicates(docs: DataFrame, words: int = 3, most: int = MOST) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of `docs` (doc_id, text)."""
    rows, _ = stored(fingerprints(docs, words), "rows")
    met = join_back(rows, fingerprint_groups(rows, most), "fp", "n")
    return met.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 3, most: int = MOST) -> DataFrame:
    """`docs` with the row of the smallest doc_id of each component (a null id last), all columns kept. Rows whose fingerprint
    is in no larger group are not shuffled."""
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("t"))

    @F.pandas_udf("long")
    def fp_of(t):
        return t.map(lambda x: np.uint64(fingerprint(bytes(x or b""), words)).astype(np.int64))

    rows, _ = stored(packed.select("row", "doc_id", fp_of("t").alias("fp")), "rows")
    groups = fingerprint_groups(rows.select("doc_id", "fp"), most)
    shared = groups.where("members > 1")
    many, _ = stored(shared.select("fp", "n", "root"), "shared")
    crowd = bits.build(many.select(F.col("fp").alias("h")), many.count())
    tested = rows.withColumn("crowd", crowd.has(F.col("fp")))
    alone = tested.where(~F.col("crowd")).select("row")
    met = join_back(tested.where("crowd").drop("crowd"), many, "fp", "n")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("row.text"))
    one = met.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min_by("row", order).alias("row")).select("row")
    return alone.unionByName(one).select("row.*")
