"""Hard-negative mining with length buckets and coordinate pruning.

The index is a table of length buckets: rows sorted by length (Euclidean norm, longest first) in range partitions and cut into buckets of at
most `BUCKET` rows whose lengths are within a factor; a bucket holds its integer vectors and, for each coordinate, the order of its
rows by that coordinate of the unit vector. Anchors are taken in blocks of bounded size, which are broadcast. A task goes through its buckets and
keeps, per anchor, the best rows so far; their last score is the threshold for what follows:

- a bucket whose longest row can't reach the threshold is left out for the anchor;
- otherwise the threshold over the lengths bounds the cosine, and the cosine bounds each coordinate of a partner: a feasible range of each of
  the anchor's `FOCUS` largest coordinates. Ranges are cut out of the sorted lists by binary search and intersected, shortest first;
- what is left is verified by exact integer inner products. Where no range is shorter than a part of the bucket, all of its rows are verified at once.

A first pass finds each anchor's best rows of its own label, a second one, for each of those, the best rows of other labels within the score
range. Tasks send no more than the wanted number of rows per anchor or pair, and those are ranked by window.

Rows with a null label, a null vector or any null or non-finite component take no part. Vectors meet only if they have the same number of
components; a vector without components scores 0. A repeated row is another row. A null vec_id sorts last in ties and is no anchor's id unless
the caller's predicate says so. Components and scores have to fit a long. An empty table or one without anchors gives no rows. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .common import arrow_map
from .ordering import numbered

BUCKET, SHRINK, FOCUS, DENSE = 1024, 0.9, 5, 0.25
#: Anchors of one block, and bytes of their vectors at most.
ANCHORS, ANCHOR_BYTES = 8192, 16 << 20
#: Anchors scored against a bucket at once.
TOGETHER = 1024
EXACT = float(1 << 53)
_INDEX = "bucket long, dims int, ids binary, noid binary, labels binary, vectors binary, lists binary"
_NO_ID = np.iinfo(np.int64).max


def quantised(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, v (floor of scale times each component) and its length, of rows that take part."""
    broken = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | F.isnan(x - x))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    some = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~broken)
    some = some.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("v"))
    return some.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))


def _packed(bucket: int, ids: list, labels: list, vectors: np.ndarray) -> dict:
    n, d = vectors.shape
    lengths = np.sqrt((vectors.astype(float) ** 2).sum(1))
    unit = vectors / np.where(lengths > 0, lengths, 1)[:, None]
    small = not vectors.size or np.abs(vectors).max() < 1 << 31
    return {"bucket": bucket, "dims": d, "ids": np.array([_NO_ID if i is None else i for i in ids], "<i8").tobytes(), "noid": np.array([i is None for i in ids], bool).tobytes(),
            "labels": np.array(labels, "<i8").tobytes(), "vectors": vectors.astype("<i4" if small else "<i8").tobytes(), "lists": np.argsort(unit, axis=0, kind="stable").T.astype("<u2").tobytes()}


def index(rows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """The length buckets of quantised rows."""
    order = [F.size("v"), F.desc("length"), F.col("vec_id")]

    def run(batches: Iterator[dict]) -> Iterable[dict]:
        number, held, longest = TaskContext.get().partitionId() << 33, [], 0.0
        for b in batches:
            out = []
            for row in zip(*(b[c].to_pylist() for c in ("vec_id", "label", "v", "length"))):
                if held and (len(held) >= bucket or len(row[2]) != len(held[0][2]) or row[3] < SHRINK * longest):
                    out.append(made(number, held))
                    number, held = number + 1, []
                longest = longest if held else row[3]
                held.append(row)
            if out:
                yield {c: [x[c] for x in out] for c in out[0]}
        if held:
            yield {c: [x] for c, x in made(number, held).items()}

    def made(number: int, held: list) -> dict:
        ids, labels, vectors, _ = zip(*held)
        return _packed(number, ids, labels, np.array(vectors, dtype=np.int64).reshape(len(held), -1))

    return arrow_map(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("vec_id", "label", "v", "length"), run, _INDEX)


class Bucket:
    def __init__(self, row: dict):
        self.number, self.dims = row["bucket"], row["dims"]
        self.ids, self.labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
        self.noid = np.frombuffer(row["noid"], bool)
        n = len(self.ids)
        self.vectors = np.frombuffer(row["vectors"], "<i4" if len(row["vectors"]) == 4 * n * self.dims else "<i8").reshape(n, self.dims).astype(float)
        self.raw = row["vectors"], n
        self.lists = np.frombuffer(row["lists"], "<u2").reshape(self.dims, n)
        self.lengths = np.sqrt((self.vectors ** 2).sum(1))
        self.unit = self.vectors / np.where(self.lengths > 0, self.lengths, 1)[:, None]
        self.longest = float(self.lengths.max())

    def whole(self) -> np.ndarray:
        """The vectors as Python integers, for products beyond what a double holds."""
        raw, n = self.raw
        return np.frombuffer(raw, "<i4" if len(raw) == 4 * n * self.dims else "<i8").reshape(n, self.dims).astype(object)


class Anchors:
    """A block of anchors with equally many components."""

    def __init__(self, slots: np.ndarray, labels: np.ndarray, own: list[tuple[int, int]], vectors: np.ndarray):
        self.slots, self.labels, self.whole = slots, labels, vectors
        self.own = {}
        for at, (bucket, place) in enumerate(own):
            self.own.setdefault(bucket, []).append((at, place))
        self.vectors = vectors.astype(float)
        self.lengths = np.sqrt((self.vectors ** 2).sum(1))
        self.unit = self.vectors / np.where(self.lengths > 0, self.lengths, 1)[:, None]
        k = min(FOCUS, vectors.shape[1])
        self.focus = np.argsort(-np.abs(self.unit), axis=1, kind="stable")[:, :k]

    def candidates(self, b: Bucket, least: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Anchors that need all rows of the bucket, and (anchor, rows) for those whose ranges say more. `least`: thresholds."""
        reach = self.lengths * b.longest
        cosine = np.where(least <= 0, -1.0, np.divide(least, reach, out=np.full(len(least), np.inf), where=reach > 0))
        alive = cosine <= 1 + 1e-9
        ranged = alive & (cosine > 0)
        if not ranged.any() or not self.focus.shape[1]:
            return np.flatnonzero(alive), []
        # unit vectors at an angle of at most `turn` have coordinates whose own angles to the axis differ by at most `turn`
        values = np.take_along_axis(self.unit, self.focus, 1)
        own, turn = np.arccos(np.clip(values, -1, 1)), np.arccos(np.clip(cosine, -1, 1))[:, None]
        low, high = np.cos(np.minimum(np.pi, own + turn)) - 1e-9, np.cos(np.maximum(0, own - turn)) + 1e-9
        first, last = np.zeros(self.focus.shape, int), np.full(self.focus.shape, len(b.ids))
        for c in np.unique(self.focus[ranged]):
            rows, cols = np.nonzero((self.focus == c) & ranged[:, None])
            values_c = b.unit[b.lists[c], c]
            first[rows, cols] = np.searchsorted(values_c, low[rows, cols], "left")
            last[rows, cols] = np.searchsorted(values_c, high[rows, cols], "right")
        width = (last - first).min(1)
        full = alive & (~ranged | (width > DENSE * len(b.ids)))
        few = []
        for a in np.flatnonzero(alive & ~full & (width > 0)):
            order = np.argsort(last[a] - first[a], kind="stable")
            c = self.focus[a, order[0]]
            got = b.lists[c, first[a, order[0]]:last[a, order[0]]].astype(int)
            for k in order[1:]:
                x = b.unit[got, self.focus[a, k]]
                got = got[(x >= low[a, k]) & (x <= high[a, k])]
            if len(got):
                few.append((a, got))
        return np.flatnonzero(full), few

    def meets(self, b: Bucket, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Arrays of (anchor, row of the bucket, exact score) of all pairs that score at least `least`, an anchor itself left out."""
        every, few = self.candidates(b, least)
        exact = self.lengths.max() * b.longest < EXACT
        for at in range(0, len(every), TOGETHER):
            some = every[at:at + TOGETHER]
            scores = self.vectors[some] @ b.vectors.T if exact else self.whole[some].astype(object) @ b.whole().T
            rows, cols = np.nonzero(scores >= least[some][:, None])
            yield self._others(b, some[rows], cols, scores[rows, cols])
        if few:
            rows, cols = np.concatenate([np.full(len(c), a) for a, c in few]), np.concatenate([c for _, c in few])
            scores = np.concatenate([b.vectors[c] @ self.vectors[a] if exact else b.whole()[c] @ self.whole[a].astype(object) for a, c in few])
            keep = scores >= least[rows]
            yield self._others(b, rows[keep], cols[keep], scores[keep])

    def _others(self, b: Bucket, rows: np.ndarray, cols: np.ndarray, scores: np.ndarray):
        if b.number in self.own:
            n = len(b.ids)
            keep = ~np.isin(rows * n + cols, [a * n + place for a, place in self.own[b.number]])
            rows, cols, scores = rows[keep], cols[keep], scores[keep]
        return rows, cols, scores.astype(np.int64)


class Best:
    """The first `k` rows of each slot by score and id, and the score that a further row has to reach."""

    def __init__(self, least: np.ndarray, k: int):
        self.k, self.least = k, least.astype(float)
        self.kept = [np.zeros(0, np.int64) for _ in range(6)]

    def add(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray, noid: np.ndarray, bucket: int, places: np.ndarray) -> None:
        if not len(slots):
            return
        new = (slots, scores, ids, noid, np.full(len(slots), bucket), places)
        slots, scores, *rest = (np.concatenate([a, b.astype(np.int64)]) for a, b in zip(self.kept, new))
        order = np.lexsort((rest[3], rest[2], rest[0], rest[1], -scores, slots))
        slots, scores, rest = slots[order], scores[order], [x[order] for x in rest]
        start = np.r_[True, slots[1:] != slots[:-1]]
        nth = np.arange(len(slots)) - np.maximum.accumulate(np.where(start, np.arange(len(slots)), 0))
        keep = nth < self.k
        last = nth == self.k - 1
        self.least[slots[last]] = np.maximum(self.least[slots[last]], scores[last])
        self.kept = [x[keep] for x in (slots, scores, *rest)]

    def rows(self) -> dict:
        slots, scores, ids, noid, bucket, place = self.kept
        return {"slot": slots, "score": scores, "id": [None if n else i for i, n in zip(ids.tolist(), noid.tolist())], "bucket": bucket, "place": place}


_FOUND = "slot long, score long, id long, bucket long, place int"


def _anchors(table: DataFrame, wanted: Column) -> DataFrame:
    """bucket, place, vec_id, label and v of the anchors, numbered."""
    def run(batches: Iterator[dict]) -> Iterable[dict]:
        for b in batches:
            for row in zip(*(b[c].to_pylist() for c in ("bucket", "dims", "ids", "noid", "labels", "vectors"))):
                x = Bucket(dict(zip(("bucket", "dims", "ids", "noid", "labels", "vectors"), row)) | {"lists": np.zeros((row[1], len(row[2]) // 8), "<u2").tobytes()})
                yield {"bucket": [x.number] * len(x.ids), "place": list(range(len(x.ids))), "vec_id": [None if n else int(i) for i, n in zip(x.ids, x.noid)], "label": x.labels,
                       "v": [v.tolist() for v in x.vectors.astype(np.int64)]}

    rows = arrow_map(table, run, "bucket long, place int, vec_id long, label long, v array<long>")
    return numbered(rows.where(wanted), ["bucket", "place"])


def _grouped(rows: list, slots: list[int]) -> list[Anchors]:
    """Anchors by number of components; `slots` are their places in the block."""
    by: dict[int, list[int]] = {}
    for k, r in enumerate(rows):
        by.setdefault(len(r["v"]), []).append(k)
    return [Anchors(np.array([slots[k] for k in ks]), np.array([rows[k]["label"] for k in ks]), [(rows[k]["bucket"], rows[k]["place"]) for k in ks],
                    np.array([rows[k]["v"] for k in ks], dtype=np.int64).reshape(len(ks), d)) for d, ks in by.items()]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("slot").orderBy(F.desc("score"), F.asc_nulls_last("id"), "bucket", "place")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(table: DataFrame, groups, fill, k: int) -> DataFrame:
    """The first `k` rows of each slot over all buckets. `groups`: anchors, the slots' first thresholds, and what `fill` needs besides;
    `fill(anchors, bucket, best, extra)` adds what a bucket has."""
    shared = table.sparkSession.sparkContext.broadcast(groups)

    def run(batches: Iterator[dict]) -> Iterable[dict]:
        anchors, least, extra = shared.value
        best = Best(least, k)
        for b in batches:
            columns = list(b)
            for row in zip(*(b[c].to_pylist() for c in columns)):
                x = Bucket(dict(zip(columns, row)))
                for a in anchors:
                    if a.vectors.shape[1] == x.dims:
                        fill(a, x, best, extra)
        if len(best.kept[0]):
            yield best.rows()

    return _ranked(arrow_map(table, run, _FOUND), k)


def _fill_own(a: Anchors, b: Bucket, best: Best, _) -> None:
    for rows, cols, scores in a.meets(b, best.least[a.slots]):
        keep = a.labels[rows] == b.labels[cols]
        rows, cols, scores = rows[keep], cols[keep], scores[keep]
        best.add(a.slots[rows], scores, b.ids[cols], b.noid[cols], b.number, cols)


def _fill_range(a: Anchors, b: Bucket, best: Best, extra) -> None:
    """Slot n of an anchor is slot * width + n; unused ones have a threshold without end."""
    width, most = extra
    slots = a.slots[:, None] * width + np.arange(width)
    least, most = best.least[slots], most[slots]
    for rows, cols, scores in a.meets(b, least.min(1)):
        keep = a.labels[rows] != b.labels[cols]
        rows, cols, scores = rows[keep], cols[keep], scores[keep]
        for n in range(width):
            fits = (scores >= least[rows, n]) & (scores <= most[rows, n])
            best.add(slots[rows[fits], n], scores[fits], b.ids[cols[fits]], b.noid[cols[fits]], b.number, cols[fits])


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
                   bucket: int = BUCKET, block: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: for each row of `rows` (vec_id, label, embedding) that is an
    `anchor` (a predicate on vec_id), its first `positives` other rows of its label, and for each of these the first `negatives` rows of other labels
    that score between `low` and `high` percent of it. Higher scores come first, ties by smaller vec_id."""
    spark = rows.sparkSession
    table = durable(index(quantised(rows, scale), bucket))
    wanted = _anchors(table, anchor)
    total, dims = wanted.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    step = max(1, min(block, ANCHOR_BYTES // (8 * max(1, dims or 0))))
    results = []
    for at in range(0, total, step):
        some = wanted.where(F.col("nth").between(at, at + step - 1)).orderBy("nth").collect()
        groups = _grouped(some, list(range(len(some))))
        own = _search(table, (groups, np.full(len(some), -np.inf), None), _fill_own, positives).orderBy("slot", "rank").collect()
        least, most = np.full(len(some) * positives, np.inf), np.full(len(some) * positives, -np.inf)
        pairs = {}
        for r in own:
            n = r["slot"] * positives + r["rank"] - 1
            lowest, highest = -(-low * r["score"] // 100), high * r["score"] // 100
            if lowest <= highest:
                least[n], most[n] = lowest, highest
                pairs[n] = (some[r["slot"]]["vec_id"], r["id"], r["score"])
        if pairs:
            known = spark.createDataFrame([(n, *p) for n, p in pairs.items()], "slot long, anchor_id long, positive_id long, positive_score long")
            found = _search(table, (groups, least, (positives, most)), _fill_range, negatives)
            results.append(durable(found.join(F.broadcast(known), "slot").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))))
    if not results:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.unionByName, results)
