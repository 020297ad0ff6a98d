"""Hard negatives against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from filingmatch.llm import negatives


def brute(rows, wanted, positives=5, most=3):
    rows = [(i, l, [math.floor(256 * float(np.float32(x))) for x in v]) for i, l, v in rows if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (i, l, v) in enumerate(rows):
        if i is None or not wanted(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j or 0, m == l) for n, (j, m, w) in enumerate(rows) if n != k and len(w) == len(v))
        for p in [x for x in scored if x[3]][:positives]:
            fits = [x for x in scored if not x[3] and 50 * -p[0] <= 100 * -x[0] <= 95 * -p[0]]
            out += [(i, None if p[1] else p[2], n + 1, None if x[1] else x[2], -p[0], -x[0]) for n, x in enumerate(fits[:most])]
    return sorted(map(repr, out))


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "x") for r in rows], "vec_id long, label int, embedding array<float>, bucket string, anchor string").repartition(4)


def sample(seed, near, n=400, d=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    rows = []
    for i in range(n):
        v = centres[rng.integers(12)] + rng.normal(size=d) * near
        rows.append((i, int(rng.integers(4)), [float(x) for x in v * rng.choice([0.1, 1.0, 1.0, 5.0])]))
    return rows


def test_equals_brute_force(spark):
    for seed, near in ((1, 1.0), (2, 0.1)):
        rows = sample(seed, near)
        rows += [(1000, None, [1.0] * 12), (1001, 1, None), (1002, 1, [float("nan")] * 12), (1003, 1, [float("inf")] + [0.0] * 11), (1004, 1, [None] + [0.0] * 11),
                 (1005, 1, [0.0] * 12), (1010, 2, [0.0] * 12), (None, 1, [1.0] * 12), (None, 2, [1.0] * 12), (2000, 1, [1.0, 2.0]), (2010, 2, [1.0, 1.9]), (2020, 1, [1.0, 2.0]), (2030, 1, []), (2040, 2, [])]
        rows += [rows[10]] * 7 + [(3000 + k, k % 2, rows[20][2]) for k in range(25)]
        for bucket, block in ((64, 8192), (16, 7)):
            got = negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0, bucket=bucket, block=block)
            assert sorted(repr(tuple(r)) for r in got.collect()) == brute(rows, lambda i: i % 10 == 0)


def test_ranges_prune_and_lose_nothing():
    rng = np.random.default_rng(4)
    v = np.concatenate([c + rng.normal(size=(100, 16)) * 0.05 for c in rng.normal(size=(10, 16))])
    v = np.floor(256 * v / np.sqrt((v ** 2).sum(1))[:, None]).astype(np.int64)
    b = negatives.Bucket(negatives._packed(1, list(range(1000)), [0] * 1000, v))
    a = negatives.Anchors(np.arange(50), np.zeros(50), [(0, 0)] * 50, v[::20])
    scores = v[::20] @ v.T
    least = np.sort(scores, 1)[:, -20].astype(float)
    every, few = a.candidates(b, least)
    assert len(every) == 0 and sum(len(c) for _, c in few) < 0.25 * scores.size
    found = {(r, c) for rows, cols, _ in a.meets(b, least) for r, c in zip(rows.tolist(), cols.tolist())}
    assert found == set(zip(*(x.tolist() for x in np.nonzero(scores >= least[:, None]))))
    big = v << 22
    a2 = negatives.Anchors(np.arange(50), np.zeros(50), [(0, 0)] * 50, big[::20] >> 10)
    b2 = negatives.Bucket(negatives._packed(1, list(range(1000)), [0] * 1000, big))
    exact = (v[::20] << 12).astype(object) @ big.astype(object).T
    for rows, cols, got in a2.meets(b2, np.full(50, -np.inf)):
        assert all(exact[r, c] == s for r, c, s in zip(rows[:500], cols[:500], got[:500]))


def test_no_rows_no_negatives(spark):
    rows = table(spark, sample(1, 1.0, 20))
    assert negatives.hard_negatives(rows.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.hard_negatives(rows, F.col("vec_id") == -5).count() == 0
