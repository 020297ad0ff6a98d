"""Exact, near and passage duplicates against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from filingmatch.llm import bits, components, exact_dedup, recompress, simhash, substrings

from .fixtures import documents, sample

SPACE = re.compile("[\x20\x09-\x0d]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


@pytest.mark.parametrize("max_bits", [1 << 28, 1 << 16])
def test_exact_copies(spark, max_bits):
    rows = sample()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[SPACE.sub("", t or "")].append((len(t or ""), i))
    keep = {k: min((-n, i is None, i or 0, i) for n, i in v)[3] for k, v in groups.items()}
    want = Counter((i, keep[k], len(v), hashlib.sha256(k.encode()).hexdigest()) for k, v in groups.items() for _, i in v)
    got = exact_dedup.mark_copies(documents(spark, rows), max_bits).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    stays = [r for r in got if r.kept]
    assert len(stays) == len(groups) and all(r.doc_id == r.keep_id for r in stays)
    left = exact_dedup.drop_copies(documents(spark, rows), max_bits)
    assert left.columns == documents(spark, rows).columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i in keep.values())


def test_filter_has_no_false_negatives(spark):
    df = spark.range(20000).select(F.xxhash64(F.col("id") % 15000).alias("h"))
    again = bits.build(df, 20000, repeated=True)
    passed = df.where(again.has(F.col("h"))).groupBy("h").count()
    assert passed.where("count = 2").count() == 5000 and passed.where("count = 1").count() < 500
    every = bits.build(df, 20000)
    assert df.where(~every.has(F.col("h"))).count() == 0
    assert spark.range(5).where(bits.build(df.limit(0), 0).has(F.col("id"))).count() == 0


def fingerprint(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closed(pairs, nodes):
    label = {n: n for n in nodes}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        label[b] = a
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("most", [2048, 2])
def test_near_copies(spark, most):
    rows = sample()
    base = rows[7][1].split()
    rows += [(200 + k, " ".join(base[:k] + ["zz"] + base[k + 1:]), "en") for k in range(0, min(20, len(base)))]
    fps = {fingerprint(t) for _, t, _ in rows}
    comp = closed([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2], fps)
    least = {}
    for i, t, _ in rows:
        if i is not None:
            c = comp[fingerprint(t)]
            least[c] = min(least.get(c, i), i)
    got = simhash.near_duplicates(documents(spark, rows), most=most).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((i, f"{fingerprint(t):016x}", least[comp[fingerprint(t)]]) for i, t, _ in rows)
    left = simhash.keep_one(documents(spark, rows), most=most)
    assert left.columns == documents(spark, rows).columns and sorted(r.doc_id for r in left.collect()) == sorted(least.values())


def test_links_of_dense_fingerprints(spark):
    rng = np.random.default_rng(5)
    center = int(rng.integers(0, 2**62))
    fps = sorted({center ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in (0, 1, 1, 2, 3, 4) * 20})
    want = closed([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2], fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for most in (1000, 3):
        got = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.near_links(df, most).collect()]
        assert all((a ^ b).bit_count() <= 2 for a, b in got) and closed(got, fps) == want


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {1000 + i: 1000 for i in range(200)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def removed(rows, window):
    seen = Counter(tuple(w[i:i + window]) for _, t, _ in rows for w in [words(t)] for i in range(len(w) - window + 1))
    out = Counter()
    for i, t, _ in rows:
        w = words(t)
        gone = {k for j in range(len(w) - window + 1) if seen[tuple(w[j:j + window])] > 1 for k in range(j, j + window)}
        out[i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()] += 1
    return out


def test_repeated_passages(spark, monkeypatch):
    rows = sample()
    got = substrings.without_repeats(documents(spark, rows), digests=True).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in got) == removed(rows, 35)
    kept = substrings.without_repeats(documents(spark, rows[:5]), window=20).collect()
    assert all(isinstance(bytes(r.kept), bytes) for r in kept) and len(kept) == 5


def test_pieces_do_not_change_what_is_chosen():
    rng = np.random.default_rng(3)
    tokens = rng.integers(0, 50, 3000).astype(np.uint64)
    tokens[1000:1300] = tokens[200:500]
    tokens[2000:2100] = 7
    whole = recompress.anchors(recompress.recompress(tokens, np.array([3000])))
    at = recompress.chosen(whole, np.arange(3000 - 34), 35)
    for lo, hi in ((100, 600), (950, 1400), (1900, 2200)):
        part = recompress.anchors(recompress.recompress(tokens[lo:hi], np.array([hi - lo])))
        own = recompress.chosen(part, np.arange(hi - lo - 34), 35)
        assert [part.name[j] if j >= 0 else -1 for j in own] == [whole.name[j] if j >= 0 else -1 for j in at[lo:hi - 34]]


def test_empty_tables(spark):
    none = documents(spark, []).limit(0)
    assert exact_dedup.mark_copies(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0
    assert substrings.without_repeats(none).count() == 0
