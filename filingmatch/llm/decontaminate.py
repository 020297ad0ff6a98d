"""Benchmark decontamination with a positional inverted index.

The index is split by documents: each of its rows holds, for a block of training documents, the postings (document, position)
of every term that a test item uses. A first job reads the whole training texts once and stores the index; corpus frequencies
of the terms come from its posting lengths. A second job evaluates the test phrases block by block: the postings of a phrase's
rarest term, shifted by its offset, give the candidate starts, and each next term, in order of frequency, keeps those whose
shifted posting exists. What is left are exact phrase matches. With a slop the same lists give proximity matches: the terms in
order within a span of the phrase's length plus the slop. Nothing of the training side is collected or broadcast. The test
items are broadcast in blocks of at most `block_bytes` of text, one pass over the training texts for each block.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A null or empty text has no words, an item without words
no window. An item whose id is null is written as `null`. Repeated items, and items that share a window, all count. Rows with
equal text and id get equal answers. An empty table on either side gives no matches. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import bits
from .common import arrow_map, row_key

WINDOW = 10
BLOCK_BYTES = 32 << 20
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isdigit() or 97 <= c <= 122 else 32 for c in range(256))
#: One word of a document's key in an index block: document number above, position below.
_POS = 40


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def item_blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items, in blocks of about `block_bytes` of text, dealt by a hash."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = size // block_bytes + 1
    plain = items.select(F.col("item_id").cast("string").alias("id"), F.col("text").cast("binary").alias("t"))
    for k in range(n):
        yield [("null" if r.id is None else r.id, words(bytes(r.t or b""))) for r in plain.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k).toLocalIterator()]


def windows(items: list[tuple[str, list[bytes]]], size: int) -> dict[tuple[bytes, ...], set[str]]:
    """Every distinct window with the items that hold it."""
    out: dict[tuple[bytes, ...], set[str]] = {}
    for item, w in items:
        for i in range(max(1, len(w) - size + 1) if w else 0):
            out.setdefault(tuple(w[i:i + size]), set()).add(item)
    return out


def build_index(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """The stored index of `docs` for `terms` (numbered by place). One row per block of documents: keys, ids and lengths of
    the documents, the numbers of the terms found, where their postings end, and all postings."""
    number = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        get = number.value.get
        for b in batches:
            at, term, length = [], [], []
            for d, text in enumerate(b["t"].to_pylist()):
                w = words(text)
                length.append(len(w))
                ids = np.array([get(x, -1) for x in w], np.int32)
                pos = np.flatnonzero(ids >= 0)
                term.append(ids[pos])
                at.append(pos + (d << _POS))
            term, at = np.concatenate(term), np.concatenate(at).astype(np.int64)
            order = np.argsort(term, kind="stable")
            found, first = np.unique(term[order], return_index=True)
            yield {"kd": [b["kd"]], "kt": [b["kt"]], "doc_id": [b["doc_id"]], "n_words": [length], "term": [found],
                   "ends": [np.r_[first, len(order)][1:]], "postings": [at[order]]}

    plain = docs.select(*row_key(), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("t"))
    return stored(arrow_map(plain, run, "kd array<long>, kt array<long>, doc_id array<long>, n_words array<long>, term array<int>, ends array<long>, "
                                        "postings array<long>"), "index")[0]


def frequencies(index: DataFrame) -> DataFrame:
    """(term, n): corpus frequencies, from the lengths of the posting lists."""
    spans = F.transform("ends", lambda end, i: F.struct(
        F.element_at("term", i + 1).alias("term"), (end - F.when(i > 0, F.element_at("ends", F.greatest(i, F.lit(1)))).otherwise(0)).alias("n")))
    return index.select(F.explode(spans).alias("s")).groupBy("s.term").agg(F.sum("s.n").alias("n"))


def _phrase(lists: dict[int, np.ndarray], phrase: list[int], rarity: list[int]) -> np.ndarray:
    """Starts of exact matches. `rarity` holds the offsets of the phrase's terms, rarest first."""
    start = lists[phrase[rarity[0]]] - rarity[0]
    for off in rarity[1:]:
        have = lists[phrase[off]]
        at = np.searchsorted(have, start + off)
        start = start[have[np.minimum(at, len(have) - 1)] == start + off]
        if not len(start):
            break
    return start


def _near(lists: dict[int, np.ndarray], phrase: list[int], rarity: list[int], slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the shortest spans from each start that hold the terms in order, at most `slop` words longer than
    the phrase. Starts too far from any posting of the rarest term are never followed."""
    reach, rare = len(phrase) + slop, lists[phrase[rarity[0]]]
    start = lists[phrase[0]]
    at = np.searchsorted(rare, start)
    start = start[(at < len(rare)) & (rare[np.minimum(at, len(rare) - 1)] - start < reach)]
    now = start
    for t in phrase[1:]:
        have = lists[t]
        at = np.searchsorted(have, now, "right")
        ok = (at < len(have)) & (have[np.minimum(at, len(have) - 1)] - start < reach)
        start, now = start[ok], have[at[ok]]
    same = (start >> _POS) == (now >> _POS)
    return start[same], now[same] + 1


def matched(index: DataFrame, phrases: list[list[int]], owners: list[list[str]], slop: int = 0) -> DataFrame:
    """One row per document of the index: kd, kt, doc_id, n_words, `hit` (positions of its hit words) and `items` (owners of
    the phrases found)."""
    spark = index.sparkSession
    count = {r.term: r.n for r in frequencies(index).collect()}
    rare = [sorted(range(len(p)), key=lambda i: (count.get(p[i], 0), i)) for p in phrases]
    plan = spark.sparkContext.broadcast([(p, r, o) for p, r, o in zip(phrases, rare, owners, strict=True) if all(t in count for t in p)])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for kd, kt, ids, length, term, ends, post in zip(*[b[c] for c in ("kd", "kt", "doc_id", "n_words", "term", "ends", "postings")], strict=True):
                ends = ends.values.to_numpy()
                parts = np.split(post.values.to_numpy(), ends[:-1]) if len(ends) else []
                lists = dict(zip(term.values.to_numpy().tolist(), parts, strict=True))
                hit: dict[int, list] = {}
                items: dict[int, set] = {}
                for phrase, rarity, own in plan.value:
                    if any(phrase[o] not in lists for o in rarity):
                        continue
                    if slop:
                        start, end = _near(lists, phrase, rarity, slop)
                    else:
                        start = _phrase(lists, phrase, rarity)
                        end = start + len(phrase)
                    for s, e in zip(start.tolist(), end.tolist(), strict=True):
                        d = s >> _POS
                        hit.setdefault(d, []).append((s & ((1 << _POS) - 1), e & ((1 << _POS) - 1)))
                        items.setdefault(d, set()).update(own)
                n = len(length)
                yield {"kd": kd.values, "kt": kt.values, "doc_id": ids.values, "n_words": length.values,
                       "hit": [sorted({i for s, e in set(hit.get(d, ())) for i in range(s, e)}) for d in range(n)], "items": [sorted(items.get(d, ())) for d in range(n)]}

    return arrow_map(index, run, "kd long, kt long, doc_id long, n_words long, hit array<int>, items array<string>")


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of `docs`: kd, kt, doc_id, n_words, hit (sorted positions of words in any match of a window of any item) and
    items (sorted ids)."""
    out = None
    for block in item_blocks(items, block_bytes):
        found = windows(block, window)
        terms = sorted({t for w in found for t in w})
        number = {t: i for i, t in enumerate(terms)}
        got = matched(build_index(docs, terms), [[number[t] for t in w] for w in found], [sorted(o) for o in found.values()], slop)
        out = got if out is None else out.unionByName(got)
        if out is not got:      # repeated rows share a key, so they are told apart by their number of rows
            once = out.groupBy("kd", "kt").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), (F.count(F.lit(1)) / 2).cast("int").alias("copies"),
                                               F.array_sort(F.array_distinct(F.flatten(F.collect_set("hit")))).alias("hit"),
                                               F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
            out = once.withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")
    return out


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of `docs` (doc_id, text)."""
    got = matches(docs, items, window)
    return got.select("doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` without the rows in which a window occurs, all columns kept. A filter of bounded size over the hit rows' keys lets
    all other rows pass unshuffled; what it holds back is compared exactly."""
    hit, _ = stored(matches(docs, items, window).where(F.size("hit") > 0).select("kd", "kt").distinct(), "hit")
    kept = bits.build(hit.select(F.col("kt").alias("h")), hit.count())
    rows = docs.select(F.struct("*").alias("row"), *row_key())
    tested = rows.withColumn("held", kept.has(F.col("kt")))
    clean = tested.where(~F.col("held")).select("row")
    return clean.unionByName(tested.where("held").join(hit, ["kd", "kt"], "left_anti").select("row")).select("row.*")
