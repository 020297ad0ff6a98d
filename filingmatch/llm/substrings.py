"""Removal of passages of `WINDOW` words or more that stand anywhere else too.

Recompression gives each window of words an anchor, a high-level symbol that depends on words of the window only; equal windows have
equal anchors. A first job counts anchor names over all texts. Windows whose anchor occurs once are unique. A second job reads the
rest: consecutive windows with one anchor form a run, and runs with equal first and last windows are equal, so a shared run proves
all its windows with one row per occurrence, combined within tasks. Only the runs at the borders of repeats are opened: their
windows meet one copy of each other run of the same anchor. A third job removes the words of repeated windows.

Windows without an anchor are compared by themselves. Names and window hashes are independent 64-bit hashes and are compared
together. The names that occur more than once are tested by a filter of bounded size; whatever else passes it is compared exactly.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A null text has no words; a text of fewer words than a window keeps all. Rows are told
apart by id and text; repeated rows are repeats of each other. An empty table gives no rows. Other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import bits
from .common import arrow_map, join_back, row_key
from .recompress import anchors, chosen, recompress, window_hashes

WINDOW = 35
PIECE = 100_000
BATCH = 300_000


def _pieces(texts: list[bytes | None], window: int) -> Iterator[tuple[list[tuple[int, int]], np.ndarray, np.ndarray]]:
    """Texts in bounded batches: (row, first word) of each piece, all their words as hashes, and the pieces' lengths. A long text
    is cut into pieces that overlap by one word less than a window, so each window is in one piece."""
    names: list[tuple[int, int]] = []
    words: list[np.ndarray] = []
    held = 0
    for row, text in enumerate(texts):
        w = text.split() if text else []
        if len(w) < window:
            continue
        h = np.frombuffer(b"".join(map(xxhash.xxh64_digest, w)), ">u8").astype(np.uint64)
        for i in range(0, len(h) - window + 1, PIECE):
            part = h[i:i + PIECE + window - 1]
            names.append((row, i))
            words.append(part)
            held += len(part)
            if held > BATCH:
                yield names, np.concatenate(words), np.array([len(x) for x in words])
                names, words, held = [], [], 0
    if names:
        yield names, np.concatenate(words), np.array([len(x) for x in words])


def _windows(tokens: np.ndarray, lengths: np.ndarray, window: int):
    """Anchors, the start of every window, the number of its piece and its anchor's."""
    a = anchors(recompress(tokens, lengths))
    starts = np.concatenate([np.arange(e - n, e - window + 1) for n, e in zip(lengths, np.cumsum(lengths), strict=True)])
    return a, starts, np.repeat(np.arange(len(lengths)), lengths - window + 1), chosen(a, starts, window)


def anchor_names(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """`h`: the name of every anchor that some window has chosen, once per place."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for _, tokens, lengths in _pieces(b["t"].to_pylist(), window):
                a, _, _, anchor = _windows(tokens, lengths, window)
                yield {"h": a.name[np.unique(anchor[anchor >= 0])].view(np.int64)}

    return arrow_map(docs.select(F.col("text").cast("binary").alias("t")), run, "h long")


def runs(docs: DataFrame, shared: bits.Filter, window: int = WINDOW) -> DataFrame:
    """Runs of windows whose anchor passes `shared`, or that have none: name, `run` (hash of the run), kd, kt, `first` (word) and
    `hashes` of the windows."""
    held, n_bits, k = shared.held, shared.bits, shared.k

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            kd, kt = b["kd"].to_numpy(zero_copy_only=False), b["kt"].to_numpy(zero_copy_only=False)
            for names, tokens, lengths in _pieces(b["t"].to_pylist(), window):
                a, starts, piece, anchor = _windows(tokens, lengths, window)
                used = np.unique(anchor[anchor >= 0])
                good = np.zeros(len(a.name) + 1, bool)          # the last place stands for anchor -1
                good[used] = bits.contains(held.value, a.name[used].view(np.int64), n_bits, k) if held is not None else False
                good[-1] = True
                pick = np.flatnonzero(good[anchor])
                if not len(pick):
                    continue
                at, own, where = starts[pick], anchor[pick], piece[pick]
                h = window_hashes(tokens, window)[at]
                new = np.r_[True, (own[1:] != own[:-1]) | (own[1:] < 0) | (at[1:] != at[:-1] + 1) | (where[1:] != where[:-1])]
                first = np.flatnonzero(new)
                last = np.r_[first[1:], len(at)] - 1
                name = a.name[np.maximum(own[first], 0)] if len(a.name) else np.zeros(len(first), np.uint64)
                for i in np.flatnonzero(own[first] < 0):
                    name[i] = xxhash.xxh64_intdigest(tokens[at[first[i]]:at[first[i]] + window].tobytes(), 7)
                begin = (np.cumsum(lengths) - lengths)[where[first]]
                row = np.array([r for r, _ in names])[where[first]]
                offset = np.array([o for _, o in names])[where[first]]
                count = (last - first + 1).astype(np.uint64)
                whole = (h[first] * np.uint64(3)) ^ (h[last] * np.uint64(0x9E3779B97F4A7C15)) ^ (count << np.uint64(57))
                yield {"name": name.view(np.int64), "run": whole.view(np.int64), "kd": kd[row], "kt": kt[row], "first": at[first] - begin + offset,
                       "hashes": pa.ListArray.from_arrays(pa.array(np.r_[first, len(at)].astype(np.int32)), pa.array(h.view(np.int64)))}

    plain = docs.select(*row_key(), F.col("text").cast("binary").alias("t"))
    return arrow_map(plain, run, "name long, run long, kd long, kt long, first long, hashes array<long>")


def repeated(docs: DataFrame, window: int = WINDOW, max_bits: int = bits.MAX_BITS * 4) -> DataFrame:
    """kd, kt and `spans`, (first window, number of windows) of all stretches of repeated windows, for rows that have any."""
    names, _ = stored(anchor_names(docs, window).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "names")
    found, _ = stored(runs(docs, bits.build(names, names.count(), max_bits=max_bits), window), "runs")
    groups, _ = stored(found.groupBy("name", "run").agg(F.count(F.lit(1)).alias("n"), F.first("hashes").alias("hashes"), F.first("kd").alias("kd"), F.first("kt").alias("kt"),
                                                        F.first("first").alias("first")), "groups")
    many, _ = stored(groups.where("n > 1").select(F.xxhash64("name", "run").alias("g"), F.col("name").alias("name_"), F.col("run").alias("run_"), "n"), "many")
    proven = (join_back(found.select("kd", "kt", "first", F.size("hashes").alias("k"), "name", "run", F.xxhash64("name", "run").alias("g")), many, "g", "n")
              .where("name = name_ AND run = run_").select("kd", "kt", "first", "k"))
    border = groups.groupBy("name").agg(F.sum("n").alias("all"), F.min("n").alias("least")).where("all > 1 AND least = 1").select("name")
    opened, _ = stored(groups.join(border, "name", "left_semi").select("name", "n", "kd", "kt", "first", F.posexplode("hashes").alias("i", "h")), "opened")
    again = opened.groupBy("name", "h").agg(F.sum("n").alias("all")).where("all > 1")
    single = opened.where("n = 1").join(again, ["name", "h"], "left_semi").select("kd", "kt", (F.col("first") + F.col("i")).alias("first"), F.lit(1).alias("k"))
    spans = F.collect_list(F.struct("first", "k")).alias("spans")
    return stored(proven.unionByName(single).groupBy("kd", "kt").agg(spans), "spans")[0]


def without_repeats(docs: DataFrame, window: int = WINDOW, digests: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and `kept` of every row of `docs` (doc_id, text): the words that stay, joined by one space, or with
    `digests` their SHA-256 as kept_sha256. Only texts that lose words are shuffled."""
    spans = repeated(docs, window)
    hit = bits.build(spans.select(F.col("kt").alias("h")), spans.count())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("t"), *row_key())
    tested = rows.withColumn("hit", hit.has(F.col("kt")))
    whole = tested.where(~F.col("hit")).select("doc_id", "t", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    cut = tested.where("hit").join(spans, ["kd", "kt"], "left").select("doc_id", "t", "spans")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            total, gone, kept = [], [], []
            for text, at in zip(b["t"].to_pylist(), b["spans"], strict=True):
                w = text.split() if text else []
                total.append(len(w))
                if at.is_valid:
                    edge = np.zeros(len(w) + 1, np.int64)
                    first = at.values.field("first").to_numpy()
                    np.add.at(edge, first, 1)
                    np.add.at(edge, first + at.values.field("k").to_numpy() + window - 1, -1)
                    stay = (np.cumsum(edge)[:-1] == 0).tolist()
                    w = [x for x, s in zip(w, stay, strict=True) if s]
                gone.append(total[-1] - len(w))
                left = b" ".join(w)
                kept.append(hashlib.sha256(left).hexdigest() if digests else left)
            yield {"doc_id": b["doc_id"], "n_words": total, "n_removed": gone, "kept_sha256" if digests else "kept": kept}

    return arrow_map(whole.unionByName(cut), run, "doc_id long, n_words long, n_removed long, " + ("kept_sha256 string" if digests else "kept binary"))
