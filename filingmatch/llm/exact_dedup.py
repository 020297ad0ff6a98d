"""Exact deduplication by two-pass Bloom filtering.

Pass one sets each text's hash in a filter that tells bits set once from bits set again. Pass two tests every row against the
bits set again: a row that fails is alone for certain and passes straight through, and only the others are shuffled, by the
SHA-256 of their normalised text, and grouped exactly.

Texts are equal when identical after deleting tabs, line ends, form feeds and spaces. A null text counts as empty, and empty
texts are equal to each other. Of equal texts the row with the most code points stays, then the smallest doc_id (a null id
after all others), then any one of rows that are alike in both. An empty table gives no rows. Other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import bits
from .common import join_back


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def _code_points() -> Column:
    return F.char_length(F.coalesce("text", F.lit("")))


def mark_copies(docs: DataFrame, max_bits: int = bits.MAX_BITS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256. Only hashes, ids and lengths
    are stored and shuffled, never texts."""
    text = docs.select("doc_id", normalised(F.col("text")).alias("t"), _code_points().alias("len"))
    rows, _ = stored(text.select("doc_id", "len", F.xxhash64("t").alias("h"), F.unhex(F.sha2("t", 256)).alias("sha"),
                                 F.monotonically_increasing_id().alias("tag")), "hashes")
    again = bits.build(rows.select("h"), rows.count(), repeated=True, max_bits=max_bits)
    tested = rows.withColumn("again", again.has(F.col("h"))).drop("h")
    alone = tested.where(~F.col("again")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                                                 F.lit(True).alias("kept"), "sha")
    maybe, _ = stored(tested.where("again").drop("again"), "maybe")
    # ~x falls as x grows and never overflows; a null sorts below every number
    best = F.max(F.struct("len", F.bitwise_not("doc_id").alias("d"), F.bitwise_not("tag").alias("t"))).alias("best")
    groups, _ = stored(maybe.groupBy("sha").agg(F.count(F.lit(1)).alias("group_size"), best), "groups")
    met = join_back(maybe, groups, "sha", "group_size").select(
        "doc_id", F.bitwise_not("best.d").alias("keep_id"), "group_size", (F.bitwise_not("tag") == F.col("best.t")).alias("kept"), "sha")
    return alone.unionByName(met).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, max_bits: int = bits.MAX_BITS) -> DataFrame:
    """`docs` with one row of each group of equal texts, all columns kept. Rows that are alone are not shuffled; the others
    are combined within each task before they meet, so a group of any size sends one row per task."""
    row = docs.select(F.struct("*").alias("row"), normalised(F.col("text")).alias("t"), _code_points().alias("len"), F.col("doc_id").alias("d"))
    hashed = row.withColumn("h", F.xxhash64("t"))
    again = bits.build(hashed.select("h"), docs.count(), repeated=True, max_bits=max_bits)
    tested = hashed.withColumn("again", again.has(F.col("h")))
    alone = tested.where(~F.col("again")).select("row")
    met = (tested.where("again").groupBy(F.sha2("t", 256).alias("sha"))
           .agg(F.max_by("row", F.struct("len", F.bitwise_not("d").alias("d"), F.xxhash64("row.text"))).alias("row")).select("row"))
    return alone.unionByName(met).select("row.*")
