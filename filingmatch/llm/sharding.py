"""Contiguous shards of equal bytes, from global prefix sums.

Rows are put in range partitions by doc_id; each partition has its own running sums, and the partitions' totals, one row each,
become their offsets. A row goes to the shard in which the middle of its bytes falls when the global sum is cut at equal targets,
so shards are contiguous in doc_id and differ by less than the largest row. Built-in functions only; texts never leave the scan.

A row's size is its UTF-8 bytes plus `overhead`; a null text has none and the checksum of nothing. Rows are ordered by doc_id
(nulls first), then by a hash of the text, then by size; rows equal in all of these are alike and take the next places in any order.
An empty table gives no rows, fewer rows than shards leave shards empty. Other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

OVERHEAD = 16


def _offsets(totals: DataFrame) -> DataFrame:
    """Bytes and rows of all earlier partitions, and of all partitions: one row per partition, however large the table."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
                         F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(every).alias("bytes_all"))


def balanced_shards(docs: DataFrame, shards: int, overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of `docs` (doc_id, text). `slot` counts the rows of
    a shard from 0 in order."""
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("tie"))
    order = ["doc_id", "tie", "size"]
    ranged = narrow.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    so_far = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows, _ = stored(ranged.select("doc_id", "size", "text_crc32", "part", F.sum("size").over(so_far).alias("end"), F.count(F.lit(1)).over(so_far).alias("nth")), "sums")
    offsets, _ = stored(_offsets(rows.groupBy("part").agg(F.max("end").alias("bytes"), F.max("nth").alias("rows"))), "offsets")
    middle = f"(((bytes_before + end) * 2 - size) * {shards}) div (bytes_all * 2)"
    placed = rows.join(F.broadcast(offsets), "part").select(
        "doc_id", "size", "text_crc32", (F.col("rows_before") + F.col("nth")).alias("nth"), F.least(F.expr(middle), F.lit(shards - 1)).cast("int").alias("shard"))
    first = placed.groupBy("shard").agg(F.min("nth").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("nth") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
