"""Numbers for the rows of a sorted table, however many rows one key holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: monotonically_increasing_id keeps the partition above this bit and the place in the partition below it.
BITS = 33


def numbered(rows: DataFrame, order: list[str], name: str = "nth") -> DataFrame:
    """`rows` with their places 0, 1, 2, .. in the order of the columns `order` (nulls first), kept in a table on shared storage.

    Rows go to range partitions, are sorted there and numbered from the partition's first place; a key with very many rows is
    cut like any other stretch. The partitions' sizes, one row each, are the only thing broadcast. Rows equal in all of `order` take
    neighbouring places in any order, fixed once the table is written.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed, _ = stored(placed, "ordered")
    part = F.shiftright("_at", BITS)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    offsets, _ = stored(sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "offsets")
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").select(
        *rows.columns, (F.col("_before") + F.col("_at").bitwiseAND((1 << BITS) - 1)).alias(name))
