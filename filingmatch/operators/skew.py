"""Joins, windows and deals that keep one task from doing the work of many."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
SALTS = 64
#: Rows of a task where a row is short but dear to work out.
DEAR_ROWS = 5_000


def spread(df: DataFrame, rows: int = DEAR_ROWS) -> DataFrame:
    """The same rows, dealt evenly over tasks of about `rows` rows. Scans and shuffles are cut by bytes, so a table of short rows comes in a few
    tasks, however long names, titles and addresses in them take to work out; here the number of tasks grows with the rows."""
    return df.repartition(max(1, -(-df.count() // rows)))


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than `hot_rows` rows. There are at most rows / hot_rows of them, which bounds the table for a
    broadcast; the count is a map-side combined aggregate over one column."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select(F.col(key).alias("_hot"))


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: str, how: str = "inner", hot_rows: int = HOT_ROWS,
                salts: int = SALTS) -> DataFrame:
    """Equi-join on `key` where a key may own a large share of `left` and `right` holds few rows per key.

    Rows of a hot key are spread over `salts` tasks by the hash of `spread` (a column that tells them apart, so a retried task
    places them alike); only the right rows of hot keys are repeated. Every other row keeps salt 0 and is shuffled once.
    """
    hot = F.broadcast(hot_keys(left, key, hot_rows))
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    many = left.join(hot, left[key] == F.col("_hot"), "left").withColumn("_salt", salt).drop("_hot")
    copies = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    few = right.join(hot, right[key] == F.col("_hot"), "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return many.join(few, [key, "_salt"], how).drop("_salt")
