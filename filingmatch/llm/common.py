"""Shared helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A key counts as hot when it owns at least this share of all rows, so there are at most this many hot keys.
HOT_SHARE = 1000
#: Rows that a Python function is given at a time, so that the objects made of them stay few.
ROWS = 2000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def parts_for(df: DataFrame, bytes_each: int = 64 << 20) -> int:
    """Partitions that hold about `bytes_each` of the input each, never fewer than the session's shuffle partitions."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // bytes_each + 1, 200_000))


def arrow_map(df: DataFrame, fn: Callable[[Iterator[dict]], Iterable[dict]], schema: str) -> DataFrame:
    """`mapInArrow` for functions over dicts of column name to Arrow array; lists, numpy and Arrow arrays may be returned."""
    out = StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS))
        for got in fn({n: b.column(i) for i, n in enumerate(b.schema.names)} for b in parts):
            yield pa.RecordBatch.from_arrays([x.cast(f.type) if isinstance(x := got[f.name], pa.Array) else pa.array(x, type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, out)


_HELD: list = [None, None]


def held(shared, make: Callable = lambda x: x):
    """What `make` makes of a broadcast value, kept by the Python worker from task to task until another value is asked for."""
    if _HELD[0] is not shared.value:
        _HELD[:] = [shared.value, make(shared.value)]
    return _HELD[1]


def row_key() -> list[Column]:
    """Two columns, `kd` and `kt`, that name a row of `documents` by what it holds: its id and a hash over text and id. They
    come out alike in every pass, however the input is split, so several passes need no stored row number. Repeated rows
    share a key, and so does everything that is found out about them."""
    return [F.coalesce("doc_id", F.lit(-1)).cast("long").alias("kd"), F.xxhash64("text", "doc_id", F.col("doc_id").isNull()).alias("kt")]


def join_back(rows: DataFrame, groups: DataFrame, key: str, weight: str, share: int = HOT_SHARE) -> DataFrame:
    """`rows` left-joined to `groups`, which has one row per `key` and its number of rows in `weight`.

    A key that owns `1/share` of all rows or more is broadcast, and there are at most `share` of them; all other keys are
    shuffled, each with less than `1/share` of the rows. Both inputs should be stored tables, as each is read twice.
    """
    total = groups.agg(F.sum(weight)).first()[0] or 0
    hot = F.broadcast(groups.where(F.col(weight) * share >= total))
    cold = groups.where(F.col(weight) * share < total)
    near = rows.join(hot, key, "inner")
    far = rows.join(hot.select(key), key, "left_anti").join(cold, key, "left")
    return near.unionByName(far.select(near.columns))


def registry() -> tuple[dict, dict, Callable]:
    """A dict of queries, one of check SQL, and the decorator that fills them."""
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    checks: dict[str, str] = {}

    def query(name: str, check: str | None = None):
        def add(fn):
            queries[name] = fn
            if check is not None:
                checks[name] = check
            return fn
        return add

    return queries, checks, query
