"""Incremental intake, late data, sliding counts and repeat-safe publishing as streams."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import publish, state
from ..session import shared_folder
from ..sources.spec import SourceSpec


def work_folder(spark: SparkSession) -> str:
    """A new folder on the storage the cluster shares."""
    return shared_folder(spark, "work")


def landing(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream over the files of one landed table."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").parquet(folder)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Everything that has landed, batch by batch, then stop."""
    q = (stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def any_written(spark: SparkSession, out: str) -> bool:
    """Whether a batch has been finished below `out`."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/batch=*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def last_written(spark: SparkSession, out: str, before: int | None = None) -> int | None:
    """The number of the last batch (before `before`) that has been finished below `out`."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/batch=*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    done = [int(f.getPath().getParent().getName().split("=")[1]) for f in found]
    return max((n for n in done if before is None or n < before), default=None)


def upserting(out: str, today: Column, cells: list[str], order: str = "seq") -> Callable[[DataFrame, int], None]:
    """A batch writer that upserts (`publish.upsert`: new ids inserted, empty cells of known ones filled) the newest row of each id, by
    `order`, into the sheet as the batch before left it. Every batch writes the next version of the sheet to its own folder, so a
    repeated batch starts from the same sheet again and replaces its own version."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, earlier = batch.sparkSession, last_written(batch.sparkSession, out, batch_id)
        empty = spark.createDataFrame([], ", ".join(["id string", *[f"{c} string" for c in cells], "added date"]))
        sheet = empty if earlier is None else spark.read.parquet(f"{out}/batch={earlier}")
        publish.upsert(sheet, batch, today, cells, F.desc(order)).drop("action").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return write


def taking_in(out: str, spec: SourceSpec, since: date, until: date, today: Column, raw: Callable[[DataFrame], DataFrame] = lambda b: b) -> Callable[[DataFrame, int], None]:
    """A batch writer that takes in registry rows: scan and window, normalized, the first per id, and of those the ids that no
    other batch took in. Every batch owns one folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        filings, spark = spec.filings(raw(batch), since, until), batch.sparkSession
        known = spark.createDataFrame([], "id string")
        if any_written(spark, out):
            known = spark.read.option("basePath", out).parquet(out).where(F.col("batch") != batch_id).select("id")
        state.intake(filings, known, today).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return write


def keep_latest(out: str) -> Callable[[DataFrame, int], None]:
    """A batch writer for results that a later batch may replace: one folder per batch, a repeated batch replaces its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return write


def latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The row of the last batch for each key of what `keep_latest` wrote."""
    rows = spark.read.option("basePath", out).parquet(out)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in values])


def append_new(out: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that appends ids the table does not hold. Every batch owns one folder, so a repeated batch replaces what
    its first try wrote and nothing is doubled."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        once = batch.dropDuplicates(["id"])
        if any_written(spark, out):             # any other failure to read what was written is an error
            known = spark.read.option("basePath", out).parquet(out).where(F.col("batch") != batch_id).select("id")
            once = once.join(known, "id", "left_anti")
        once.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return write


def distinct_within(stream: DataFrame, id_col: str, ts: str, horizon: str = "45 days") -> DataFrame:
    """Repeats of an id inside the look-back horizon dropped with bounded state (later ones meet the anti join of the intake)."""
    return stream.withWatermark(ts, horizon).dropDuplicatesWithinWatermark([id_col])


def pane_counts(stream: DataFrame, key: str, ts: str, pane: str = "1 minute", keep: str = "1 day") -> DataFrame:
    """(pane, key, n): events per key and pane, the time between two starts of a sliding window. An event is one row of one pane; in update or
    append mode the state of panes past the watermark is dropped."""
    counted = stream.withWatermark(ts, keep).groupBy(F.window(ts, pane), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("pane"), key, "n")


def window_counts(panes: DataFrame, key: str, length: int = 15, pane: str = "1 minute") -> DataFrame:
    """(window_start, key, n): events per key and sliding window of `length` panes, added up from the panes it covers."""
    starts = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda k: F.col("pane") - k * F.expr(f"INTERVAL '{pane.split()[0]}' {pane.split()[1].upper().rstrip('S')}"))
    return panes.select(key, F.explode(starts).alias("window_start"), "n").groupBy("window_start", key).agg(F.sum("n").alias("n"))
