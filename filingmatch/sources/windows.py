"""Incremental windows, guarded reads and freshness of the registries."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spec import SourceSpec


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def lag_table(spark: SparkSession, specs: list[SourceSpec]) -> DataFrame:
    return spark.createDataFrame([(s.key, s.lag) for s in specs], "key string, lag int")


def since_day(last_ok: Column, lag: Column, today: Column, backfill: Column | int) -> Column:
    """The first day to read: the backfill floor for a source that never succeeded, else its last good day less the lag
    (at most today less the lag), never before the floor."""
    floor = F.date_sub(today, F.lit(backfill) if isinstance(backfill, int) else backfill)
    reach = F.least(F.date_sub(last_ok, lag), F.date_sub(today, lag))
    return F.when(last_ok.isNull(), floor).otherwise(F.greatest(floor, reach))


def windows(source_state: DataFrame, specs: list[SourceSpec], today: date, backfill: int = 45, override: date | None = None) -> DataFrame:
    """(key, since, until) per source. One row per registry: both sides are as small as the list of registries."""
    lags = lag_table(source_state.sparkSession, specs)
    since = F.lit(override) if override else since_day(F.col("last_ok"), F.col("lag"), F.lit(today), backfill)
    return (lags.join(source_state.select("key", "last_ok"), "key", "left")
            .select("key", since.alias("since"), F.lit(today).alias("until")))


def within_windows(rows: DataFrame, source_windows: DataFrame, key: str, day: str) -> DataFrame:
    """Rows of every source inside its own window: one pass over the union, the windows are broadcast (one row per source)."""
    w = F.broadcast(source_windows.select(F.col("key").alias("_k"), "since", "until"))
    return (rows.join(w, (rows[key] == F.col("_k")) & rows[day].between(F.col("since"), F.col("until")))
            .drop("_k", "since", "until"))


def guarded(specs: list[SourceSpec], job: Callable[[SourceSpec], int]) -> list[tuple[str, str, str, int]]:
    """Runs the intake job of every source; one that fails does not stop the others. Returns (key, status, error, new)."""
    out = []
    for s in specs:
        try:
            out.append((s.key, "ok", "", int(job(s))))
        except Exception as err:                       # noqa: BLE001 - whatever broke one source must not break the run
            out.append((s.key, "failed", f"{type(err).__name__}: {str(err)[:160]}", 0))
    return out


def advance(source_state: DataFrame, outcome: DataFrame, today: date) -> DataFrame:
    """Source state after a run: only a source that succeeded moves forward."""
    ok = outcome.where(F.col("status") == "ok").select("key", F.lit(today).alias("_now")).distinct()
    return (source_state.join(ok, "key", "full_outer")
            .select("key", F.coalesce("_now", "last_ok").alias("last_ok")))


def run_outcome(outcome: DataFrame) -> DataFrame:
    """ok | partial | failed over the sources of a run."""
    failed = F.count_if(F.col("status") != "ok")
    return outcome.agg(F.count(F.lit(1)).alias("sources"), failed.alias("failed_sources"), overall(failed, F.count(F.lit(1))).alias("status"))


def overall(failed: Column, sources: Column) -> Column:
    return F.when((failed > 0) & (failed == sources), "failed").when(failed > 0, "partial").otherwise("ok")


def freshness(filings: DataFrame, today: date, days: int = 7) -> DataFrame:
    """Filings of the last days per source and the newest date."""
    return (filings.where(F.col("registered").between(F.date_sub(F.lit(today), days), F.lit(today)))
            .groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("registered").alias("latest")))
