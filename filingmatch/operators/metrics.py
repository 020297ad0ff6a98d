"""Counts, series and top lists over the state table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.core import nonempty


def _labels(df: DataFrame, values: list[str], name: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(v,) for v in values], f"{name} string")


def counts_by_state(companies: DataFrame) -> DataFrame:
    """All five states, zeros filled."""
    n = companies.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    return _labels(companies, V.STATES_OF_COMPANY, "state").join(n, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


def held_breakdown(companies: DataFrame) -> DataFrame:
    """Companies not listed yet, by reason."""
    seen, site = F.col("enrich").isNotNull(), nonempty("enrich.website")
    fresh = (F.col("state") == "new") & ~seen
    return companies.where(F.col("state").isin("new", "held")).agg(
        F.count_if(fresh).alias("not_looked_up"), F.count_if(~fresh & ~(seen & site)).alias("no_website"), F.count_if(~fresh & seen & site).alias("missing_contact"))


def listed_day() -> Column:
    return F.coalesce("ready_at", "pushed_at", "first_seen")


def added_per_day(listed: DataFrame, today: Column, days: int = 12) -> DataFrame:
    """The last days with their counts, zeros filled."""
    series = listed.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(today, days - 1), today)).alias("d"))
    n = listed.where(listed_day() >= F.date_sub(today, days - 1)).groupBy(listed_day().alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return series.join(n, "d", "left").select("d", F.coalesce("n", F.lit(0)).alias("n"))


def recent_and_latest(listed: DataFrame, today: Column) -> DataFrame:
    """Total, last seven days, newest day and its count."""
    per_day = listed.groupBy(listed_day().alias("d")).agg(F.count(F.lit(1)).alias("n"))
    week = F.sum(F.when(F.col("d").between(F.date_sub(today, 6), today), F.col("n")).otherwise(0))
    return per_day.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(week, F.lit(0)).alias("last7"), F.max("d").alias("latest_day"),
                       F.coalesce(F.max_by("n", "d"), F.lit(0)).alias("latest"))


def top(rows: DataFrame, key: Column, limit: int = 8) -> DataFrame:
    """The most frequent values, ties by value."""
    return rows.groupBy(key.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("value")).limit(limit)


def dashboard(listed: DataFrame) -> DataFrame:
    """Day, state, source and total counts of the listed companies in one aggregate over one scan."""
    base = listed.select(listed_day().alias("d"), F.when(nonempty("raw.state"), F.col("raw.state")).otherwise("?").alias("s"), F.col("raw.source").alias("r"))
    sets = base.groupingSets([["d"], ["s"], ["r"], []], "d", "s", "r").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("g") == 3, "day").when(F.col("g") == 5, "state").when(F.col("g") == 6, "source").otherwise("total")
    return sets.select(kind.alias("kind"), F.coalesce(F.col("d").cast("string"), "s", "r", F.lit("")).alias("value"), "n")


def reachable(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(nonempty("email") & nonempty("phone")).alias("both_ways"), F.count(F.lit(1)).alias("total"))


def list_version(companies: DataFrame) -> DataFrame:
    """Changes whenever what the downloads contain changes."""
    return companies.where(F.col("state").isin(V.LISTED)).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.coalesce("pushed_at", "ready_at", "first_seen")).alias("newest"),
        F.coalesce(F.sum(F.length(F.to_json("enrich"))), F.lit(0)).alias("size"))


def in_order(listed: DataFrame) -> DataFrame:
    """Newest filing first."""
    return listed.orderBy(F.desc_nulls_last("raw.registered"), F.desc("id"))


def run_header(runs: DataFrame) -> DataFrame:
    """When the list was last refreshed, and a note when the newest run failed."""
    good = F.col("status").isin("ok", "partial")
    last = F.max_by("status", "id")
    return runs.agg(F.max_by(F.when(good, F.coalesce("finished", "started")), F.when(good, F.col("id"))).alias("updated"), F.max("id").alias("last_run"), last.alias("last_status"),
                    F.when(last == "failed", "Last run: failed").when(last == "offline", "Last run: no internet").otherwise("").alias("problem"))


def recent_runs(runs: DataFrame, n: int = 6) -> DataFrame:
    return runs.orderBy(F.desc("id")).limit(n)


def new_per_source(rows: DataFrame) -> DataFrame:
    """One row: source -> new filings, as a map (as many entries as there are registries)."""
    n = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("sources"), F.sum("n").alias("added"))


def preview(rows: DataFrame, n: int = 500) -> DataFrame:
    return rows.select("company", "website", "email", "phone", "registered", "state").limit(n)
