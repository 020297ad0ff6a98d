"""Streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..operators import state
from ..sources import REGISTRY
from ..streaming import jobs
from . import landed as L
from .catalog import query
from .companies import companies
from .section_a import CHECK_TX, SINCE, UNTIL


@query("i1_incremental_intake", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1")
def i1(spark, sf):
    out, check = jobs.work_folder(spark) + "/t", jobs.work_folder(spark)
    rows = jobs.landing(spark, sf, "customer").select(F.concat(F.lit("tx:"), F.col("c_custkey").cast("string")).alias("id"), "c_mktsegment")
    jobs.run_available(rows, jobs.append_new(out), check)
    return spark.read.parquet(out).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))


@query("i1_registry_intake", f"SELECT count(*) AS n, count(DISTINCT id) AS ids FROM ({CHECK_TX}) t")
def i1_registry(spark, sf):
    """The rows of one registry as they land, through scan, window, first per id and intake."""
    out, check = jobs.work_folder(spark) + "/t", jobs.work_folder(spark)
    write = jobs.taking_in(out, REGISTRY["tx"], SINCE, UNTIL, F.lit(L.TODAY).cast("date"), lambda b: L.landed(b.sparkSession, sf, L.RAW["tx"], customer=b))
    jobs.run_available(jobs.landing(spark, sf, "customer"), write, check)
    return spark.read.parquet(out).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))


@query("i2_late_data", "SELECT count(DISTINCT user_id || event_type) AS n FROM events")
def i2(spark, sf):
    out, check = jobs.work_folder(spark) + "/t", jobs.work_folder(spark)
    rows = jobs.landing(spark, sf, "events").select(F.concat(F.col("user_id").cast("string"), "event_type").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    jobs.run_available(jobs.distinct_within(rows, "id", "ts"), jobs.append_new(out), check)
    return spark.read.parquet(out).agg(F.count(F.lit(1)).alias("n"))


@query("i3_timed_recheck", f"SELECT id, attempts + k AS attempt, first_seen + CAST([{', '.join(map(str, V.RETRY_DAYS))}][attempts + k + 1] AS INTEGER) AS due FROM ({L.COMPANIES}) c, (VALUES (1), (2), (3)) t(k) WHERE state = 'held' AND attempts + k < 4")
def i3(spark, sf):
    """Held companies whose next looks, each on the day it is due, leave them held."""
    rows, ladder, seen = companies(spark, sf).where("state = 'held'"), F.array(*[F.lit(d) for d in V.RETRY_DAYS]), []
    for _ in range(3):
        day = F.date_add("first_seen", F.get(ladder, F.col("attempts")))
        judged = rows.withColumn("new_state", F.col("state")).withColumn("new_enrich", F.col("enrich"))
        rows = state.recorded(judged, day).where("state = 'held'")
        seen.append(rows.select("id", F.col("attempts").alias("attempt"), F.col("next_due").alias("due")))
    return seen[0].unionByName(seen[1]).unionByName(seen[2])


@query("i4_sliding_rate", """SELECT event_type, w AS window_start, count(*) AS n FROM (SELECT event_type, unnest(generate_series(date_trunc('minute', ts) - INTERVAL 14 MINUTE, date_trunc('minute', ts), INTERVAL 1 MINUTE)) AS w FROM events) q
 GROUP BY event_type, w""")
def i4(spark, sf):
    out, check = jobs.work_folder(spark) + "/t", jobs.work_folder(spark)
    rows = jobs.landing(spark, sf, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    jobs.run_available(jobs.pane_counts(rows, "event_type", "ts"), jobs.keep_latest(out), check, mode="update")
    panes = jobs.latest(spark, out, ["pane", "event_type"])
    return jobs.window_counts(panes, "event_type").select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query("i5_repeat_safe_publish", "SELECT count(*) AS n, count(DISTINCT c_custkey) AS ids FROM customer")
def i5(spark, sf):
    """Batches as they land, each delivered twice, and all rows once more in a later batch, leave one row per id."""
    out, check = jobs.work_folder(spark) + "/t", jobs.work_folder(spark)
    write = jobs.upserting(out, F.lit(L.TODAY).cast("date"), ["company"])
    row = [F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("company"), F.col("c_custkey").alias("seq")]

    def twice(batch, batch_id):
        write(batch, batch_id)
        write(batch, batch_id)

    jobs.run_available(jobs.landing(spark, sf, "customer").select(*row), twice, check)
    write(L.table(spark, sf, "customer").select(*row), jobs.last_written(spark, out) + 1)
    return spark.read.parquet(f"{out}/batch={jobs.last_written(spark, out)}").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))
