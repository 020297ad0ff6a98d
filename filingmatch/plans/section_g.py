"""Counts, series, top lists and rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, publish, rates
from . import check_sql as C
from . import landed as L
from .catalog import query
from .companies import companies
from .section_f import TODAY_SQL, today

_LISTED = f"(SELECT * FROM ({L.COMPANIES}) c WHERE state IN ('ready', 'pushed') AND has_lookup) li"
_ALL = f"(SELECT * FROM ({L.COMPANIES}) c WHERE state IN ('ready', 'pushed')) li"
_DAY = "coalesce(ready_at, pushed_at, first_seen)"


def listed(spark, sf):
    return companies(spark, sf).where(F.col("state").isin("ready", "pushed"))


@query("g1_counts_by_state", f"SELECT s.state, count(c.id) AS n FROM (VALUES ('new'), ('held'), ('ready'), ('pushed'), ('dropped')) s(state) LEFT JOIN ({L.COMPANIES}) c ON c.state = s.state GROUP BY s.state")
def g1(spark, sf):
    return metrics.counts_by_state(companies(spark, sf))


@query("g2_held_breakdown", f"""SELECT count(*) FILTER (state = 'new' AND NOT has_lookup) AS not_looked_up, count(*) FILTER (NOT (state = 'new' AND NOT has_lookup) AND NOT (has_lookup AND website <> '')) AS no_website,
 count(*) FILTER (NOT (state = 'new' AND NOT has_lookup) AND has_lookup AND website <> '') AS missing_contact FROM ({L.COMPANIES}) c WHERE state IN ('new', 'held')""")
def g2(spark, sf):
    return metrics.held_breakdown(companies(spark, sf))


@query("g3_added_per_day", f"SELECT CAST(d.d AS DATE) AS d, count(li.id) AS n FROM (SELECT unnest(generate_series({TODAY_SQL} - 11, {TODAY_SQL}, INTERVAL 1 DAY)) AS d) d LEFT JOIN {_ALL} ON {_DAY} = d.d GROUP BY d.d")
def g3(spark, sf):
    return metrics.added_per_day(listed(spark, sf), today())


@query("g4_recent_and_latest", f"""SELECT sum(n)::BIGINT AS total, sum(CASE WHEN d BETWEEN {TODAY_SQL} - 6 AND {TODAY_SQL} THEN n ELSE 0 END)::BIGINT AS last7, max(d) AS latest_day, arg_max(n, d) AS latest
 FROM (SELECT {_DAY} AS d, count(*) AS n FROM {_ALL} GROUP BY 1) q""")
def g4(spark, sf):
    return metrics.recent_and_latest(listed(spark, sf), today())


@query("g5_top_states", f"SELECT CASE WHEN state_code = '' THEN '?' ELSE state_code END AS value, count(*) AS n FROM {_ALL} GROUP BY 1 ORDER BY n DESC, value LIMIT 8")
def g5(spark, sf):
    return metrics.top(listed(spark, sf), F.coalesce(F.nullif("raw.state", F.lit("")), F.lit("?")))


@query("g5_top_sources", f"SELECT source AS value, count(*) AS n FROM {_ALL} GROUP BY 1 ORDER BY n DESC, value LIMIT 8")
def g5_sources(spark, sf):
    return metrics.top(listed(spark, sf), F.col("source"))


@query("g6_dashboard", f"""SELECT 'day' AS kind, CAST({_DAY} AS VARCHAR) AS value, count(*) AS n FROM {_ALL} GROUP BY 2 UNION ALL SELECT 'state', CASE WHEN state_code = '' THEN '?' ELSE state_code END, count(*) FROM {_ALL} GROUP BY 2
UNION ALL SELECT 'source', source, count(*) FROM {_ALL} GROUP BY 2 UNION ALL SELECT 'total', '', count(*) FROM {_ALL}""")
def g6(spark, sf):
    return metrics.dashboard(listed(spark, sf))


@query("g7_reachable", f"SELECT count(*) FILTER (email <> '' AND {C.fmt_phone('phone')} <> '') AS both_ways, count(*) AS total FROM {_LISTED}")
def g7(spark, sf):
    return metrics.reachable(publish.published(publish.listed(companies(spark, sf))))


@query("g8_list_version", f"SELECT count(*) AS n, max(coalesce(pushed_at, ready_at, first_seen)) AS newest FROM {_ALL}")
def g8(spark, sf):
    return metrics.list_version(companies(spark, sf)).select("n", "newest")


@query("g8_version_moves", f"SELECT count(*) > 0 AS differs, count(*) > 0 AS same_again FROM {_ALL}")
def g8_moves(spark, sf):
    """One address more on the listed rows is another version of the list, reading the same rows again is not."""
    rows = companies(spark, sf)
    more = rows.withColumn("enrich", F.col("enrich").withField("email", F.concat(F.coalesce("enrich.email", F.lit("")), F.lit("x"))))
    was, now, again = (metrics.list_version(x).select(F.struct("n", "newest", "size").alias(k)) for x, k in ((rows, "was"), (more, "now"), (rows, "again")))
    each = was.select("was", F.lit(None).cast("struct<n: long, newest: date, size: long>").alias("now"), F.lit(None).cast("struct<n: long, newest: date, size: long>").alias("again"))
    every = each.unionByName(now, allowMissingColumns=True).unionByName(again, allowMissingColumns=True)
    one = every.agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("was", "now", "again")])
    return one.select((F.col("was") != F.col("now")).alias("differs"), (F.col("was") == F.col("again")).alias("same_again"))


@query("g9_listed_in_order", f"SELECT id, registered FROM {_LISTED} ORDER BY registered DESC, id DESC")
def g9(spark, sf):
    return metrics.in_order(publish.listed(companies(spark, sf))).select("id", "raw.registered")


@query("g10_run_header", f"""SELECT arg_max(finished, id) FILTER (status IN ('ok', 'partial')) AS updated, max(id) AS last_run, arg_max(status, id) AS last_status,
 CASE arg_max(status, id) WHEN 'failed' THEN 'Last run: failed' WHEN 'offline' THEN 'Last run: no internet' ELSE '' END AS problem FROM ({L.RUNS}) r""")
def g10(spark, sf):
    return metrics.run_header(L.landed(spark, sf, L.RUNS))


@query("g10_recent_runs", f"SELECT * FROM ({L.RUNS}) r ORDER BY id DESC LIMIT 6")
def g10_recent(spark, sf):
    return metrics.recent_runs(L.landed(spark, sf, L.RUNS))


@query("g11_new_per_source", f"SELECT string_agg(source || '=' || n, ',' ORDER BY source) AS sources, sum(n)::BIGINT AS added FROM (SELECT source, count(*) AS n FROM ({L.FILINGS}) f GROUP BY source) q")
def g11(spark, sf):
    m = metrics.new_per_source(L.landed(spark, sf, L.FILINGS))
    pairs = F.transform(F.map_entries("sources"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return m.select(F.array_join(F.array_sort(pairs), ",").alias("sources"), "added")


@query("g12_trailing_count", """SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 899999999 PRECEDING AND CURRENT ROW) AS n FROM events""")
def g12(spark, sf):
    return rates.trailing_counts(L.table(spark, sf, "events"), "event_type", "ts").select("event_id", "event_type", "n")


@query("g13_retention", "SELECT count(*) AS n, min(event_id) AS first_event FROM events WHERE epoch_us(ts) >= epoch_us(TIMESTAMP '2024-01-20 12:00:00') - 86400000000")
def g13(spark, sf):
    now = F.lit("2024-01-20 12:00:00").cast("timestamp")
    return rates.kept(L.table(spark, sf, "events"), "ts", now).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query("g14_preview", f"SELECT least(count(*), 500) AS n, least(count(*), 500) AS known FROM {_LISTED}")
def g14(spark, sf):
    """Any 500 rows may be shown, so the check is that there are as many, and that each is a published row."""
    rows = publish.published(publish.listed(companies(spark, sf)))
    shown = metrics.preview(rows)
    row = F.to_json(F.struct(*shown.columns)).alias("row")
    known = rows.select(row).distinct().withColumn("known", F.lit(1))
    return shown.select(row).join(known, "row", "left").agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("known"))


@query("g15_admission", """WITH RECURSIVE e AS (SELECT event_id, event_type, ts, epoch_us(ts) AS us FROM events),
 a AS (SELECT event_type, min(struct_pack(us := us, id := event_id)) AS p FROM e GROUP BY event_type
  UNION ALL SELECT e.event_type, min(struct_pack(us := e.us, id := e.event_id)) FROM a JOIN e ON e.event_type = a.event_type AND e.us >= a.p.us + 900000000 GROUP BY e.event_type)
 SELECT event_id, event_type, ts, event_id IN (SELECT p.id FROM a) AS admitted FROM e""")
def g15(spark, sf):
    return rates.admitted(L.table(spark, sf, "events").select("event_id", "event_type", "ts"), "event_type", "ts", "event_id", limit=1)


@query("g15_reserve")
def g15_reserve(spark, sf):
    e = L.table(spark, sf, "events")
    e = e.withColumn("keys", F.array(F.concat(F.lit("type:"), "event_type"), F.concat(F.lit("user:"), F.col("user_id").cast("string"))))
    return rates.reserved(e.select("event_id", "keys", "ts"), "keys", "ts", "event_id", {"type": 2, "user": 1}).select("event_id", "admitted")
