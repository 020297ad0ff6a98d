"""Sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..operators import publish
from . import check_sql as C
from . import landed as L
from .catalog import query
from .companies import companies
from .section_b import FIT, MAIL_FROM
from .section_f import TODAY_SQL, today

_SINCE = "CASE WHEN created IS NOT NULL THEN ' (domain registered ' || created || ')' ELSE '' END"
_ROWS = f"""SELECT id, name || CASE WHEN trade_name <> '' THEN ' (' || trade_name || ')' ELSE '' END AS company, website, email, {C.fmt_phone('phone')} AS phone,
 {C.compose_address("CASE WHEN individual THEN '' ELSE address END", 'city', 'state_code', "CASE WHEN individual THEN '' ELSE zip END")} AS address, CAST(registered AS VARCHAR) AS registered,
 contact_name || CASE WHEN contact_name <> '' AND contact_title <> '' THEN ', ' || contact_title ELSE '' END AS contact, '' AS contact_email,
 CASE WHEN linkedin = '' AND linkedin_company <> '' THEN linkedin_company ELSE linkedin END AS linkedin, CASE WHEN linkedin = '' AND linkedin_company <> '' THEN 'Company' ELSE 'Profile' END AS linkedin_label,
 industry, state_code AS state, {C.label(V.SOURCE_LABEL, 'source', 'source')} AS source, {FIT} AS fit,
 concat_ws('. ', 'Website: ' || why || {_SINCE}, CASE WHEN email <> '' THEN 'Email: ' || {MAIL_FROM} END, CASE WHEN phone <> '' THEN 'Phone: ' || phone_from END) AS proof
FROM ({L.COMPANIES}) c WHERE @WHERE@"""
_LISTED = _ROWS.replace("@WHERE@", "state IN ('ready', 'pushed') AND has_lookup")


@query("h1_published_rows", _LISTED)
def h1(spark, sf):
    return publish.published(publish.listed(companies(spark, sf)))


_SHEET_CELLS = ["company", "phone", "address", "industry", "state"]
SHEET = f"""SELECT 'c' || CAST(s_suppkey AS STRING) AS id, {L._pick('s_suppkey', 's_name', "''")} AS company, {L._pick('s_suppkey', "''", "'by hand'", "''")} AS phone,
 CAST(s_acctbal AS STRING) AS address, '' AS industry, {L._pick('s_suppkey', "'TX'", "''")} AS state, DATE '2024-04-01' AS added FROM supplier"""
INCOMING = f"""SELECT {L._pick('c_custkey', "'c' || CAST(c_custkey AS STRING)", "'c' || CAST(c_custkey - 1 AS STRING)", "'c' || CAST(c_custkey AS STRING)", "''")} AS id,
 {L._pick('c_custkey', 'c_name', 'c_name', 'c_name', 'c_name', "''")} AS company, '(415) 624-0001' AS phone, 'somewhere' AS address, c_mktsegment AS industry, 'CA' AS state, c_custkey AS seq FROM customer"""
_ONCE = f"""(SELECT * FROM ({INCOMING}) i WHERE id <> '' AND company <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1)"""
_FILL = ", ".join(f"coalesce(nullif(s.{c}, ''), nullif(i.{c}, ''), '') AS {c}" for c in _SHEET_CELLS)
_MERGED = f"""SELECT coalesce(s.id, i.id) AS id, {_FILL}, CASE WHEN s.id IS NULL THEN {TODAY_SQL} ELSE s.added END AS added,
 CASE WHEN s.id IS NULL THEN 'inserted' WHEN i.id IS NOT NULL THEN 'updated' ELSE 'kept' END AS action FROM ({SHEET}) s FULL OUTER JOIN {_ONCE} i ON i.id = s.id"""


@query("h2_upsert", _MERGED)
def h2(spark, sf):
    return publish.upsert(L.landed(spark, sf, SHEET), L.landed(spark, sf, INCOMING), today(), _SHEET_CELLS)


@query("h2_upsert_counts", f"""SELECT count(*) FILTER (action = 'inserted') AS inserted, count(*) FILTER (action = 'updated') AS updated,
 (SELECT count(*) FROM customer) - count(*) FILTER (action <> 'kept') AS skipped, count(*) AS total FROM ({_MERGED}) m""")
def h2_counts(spark, sf):
    incoming = L.landed(spark, sf, INCOMING)
    return publish.upsert_counts(incoming, publish.upsert(L.landed(spark, sf, SHEET), incoming, today(), _SHEET_CELLS))


@query("h3_csv_rows", "SELECT " + ", ".join(f"{C.csv_safe(k)} AS \"{h}\"" for h, k in V.CSV_COLUMNS) + f" FROM ({_LISTED}) r")
def h3(spark, sf):
    return publish.csv_rows(publish.published(publish.listed(companies(spark, sf))))


_INCOMPLETE = ["company", "website", "email", "phone", "address", "registered", "state", "source"]


@query("h4_incomplete", "SELECT " + ", ".join(f"{C.csv_safe(c)} AS {c}" for c in _INCOMPLETE) + ", stage, '' AS missing FROM (SELECT r.*, c2.state AS stage FROM ("
       + _ROWS.replace("@WHERE@", "state IN ('held', 'new') AND has_lookup") + f") r JOIN ({L.COMPANIES}) c2 ON c2.id = r.id) q")
def h4(spark, sf):
    return publish.incomplete(companies(spark, sf))


@query("h5_redacted", f"""SELECT id, state, name, website, domain, next_due FROM ({L.COMPANIES}) c0 WHERE false UNION ALL
SELECT id, state, name, CASE WHEN has_lookup THEN website END, nullif(domain, ''), next_due FROM ({L.COMPANIES}) c WHERE state IN ('ready', 'pushed')
UNION ALL SELECT source || ':x' || row_number() OVER (ORDER BY id), state, NULL, CASE WHEN has_lookup THEN CASE WHEN website <> '' THEN 'yes' ELSE '' END END, NULL, NULL FROM ({L.COMPANIES}) c WHERE state NOT IN ('ready', 'pushed')""")
def h5(spark, sf):
    return publish.redacted(companies(spark, sf)).select("id", "state", "raw.name", "enrich.website", "domain", "next_due")


_PLANT = "state NOT IN ('ready', 'pushed') AND length(id) % 2 = 1"


@query("h5_leaks", f"""SELECT id FROM ({L.COMPANIES}) c WHERE {_PLANT} UNION ALL SELECT 'mail-' || id FROM ({L.COMPANIES}) c WHERE {_PLANT} AND website <> '' AND has_lookup""")
def h5_leaks(spark, sf):
    """A redacted copy has no leak; what is planted in it, whole companies and lone lookup details, is found."""
    whole = companies(spark, sf)
    clean = publish.redacted(whole)
    planted = whole.where(_PLANT)
    looked = planted.where("enrich.website <> ''")
    nothing = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in whole.schema["raw"].dataType.fields])
    lone = F.struct(*[(F.lit("a@b.example") if f.name == "email" else F.lit(None).cast(f.dataType)).alias(f.name) for f in whole.schema["enrich"].dataType.fields])
    hidden = {"id": F.concat(F.lit("mail-"), "id"), "raw": nothing, "enrich": lone, "domain": F.lit(None).cast("string"), "pushed_hash": F.lit(None).cast("string")}
    mail = looked.select(*[hidden[c].alias(c) if c in hidden else F.col(c) for c in whole.columns])
    return publish.leaks(clean.unionByName(planted).unionByName(mail)).select("id")


@query("h6_run_log", f"SELECT started, 1260 AS seconds, added, held, pushed AS updated, {C.csv_safe(C.lit('=') + ' || trigger_kind')} AS sources, status, '' AS errors FROM ({L.RUNS}) r")
def h6(spark, sf):
    r = L.landed(spark, sf, L.RUNS).select("started", F.lit(1260).alias("seconds"), "added", "held", F.col("pushed").alias("updated"),
                                           F.concat(F.lit("="), "trigger_kind").alias("sources"), "status", F.lit("").alias("errors"))
    return publish.log_row(r)


@query("h7_state_version", f"SELECT id, state, attempts, strikes FROM ({L.COMPANIES}) c")
def h7(spark, sf):
    """A version of the state table written beside the others and read back."""
    from ..streaming.jobs import work_folder
    path = publish.write_version(companies(spark, sf), work_folder(spark), "1")
    return spark.read.parquet(path).select("id", "state", "attempts", "strikes")
