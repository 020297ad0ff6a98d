"""Scans, sources and incremental reads."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import fixed_values as V
from .. import schemas as S
from ..functions import names as N
from ..sources import REGISTRY, build, crawl, page_scan, windows
from ..sources.registries import officers, with_people
from ..sources.spec import FILING_COLUMNS
from ..functions.people import person_name
from . import check_sql as C
from . import landed as L
from .catalog import query

SINCE, UNTIL, TODAY = date(2024, 1, 15), date(2024, 4, 20), date.fromisoformat(L.TODAY)
_S, _U = f"'{SINCE}'", f"'{UNTIL}'"


def raw(spark: SparkSession, sf: str, key: str) -> DataFrame:
    return L.landed(spark, sf, L.RAW[key])


def flat_filing(df: DataFrame) -> DataFrame:
    """A filing with its nested fields as text."""
    return df.select(*[c for c in FILING_COLUMNS if c not in ("emails", "extra")], F.array_join("emails", ",").alias("emails"),
                     F.coalesce(F.try_element_at("extra", F.lit("ubi")), F.lit("")).alias("ubi"))


def filings(spark: SparkSession, sf: str, key: str, since: date = SINCE, until: date = UNTIL) -> DataFrame:
    return REGISTRY[key].filings(raw(spark, sf, key), since, until)


def _normal(source: str, rid: str, tie: str, **v: str) -> str:
    """The select list of one normalized source plus the order that settles repeated ids."""
    given = {"trade_name": "''", "entity_type": "''", "individual": "false", "industry": "''", "phone": "''", "emails": "''", "ubi": "''",
             "coded": "true", **v, "id": f"'{source}:' || {rid}", "source": f"'{source}'"}
    cols = [c for c in FILING_COLUMNS if c not in ("emails", "extra")] + ["emails", "ubi"]
    return ", ".join(f"{given[c]} AS {c}" for c in cols) + f", {given['registered']} AS _age, {tie} AS _tie"


def _or(a: str, b: str) -> str:
    return f"coalesce(nullif({a}, ''), {b}, '')"


def _unique(select: str, frm: str) -> str:
    return (f"SELECT * EXCLUDE (_age, _tie, _rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY _age DESC, _tie) AS _rn "
            f"FROM (SELECT {select} FROM {frm}) s) u WHERE _rn = 1")


def _trade(a: str, b: str) -> str:
    return f"CASE WHEN {C.is_distinct_name(a, b)} THEN {C.tidy_name(b)} ELSE '' END"


def _between(col: str) -> str:
    return f"{col}[1:10] BETWEEN {_S} AND {_U}"


_D = "CAST(NULLIF({0}, '') AS DATE)"
CHECK_TX = _unique(_normal(
    "tx", "taxpayer_number || '-' || outlet_number", "taxpayer_name", name=C.tidy_name(_or("taxpayer_name", "outlet_name")),
    trade_name=_trade("taxpayer_name", "outlet_name"), entity_type=C.label(V.TX_ORG, "taxpayer_organization_type", "taxpayer_organization_type"),
    individual="taxpayer_organization_type = 'IS'", state=f"upper({_or('outlet_state', C.lit('TX'))})", city=C.title_case("outlet_city"),
    address=C.tidy_address("outlet_address"), zip=C.clean_zip("outlet_zip_code"), registered=_D.format(C.iso("outlet_permit_issue_date")),
    naics="CAST(outlet_naics_code AS VARCHAR)", industry="'Sales-tax permit, NAICS ' || CAST(outlet_naics_code AS VARCHAR)"),
    f"({L.RAW_TX}) x WHERE {_between('outlet_permit_issue_date')} AND {C.is_it_text('CAST(outlet_naics_code AS VARCHAR)')} "
    f"AND NOT (taxpayer_organization_type = 'IS' AND NOT {C.looks_like_company('outlet_name')})")
_CODE = r"'^(.*?)\s*\((\d{6})\)\s*$'"
_MAIL = "lower(trim(business_email_address))"
CHECK_CT = _unique(_normal(
    "ct", _or("accountnumber", "x.id"), "x.id", name=C.tidy_name("name"), entity_type="business_type", state=f"upper({_or('billingstate', C.lit('CT'))})",
    city=C.title_case("billingcity"), address=C.tidy_address("billingstreet"), zip=C.clean_zip("billingpostalcode"),
    registered=_D.format(C.iso("date_registration")), naics=f"regexp_extract(naics_code, {_CODE}, 2)", industry=f"trim(regexp_extract(naics_code, {_CODE}, 1))",
    emails=f"CASE WHEN {C.email_kind('business_email_address')} IN ('own', 'free') THEN {_MAIL} ELSE '' END"),
    f"({L.RAW_CT}) x WHERE {_between('date_registration')} AND regexp_matches(naics_code, '\\(({'|'.join(V.IT_PREFIXES)})')")
_SOLE = "lower(ownership_type) LIKE 'sole%'"
_SEA = f"CASE WHEN {_SOLE} THEN trade_name ELSE business_legal_name END"
CHECK_SEATTLE = _unique(_normal(
    "seattle", _or("city_account_number", "ubi"), f"{_SEA} || ' ' || trade_name", name=C.tidy_name(_SEA), trade_name=_trade(_SEA, "trade_name"),
    entity_type="ownership_type", individual=_SOLE, state=f"upper({_or('state', C.lit('WA'))})", city=C.title_case("city"),
    address=C.tidy_address("street_address"), zip=C.clean_zip("zip"), registered="CAST(strptime(license_start_date, '%Y%m%d') AS DATE)",
    naics="naics_code", industry="naics_description", phone=C.norm_phone("business_phone"), ubi="ubi"),
    f"({L.RAW_SEATTLE}) x WHERE license_start_date BETWEEN '{SINCE:%Y%m%d}' AND '{UNTIL:%Y%m%d}' AND {C.is_it_text('naics_code')} "
    f"AND NOT ({_SOLE} AND (trade_name = '' OR {C.flat('trade_name')} = {C.flat('business_legal_name')}))")
_OWN = C.looks_like_company("ownership_name")
CHECK_SF = _unique(_normal(
    "sf", _or("uniqueid", "ttxid"), f"(CASE WHEN {_OWN} THEN ownership_name ELSE dba_name END) || ' ' || ttxid",
    name=C.tidy_name(f"CASE WHEN {_OWN} THEN ownership_name ELSE dba_name END"),
    trade_name=f"CASE WHEN {_OWN} THEN {_trade('ownership_name', 'dba_name')} ELSE '' END", entity_type=f"CASE WHEN {_OWN} THEN 'Company' ELSE 'Individual' END",
    individual=f"NOT {_OWN}", state=f"upper({_or('state', C.lit('CA'))})", city=C.title_case(_or("city", "'San Francisco'")),
    address=C.tidy_address("full_business_address"), zip=C.clean_zip("business_zip"), registered=_D.format(C.iso("location_start_date")),
    naics="self_reported_naics_code", industry="'NAICS ' || self_reported_naics_code"),
    f"({L.RAW_SF}) x WHERE {_between('location_start_date')} AND {C.is_it_text('self_reported_naics_code')} AND ({_OWN} OR dba_name <> '')")
_LEGAL = C.looks_like_company("business_name")
CHECK_LA = _unique(_normal(
    "la", "location_account", "business_name || ' ' || dba_name", name=C.tidy_name("business_name"), trade_name=_trade("business_name", "dba_name"),
    entity_type=f"CASE WHEN {_LEGAL} THEN 'Company' ELSE 'Individual' END", individual=f"NOT {_LEGAL}",
    state=_or(C.state_from_zip("zip_code"), "'CA'"), city=C.title_case(_or("city", "'Los Angeles'")), address=C.tidy_address("street_address"),
    zip=C.clean_zip("zip_code"), registered=_D.format(C.iso("location_start_date")), naics="naics", industry="primary_naics_description"),
    f"({L.RAW_LA}) x WHERE {_between('location_start_date')} AND {C.is_it_text('naics')} AND ({_LEGAL} OR dba_name <> '')")
CHECK_SOURCES = {"tx": CHECK_TX, "ct": CHECK_CT, "seattle": CHECK_SEATTLE, "sf": CHECK_SF, "la": CHECK_LA}


@query("a1_registry_scan", f"""
SELECT uniqueid, ownership_name, location_start_date FROM ({L.RAW_SF}) r WHERE {_between('location_start_date')}
AND {C.is_it_text('self_reported_naics_code')}""")
def a1(spark, sf):
    spec = REGISTRY["sf"]
    return page_scan(raw(spark, sf, "sf"), spec.scan(SINCE, UNTIL), [F.desc("location_start_date"), F.asc("uniqueid"), F.asc("ttxid")],
                     ["uniqueid", "ownership_name", "location_start_date"])


@query("a2_remote_count", f"SELECT count(*) AS n FROM ({L.RAW_SF}) r WHERE {_between('location_start_date')} AND {C.is_it_text('self_reported_naics_code')}")
def a2(spark, sf):
    return raw(spark, sf, "sf").where(REGISTRY["sf"].scan(SINCE, UNTIL)).agg(F.count(F.lit(1)).alias("n"))


def _source_query(key: str):
    return lambda spark, sf: flat_filing(filings(spark, sf, key))


for _n, _key in ((3, "tx"), (4, "ct"), (6, "seattle"), (7, "sf"), (8, "la")):
    query(f"a{_n}_{ {'tx': 'texas', 'ct': 'connecticut', 'seattle': 'seattle', 'sf': 'san_francisco', 'la': 'los_angeles'}[_key]}_scan",
          CHECK_SOURCES[_key])(_source_query(_key))

_OFF_NAME = "concat_ws(' ', nullif(trim(firstname), ''), nullif(trim(lastname), ''))"
CHECK_OFFICERS = f"""SELECT business_id, create_dt, name__c, {C.tidy_name(_or(_OFF_NAME, 'trim(name__c)'))} AS name, {C.title_case('trim(designation)')} AS title
FROM ({L.RAW_CT_OFFICERS}) o WHERE {_or(_OFF_NAME, 'trim(name__c)')} <> ''"""


@query("a5_officers", f"""SELECT f.id, f.name AS company, o.create_dt, o.name, o.title FROM (SELECT *, x.id AS bid FROM ({L.RAW_CT}) x
  WHERE {_between('date_registration')} AND regexp_matches(naics_code, '\\(({'|'.join(V.IT_PREFIXES)})')) f LEFT JOIN ({CHECK_OFFICERS}) o ON o.business_id = f.bid""")
def a5(spark, sf):
    ct = raw(spark, sf, "ct").where(REGISTRY["ct"].scan(SINCE, UNTIL)).select("id", F.col("name").alias("company"))
    return (ct.join(officers(L.landed(spark, sf, L.RAW_CT_OFFICERS)), F.col("id") == F.col("business_id"), "left")
            .select("id", "company", "create_dt", "name", "title"))


_WITH_BID = f"(SELECT t.id, t.name, x.id AS bid FROM ({CHECK_CT}) t JOIN ({L.RAW_CT}) x ON t.id = 'ct:' || coalesce(nullif(x.accountnumber, ''), x.id) AND t.registered = CAST(x.date_registration[1:10] AS DATE) AND t.name = {C.tidy_name('x.name')})"


@query("a5_filing_people", f"""SELECT f.id, f.name, coalesce(string_agg(o.name || ' / ' || o.title, '; ' ORDER BY o.create_dt, o.name__c, o.name, o.title), '') AS people
FROM {_WITH_BID} f LEFT JOIN ({CHECK_OFFICERS}) o ON o.business_id = f.bid GROUP BY f.id, f.name""")
def a5_people(spark, sf):
    kids = L.landed(spark, sf, L.RAW_CT_OFFICERS)
    return with_people(filings(spark, sf, "ct"), kids).select("id", "name", F.array_join(F.transform("people", lambda p: F.concat(p["name"], F.lit(" / "), p["title"])), "; ").alias("people"))


@query("a5_first_officer", f"""SELECT f.id, f.name, first(o.name ORDER BY o.create_dt, o.name__c, o.name, o.title) AS officer, first(o.title ORDER BY o.create_dt, o.name__c, o.name, o.title) AS title
FROM {_WITH_BID} f LEFT JOIN (SELECT * FROM ({CHECK_OFFICERS}) o0 WHERE {C.person_name('o0.name', 'true')} IS NOT NULL) o ON o.business_id = f.bid GROUP BY f.id, f.name""")
def a5_first(spark, sf):
    kids = L.landed(spark, sf, L.RAW_CT_OFFICERS)
    persons = F.filter("people", lambda p: person_name(p["name"], registry=True).isNotNull())
    return with_people(filings(spark, sf, "ct"), kids).select("id", "name", F.get(persons, F.lit(0))["name"].alias("officer"), F.get(persons, F.lit(0))["title"].alias("title"))


@query("a9_source_union", " UNION ALL BY NAME ".join(f"({CHECK_SOURCES[k]})" for k in ("tx", "seattle", "la")))
def a9(spark, sf):
    chosen = build({"tx": True, "ct": False, "seattle": True, "sf": True, "la": True}, only=["tx", "seattle", "la"])
    return flat_filing(windows.union([filings(spark, sf, s.key) for s in chosen]))


@query("a10_code_predicate", f"""SELECT naics, {C.is_it_text('naics')} AS by_text, {C.is_it_text('naics')} AS by_number, {C.is_it_text('naics')} AS by_label, count(*) AS n
FROM ({L.REG}) r GROUP BY naics""")
def a10(spark, sf):
    reg = L.landed(spark, sf, L.REG)
    return (reg.withColumn("l", F.concat(F.col("naics_label"), F.lit(" ("), F.col("naics"), F.lit(")")))
            .groupBy("naics", N.code_is_it("naics").alias("by_text"), N.number_is_it(F.col("naics").cast("bigint")).alias("by_number"),
                     N.label_is_it("l").alias("by_label")).agg(F.count(F.lit(1)).alias("n")))


@query("a11_first_per_id", f"""SELECT id, name, registered FROM (SELECT 'tx:3' || {L._ID} || '-1' AS id, legal AS name, filed AS registered,
  row_number() OVER (PARTITION BY {L._ID} ORDER BY filed DESC, legal) AS rn FROM ({L.REG}) r) q WHERE rn = 1""")
def a11(spark, sf):
    from ..sources import first_per_id
    reg = L.landed(spark, sf, L.REG)
    rows = reg.select(F.expr(f"'tx:3' || {L._ID} || '-1'").alias("id"), F.col("legal").alias("name"), F.col("filed").alias("registered"),
                      F.struct((-F.unix_date("filed")).alias("age"), F.col("legal").alias("tie")).alias("_first"))
    return first_per_id(rows)


_LAGS = {k: s.lag for k, s in REGISTRY.items()}
_WINDOWS = f"""SELECT s.key, CASE WHEN last_ok IS NULL THEN DATE '{TODAY}' - 45
  ELSE greatest(DATE '{TODAY}' - 45, least(last_ok - lag, DATE '{TODAY}' - lag)) END AS since, DATE '{TODAY}' AS until
FROM ({L.SOURCE_STATE}) s JOIN (VALUES {', '.join(f"('{k}', {v})" for k, v in _LAGS.items())}) l(key, lag) ON l.key = s.key"""


@query("a12_source_window", f"""SELECT f.source, w.since, count(*) AS filings, min(f.registered) AS first_day FROM ({L.FILINGS}) f
JOIN ({_WINDOWS}) w ON w.key = f.source AND f.registered BETWEEN w.since AND w.until GROUP BY f.source, w.since""")
def a12(spark, sf):
    w = windows.windows(L.landed(spark, sf, L.SOURCE_STATE), list(REGISTRY.values()), TODAY)
    rows = windows.within_windows(L.landed(spark, sf, L.FILINGS), w, "source", "registered")
    return (rows.groupBy("source").agg(F.count(F.lit(1)).alias("filings"), F.min("registered").alias("first_day"))
            .join(F.broadcast(w.select(F.col("key").alias("source"), "since")), "source").select("source", "since", "filings", "first_day"))


_OUTCOME = f"""SELECT {L._picks('user_id', 'tx', 'ct', 'seattle', 'sf', 'la')} AS key,
  CASE WHEN count(CASE WHEN event_type = 'error' AND user_id % 10 < 2 THEN 1 END) > 0 THEN 'failed' ELSE 'ok' END AS status
FROM events GROUP BY {L._picks('user_id', 'tx', 'ct', 'seattle', 'sf', 'la')}"""


@query("a13_source_isolation", f"""SELECT s.key, CASE WHEN o.status = 'ok' THEN DATE '{TODAY}' ELSE s.last_ok END AS last_ok, o.status,
  (SELECT CASE WHEN count(*) FILTER (status <> 'ok') = count(*) THEN 'failed' WHEN count(*) FILTER (status <> 'ok') > 0 THEN 'partial' ELSE 'ok' END
   FROM ({_OUTCOME}) x) AS run_status FROM ({L.SOURCE_STATE}) s JOIN ({_OUTCOME}) o ON o.key = s.key""")
def a13(spark, sf):
    state, outcome = L.landed(spark, sf, L.SOURCE_STATE), L.landed(spark, sf, _OUTCOME)
    after = windows.advance(state, outcome, TODAY)
    every = Window.partitionBy(F.lit(1))                    # one row per source
    failed, all_ = F.count_if(F.col("status") != "ok").over(every), F.count(F.lit(1)).over(every)
    return after.join(outcome.withColumn("run_status", windows.overall(failed, all_)), "key").select("key", "last_ok", "status", "run_status")


@query("a14_freshness", f"""SELECT source, count(*) AS n, max(registered) AS latest FROM ({L.FILINGS}) f
WHERE registered BETWEEN DATE '{TODAY}' - 7 AND DATE '{TODAY}' GROUP BY source""")
def a14(spark, sf):
    return windows.freshness(L.landed(spark, sf, L.FILINGS), TODAY)


_CRAWL = """SELECT page_id, url, CASE WHEN page_id % 17 = 3 THEN '' ELSE html END AS html,
  CASE page_id % 7 WHEN 1 THEN 404 WHEN 2 THEN 301 ELSE 200 END AS status,
  CASE page_id % 5 WHEN 2 THEN 'application/pdf' WHEN 3 THEN 'TEXT/plain' ELSE 'text/html; charset=utf-8' END AS content_type FROM pages"""


@query("a15_page_admission", f"""SELECT page_id, {C.bare_host('url')} AS host, strlen(html) AS bytes FROM ({_CRAWL}) p
WHERE status < 400 AND strlen(html) > 0 AND (lower(content_type) LIKE '%html%' OR lower(content_type) LIKE '%text%')""")
def a15(spark, sf):
    return crawl.located(crawl.admitted(L.landed(spark, sf, _CRAWL))).select("page_id", "host", F.octet_length("html").cast("bigint").alias("bytes"))


@query("a16_nested_read", """SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k_value, event_id % 13 <> 0 AS readable FROM events WHERE event_id % 13 <> 0
UNION ALL SELECT event_id, NULL, false FROM events WHERE event_id % 13 = 0""")
def a16(spark, sf):
    stored = L.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 13 == 0, F.concat(F.lit("{broken"), "props")).otherwise(
        F.col("props")).alias("raw"))
    read = stored.withColumn("r", F.from_json("raw", "struct<k:bigint>"))
    return read.select("event_id", F.col("r.k").alias("k_value"), F.col("r.k").isNotNull().alias("readable"))


def all_filings(spark: SparkSession, sf: str) -> DataFrame:
    """The filing records the matching jobs read, in the stored schema."""
    f = L.landed(spark, sf, L.FILINGS)
    return to_records(f)


def to_records(f: DataFrame) -> DataFrame:
    person = F.struct(F.col("officer").alias("name"), F.col("officer_title").alias("title"))
    cols = {"entity_type": F.lit(""), "naics": F.lit(""), "coded": F.lit(True), "extra": F.create_map().cast("map<string,string>"),
            "emails": F.filter(F.array("email"), lambda e: e != ""), "people": F.array(person)}
    return f.select(*[cols[x.name].alias(x.name) if x.name in cols else F.col(x.name) for x in S.FILING.fields])
