"""Rules, state transitions and re-judging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cells import row_hash
from ..operators import publish, rules, state
from ..operators.skew import spread
from . import check_sql as C
from . import landed as L
from .catalog import query
from .companies import companies

TODAY_SQL = f"DATE '{L.TODAY}'"
DEFAULT = rules.Rules()
STRICT = rules.Rules(require=("website", "email", "phone", "address"), skip_established=True, contact_either=True)


def today():
    return F.lit(L.TODAY).cast("date")


def _mail_ok(e: str) -> str:
    return f"(trim({e}) <> '' AND NOT {C.not_a_contact(C.let(e, 'm9', 'split_part(m9, chr(64), 1)'))})"


def _phone_ok(p: str, came: str) -> str:
    return f"({C.usable_phone(p)} <> '' AND {came} <> 'city licence')"


def sql_qualify(email: str, phone: str, came: str, strict: bool = False) -> tuple[str, str]:
    """(state, missing) over the flat state table."""
    mail, tel = _mail_ok(email), _phone_ok(phone, came)
    if strict:
        parts = f"CASE WHEN NOT {mail} AND NOT {tel} THEN 'email or phone' END, CASE WHEN address = '' THEN 'address' END"
        old = "date_diff('day', created, registered) / 365.25 >= 3"
    else:
        parts, old = f"CASE WHEN NOT {mail} THEN 'email' END, CASE WHEN NOT {tel} THEN 'phone' END", "false"
    missing = f"concat_ws(', ', {parts})"
    st = f"CASE WHEN NOT has_lookup OR website = '' THEN 'held' WHEN {old} OR it_level = 'none' THEN 'dropped' WHEN {missing} <> '' THEN 'held' ELSE 'ready' END"
    ms = (f"CASE WHEN NOT has_lookup OR website = '' THEN 'website' WHEN {old} THEN 'established company (website since ' || year(created) || ')' "
          f"WHEN it_level = 'none' THEN 'no sign of IT work on the website' ELSE {missing} END")
    return st, ms


def _qualify_check(strict: bool) -> str:
    st, ms = sql_qualify("email", "phone", "phone_from", strict)
    return f"SELECT id, {st} AS verdict, {ms} AS missing FROM ({L.COMPANIES}) c"


def _qualified(spark, sf, r):
    q = rules.qualify(F.col("raw"), F.col("enrich"), r)
    return companies(spark, sf).select("id", q.alias("q")).select("id", F.col("q.state").alias("verdict"), F.array_join("q.missing", ", ").alias("missing"))


@query("f1_qualify", _qualify_check(False))
def f1(spark, sf):
    return _qualified(spark, sf, DEFAULT)


@query("f1_qualify_strict", _qualify_check(True))
def f1_strict(spark, sf):
    return _qualified(spark, sf, STRICT)


@query("f2_usable", f"SELECT id, has_lookup AND {_mail_ok('email')} AS email_ok, has_lookup AND {_phone_ok('phone', 'phone_from')} AS phone_ok FROM ({L.COMPANIES}) c")
def f2(spark, sf):
    e = F.col("enrich")
    return companies(spark, sf).select("id", rules.has_usable_email(e).alias("email_ok"), rules.has_usable_phone(e).alias("phone_ok"))


CLEANED = f"""
cl AS (SELECT *, phone <> '' AND {C.usable_phone('phone')} = '' AS refused, {C.usable_phone('phone2')} AS next_phone, email <> '' AND NOT {_mail_ok('email')} AS no_mail,
  CASE WHEN contact_from = 'state registry' THEN {C.person_name('contact_name', 'true')} ELSE {C.person_name('contact_name', 'false', C.core_tokens('name'))} END AS who,
  {C.clean_title('contact_title')} AS what, {C.person_name('officer', 'true')} AS off, {C.clean_title('officer_title')} AS off_title FROM ({L.COMPANIES}) c),
c2 AS (SELECT *, CASE WHEN refused THEN next_phone ELSE phone END AS phone_n, CASE WHEN refused AND next_phone = '' THEN '' ELSE phone_from END AS phone_from_n, CASE WHEN no_mail THEN '' ELSE email END AS email_n,
  CASE WHEN no_mail THEN '' ELSE email_from END AS email_from_n, who IS NOT NULL AND (contact_from = 'state registry' OR (what <> '' AND {C.is_lead('what')})) AS good FROM cl),
c3 AS (SELECT *, CASE WHEN contact_name = '' THEN '' WHEN good THEN who ELSE coalesce(off, '') END AS name_n, CASE WHEN contact_name = '' THEN '' WHEN good THEN what WHEN off IS NOT NULL THEN off_title ELSE '' END AS title_n,
  CASE WHEN contact_name = '' THEN linkedin WHEN good THEN linkedin ELSE '' END AS linkedin_n,
  has_lookup AND (phone_n <> phone OR phone_from_n <> phone_from OR email_n <> email OR email_from_n <> email_from OR next_phone = '' OR
    (contact_name <> '' AND (NOT good OR who <> contact_name OR what <> contact_title))) AS changed FROM c2)
"""


@query("f3_clean_stored", f"WITH {CLEANED} SELECT id, phone_n AS phone, phone_from_n AS phone_from, next_phone AS phones, email_n AS email, email_from_n AS email_from, name_n AS contact, title_n AS title, linkedin_n AS linkedin FROM c3 WHERE has_lookup")
def f3(spark, sf):
    c = spread(companies(spark, sf).where(F.col("enrich").isNotNull()).select("id", "raw", "enrich"))
    e = c.select("id", rules.clean_stored(F.col("raw"), F.col("enrich")).alias("e"))
    blank = lambda x: F.coalesce(F.col(x), F.lit(""))                                            # noqa: E731
    return e.select("id", "e.phone", "e.phone_from", F.array_join("e.phones", " ").alias("phones"), "e.email", "e.email_from",
                    blank("e.contact.name").alias("contact"), blank("e.contact.title").alias("title"), "e.linkedin")


_KIND = "CASE WHEN CAST(split_part(id, ':', 2) AS BIGINT) % 7 = 2 THEN 'transient' WHEN CAST(split_part(id, ':', 2) AS BIGINT) % 13 = 5 THEN 'crash' ELSE 'ok' END"


@query("f4_record_attempt", f"""SELECT id, CASE WHEN q IN ('new', 'held') AND attempts + 1 >= 4 THEN 'dropped' ELSE q END AS state, attempts + 1 AS attempts,
 CASE WHEN q IN ('new', 'held') AND attempts + 1 < 4 THEN greatest(first_seen + [0, 3, 10, 30][attempts + 2], {TODAY_SQL} + 1) END AS next_due,
 CASE WHEN q = 'ready' THEN coalesce(ready_at, {TODAY_SQL}) ELSE ready_at END AS ready_at, 0 AS strikes
FROM (SELECT *, {sql_qualify('email', 'phone', 'phone_from')[0]} AS q FROM ({L.COMPANIES}) c WHERE state IN ('new', 'held', 'ready')) z""")
def f4(spark, sf):
    c = companies(spark, sf).where(F.col("state").isin("new", "held", "ready"))
    judged = c.withColumn("new_state", rules.qualify(F.col("raw"), F.col("enrich"), DEFAULT)["state"]).withColumn("new_enrich", F.col("enrich"))
    return state.recorded(judged, today()).select("id", "state", "attempts", "next_due", "ready_at", "strikes")


@query("f5_strikes", f"""SELECT id, kind, CASE WHEN kind = 'ok' THEN 'judge' WHEN kind = 'transient' AND strikes + 1 < 3 THEN 'strike' ELSE 'miss' END AS outcome,
 CASE WHEN kind = 'transient' AND strikes + 1 < 3 THEN strikes + 1 ELSE 0 END AS strikes FROM (SELECT id, strikes, {_KIND} AS kind FROM ({L.COMPANIES}) c) q""")
def f5(spark, sf):
    c = L.landed(spark, sf, L.COMPANIES).select("id", "strikes", F.expr(_KIND).alias("kind"))
    return state.with_strikes(c).select("id", "kind", "outcome", "strikes")


@query("f6_misses", f"""SELECT id, CASE WHEN attempts + 1 >= 4 THEN 'dropped' ELSE 'held' END AS state, CASE WHEN kind = 'crash' THEN 'lookup error' ELSE 'website' END AS missing, attempts + 1 AS attempts
FROM (SELECT id, attempts, strikes, {_KIND} AS kind FROM ({L.COMPANIES}) c) q WHERE kind = 'crash' OR (kind = 'transient' AND strikes + 1 >= 3)""")
def f6(spark, sf):
    c = companies(spark, sf).withColumn("kind", F.expr(_KIND))
    missed = state.with_strikes(c).where("outcome = 'miss'")
    empty = F.struct(*[(state.miss_reason(F.col("kind")) if f.name == "missing" else F.lit(None).cast(f.dataType)).alias(f.name) for f in c.schema["enrich"].dataType.fields])
    done = state.recorded(missed.withColumn("new_state", F.lit("held")).withColumn("new_enrich", empty), today())
    return done.select("id", "state", F.array_join("enrich.missing", ", ").alias("missing"), "attempts")


_QC, _MC = sql_qualify("email_n", "phone_n", "phone_from_n")
_QR, _ = sql_qualify("email", "phone", "phone_from")
PLAN = f"""
{CLEANED},
j AS (SELECT *, CASE WHEN state IN ('ready', 'pushed') THEN {_QC} ELSE {_QR} END AS q, {_MC} AS why_not FROM c3),
w AS (SELECT *, state IN ('held', 'dropped') AND has_lookup AND q = 'ready' AS wants FROM j),
fr AS (SELECT id FROM w WHERE wants AND (domain = '' OR domain NOT IN (SELECT domain FROM w WHERE state IN ('ready', 'pushed') AND domain <> ''))
  QUALIFY row_number() OVER (PARTITION BY domain, CASE WHEN domain = '' THEN id END ORDER BY first_seen, id) = 1),
p AS (SELECT *, CASE WHEN wants AND id IN (SELECT id FROM fr) THEN 'released' WHEN state = 'pushed' AND has_lookup AND q <> 'ready' THEN 'unlisted'
  WHEN state = 'ready' AND has_lookup AND q <> 'ready' THEN 'demoted' WHEN state IN ('ready', 'pushed') AND changed THEN 'cleaned' END AS action FROM w)
"""


def plan(spark, sf):
    return state.rejudged(companies(spark, sf), DEFAULT, today())


@query("f7_release", f"WITH {PLAN} SELECT id, state AS was, {TODAY_SQL} AS ready_at FROM p WHERE action = 'released'")
def f7(spark, sf):
    return plan(spark, sf).where("action = 'released'").select("id", F.col("state").alias("was"), F.col("new_ready_at").alias("ready_at"))


@query("f8_demote", f"""WITH {PLAN} SELECT id, action, CASE WHEN action = 'unlisted' THEN 'held' ELSE q END AS becomes, why_not AS missing,
 CASE WHEN action = 'unlisted' THEN {TODAY_SQL} WHEN q = 'held' THEN {TODAY_SQL} + 1 END AS next_due FROM p WHERE action IN ('unlisted', 'demoted')""")
def f8(spark, sf):
    return (plan(spark, sf).where(F.col("action").isin("unlisted", "demoted"))
            .select("id", "action", F.col("new_state").alias("becomes"), F.array_join("new_enrich.missing", ", ").alias("missing"), F.col("new_next_due").alias("next_due")))


@query("f9_clean_in_place", f"WITH {PLAN} SELECT id, email_n AS email, phone_n AS phone, name_n AS contact FROM p WHERE action = 'cleaned'")
def f9(spark, sf):
    return plan(spark, sf).where("action = 'cleaned'").select("id", "new_enrich.email", "new_enrich.phone", F.coalesce("new_enrich.contact.name", F.lit("")).alias("contact"))


@query("f10_rejudge_report", f"WITH {PLAN} SELECT action, count(*) AS n FROM p WHERE action IS NOT NULL GROUP BY action")
def f10(spark, sf):
    return plan(spark, sf).where("action IS NOT NULL").groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("f11_repair_dry_run", f"""WITH {PLAN} SELECT id, name, action, state AS was, CASE action WHEN 'released' THEN 'ready' WHEN 'unlisted' THEN 'held' WHEN 'demoted' THEN q ELSE state END AS becomes,
 CASE WHEN action IN ('unlisted', 'demoted') THEN why_not ELSE '' END AS missing FROM p WHERE action IS NOT NULL""")
def f11(spark, sf):
    return state.change_log(plan(spark, sf))


@query("f12_push_marks", f"""SELECT state, pushed_at, hashed, count(*) AS n FROM (SELECT CASE WHEN state = 'ready' AND acked THEN 'pushed' ELSE state END AS state,
 CASE WHEN state = 'ready' AND acked THEN {TODAY_SQL} ELSE pushed_at END AS pushed_at, state = 'ready' AND acked AS hashed FROM (SELECT *, CAST(split_part(id, ':', 2) AS BIGINT) % 3 <> 1 AS acked FROM ({L.COMPANIES}) c) a) b GROUP BY ALL""")
def f12(spark, sf):
    c = companies(spark, sf)
    sent = publish.published(c.where("state = 'ready' AND enrich IS NOT NULL"))
    hashes = sent.select("id", row_hash(*sent.columns).alias("row_hash"))
    all_ready = c.where("state = 'ready'").select("id").join(hashes, "id", "left").select("id", F.coalesce("row_hash", F.lit("-")).alias("row_hash"))
    ack = all_ready.where(F.split_part("id", F.lit(":"), F.lit(2)).cast("bigint") % 3 != 1)
    marked = state.mark_pushed(c, ack, today())
    return marked.groupBy("state", "pushed_at", F.col("pushed_hash").isNotNull().alias("hashed")).agg(F.count(F.lit(1)).alias("n"))


@query("f12_batches", f"""SELECT batch, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (SELECT id, CAST(floor((row_number() OVER (ORDER BY id) - 1) / 80) AS BIGINT) AS batch FROM ({L.COMPANIES}) c WHERE state = 'ready') q GROUP BY batch""")
def f12_batches(spark, sf):
    ready = L.landed(spark, sf, L.COMPANIES).where("state = 'ready'").select("id")
    return state.batches(ready, ["id"]).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("f13_bulk_rewrites", f"""SELECT 'reset' AS job, CASE WHEN state = 'pushed' THEN 'ready' ELSE state END AS state, count(*) AS n, count(CASE WHEN state = 'pushed' THEN NULL ELSE pushed_at END) AS dated FROM ({L.COMPANIES}) c GROUP BY ALL
UNION ALL SELECT 'recheck', state, count(*), count(CASE WHEN state = 'ready' THEN 1 WHEN next_due = {TODAY_SQL} THEN 1 END) FROM ({L.COMPANIES}) c GROUP BY ALL
UNION ALL SELECT 'set', CASE WHEN attempts = 3 THEN 'dropped' ELSE state END AS st, count(*), 0 FROM ({L.COMPANIES}) c GROUP BY ALL""")
def f13(spark, sf):
    c = companies(spark, sf)
    n = F.count(F.lit(1)).alias("n")
    reset = state.reset_pushed(c).groupBy("state").agg(n, F.count("pushed_at").alias("dated")).select(F.lit("reset").alias("job"), "state", "n", "dated")
    again = state.recheck_listed(c, today()).groupBy("state").agg(n, F.count_if(F.col("next_due") == today()).alias("dated")).select(F.lit("recheck"), "state", "n", "dated")
    put = state.set_state(c, c.where("attempts = 3").select("id"), "dropped").groupBy("state").agg(n).select(F.lit("set"), "state", "n", F.lit(0).cast("bigint"))
    return reset.union(again).union(put)


@query("f14_run_status", f"""SELECT sources, failed, errors, checked, CASE WHEN failed = sources THEN 'failed' WHEN failed > 0 OR (errors >= 10 AND errors > 0.05 * (checked + errors)) THEN 'partial' ELSE 'ok' END AS status
FROM (SELECT count(*) AS sources, count(*) FILTER (last_ok IS NULL) AS failed FROM ({L.SOURCE_STATE}) s) a,
 (SELECT count(*) FILTER (kind = 'transient' AND strikes + 1 < 3) AS errors, count(*) FILTER (NOT (kind = 'transient' AND strikes + 1 < 3)) AS checked FROM (SELECT strikes, {_KIND} AS kind FROM ({L.COMPANIES}) c) q) b""")
def f14(spark, sf):
    src = L.landed(spark, sf, L.SOURCE_STATE).select("key", F.when(F.col("last_ok").isNull(), "failed").otherwise("ok").alias("status"))
    c = L.landed(spark, sf, L.COMPANIES).select("id", "strikes", F.expr(_KIND).alias("kind"))
    return state.run_status(src, state.with_strikes(c)).select("sources", "failed", "errors", "checked", "status")
