"""Joins and entity resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.core import text
from ..functions.places import mentions_word
from ..operators import match as X
from ..operators import pages as P
from ..operators import state as S
from . import check_sql as C
from . import landed as L
from .catalog import query
from .section_a import all_filings
from .section_c import HEAD, HOMES, PHONES, _with, pages, texts

_PARTS = "list_filter(list_transform(string_split({0}, '/'), lambda n1: trim(n1)), lambda n2: n2 <> '')"
_SLUGS = C.slugs("nm")
CAND = f"""
fl AS ({L.FILINGS}),
cn AS (SELECT id, unnest(list_concat({_PARTS.format('name')}, {_PARTS.format('trade_name')})) AS nm, generate_subscripts(list_concat({_PARTS.format('name')}, {_PARTS.format('trade_name')}), 1) AS ni FROM fl),
cs AS (SELECT id, ni, unnest({_SLUGS}) AS sl, generate_subscripts({_SLUGS}, 1) AS si FROM cn),
cd AS (SELECT id, 0 AS ni, 0 AS si, 0 AS ti, split_part(email, '@', 2) AS domain, true AS hinted FROM fl WHERE {C.email_kind('email')} = 'own'
 UNION ALL SELECT id, ni, si, t.i, sl || '.' || t.t, false FROM cs, (VALUES {', '.join(f"({i + 1}, '{t}')" for i, t in enumerate(V.TLDS))}) t(i, t)
 UNION ALL SELECT id, ni, si, 99, sl[1:length(sl) - 2] || '.ai', false FROM cs WHERE sl LIKE '%ai' AND length(sl) >= 6 AND NOT contains(sl, '-')),
ca AS (SELECT id, domain, bool_or(hinted) AS hinted, min(ni * 1000000 + si * 1000 + ti) AS spot FROM cd GROUP BY id, domain),
cand AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY spot) - 1 AS pos, domain, hinted FROM ca),
live AS (SELECT * RENAME (nth AS pos) FROM (SELECT c.id, row_number() OVER (PARTITION BY c.id ORDER BY c.pos) - 1 AS nth, c.domain, c.hinted, h.page_id FROM cand c JOIN homes h ON h.host = c.domain) lq)
"""
_PARKED = f"(regexp_matches({{h}} || ' ' || body[1:700], {C.lit(V.PARKED)}) AND length(body) < 1500)"
_TOK = "list_filter(string_split_regex(regexp_replace(lower(address), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda w: w <> '')"
_PAT = C.let(_TOK, "t", f"""CASE WHEN regexp_matches(t[1], '^[0-9]+$') THEN '\\b' || t[1] || '\\b[\\s,\\.#\\-a-z]{{0,18}}?\\b' ||
 list_filter(t[2:], lambda w: w NOT IN {C.among(V.STREET_DIRECTIONS)} AND NOT regexp_matches(w, '^[0-9]+$'))[1] END""")
_CITY = "(town <> '' AND regexp_matches({0}, '\\b' || regexp_escape(town) || '\\b'))"
_INDOM = "(contains(label, k1) OR (length(label) >= 4 AND contains(k1, label)))"
EVID = f"""
hf AS (SELECT * FROM (SELECT h.host, p.url, p.page_id, {HEAD} AS head, p.body, lower(p.body) AS low, {C.flat('p.body')} AS fb, ph.phones, {C.flat("split_part(h.host, '.', 1)")} AS label
  FROM homes h JOIN pf p ON p.page_id = h.page_id JOIN ph ON ph.page_id = h.page_id) q WHERE NOT {_PARKED.format(h='head')}),
fk AS (SELECT id, {C.distinct_in_order(f"list_filter([{C.core('name')}, {C.core('trade_name')}], lambda c1: length(c1) >= 3)")} AS cores, {C.flat('name')} AS legal, len({C.core_tokens('name')}) AS words,
  lower(city) AS town, zip, {C.norm_phone('phone')} AS line, CASE WHEN NOT individual THEN {_PAT} END AS street, registered FROM fl),
dc AS ({L.DOMAIN_CREATED}),
pa AS (SELECT l.id, l.pos, l.domain, l.hinted, f.*, k.* EXCLUDE (id), {C.flat('head')} AS fh, d.created, date_diff('day', k.registered, d.created) AS delta FROM live l JOIN hf f ON f.host = l.domain JOIN fk k ON k.id = l.id LEFT JOIN dc d ON d.host = l.domain),
ga AS (SELECT *, list_contains(cores, label) AS exact, {_CITY.format('low')} AS city_hit, len(list_filter(cores, lambda k1: contains(fh, k1))) > 0 AS in_head, len(list_filter(cores, lambda k1: {_INDOM})) > 0 AS in_domain,
  CASE WHEN delta BETWEEN -300 AND 60 THEN 'domain registered ' || abs(delta) || ' days ' || CASE WHEN delta <= 0 THEN 'before' ELSE 'after' END || ' the filing' END AS noted
  FROM pa WHERE len(list_filter(cores, lambda k1: contains(fh, k1) OR contains(fb, k1) OR {_INDOM})) > 0),
sc AS (SELECT *, CASE WHEN noted IS NOT NULL AND (abs(delta) <= 21 OR (exact AND delta BETWEEN -90 AND 30)) THEN noted END AS sure_note,
  list_filter([CASE WHEN line <> '' AND list_contains(phones, line) THEN '{V.WHY_PHONE}' END, CASE WHEN street IS NOT NULL AND regexp_matches(low, street) THEN '{V.WHY_STREET}' END,
    CASE WHEN length(legal) >= 6 AND contains(fb, legal) AND (words >= 2 OR city_hit) THEN '{V.WHY_NAME}' END, CASE WHEN hinted THEN '{V.WHY_EMAIL}' END], lambda s1: s1 IS NOT NULL) AS spec0 FROM ga),
sd AS (SELECT *, CASE WHEN sure_note IS NOT NULL THEN list_append(spec0, sure_note) ELSE spec0 END AS spec, CASE WHEN sure_note IS NULL THEN noted END AS note FROM sc),
fx AS (SELECT host, list_position({C.items(V.FINE_PRINT_PATHS)}, rtrim(path, '/')) AS place, min(page_id) AS page_id FROM pf WHERE rtrim(path, '/') IN {C.among(V.FINE_PRINT_PATHS)} GROUP BY ALL),
fp AS (SELECT x.host, lower(string_agg(p.body, ' ' ORDER BY x.place)) AS fine FROM fx x JOIN pf p ON p.page_id = x.page_id GROUP BY x.host),
se AS (SELECT sd.*, p.fine, CASE WHEN len(spec) > 0 OR p.fine IS NULL THEN spec WHEN street IS NOT NULL AND regexp_matches(p.fine, street) THEN [{C.lit(V.WHY_FINE_STREET)}]
   WHEN length(legal) >= 6 AND contains({C.flat('p.fine')}, legal) AND ({_CITY.format('p.fine')} OR (regexp_matches(zip, '^[0-9]+$') AND contains(p.fine, zip[1:5]))) THEN [{C.lit(V.WHY_FINE_NAME)}] ELSE [] END AS spec2
  FROM sd LEFT JOIN fp p ON p.host = sd.domain),
ac AS (SELECT *, CASE WHEN len(spec2) > 0 THEN CASE WHEN note IS NOT NULL THEN list_append(spec2, note) ELSE spec2 END WHEN note IS NOT NULL AND city_hit THEN [note, '{V.WHY_CITY}']
   WHEN in_head AND in_domain AND city_hit AND exact THEN ['{V.WHY_EXACT}'] END AS why FROM se),
mt AS (SELECT * FROM ac WHERE why IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) = 1)
"""
_E = (HOMES, PHONES, CAND, EVID)


def created(spark: SparkSession, sf: str) -> DataFrame:
    return L.landed(spark, sf, L.DOMAIN_CREATED)


@query("e1_candidates", _with("SELECT id, pos, domain, hinted FROM cand", HOMES, CAND))
def e1(spark, sf):
    return X.candidates(all_filings(spark, sf)).select("id", F.col("pos").cast("bigint").alias("pos"), "domain", "hinted")


@query("e2_live_candidates", _with("SELECT id, pos, domain, hinted FROM live", HOMES, CAND))
def e2(spark, sf):
    return X.live_candidates(all_filings(spark, sf), P.home_pages(pages(spark, sf))).select("id", F.col("pos").cast("bigint").alias("pos"), "domain", "hinted")


_PARK_PAGES = f"""SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN '<html><title>' || CASE WHEN page_id % 8 = 0 THEN 'This domain is for sale' ELSE 'Welcome' END || '</title><body>' || substr(url, 1, 60) || ' coming soon</body></html>'
 WHEN 1 THEN replace(html, '</h1>', ' parked free</h1>') ELSE html END AS html FROM pages"""


@query("e3_parked_filter", f"""WITH pk AS ({_PARK_PAGES}), t1 AS (SELECT page_id, regexp_replace(html, {C.lit('(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>')}, chr(1), 'g') AS m FROM pk),
 t2 AS (SELECT page_id, m, array_to_string(list_filter(list_transform(string_split(replace(replace(replace(replace(regexp_replace(m, '<[!/?a-zA-Z][^>]*>', chr(1), 'g'), '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&'), chr(1)), lambda a1: trim(a1, e' \\t\\n')), lambda a2: a2 <> ''), chr(10)) AS body FROM t1)
 SELECT page_id, regexp_matches(body[1:700] || ' ' || coalesce(regexp_extract(m, '(?is)<h1>(.*?)</h1>', 1), ''), {C.lit(V.PARKED)}) AND length(body) < 1500 AS parked FROM t2""")
def e3(spark, sf):
    t = P.page_texts(L.landed(spark, sf, _PARK_PAGES))
    return t.select("page_id", X.parked(F.col("head"), F.col("body")).alias("parked"))


def joined_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Live candidates with their filing keys, home page and domain date."""
    filings, p = all_filings(spark, sf), pages(spark, sf)
    homes = P.home_pages(p)
    facts = X.home_facts(p, homes).withColumnRenamed("host", "domain")
    dated = facts.join(created(spark, sf).select(F.col("host").alias("domain"), "created"), "domain", "left")
    return X.live_candidates(filings, homes).join(X.filing_keys(filings), "id").join(dated, "domain")


@query("e4_name_gate", _with(f"SELECT id, domain, len(list_filter(cores, lambda k1: contains(fh, k1) OR contains(fb, k1) OR {_INDOM})) > 0 AS passes FROM pa", *_E))
def e4(spark, sf):
    gate = X.passes_name_gate(F.col("cores"), F.col("head_flat"), F.col("body_flat"), F.col("label"))
    return joined_pairs(spark, sf).select("id", "domain", gate.alias("passes"))


@query("e5_city_hit", _with(f"SELECT id, domain, {_CITY.format('low')} AS city_hit FROM pa", *_E))
def e5(spark, sf):
    return joined_pairs(spark, sf).select("id", "domain", mentions_word(F.col("low"), F.col("town")).alias("city_hit"))


@query("e6_specific_evidence", _with("SELECT id, domain, array_to_string(spec, '; ') AS specific FROM sd", *_E))
def e6(spark, sf):
    return X.scored(joined_pairs(spark, sf)).select("id", "domain", F.array_join("specific", "; ").alias("specific"))


@query("e7_domain_age", _with("SELECT id, domain, delta, coalesce(sure_note, '') AS specific_note, coalesce(note, '') AS weak_note FROM sd", *_E))
def e7(spark, sf):
    rows = X.scored(joined_pairs(spark, sf))
    sure = F.filter("specific", lambda s: s.startswith("domain registered"))
    return rows.select("id", "domain", F.datediff("created", "registered").cast("bigint").alias("delta"), text(F.get(sure, F.lit(0))).alias("specific_note"), text("note").alias("weak_note"))


@query("e8_fine_print", _with("SELECT id, domain, array_to_string(spec2, '; ') AS found FROM se WHERE len(spec) = 0", *_E))
def e8(spark, sf):
    rows = X.scored(joined_pairs(spark, sf)).where(F.size("specific") == 0)
    fine = X.fine_print(pages(spark, sf), rows.select("domain").distinct())
    return X.fine_evidence(rows.join(fine, "domain", "left")).select("id", "domain", F.array_join("specific", "; ").alias("found"))


@query("e9_accepted", _with("SELECT id, domain, array_to_string(why, '; ') AS why, city_hit FROM ac WHERE why IS NOT NULL", *_E))
def e9(spark, sf):
    found = X.evidence(all_filings(spark, sf), pages(spark, sf), created(spark, sf))
    return found.select("id", "domain", F.array_join("why", "; ").alias("why"), "city_hit")


@query("e10_first_accepted", _with("SELECT id, domain, url, array_to_string(why, '; ') AS why, created FROM mt", *_E))
def e10(spark, sf):
    m = X.matched(all_filings(spark, sf), pages(spark, sf), created(spark, sf))
    return m.select("id", "domain", "url", F.array_join("why", "; ").alias("why"), "created")


@query("e11_domain_uniqueness", f"""SELECT id, domain, CASE WHEN owned OR rn > 1 THEN 'same website as another company' ELSE '' END AS dropped_because FROM (
  SELECT c.id, c.domain, c.domain <> '' AND c.domain IN (SELECT domain FROM ({L.COMPANIES}) o WHERE state IN ('ready', 'pushed')) AS owned,
    row_number() OVER (PARTITION BY c.domain, CASE WHEN c.domain = '' THEN c.id END ORDER BY c.first_seen, c.id) AS rn FROM ({L.COMPANIES}) c WHERE c.state = 'held') q""")
def e11(spark, sf):
    c = L.landed(spark, sf, L.COMPANIES).select("id", "domain", "state", "first_seen")
    new = c.where("state = 'held'")
    return S.claim_domains(new, c.where(F.col("state").isin(V.LISTED)), ["first_seen", "id"]).select("id", "domain", F.when(
        F.col("domain_taken"), "same website as another company").otherwise("").alias("dropped_because"))


@query("e12_new_only", f"""SELECT source, count(*) AS added FROM (SELECT id, source FROM ({L.FILINGS}) f WHERE id NOT IN (SELECT id FROM ({L.COMPANIES}) c WHERE attempts < 2)) q GROUP BY source""")
def e12(spark, sf):
    known = L.landed(spark, sf, L.COMPANIES).where("attempts < 2").select("id")
    return S.new_only(L.landed(spark, sf, L.FILINGS), known).groupBy("source").agg(F.count(F.lit(1)).alias("added"))


@query("e13_due_worklist", f"""SELECT id, state, next_due, first_seen FROM ({L.COMPANIES}) c WHERE state IN ('new', 'held', 'ready') AND next_due <= DATE '{L.TODAY}'
""")
def e13(spark, sf):
    return S.due(L.landed(spark, sf, L.COMPANIES), F.lit(L.TODAY).cast("date")).select("id", "state", "next_due", "first_seen")
