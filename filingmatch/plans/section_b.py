"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as V
from ..functions import cells, links, mail
from ..functions import names as N
from ..functions import people as H
from ..functions import phones as P
from ..functions import places as G
from ..operators.lexicon import given_names, learned
from ..operators.skew import spread
from . import check_sql as C
from . import landed as L
from .catalog import query


def reg(spark, sf):
    return L.landed(spark, sf, L.REG)


@query("b1_flat", f"SELECT k, {C.flat('legal')} AS legal, {C.flat('trade')} AS trade FROM ({L.REG}) r")
def b1(spark, sf):
    return reg(spark, sf).select("k", N.flat("legal").alias("legal"), N.flat("trade").alias("trade"))


@query("b2_core_tokens", f"SELECT k, {C.join(C.core_tokens('legal'), ' ')} AS legal, {C.join(C.core_tokens('trade'), ' ')} AS trade FROM ({L.REG}) r")
def b2(spark, sf):
    return reg(spark, sf).select("k", F.array_join(N.core_tokens("legal"), " ").alias("legal"), F.array_join(N.core_tokens("trade"), " ").alias("trade"))


@query("b3_slugs", f"SELECT k, {C.join(C.slugs('legal'), ' ')} AS slugs, {C.join(C.slugs('trade'), ' ')} AS trade_slugs FROM ({L.REG}) r")
def b3(spark, sf):
    return reg(spark, sf).select("k", F.array_join(N.slugs("legal"), " ").alias("slugs"), F.array_join(N.slugs("trade"), " ").alias("trade_slugs"))


@query("b4_tidy_name", f"SELECT k, {C.tidy_name('legal')} AS legal, {C.tidy_name('trade')} AS trade FROM ({L.REG}) r")
def b4(spark, sf):
    return reg(spark, sf).select("k", N.tidy_name("legal").alias("legal"), N.tidy_name("trade").alias("trade"))


@query("b5_tidy_address", f"SELECT k, {C.tidy_address('street')} AS street, {C.tidy_address('upper(street)')} AS shouted FROM ({L.REG}) r")
def b5(spark, sf):
    return reg(spark, sf).select("k", N.tidy_address("street").alias("street"), N.tidy_address(F.upper("street")).alias("shouted"))


@query("b6_norm_phone", f"SELECT k, regexp_replace(phone, '[^0-9]', '', 'g') AS digits, {C.norm_phone('phone')} AS norm FROM ({L.REG}) r")
def b6(spark, sf):
    return reg(spark, sf).select("k", P.digits("phone").alias("digits"), P.norm_phone("phone").alias("norm"))


_DOC_PHONE = r"\+1 \(\d{3}\) \d{3}-\d{4}"
_REASON = C.let(C.norm_phone("raw"), "n", """CASE WHEN n = '' THEN 'not ten digits' WHEN n[1:1] IN ('0', '1') OR n[4:4] IN ('0', '1') THEN 'starts with 0 or 1'
 WHEN n[4:6] = '555' THEN '555 exchange' WHEN n[2:3] = '11' THEN 'service code' WHEN replace(n, n[1:1], '') = '' THEN 'one digit repeated'
 WHEN n[1:3] IN """ + C.among(V.NON_GEOGRAPHIC_AREAS) + " THEN 'area without a place' ELSE '' END")


@query("b7_usable_phone", f"""SELECT k, {C.placeholder_phone('phone')} AS placeholder, {C.usable_phone('phone')} AS usable, 'filing' AS origin,
  CAST(NULL AS VARCHAR) AS reason FROM ({L.REG}) r
UNION ALL SELECT doc_id, {C.placeholder_phone('raw')}, {C.usable_phone('raw')}, 'document', {_REASON}
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_DOC_PHONE}')) AS raw FROM documents) d""")
def b7(spark, sf):
    filed = reg(spark, sf).select("k", P.placeholder_phone("phone").alias("placeholder"), P.usable_phone("phone").alias("usable"),
                                  F.lit("filing").alias("origin"), F.lit(None).cast("string").alias("reason"))
    docs = L.table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_DOC_PHONE), F.lit(0))).alias("raw"))
    return filed.union(docs.select("doc_id", P.placeholder_phone("raw"), P.usable_phone("raw"), F.lit("document"), P.phone_reject_reason("raw")))


@query("b8_fmt_phone", f"SELECT k, {C.fmt_phone('phone')} AS shown FROM ({L.REG}) r")
def b8(spark, sf):
    return reg(spark, sf).select("k", P.fmt_phone("phone").alias("shown"))


_HOSTS = """SELECT page_id, host, CASE page_id % 5 WHEN 0 THEN host WHEN 1 THEN replace(host, '.example.', '.co.') WHEN 2 THEN 'mail.' || replace(host, '.example.net', '.co.uk')
 WHEN 3 THEN upper(host) || '.' ELSE replace(host, '.example.com', '.com.au') END AS shape FROM (SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages) h0"""


@query("b9_site_root", f"SELECT page_id, {C.site_root('shape')} AS root FROM ({_HOSTS}) h")
def b9(spark, sf):
    return L.landed(spark, sf, _HOSTS).select("page_id", mail.site_root("shape").alias("root"))


_PAIRS = f"SELECT page_id, host, shape, CASE page_id % 3 WHEN 0 THEN 'mail.' || shape WHEN 1 THEN 'not' || shape ELSE host END AS other FROM ({_HOSTS}) h"


@query("b10_same_site", f"SELECT page_id, {C.same_site('other', 'shape')} AS same, {C.same_site('shape', 'host')} AS back FROM ({_PAIRS}) h")
def b10(spark, sf):
    return L.landed(spark, sf, _PAIRS).select("page_id", mail.same_site("other", "shape").alias("same"), mail.same_site("shape", "host").alias("back"))


@query("b11_compose_address", f"SELECT k, {C.compose_address('street', 'city', 'st', 'zip5')} AS address FROM ({L.REG}) r")
def b11(spark, sf):
    return reg(spark, sf).select("k", G.compose_address("street", "city", "st", "zip5").alias("address"))


_DATES = "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) WHEN 1 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) || 'T00:00:00' WHEN 2 THEN 'on ' || CAST(CAST(o_orderdate AS DATE) AS STRING) ELSE '2024-13-40' END AS d FROM orders"


@query("b12_iso", f"SELECT o_orderkey, {C.iso('d')} AS iso, TRY_CAST(nullif({C.iso('d')}, '') AS DATE) AS day FROM ({_DATES}) d")
def b12(spark, sf):
    return L.landed(spark, sf, _DATES).select("o_orderkey", cells.iso_day("d").alias("iso"), cells.day("d").alias("day"))


_ZIPS = "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'n/a' ELSE ' ' || lpad(CAST((o_orderkey * 7919) % 100000 AS STRING), 5, '0') || '-0001' END AS zip FROM orders"


@query("b13_clean_zip", f"SELECT o_orderkey, {C.clean_zip('zip')} AS zip5 FROM ({_ZIPS}) z")
def b13(spark, sf):
    return L.landed(spark, sf, _ZIPS).select("o_orderkey", G.clean_zip("zip").alias("zip5"))


@query("b14_state_from_zip", f"SELECT o_orderkey, {C.state_from_zip('zip')} AS state FROM ({_ZIPS}) z")
def b14(spark, sf):
    return G.state_from_zip(L.landed(spark, sf, _ZIPS), "zip", "state").select("o_orderkey", "state")


@query("b15_email_kind", f"""SELECT k, {C.email_kind('email')} AS kind, 'filing' AS origin, count(*) AS n FROM ({L.REG}) r GROUP BY ALL
UNION ALL SELECT doc_id, {C.email_kind('m')}, CASE WHEN regexp_matches(m, {C.lit(V.BAD_EMAIL)}) THEN 'placeholder' ELSE 'document' END, count(*)
FROM (SELECT doc_id, unnest(regexp_extract_all(text, {C.lit(V.EMAIL)})) AS m FROM documents WHERE contains(text, '@')) d GROUP BY ALL""")
def b15(spark, sf):
    filed = reg(spark, sf).select("k", mail.email_kind("email").alias("kind"), F.lit("filing").alias("origin"))
    docs = (L.table(spark, sf, "documents").where(F.contains("text", F.lit("@")))
            .select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(V.EMAIL), F.lit(0))).alias("m")))
    origin = F.when(F.col("m").rlike(V.BAD_EMAIL), "placeholder").otherwise("document")
    return filed.union(docs.select("doc_id", mail.email_kind("m"), origin)).groupBy("k", "kind", "origin").agg(F.count(F.lit(1)).alias("n"))


@query("b16_looks_like_company", f"SELECT k, {C.looks_like_company('legal')} AS legal, {C.looks_like_company('trade')} AS trade FROM ({L.REG}) r")
def b16(spark, sf):
    return reg(spark, sf).select("k", N.looks_like_company("legal").alias("legal"), N.looks_like_company("trade").alias("trade"))


@query("b17_distinct_name", f"SELECT k, {C.is_distinct_name('legal', 'trade')} AS differs, {C.is_distinct_name('trade', 'legal')} AS back FROM ({L.REG}) r")
def b17(spark, sf):
    return reg(spark, sf).select("k", N.is_distinct_name("legal", "trade").alias("differs"), N.is_distinct_name("trade", "legal").alias("back"))


@query("b18_clean_text", f"""SELECT doc_id, md5({C.clean_text("chr(7) || ' ' || text || chr(31)")}) AS text600,
  md5({C.clean_text("source || chr(1)", 600)} || '|' || {C.clean_text("lang || ' '", 600)}) AS scrubbed FROM documents""")
def b18(spark, sf):
    docs = L.table(spark, sf, "documents")
    nested = F.array(F.struct(F.concat("source", F.char(F.lit(1))).alias("a"), F.create_map(F.lit("k"), F.concat("lang", F.lit(" "))).alias("m")))
    kind = T.ArrayType(T.StructType([T.StructField("a", T.StringType()), T.StructField("m", T.MapType(T.StringType(), T.StringType()))]))
    clean = cells.scrub(nested, kind)[0]
    return docs.select("doc_id", F.md5(cells.clean_text(F.concat(F.char(F.lit(7)), F.lit(" "), "text", F.char(F.lit(31))))).alias("text600"),
                       F.md5(F.concat(clean["a"], F.lit("|"), clean["m"]["k"])).alias("scrubbed"))


_WORDS = C.lit(r"\S+@\S+")


@query("b19_valid_email", f"""SELECT doc_id, m, {C.valid_email('m')} AS valid, CASE WHEN NOT {C.valid_email('m')} THEN 'not an address'
 WHEN regexp_matches(m, {C.lit(V.BAD_EMAIL)}) THEN 'placeholder or robot' ELSE '' END AS reason
FROM (SELECT doc_id, unnest(regexp_extract_all(text, {_WORDS})) AS m FROM documents WHERE contains(text, '@')) d""")
def b19(spark, sf):
    words = (L.table(spark, sf, "documents").where(F.contains("text", F.lit("@")))
             .select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\S+@\S+"), F.lit(0))).alias("m")))
    return words.select("doc_id", "m", mail.valid_email("m").alias("valid"), mail.email_reject_reason("m").alias("reason"))


@query("b20_site_age", f"SELECT id, date_diff('day', created, registered) / 365.25 AS years FROM ({L.COMPANIES}) c")
def b20(spark, sf):
    return L.landed(spark, sf, L.COMPANIES).select("id", cells.site_age_years(F.col("created"), F.col("registered")).alias("years"))


@query("b21_not_a_contact", f"SELECT id, {C.not_a_contact(C.let('email', 'm0', 'split_part(m0, chr(64), 1)'))} AS is_function FROM ({L.COMPANIES}) c")
def b21(spark, sf):
    return L.landed(spark, sf, L.COMPANIES).select("id", mail.not_a_contact(mail.local_part("email")).alias("is_function"))


_TITLES = f"""SELECT k, {L._picks('k', 'Meet the', '', 'Our', 'THE', '- ', '(', '')} || ' ' ||
 {L._picks('k', 'CEO', 'chief executive officer', 'VP OF SALES', 'iOS developer', 'Owner: boss', 'Co-Founder', 'OWNER', 'Managing  Partner', 'Founder · MBA', 'CO-FOUNDER', 'Principal', '.NET lead')} ||
 {L._picks('k', ' of', '', ' &', ', ' , ' - ' , ')', ' and', ' | Head of a very long list of duties that never ends at all')} AS title FROM ({L.REG}) r"""


@query("b22_clean_title", f"SELECT k, title, {C.clean_title('title')} AS clean FROM ({_TITLES}) t")
def b22(spark, sf):
    return L.landed(spark, sf, _TITLES).select("k", "title", H.clean_title("title").alias("clean"))


_NAMES = f"""SELECT k, {L._picks('k', 'Linda', 'ROBERT', 'J.', 'maria de', 'Dr. Susan', 'Jobs', 'Oak', 'José')} || ' ' ||
 {L._picks('k', 'Marlow', 'KELLER', 'Lane', 'Pipeline', 'jr', 'O’Neil', 'Valley', 'van Dyke', 'York', 'III', 'Do')} || {L._picks('k', '', ' Jr.', '', ' Stone', '', ' de la Cruz', ' & Co')} AS person,
 legal FROM ({L.REG}) r"""


@query("b23_person_name", f"""SELECT k, person, {C.person_name('person')} AS on_page, {C.person_name('person', 'true')} AS in_filing,
  {C.person_name('person', 'false', C.core_tokens("person || ' LLC'"))} AS own_name FROM ({_NAMES}) n""")
def b23(spark, sf):
    names = spread(L.landed(spark, sf, _NAMES))
    return names.select("k", "person", H.person_name("person").alias("on_page"), H.person_name("person", registry=True).alias("in_filing"),
                        H.person_name("person", company_tokens=N.core_tokens(F.concat("person", F.lit(" LLC")))).alias("own_name"))


# names of officers and of companies, and the words that begin the former, by counting once more in the check engine
_OFFICER_NAMES = f"""SELECT CASE WHEN trim(firstname) <> '' AND trim(lastname) <> '' THEN trim(firstname) || ' ' || trim(lastname) ELSE trim(name__c) END AS name FROM ({L.RAW_CT_OFFICERS}) o"""
_COMPANY_NAMES = f"SELECT legal AS name FROM ({L.REG}) r1 UNION ALL SELECT trade AS name FROM ({L.REG}) r2"
_FIRST = """SELECT DISTINCT rtrim(split_part(name, ' ', 1), '.') AS word, name, {p} AS person, substr(md5(name), 1, 1) IN ('0', '1', '2', '3') AS held
 FROM (SELECT lower(regexp_replace(trim(name), '\\s+', ' ', 'g')) AS name FROM ({t}) n0) n1 WHERE contains(name, ' ')"""
_SCORED = """SELECT word, n, CAST((n * greatest(others, 1) * 1000) // (n * greatest(others, 1) + other * greatest(people, 1)) AS BIGINT) AS score FROM
 (SELECT word, count(*) FILTER (person) AS n, count(*) FILTER (NOT person) AS other FROM {t} GROUP BY word) w0, (SELECT count(*) FILTER (person) AS people, count(*) FILTER (NOT person) AS others FROM {t}) w1 WHERE n > 0"""
_GIVEN = f"""nm AS MATERIALIZED ({_FIRST.format(p='true', t=_OFFICER_NAMES)} UNION ALL {_FIRST.format(p='false', t=_COMPANY_NAMES)}),
tr AS (SELECT * FROM nm WHERE NOT held), kn AS ({_SCORED.format(t='tr')}),
ak AS (SELECT nm.person, coalesce(kn.score, -1) AS score FROM nm LEFT JOIN kn ON kn.word = nm.word WHERE nm.held),
rt AS (SELECT cut, count(*) FILTER (person AND score >= cut) * greatest(count(*) FILTER (NOT person), 1) - count(*) FILTER (NOT person AND score >= cut) * greatest(count(*) FILTER (person), 1) AS gain
  FROM ak, (SELECT unnest(generate_series(100, 900, 100)) AS cut) c0 GROUP BY cut),
bc AS (SELECT coalesce((SELECT cut FROM rt ORDER BY gain DESC, cut LIMIT 1), 500) AS cut),
gv AS MATERIALIZED (SELECT word, n, score, CAST(cut AS BIGINT) AS cut FROM ({_SCORED.format(t='nm')}) s0, bc WHERE score >= cut AND n >= 2)"""


def officer_names(spark, sf):
    return L.landed(spark, sf, _OFFICER_NAMES)


def company_names(spark, sf):
    return L.landed(spark, sf, _COMPANY_NAMES)


@query("b23_given_names", f"WITH {_GIVEN} SELECT word, n, score, cut FROM gv")
def b23_given(spark, sf):
    return given_names(officer_names(spark, sf), company_names(spark, sf)).select("word", "n", F.col("score").cast("bigint").alias("score"), F.col("cut").cast("bigint").alias("cut"))


_ANY_NAMES = f"""SELECT k, {L._picks('k', 'Abigail', 'Linda', 'JOBS', 'Ann', 'María', 'Oak', 'Cloud')} || ' ' || {L._picks('k', 'Jobs', 'LANE', 'Pipeline', 'Court', 'Stone')} AS person FROM ({L.REG}) r"""


@query("b23_person_name_learned", f"""WITH {_GIVEN}, ls AS (SELECT list_concat(list(word), {C.items(V.DEFAULT_GIVEN_NAMES)}) AS given FROM gv)
SELECT k, person, {C.person_name('person', names='given')} AS on_page FROM ({_ANY_NAMES}) n, ls""")
def b23_learned(spark, sf):
    lexicon = learned(officer_names(spark, sf), company_names(spark, sf))
    return spread(L.landed(spark, sf, _ANY_NAMES)).select("k", "person", H.person_name("person", lexicon=lexicon).alias("on_page"))


_BODY = "'we are at ' || lower(street) || ', suite 4 and ' || CAST(k % 900 + 10 AS STRING) || ' - w market street'"
_TOK = "list_filter(string_split_regex(regexp_replace(lower(street), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda w: w <> '')"
_PAT = C.let(_TOK, "t", f"""CASE WHEN regexp_matches(t[1], '^[0-9]+$') THEN '\\b' || t[1] || '\\b[\\s,\\.#\\-a-z]{{0,18}}?\\b' ||
 list_filter(t[2:], lambda w: w NOT IN {C.among(V.STREET_DIRECTIONS)} AND NOT regexp_matches(w, '^[0-9]+$'))[1] END""")


@query("b24_street_pattern", f"""SELECT k, pattern, pattern IS NOT NULL AND regexp_matches(body, coalesce(pattern, 'x')) AS found,
  pattern IS NOT NULL AND regexp_matches('9' || body, coalesce('^' || pattern, 'x')) AS elsewhere
FROM (SELECT k, {_BODY} AS body, {_PAT} AS pattern FROM ({L.REG}) r) q""")
def b24(spark, sf):
    rows = reg(spark, sf).select("k", F.expr(_BODY).alias("body"), G.street_pattern("street").alias("pattern"))
    found = F.coalesce(F.regexp_like("body", F.col("pattern")), F.lit(False))
    elsewhere = F.coalesce(F.regexp_like(F.concat(F.lit("9"), "body"), F.concat(F.lit("^"), "pattern")), F.lit(False))
    return rows.select("k", "pattern", found.alias("found"), elsewhere.alias("elsewhere"))


_PROFILES = f"""SELECT k, {L._picks('k', 'https://www.', 'HTTP://', 'https://uk.', 'ftp://', 'https://evil-')} || {L._picks('k', 'linkedin.com/', 'LinkedIn.com/')} ||
 {L._picks('k', 'in/', 'company/', 'Company/', 'school/')} || replace(base, ' ', '-') || {L._picks('k', '', '/', '?trk=1', '#top', '/extra')} AS href FROM ({L.REG}) r"""
_HREF = "trim(split_part(split_part(href, '?', 1), '#', 1))"


@query("b25_profile_url", f"""SELECT k, CASE WHEN regexp_matches({_HREF}, {C.lit(V.PROFILE_URL)}) THEN 'https://www.linkedin.com/' ||
 lower(regexp_extract({_HREF}, {C.lit(V.PROFILE_URL)}, 1)) || '/' || regexp_extract({_HREF}, {C.lit(V.PROFILE_URL)}, 2) ELSE '' END AS url FROM ({_PROFILES}) p""")
def b25(spark, sf):
    return L.landed(spark, sf, _PROFILES).select("k", links.profile_url("href").alias("url"))




@query("b26_xor_decode", """SELECT c_custkey AS k, lower(replace(c_name, '#', '.')) || '@mail.io' AS mail, '' AS broken FROM customer""")
def b26(spark, sf):
    """Hides an address built from each customer and reads it back."""
    rows = L.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("k"), (16 + F.col("c_custkey") % 200).cast("int").alias("key"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@mail.io")).alias("plain"))
    hexed = F.array_join(F.transform(F.split("plain", ""), lambda ch: F.lpad(F.hex(F.ascii(ch).bitwiseXOR(F.col("key"))), 2, "0")), "")
    hidden = rows.withColumn("hidden", F.lower(F.concat(F.lpad(F.hex("key"), 2, "0"), hexed)))
    return hidden.select("k", mail.xor_decode("hidden").alias("mail"), mail.xor_decode(F.concat("hidden", F.lit("z"))).alias("broken"))


_ANCHOR = r"(?is)<a\b[^>]*?\shref\s*=\s*\"([^\"]*)\""
_ORIGIN = "regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)"
_FOLDER = "regexp_extract(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '^(.*/)', 1)"


@query("b27_absolute_url", f"""SELECT page_id, href, count(*) AS n, CASE WHEN href LIKE '%[YOUR%' THEN '' WHEN href LIKE '%:%' THEN split_part(href, '#', 1)
  WHEN href LIKE '//%' THEN split_part(url, ':', 1) || ':' || href WHEN href LIKE '/%' THEN {_ORIGIN} || split_part(href, '#', 1)
  ELSE {_ORIGIN} || {_FOLDER} || split_part(href, '#', 1) END AS target
FROM (SELECT page_id, url, unnest(regexp_extract_all(html, {C.lit(_ANCHOR)}, 1)) AS href FROM ({L.SITE_PAGES}) p) a GROUP BY ALL""")
def b27(spark, sf):
    hrefs = L.landed(spark, sf, L.SITE_PAGES).select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(1))).alias("href"))
    return hrefs.groupBy("page_id", "href", links.absolute_url("url", "href").alias("target")).agg(F.count(F.lit(1)).alias("n"))


_CELLS = f"SELECT k, {L._pick('k', 'legal', chr(39) + '=SUM(1)' + chr(39), chr(39) + '+' + chr(39) + ' || phone', chr(39) + '@' + chr(39) + ' || base', chr(39) + '-' + chr(39) + ' || zip5')} AS v FROM ({L.REG}) r"


@query("b28_csv_safe", f"SELECT k, {C.csv_safe('v')} AS safe FROM ({_CELLS}) c")
def b28(spark, sf):
    return L.landed(spark, sf, _CELLS).select("k", cells.csv_safe("v").alias("safe"))


@query("b29_display_site", "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '^www\\.', ''), '/+$', '') AS shown FROM pages")
def b29(spark, sf):
    return L.table(spark, sf, "pages").select("page_id", links.display_site("url").alias("shown"))


@query("b30_row_hash", """SELECT c_custkey, sha1('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}') AS h FROM customer""")
def b30(spark, sf):
    return L.table(spark, sf, "customer").select("c_custkey", cells.row_hash("c_name", "c_mktsegment", "c_custkey").alias("h"))


FIT = f"""concat_ws(' · ', nullif({C.label(V.FIT_LABEL, 'it_level')}, ''), CASE WHEN date_diff('day', created, registered) / 365.25 >= 3
 THEN 'site since ' || year(created) END)"""


@query("b31_fit_label", f"SELECT id, {FIT} AS fit FROM ({L.COMPANIES}) c")
def b31(spark, sf):
    return L.landed(spark, sf, L.COMPANIES).select("id", cells.fit_label(F.col("it_level"), F.col("created"), F.col("registered")).alias("fit"))


MAIL_FROM = f"""CASE WHEN email_from <> 'state registry' THEN email_from ELSE email_from || CASE WHEN {C.same_site("split_part(email, '@', 2)", "coalesce(nullif(domain, ''), '')")}
 THEN ' (same domain as the website)' ELSE ' (domain differs from the website)' END END"""


@query("b32_email_source", f"SELECT id, {MAIL_FROM} AS source FROM ({L.COMPANIES}) c")
def b32(spark, sf):
    c = L.landed(spark, sf, L.COMPANIES)
    return c.select("id", cells.email_source(F.col("email"), F.col("email_from"), F.col("domain"), F.col("website")).alias("source"))


@query("b33_email_key", f"SELECT k, sha256(lower(trim(email)))[1:16] AS key FROM ({L.REG}) r")
def b33(spark, sf):
    return reg(spark, sf).select("k", mail.email_key("email").alias("key"))


@query("b34_labels", f"""SELECT id, strftime(CAST(started AS TIMESTAMP), '%-d %b %Y, %H:%M') AS moment, strftime(CAST(started[1:10] AS DATE), '%-d %b %Y') AS day_text,
 {C.label(V.STATUS_LABEL, 'status', 'status')} AS status_text, {C.label(V.TRIGGER_LABEL, 'trigger_kind')} AS trigger_text,
 CASE status WHEN 'offline' THEN 'Nothing changed' WHEN 'failed' THEN 'Nothing added' ELSE added || ' added' END AS line1,
 CASE status WHEN 'offline' THEN 'no internet connection' WHEN 'failed' THEN 'every registry failed' ELSE pushed || ' sent to the sheet · ' || held || ' held back' END AS line2
FROM ({L.RUNS}) r""")
def b34(spark, sf):
    r = L.landed(spark, sf, L.RUNS)
    started = F.try_to_timestamp("started")
    line = cells.run_lines(F.col("status"), F.col("added"), F.col("pushed"), F.col("held"))
    return (r.withColumn("l", line).select(
        "id", cells.moment_label(started).alias("moment"), cells.day_label(F.to_date(started)).alias("day_text"),
        cells.lookup(V.STATUS_LABEL, F.col("status"), F.col("status")).alias("status_text"),
        cells.lookup(V.TRIGGER_LABEL, F.col("trigger_kind")).alias("trigger_text"), F.col("l.line1").alias("line1"), F.col("l.line2").alias("line2")))


