"""Page to facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import markup as M
from ..operators import pages as P
from ..operators.dom import dom_facts
from ..operators.profiles import with_profiles
from ..sources.crawl import located
from . import check_sql as C
from . import landed as L
from .catalog import query


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return L.landed(spark, sf, L.SITE_PAGES)


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return P.page_texts(pages(spark, sf))


# ------------------------------------------------------------------------------------------------- check SQL for pages
_HIDDEN = "(?is)<!--.*?-->|" + "|".join(f"<{t}\\b[^>]*>.*?</{t}\\s*>" for t in V.HIDDEN_TAGS)
_WS = "e' \\t\\n\\r\\x0b\\x0c'"


def sql_nodes(markup: str) -> str:
    plain = f"regexp_replace({markup}, '<[!/?a-zA-Z][^>]*>', chr(1), 'g')"
    for name, char in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        plain = f"replace({plain}, '{name}', {C.lit(char)})"
    return f"list_filter(list_transform(string_split({plain}, chr(1)), lambda s1: trim(s1, {_WS})), lambda s2: s2 <> '')"


def sql_abs(url: str, href: str) -> str:
    origin = f"regexp_extract({url}, '^([A-Za-z]+://[^/?#]*)', 1)"
    folder = f"coalesce(nullif(regexp_extract(regexp_extract({url}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '^(.*/)', 1), ''), '/')"
    cut = f"split_part({href}, '#', 1)"
    return (f"CASE WHEN contains({href}, '[YOUR') THEN '' WHEN regexp_matches({cut}, '^[a-zA-Z]+:') THEN {cut} WHEN {cut} LIKE '//%' THEN split_part({url}, ':', 1) || ':' || {cut} "
            f"WHEN {cut} LIKE '/%' THEN {origin} || {cut} ELSE {origin} || {folder} || {cut} END")


_SAID = C.lit("(?is)<blockquote>.*?</blockquote>|<div class=\"card testimonial-box\">.*?</div>")
_HREF = "regexp_extract({0}, '(?is)^<[^>]*?\\shref\\s*=\\s*\"([^\"]*)\"', 1)"
PF = f"""
sp AS ({L.SITE_PAGES}),
t1 AS (SELECT page_id, url, html, {C.bare_host('url')} AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_replace(html, {C.lit(_HIDDEN)}, chr(1), 'g') AS m FROM sp),
t2 AS (SELECT *, array_to_string({sql_nodes('m')}, chr(10)) AS full_text, array_to_string({sql_nodes(f"regexp_replace(m, {_SAID}, chr(1), 'g')")}, chr(10)) AS said,
  regexp_extract_all(m, '(?is)<a\\b[^>]*>.*?</a\\s*>') AS anchors FROM t1),
pf AS (SELECT *, full_text AS body, regexp_matches(path, {C.lit(V.LEGAL_PATH)}) AS is_legal,
  list_transform(anchors, lambda an: {{'href': replace({_HREF.format('an')}, '&amp;', '&'), 'label': array_to_string({sql_nodes('an')}, ' ')}}) AS links FROM t2)
"""


def _with(select: str, *ctes: str) -> str:
    return "WITH " + ",".join([PF, *ctes]) + select


@query("c1_visible_text", _with("SELECT page_id, length(body) AS chars, md5(body) AS body FROM pf"))
def c1(spark, sf):
    return texts(spark, sf).select("page_id", F.length("body").cast("bigint").alias("chars"), F.md5("body").alias("body"))


HEAD = f"""concat_ws(' . ', array_to_string({sql_nodes("regexp_extract(m, '(?is)<title[^>]*>(.*?)</title>', 1)")}, ' '),
 nullif(replace(regexp_extract(m, '(?is)<meta name="description" content="([^"]*)"', 1), '&amp;', '&'), ''),
 nullif(array_to_string(list_transform(regexp_extract_all(m, '(?is)<h[12][^>]*>(.*?)</h[12]>', 1)[1:8], lambda hh: array_to_string({sql_nodes('hh')}, ' ')), ' . '), ''))"""


@query("c2_head_text", _with(f"SELECT page_id, {HEAD} AS head FROM pf"))
def c2(spark, sf):
    return texts(spark, sf).select("page_id", "head")


@query("c3_links", _with("SELECT page_id, pos - 1 AS pos, l.href AS href, l.label AS label FROM (SELECT page_id, unnest(links) AS l, generate_subscripts(links, 1) AS pos FROM pf) q"))
def c3(spark, sf):
    return texts(spark, sf).select("page_id", F.posexplode("links").alias("pos", "l")).select("page_id", "pos", "l.href", "l.label")


HOMES = "homes AS (SELECT host, min(page_id) AS page_id FROM pf WHERE path IN ('', '/') GROUP BY host)"
_NETLOC = "replace(lower(regexp_extract(u, '^[a-zA-Z]+://([^/?#]*)', 1)), 'www.', '')"
_PATH = "regexp_extract(u, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)"
_KEY = "rtrim(split_part({0}, '#', 1), '/')"
ROLES = f"""
hl AS (SELECT h.host AS site, p.url, unnest(p.links) AS l, generate_subscripts(p.links, 1) AS pos FROM homes h JOIN pf p ON p.page_id = h.page_id),
ha AS (SELECT site, url, pos, l.label AS label, l.href AS href, {sql_abs('url', 'l.href')} AS u FROM hl),
rc AS (SELECT site, url, pos, {_KEY.format('u')} AS url_key FROM ha WHERE u <> '' AND {_NETLOC} = site AND NOT regexp_matches({_PATH}, {C.lit(V.SKIP_PATH)})
  AND regexp_matches({_PATH} || ' ' || label, {C.lit(V.PAGE_HINT)})
  UNION ALL SELECT h.host, p.url, 1000 + d.i, regexp_extract(p.url, '^([a-z]+://[^/?#]+)', 1) || d.p FROM homes h JOIN pf p ON p.page_id = h.page_id,
    (VALUES {', '.join(f"({i}, '{p}')" for i, p in enumerate(V.DEFAULT_PATHS))}) d(i, p)),
rr AS (SELECT site, url_key, row_number() OVER (PARTITION BY site ORDER BY min(pos)) AS rank FROM rc WHERE url_key <> {_KEY.format('url')} GROUP BY site, url_key QUALIFY rank <= 6),
lc AS (SELECT site, {_KEY.format('u')} AS url_key, min(pos) AS pos FROM ha WHERE u <> '' AND {_NETLOC} = site AND regexp_matches(href || ' ' || label, {C.lit(V.LEGAL_LINK)})
  AND {_KEY.format('u')} <> {_KEY.format('url')} GROUP BY ALL),
lr AS (SELECT site, url_key, 6 + row_number() OVER (PARTITION BY site ORDER BY pos) AS rank FROM lc WHERE (site, url_key) NOT IN (SELECT site, url_key FROM rr) QUALIFY rank <= 8
  UNION ALL SELECT h.host, regexp_extract(p.url, '^([a-z]+://[^/?#]+)', 1) || d.p, 6 + d.i FROM homes h JOIN pf p ON p.page_id = h.page_id, (VALUES (1, '/privacy'), (2, '/privacy-policy')) d(i, p)
    WHERE h.host NOT IN (SELECT site FROM lc))
"""


def _plan(spark, sf):
    p = pages(spark, sf)
    homes = P.home_pages(p).select(F.col("host").alias("site"), "page_id")
    front = P.page_texts(p.join(homes, "page_id", "left_semi"))
    roles = P.role_targets(F.col("url"), F.col("host"), F.col("links"))
    return front.select("url", F.col("host").alias("site"), "links", roles.alias("roles"))


@query("c4_role_pages", _with("SELECT site, rank, url_key FROM rr", HOMES, ROLES))
def c4(spark, sf):
    return _plan(spark, sf).select("site", F.posexplode("roles").alias("i", "url_key")).select("site", (F.col("i") + 1).cast("bigint").alias("rank"), "url_key")


@query("c5_legal_pages", _with("SELECT site, rank, url_key FROM lr", HOMES, ROLES))
def c5(spark, sf):
    read = F.concat(F.array(P.page_key("url")), "roles")
    legal = P.legal_targets(F.col("url"), F.col("site"), F.col("links"), read)
    return (_plan(spark, sf).select("site", F.posexplode(legal).alias("i", "url_key"))
            .select("site", (F.col("i") + 7).cast("bigint").alias("rank"), "url_key"))


@query("c6_legal_flag", _with("SELECT page_id, is_legal FROM pf"))
def c6(spark, sf):
    return located(pages(spark, sf).select("page_id", "url")).select("page_id", F.col("path").rlike(V.LEGAL_PATH).alias("is_legal"))


@query("c7_redirect_guard", _with(f"""SELECT page_id, host, target, {C.same_site('target', 'host')} OR {C.same_site('host', 'target')} AS stays, count(*) AS n
FROM (SELECT page_id, host, {C.bare_host('u')} AS target FROM (SELECT page_id, host, {sql_abs('url', 'l.href')} AS u FROM (SELECT page_id, host, url, unnest(links) AS l FROM pf) a) b
  WHERE u LIKE 'http%') c GROUP BY ALL"""))
def c7(spark, sf):
    linked = (texts(spark, sf).select("page_id", "host", "url", F.explode("links").alias("l"))
              .select("page_id", "host", P.absolute_url("url", F.col("l.href")).alias("u")).where(F.col("u").startswith("http")))
    target = P.bare_host("u")
    return linked.groupBy("page_id", "host", target.alias("target"), P.stays_on_site(target, F.col("host")).alias("stays")).agg(F.count(F.lit(1)).alias("n"))


def sql_emails(found: str) -> str:
    shaped = f"list_transform({found}, lambda e1: lower(trim(e1, '.,;:()<>\"'' ')))"
    return C.distinct_in_order(f"list_filter({shaped}, lambda e2: {C.valid_email('e2')} AND NOT regexp_matches(e2, {C.lit(V.BAD_EMAIL)}))")


_HIDDEN_MAIL = """array_to_string(list_transform(range(3, length(x1), 2), lambda i1: chr(xor(CAST('0x' || x1[i1:i1 + 1] AS INTEGER), CAST('0x' || x1[1:2] AS INTEGER)))), '')"""
_AT = r"(?i)\s{0,3}[\[\(]\s{0,3}at\s{0,3}[\]\)]\s{0,3}"
RAW_MAIL = f"""list_concat(list_transform(list_filter(links, lambda a1: a1.href LIKE 'mailto%'), lambda a2: split_part(a2.href[8:], '?', 1)),
 list_transform(regexp_extract_all(m, 'data-cfemail="([0-9a-f]+)"', 1), lambda x1: {_HIDDEN_MAIL}), regexp_extract_all(regexp_replace(body, '{_AT}', '@', 'g'), {C.lit(V.EMAIL)}))"""


@query("c8_emails", _with(f"""SELECT page_id, array_to_string({sql_emails(RAW_MAIL)}, ' ') AS emails, CAST(len(regexp_extract_all(body, '@')) AS BIGINT) AS at_signs FROM pf"""))
def c8(spark, sf):
    return texts(spark, sf).select("page_id", F.array_join(M.emails(F.col("markup"), F.col("links"), F.col("body")), " ").alias("emails"),
                                   F.size(F.regexp_extract_all("body", F.lit("@"), F.lit(0))).cast("bigint").alias("at_signs"))


@query("c8_document_emails", f"""SELECT doc_id, e, CASE WHEN NOT {C.valid_email('e')} THEN 'not an address' WHEN regexp_matches(e, {C.lit(V.BAD_EMAIL)}) THEN 'placeholder or robot' ELSE '' END AS reason,
 count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, {C.lit(V.EMAIL)})) AS e FROM documents) d GROUP BY ALL""")
def c8_documents(spark, sf):
    docs = L.table(spark, sf, "documents")
    found = docs.where(F.contains("text", F.lit("@"))).select("doc_id", F.explode(M.text_addresses(F.col("text"))).alias("e"))
    from ..functions.mail import email_reject_reason
    return found.groupBy("doc_id", "e", email_reject_reason("e").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_NUM = V.PHONE_BODY
_NEAR = f"""list_transform(ms, lambda m1, i1: {{'n': m1, 'before': lower(right(array_to_string(list_transform(range(greatest(1, i1 - 8), i1 + 1), lambda j1: bt[j1] || CASE WHEN j1 < i1 THEN ms[j1] ELSE '' END), ''), 80))}})"""
PHONES = f"""
ph AS (SELECT page_id, url, host, path, is_legal, {C.distinct_in_order(f"list_filter(list_concat(list_transform(list_filter(links, lambda a1: a1.href LIKE 'tel%'), lambda a2: " + C.usable_phone("split_part(split_part(a2.href, ':', 2), ';', 1)") + "), list_transform(list_filter(near, lambda n1: NOT contains(right(n1.before, 14), 'fax') AND NOT regexp_matches(string_split_regex(n1.before, '[.\\n]\\s')[-1], " + C.lit(V.OTHER_PEOPLES_PHONE) + ")), lambda n2: " + C.usable_phone('n2.n') + ")), lambda u1: u1 <> '')")} AS phones
 FROM (SELECT *, {_NEAR} AS near FROM (SELECT *, regexp_extract_all(calm, {C.lit(_NUM)}) AS ms, string_split_regex(calm, {C.lit(_NUM)}) AS bt FROM (SELECT *, regexp_replace(body, '\\d{{12,}}', 'x', 'g') AS calm FROM pf) q00) q0) q1)
"""


@query("c9_phones", _with("SELECT page_id, array_to_string(phones, ' ') AS phones FROM ph", PHONES))
def c9(spark, sf):
    return texts(spark, sf).select("page_id", F.array_join(M.phones(F.col("links"), F.col("body")), " ").alias("phones"))


_LD = "regexp_extract(html, '(?is)<script[^>]*ld\\+json[^>]*>(.*?)</script>', 1)"
NODES = f"""
jd AS (SELECT page_id, is_legal, CAST({_LD} AS JSON) AS d FROM pf WHERE {_LD} <> ''),
nd AS (SELECT page_id, is_legal, 0 AS pos, 'None' AS types, '' AS name, '' AS job_title, CAST(NULL AS VARCHAR) AS email, CAST(NULL AS VARCHAR) AS telephone, false AS founds FROM jd
 UNION ALL SELECT page_id, is_legal, 1, array_to_string(CAST(d->'$."@graph"[1]."@type"' AS VARCHAR[]), ' '), d->>'$."@graph"[1].name', d->>'$."@graph"[1].jobTitle', d->>'$."@graph"[1].email', NULL, false FROM jd
 UNION ALL SELECT page_id, is_legal, 2, d->>'$."@graph"[0]."@type"', d->>'$."@graph"[0].name', '', d->>'$."@graph"[0].email', d->>'$."@graph"[0].telephone', true FROM jd
 UNION ALL SELECT page_id, is_legal, 3, d->>'$."@graph"[0].founder."@type"', d->>'$."@graph"[0].founder.name', '', d->>'$."@graph"[0].founder.email', NULL, false FROM jd)
"""


def _dom(spark, sf):
    return located(pages(spark, sf)).withColumn("dom", dom_facts(F.col("html"), "nodes"))


@query("c10_json_ld", _with("SELECT page_id, pos, types, name, job_title, email, telephone FROM nd", NODES))
def c10(spark, sf):
    return (_dom(spark, sf).select("page_id", F.posexplode("dom.nodes").alias("pos", "n"))
            .select("page_id", "pos", "n.types", "n.name", "n.job_title", "n.email", "n.telephone"))


@query("c11_json_ld_contact", _with(f"""SELECT p.page_id, coalesce(n.phone, '') AS phones, coalesce(n.mail, '') AS emails FROM pf p LEFT JOIN (SELECT page_id,
 array_to_string(list_filter(list({C.usable_phone('telephone')} ORDER BY pos), lambda x2: x2 <> ''), ' ') AS phone,
 array_to_string(list_filter(list(lower(regexp_extract(email, {C.lit(V.EMAIL)})) ORDER BY pos), lambda x3: x3 <> ''), ' ') AS mail FROM nd WHERE email IS NOT NULL OR telephone IS NOT NULL GROUP BY page_id) n
 ON n.page_id = p.page_id""", NODES))
def c11(spark, sf):
    return _dom(spark, sf).select("page_id", F.array_join(P.ld_phones(F.col("dom.nodes")), " ").alias("phones"), F.array_join(P.ld_emails(F.col("dom.nodes")), " ").alias("emails"))


LD_PEOPLE = f"""
lq AS (SELECT page_id, pos * 2 AS ord, name AS n, job_title AS t, email AS e FROM nd WHERE contains(types, 'Person') AND name <> ''
 UNION ALL SELECT a.page_id, a.pos * 2 + 1, b.name, 'Founder', b.email FROM nd a JOIN nd b ON b.page_id = a.page_id AND b.pos = 3 WHERE a.founds),
lp AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY ord) - 1 AS pos0, ord, {C.person_name('n')} AS name, {C.clean_title('t')} AS title,
  CASE WHEN {C.valid_email("lower(trim(replace(coalesce(e, ''), 'mailto:', '')))")} THEN lower(trim(replace(coalesce(e, ''), 'mailto:', ''))) ELSE '' END AS email FROM lq)
"""


@query("c12_json_ld_people", _with("SELECT page_id, pos0 AS pos, name, title, email FROM lp WHERE name IS NOT NULL", NODES, LD_PEOPLE))
def c12(spark, sf):
    people = P.recognized(P.ld_mentions(F.col("dom.nodes")))
    return (_dom(spark, sf).select("page_id", F.explode(people).alias("p"))
            .select("page_id", F.col("p.pos").cast("bigint").alias("pos"), "p.name", "p.title", "p.email"))


_SPLIT = C.lit(r"^(.{3,45}?)\s*[,\-–—|•:/(]\s*(.{3,70})$")
_A, _B = f"regexp_extract(line, {_SPLIT}, 1)", f"rtrim(regexp_extract(line, {_SPLIT}, 2), ')')"
TEXT_PEOPLE = f"""
ln AS (SELECT page_id, line, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos FROM
  (SELECT page_id, trim(unnest(string_split(said, chr(10))), {_WS}) AS line, generate_subscripts(string_split(said, chr(10)), 1) AS i FROM pf) q WHERE line <> ''),
nb AS (SELECT *, lag(line) OVER (PARTITION BY page_id ORDER BY pos) AS above, lead(line) OVER (PARTITION BY page_id ORDER BY pos) AS below FROM ln),
tl AS (SELECT page_id, pos, line, above, below, {_A} AS a, {_B} AS b FROM nb WHERE length(line) <= 110 AND {C.is_lead('line')}),
tn AS (SELECT page_id, pos, line, a, b, CASE WHEN {C.is_lead('b')} AND NOT {C.is_lead('a')} THEN {C.person_name('a')} END AS an,
  CASE WHEN {C.is_lead('a')} AND NOT {C.is_lead('b')} THEN {C.person_name('b')} END AS bn, {C.person_name('line')} AS wn,
  CASE WHEN NOT {C.is_lead('above')} THEN {C.person_name('above')} END AS un, CASE WHEN NOT {C.is_lead('below')} THEN {C.person_name('below')} END AS dn FROM tl),
tp AS (SELECT page_id, 1 AS part, pos, coalesce(an, bn, CASE WHEN wn IS NULL AND {C.clean_title('line')} <> '' THEN coalesce(un, dn) END) AS name,
  {C.clean_title('CASE WHEN an IS NOT NULL THEN trim(b) WHEN bn IS NOT NULL THEN trim(a) ELSE line END')} AS title FROM tn
 UNION ALL SELECT page_id, 2, i - 1, {C.person_name('n')}, 'Founder' FROM (SELECT page_id, unnest(regexp_extract_all(said, {C.lit(V.FOUNDED_BY)}, 1)) AS n,
   generate_subscripts(regexp_extract_all(said, {C.lit(V.FOUNDED_BY)}, 1), 1) AS i FROM pf) f)
"""


def said_facts(spark, sf, *more: str):
    """Page text without quoted passages, the part of the page facts that people are read from, and those that `more` names."""
    p = texts(spark, sf).withColumn("dom", dom_facts(F.col("html"), "said", *more))
    return p.select("page_id", F.col("path").rlike(V.LEGAL_PATH).alias("is_legal"), F.coalesce("dom.said", "body").alias("said"), *[F.col(f"dom.{m}").alias(m) for m in more])


@query("c13_text_people", _with("SELECT page_id, part, pos, name, title FROM tp WHERE name IS NOT NULL AND title <> ''", TEXT_PEOPLE))
def c13(spark, sf):
    people = P.recognized(F.concat(P.line_mentions(F.col("said")), P.founder_mentions(F.col("said"))))
    return (said_facts(spark, sf).select("page_id", F.explode(people).alias("p"))
            .select("page_id", "p.part", F.col("p.pos").cast("bigint").alias("pos"), "p.name", "p.title"))


@query("c14_quote_suppression", _with("SELECT page_id, md5(said) AS said, length(full_text) - length(said) AS quoted FROM pf"))
def c14(spark, sf):
    full = texts(spark, sf).withColumn("dom", dom_facts(F.col("html"), "said"))
    said = F.coalesce("dom.said", "body")
    return full.select("page_id", F.md5(said).alias("said"), (F.length("body") - F.length(said)).cast("bigint").alias("quoted"))


_PROFILE = f"lower(regexp_extract(split_part(l.href, '?', 1), {C.lit(V.PROFILE_URL)}, 1)) || '/' || regexp_extract(split_part(l.href, '?', 1), {C.lit(V.PROFILE_URL)}, 2)"


@query("c15_profile_links", _with(f"""SELECT page_id, 'https://www.linkedin.com/' || {_PROFILE} AS url, l.label || '  ' AS own, (SELECT coalesce('https://www.linkedin.com/company/' ||
  regexp_extract(array_to_string(list_transform(p2.links, lambda z: z.href), ' '), 'linkedin.com/company/([A-Za-z0-9_.%-]{{2,100}})[ #?]', 1), '') FROM pf p2 WHERE p2.page_id = q.page_id) AS company
FROM (SELECT page_id, unnest(links) AS l FROM pf) q WHERE contains(l.href, 'linkedin.com/in/')"""))
def c15(spark, sf):
    p = texts(spark, sf).withColumn("dom", dom_facts(F.col("html"), "profiles"))
    company = P.company_profile(F.col("links"))
    company = F.when(company == "", F.lit("https://www.linkedin.com/company/")).otherwise(company)
    return (p.select("page_id", company.alias("company"), F.explode(P.person_profiles(F.col("dom.profiles"))["links"]).alias("p"))
            .select("page_id", "p.url", "p.own", "company"))


# pages whose profile links stand in cards: the blocks of each link by depth, worded from how the cards are built
TEAM = f"""
tg AS ({L.TEAM_PAGES}),
tx AS (SELECT page_id, regexp_replace(html, {C.lit(_HIDDEN)}, chr(1), 'g') AS m, html, card_a, card_b, card_c, card_d, person4 FROM tg),
ty AS (SELECT *, array_to_string({sql_nodes("m")}, ' ') AS whole, array_to_string({sql_nodes("regexp_extract(m, '(?is)<body[^>]*>(.*)</body>', 1)")}, ' ') AS body_text,
  array_to_string({sql_nodes("regexp_extract(m, '(?is)<section><h2>Faces</h2>.*?</section>')")}, ' ') AS faces, contains(html, '<h2>Faces</h2>') AS cards FROM tx),
lk AS (SELECT page_id, 'https://www.linkedin.com/in/' || regexp_extract(html, 'linkedin.com/in/([a-z0-9-]+)/[?]x=1', 1) AS url, 0 AS n, regexp_extract(html, '<div><p>([^<]*)</p><a href="https://www.linkedin.com/in/[a-z0-9-]+/[?]x=1', 1) || ' Profile' AS own_block,
    'Profile' AS own, ['body', 'html'] AS rings FROM ty WHERE contains(html, '/?x=1')
  UNION ALL SELECT page_id, 'https://www.linkedin.com/in/card-' || (page_id - 1000000000) || '-' || k.k, k.n, CASE k.k WHEN 'a' THEN card_a WHEN 'b' THEN card_b WHEN 'c' THEN card_c WHEN 'd' THEN card_d ELSE 'Profile' END,
    CASE k.k WHEN 'a' THEN 'Profile' WHEN 'b' THEN 'Both' WHEN 'c' THEN 'in ' || regexp_extract(html, 'aria-label="([^"]*)"', 1) WHEN 'd' THEN 'in' ELSE 'Profile' END,
    CASE k.k WHEN 'e' THEN ['body', 'html'] WHEN 'd' THEN ['own', 'card', 'list'] ELSE ['section', 'body', 'html'] END FROM ty JOIN (VALUES ('a', 1), ('b', 2), ('c', 3), ('d', 4), ('e', 1)) k(k, n) ON (k.k <> 'e' AND cards) OR (k.k = 'e' AND contains(html, '-e">Profile<'))),
bl AS (SELECT page_id, url, n, own, 0 AS depth, own_block AS block FROM lk
  UNION ALL SELECT lk.page_id, url, n, own, i, CASE rings[i] WHEN 'section' THEN faces WHEN 'body' THEN body_text WHEN 'html' THEN whole WHEN 'own' THEN 'in' ELSE person4 || ' in' END
    FROM lk JOIN ty ON ty.page_id = lk.page_id, generate_series(1, 3) g(i) WHERE i <= len(rings))
"""


def team_facts(spark, sf):
    """Facts of the team pages, with the profile links in plain form."""
    t = P.page_texts(L.landed(spark, sf, L.TEAM_PAGES)).withColumn("dom", dom_facts(F.col("html")))
    return t.select("page_id", F.coalesce("dom.said", "body").alias("said"), F.col("dom.nodes").alias("nodes"), P.person_profiles(F.col("dom.profiles")).alias("profiles"))


@query("c15_profile_blocks", "WITH " + TEAM.strip().rstrip(",") + "SELECT page_id, url, depth, md5(block) AS block FROM bl")
def c15_blocks(spark, sf):
    links = team_facts(spark, sf).select("page_id", F.col("profiles.told").alias("told"), F.explode("profiles.links").alias("p"))
    return (links.select("page_id", "told", "p.url", F.posexplode("p.blocks").alias("depth", "b"))
            .select("page_id", "url", "depth", F.md5(F.substr("told", F.col("b.at") + 1, F.col("b.n"))).alias("block")))


_TEAM_AS_PAGES = PF.replace(f"sp AS ({L.SITE_PAGES})", f"sp AS (SELECT page_id, url, html FROM ({L.TEAM_PAGES}) tp0)")


@query("c16_person_profile", "WITH " + ",".join([_TEAM_AS_PAGES, NODES, LD_PEOPLE, TEXT_PEOPLE, TEAM]) + """,
nm AS (SELECT DISTINCT page_id, name FROM (SELECT page_id, name FROM lp WHERE name IS NOT NULL UNION ALL SELECT page_id, name FROM tp WHERE name IS NOT NULL AND title <> '')),
dr AS (SELECT nm.page_id, nm.name, arg_min(url, n) AS url FROM nm JOIN lk ON lk.page_id = nm.page_id
  WHERE (contains(lower(url), split_part(lower(name), ' ', 1)) AND contains(lower(url), split_part(lower(name), ' ', -1))) OR contains(lower(own), lower(name)) GROUP BY ALL),
nr AS (SELECT nm.page_id, nm.name, bl.url, bl.n, arg_min(block, depth) AS block FROM nm JOIN bl ON bl.page_id = nm.page_id WHERE contains(lower(block), lower(name)) GROUP BY ALL),
nb2 AS (SELECT nr.page_id, nr.name, arg_min(url, n) AS url FROM nr WHERE NOT EXISTS (SELECT 1 FROM nm o WHERE o.page_id = nr.page_id AND lower(o.name) <> lower(nr.name) AND contains(lower(nr.block), lower(o.name)))
  GROUP BY nr.page_id, nr.name)
SELECT nm.page_id, nm.name, coalesce(dr.url, nb2.url, '') AS profile FROM nm LEFT JOIN dr ON dr.page_id = nm.page_id AND dr.name = nm.name LEFT JOIN nb2 ON nb2.page_id = nm.page_id AND nb2.name = nm.name""")
def c16(spark, sf):
    """Every person of a page with the profile that is theirs."""
    named = team_facts(spark, sf).select("page_id", "profiles", F.array_distinct(F.transform(P.people_of_page(F.col("said"), F.col("nodes")), lambda p: p["name"])).alias("names"))
    found = with_profiles(named, F.col("names"), F.array("profiles"), "urls")
    return (found.select("page_id", F.explode(F.arrays_zip("names", F.coalesce("urls", F.array().cast("array<string>")).alias("urls"))).alias("p"))
            .select("page_id", F.col("p.names").alias("name"), F.coalesce("p.urls", F.lit("")).alias("profile")))
