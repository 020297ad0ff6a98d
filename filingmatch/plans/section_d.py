"""Site folds, classification and choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.links import plain_web_address
from ..functions.names import core_tokens
from ..operators import choose, classify, sites
from ..operators import pages as P
from ..operators.skew import spread
from . import check_sql as C
from . import landed as L
from .catalog import query
from .section_c import HEAD, HOMES, LD_PEOPLE, NODES, PHONES, RAW_MAIL, ROLES, TEXT_PEOPLE, _with, pages, said_facts, sql_emails, texts

# -------------------------------------------------------------------------------------------------- check SQL of a site
_KEYED = "rtrim(split_part(url, '#', 1), '/')"
CHOSEN = f"""
ix AS (SELECT {_KEYED} AS url_key, min(page_id) AS page_id FROM pf GROUP BY 1),
ch AS (SELECT site, page_id, min(rank) AS rank FROM (SELECT host AS site, page_id, 0 AS rank FROM homes UNION ALL SELECT r.site, i.page_id, r.rank FROM rr r JOIN ix i ON i.url_key = r.url_key
  UNION ALL SELECT r.site, i.page_id, r.rank FROM lr r JOIN ix i ON i.url_key = r.url_key) q GROUP BY site, page_id)
"""
_LD_MAIL = f"""lm AS (SELECT page_id, {sql_emails(f"list(regexp_extract(email, {C.lit(V.EMAIL)}) ORDER BY pos)")} AS mails FROM nd WHERE email IS NOT NULL GROUP BY page_id),
lt AS (SELECT page_id, list_filter(list({C.usable_phone('telephone')} ORDER BY pos), lambda x1: x1 <> '') AS phones FROM nd WHERE telephone IS NOT NULL GROUP BY page_id),
em AS (SELECT page_id, {sql_emails(RAW_MAIL)} AS mails FROM pf)"""
FOLD = f"""
{_LD_MAIL},
ml AS (SELECT c.site, c.rank, p.is_legal, 0 AS src, unnest(l.mails) AS v, generate_subscripts(l.mails, 1) AS i FROM ch c JOIN pf p ON p.page_id = c.page_id JOIN lm l ON l.page_id = c.page_id
  UNION ALL SELECT c.site, c.rank, p.is_legal, 1, unnest(e.mails), generate_subscripts(e.mails, 1) FROM ch c JOIN pf p ON p.page_id = c.page_id JOIN em e ON e.page_id = c.page_id),
mo AS (SELECT site, v, min((rank * 2 + src) * 100000 + i) AS spot, bool_and(is_legal) AS legal_only FROM ml GROUP BY site, v),
me AS (SELECT site, list(v ORDER BY CASE WHEN NOT {C.same_site("split_part(v, '@', 2)", 'site')} THEN 2 WHEN split_part(v, '@', 1) IN {C.among(V.FRONT_DOOR)} THEN 0 ELSE 1 END, spot) AS emails,
  list(v ORDER BY CASE WHEN NOT {C.same_site("split_part(v, '@', 2)", 'site')} THEN 2 WHEN split_part(v, '@', 1) IN {C.among(V.FRONT_DOOR)} THEN 0 ELSE 1 END, spot) FILTER (legal_only) AS legal_emails, list(v ORDER BY spot) AS page_emails FROM mo GROUP BY site),
pl AS (SELECT c.site, c.rank, p.is_legal, 0 AS src, unnest(l.phones) AS v, generate_subscripts(l.phones, 1) AS i FROM ch c JOIN pf p ON p.page_id = c.page_id JOIN lt l ON l.page_id = c.page_id
  UNION ALL SELECT c.site, c.rank, p.is_legal, 1, unnest(h.phones), generate_subscripts(h.phones, 1) FROM ch c JOIN pf p ON p.page_id = c.page_id JOIN ph h ON h.page_id = c.page_id),
po AS (SELECT site, v, min((rank * 2 + src) * 100000 + i) AS spot, arg_min(src, (rank * 2 + src) * 100000 + i) AS src, bool_and(is_legal) AS legal_only FROM pl GROUP BY site, v),
pq AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY legal_only, src, CASE WHEN src = 0 THEN -spot ELSE spot END) AS rn FROM po),
pe AS (SELECT site, list(v ORDER BY rn) AS phones, list(v ORDER BY rn) FILTER (legal_only) AS legal_phones FROM pq WHERE rn <= 6 GROUP BY site),
bd AS (SELECT c.site, count(*) AS pages, string_agg(p.body, chr(10) ORDER BY c.rank, c.page_id) AS body, arg_min({HEAD}, c.rank) AS head FROM ch c JOIN pf p ON p.page_id = c.page_id GROUP BY c.site)
"""
_SITE = (HOMES, ROLES, CHOSEN, NODES, PHONES, FOLD)
_J = "coalesce(array_to_string({0}, ' '), '')"


def site_rows(spark: SparkSession, sf: str) -> DataFrame:
    return sites.fold_sites(pages(spark, sf))


def _joined(c: str):
    return F.array_join(c, " ").alias(c)


@query("d1_site_fold", _with(f"""SELECT b.site, b.pages, {_J.format('m.page_emails')} AS page_emails, {_J.format('p.phones')} AS phones, md5(b.body) AS body, md5(b.head) AS head
FROM bd b LEFT JOIN me m ON m.site = b.site LEFT JOIN pe p ON p.site = b.site""", *_SITE))
def d1(spark, sf):
    return site_rows(spark, sf).select("site", F.col("pages").cast("bigint").alias("pages"), _joined("page_emails"), _joined("phones"),
                                       F.md5("body").alias("body"), F.md5("head").alias("head"))


@query("d2_legal_only", _with(f"""SELECT b.site, {_J.format('m.legal_emails')} AS legal_only_emails, {_J.format('p.legal_phones')} AS legal_only_phones
FROM bd b LEFT JOIN me m ON m.site = b.site LEFT JOIN pe p ON p.site = b.site""", *_SITE))
def d2(spark, sf):
    return site_rows(spark, sf).select("site", _joined("legal_only_emails"), _joined("legal_only_phones"))


@query("d3_email_order", _with(f"SELECT b.site, {_J.format('m.emails')} AS emails FROM bd b LEFT JOIN me m ON m.site = b.site", *_SITE))
def d3(spark, sf):
    return site_rows(spark, sf).select("site", _joined("emails"))


_PH = "[area || '624' || line, phone2, area || exch || line, '4156247812', area || '333' || line, area || '444' || line, area || '666' || line]"
_CO = f"(SELECT c.*, r.area, r.exch, r.line, r.k FROM ({L.COMPANIES}) c JOIN ({L.REG}) r ON r.k = CAST(split_part(c.id, ':', 2) AS BIGINT)) x"


def companies(spark: SparkSession, sf: str) -> DataFrame:
    c = L.landed(spark, sf, L.COMPANIES)
    reg = L.landed(spark, sf, L.REG).select("k", "area", "exch", "line")
    return c.withColumn("k", F.split_part("id", F.lit(":"), F.lit(2)).cast("bigint")).join(reg, "k")


def _numbers():
    p = lambda mid: F.concat("area", F.lit(mid), "line")                                         # noqa: E731
    return F.array(p("624"), F.col("phone2"), F.concat("area", "exch", "line"), F.lit("4156247812"), p("333"), p("444"), p("666"))


@query("d4_phone_order", f"""SELECT id, array_to_string(list_concat(list_filter(n, lambda a1: a1[4:4] IN ('6', '4')), list_filter(n, lambda a2: a2[4:4] NOT IN ('6', '4')))[1:6], ' ') AS phones
FROM (SELECT id, {C.distinct_in_order(_PH)} AS n FROM {_CO}) q""")
def d4(spark, sf):
    rows = companies(spark, sf).withColumn("n", F.array_distinct(_numbers()))
    real = F.filter("n", lambda p: F.substring(p, 4, 1).isin("6", "4"))
    return rows.select("id", F.array_join(sites.order_phones(F.col("n"), real), " ").alias("phones"))


_PLAIN = f"""NOT list_has_any(list_transform(string_split(lower(name), ' '), lambda o1: trim(o1, '.')), {C.items(V.ORGWORDS)}) AND {C.is_lead('title')}
 AND NOT (regexp_matches(title, ',\\s*[A-Za-z]|\\b(at|of|for)\\s+[A-Z]') AND NOT regexp_matches(title, '&|and|/'))"""
PEOPLE = f"""
pp AS (SELECT page_id, 0 AS part, pos0 AS pos, name, title, email FROM lp WHERE name IS NOT NULL UNION ALL SELECT page_id, part, pos, name, title, '' FROM tp WHERE name IS NOT NULL AND title <> ''),
pk AS (SELECT pp.* FROM pp JOIN pf ON pf.page_id = pp.page_id WHERE NOT pf.is_legal AND {_PLAIN}),
ld AS (SELECT c.site, k.name, k.title, k.email, c.rank, k.part, k.pos FROM pk k JOIN ch c ON c.page_id = k.page_id QUALIFY row_number() OVER (PARTITION BY c.site, lower(k.name) ORDER BY c.rank, k.part, k.pos) = 1)
"""
_PEOPLE = (HOMES, ROLES, CHOSEN, NODES, LD_PEOPLE, TEXT_PEOPLE, PEOPLE)


@query("d5_person_filter", _with("SELECT page_id, name, title, count(*) AS n FROM pk GROUP BY ALL", *_PEOPLE))
def d5(spark, sf):
    people = P.people_of_page(F.col("said"), F.col("nodes"))
    rows = said_facts(spark, sf, "nodes").where(~F.col("is_legal")).select("page_id", F.explode(people).alias("p"))
    return (rows.select("page_id", F.explode(sites.leaders(F.array("p"))).alias("p")).groupBy("page_id", F.col("p.name").alias("name"), F.col("p.title").alias("title"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("d6_person_dedup", _with("SELECT site, name, title, email, row_number() OVER (PARTITION BY site ORDER BY rank, part, pos) - 1 AS place FROM ld", *_PEOPLE))
def d6(spark, sf):
    return (site_rows(spark, sf).select("site", F.posexplode("leaders").alias("place", "p"))
            .select("site", "p.name", "p.title", "p.email", F.col("place").cast("bigint").alias("place")))


_FORMS = "[f, f || '.' || l, f || l, f[1:1] || l, f || '_' || l, f[1:1] || '.' || l]"


@query("d7_person_email", _with(f"""SELECT site, name, CASE WHEN email <> '' THEN email ELSE coalesce(list_filter(page_emails, lambda e1: {C.same_site("split_part(e1, '@', 2)", 'site')}
 AND list_contains({_FORMS}, split_part(e1, '@', 1)))[1], '') END AS email
FROM (SELECT d.*, m.page_emails, lower(string_split(name, ' ')[1]) AS f, lower(string_split(name, ' ')[-1]) AS l FROM ld d LEFT JOIN me m ON m.site = d.site) q""", *_PEOPLE, PHONES, FOLD))
def d7(spark, sf):
    mine = F.when(F.col("p.email") != "", F.col("p.email")).otherwise(choose.person_email(F.col("p.name"), F.col("page_emails"), F.col("site")))
    return site_rows(spark, sf).select("site", "page_emails", F.explode("leaders").alias("p")).select("site", "p.name", mine.alias("email"))


_RANK = "CASE WHEN regexp_matches(lower(title), 'ceo|chief executive') THEN 0 WHEN contains(lower(title), 'founder') THEN 1 ELSE 2 END"


@query("d8_person_rank", _with(f"SELECT site, name, title, row_number() OVER (PARTITION BY site ORDER BY {_RANK}, rank, part, pos) AS place FROM ld QUALIFY place <= 4", *_PEOPLE))
def d8(spark, sf):
    return (site_rows(spark, sf).select("site", F.posexplode(choose.rank_people(F.col("leaders"))).alias("i", "p"))
            .select("site", "p.name", "p.title", (F.col("i") + 1).cast("bigint").alias("place")))


def _signs(e: str, patterns: list[str]) -> str:
    arms = ["CAST(regexp_matches({0}, {1}) AS INTEGER)".format(e, C.lit("(?i)" + p.replace("caf[eé]\\b", "caf[eq]\\b"))) for p in patterns]
    return "(" + " + ".join(arms) + ")"


def sql_classify(head: str, body: str, keep: str, frm: str) -> str:
    """keep, level, score of every row of `frm`."""
    return f"""SELECT {keep}, CASE WHEN s >= 6 THEN 'strong' WHEN s >= 2 THEN 'weak' WHEN thin AND nh = 0 THEN 'unknown' ELSE 'none' END AS level, round(s, 1) AS score
FROM (SELECT {keep}, nh, thin, 3.0 * sh + least(sb, 8) + wh + 0.5 * least(wb, 5) - 3.0 * nh - 0.5 * least(nb, 4) AS s FROM (SELECT {keep},
  {_signs('h', V.STRONG_SIGNS)} AS sh, {_signs('b', V.STRONG_SIGNS)} AS sb, {_signs('h', V.WEAK_SIGNS)} AS wh, {_signs('b', V.WEAK_SIGNS)} AS wb,
  {_signs('h', V.OTHER_TRADE_SIGNS)} AS nh, {_signs('b', V.OTHER_TRADE_SIGNS)} AS nb, length(trim(b)) < 400 AND length(trim(h)) < 120 AS thin
  FROM (SELECT {keep}, regexp_replace({head}, '[À-ÖØ-öø-ɏ]', 'q', 'g') AS h, regexp_replace(({body}), '[À-ÖØ-öø-ɏ]', 'q', 'g') AS b FROM {frm}) q1) q2) q3"""


@query("d9_classify_pages", _with(sql_classify(HEAD, "body", "page_id", "pf")))
def d9(spark, sf):
    return (texts(spark, sf).select("page_id", classify.classify(F.col("head"), F.col("body")).alias("it"))
            .select("page_id", "it.level", F.col("it.score").cast("double").alias("score")))


_DOCS = "(SELECT d.doc_id, d.text, d.lang, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) x"


@query("d9_classify_documents", f"""SELECT lang, quality, level, count(*) AS n, sum(score) AS total FROM ({sql_classify("split_part(text, chr(10), 1)", 'text', 'doc_id, lang, quality', _DOCS)}) z GROUP BY ALL""")
def d9_documents(spark, sf):
    docs = L.table(spark, sf, "documents").join(L.table(spark, sf, "labels"), "doc_id", "left")
    it = classify.classify(F.split_part("text", F.lit("\n"), F.lit(1)), F.col("text"))
    return (docs.select("lang", "quality", it.alias("it")).groupBy("lang", "quality", F.col("it.level").alias("level"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("it.score").alias("total")))


# ------------------------------------------------------------------------------------------------------------------- choice
_MAILS = "list_filter([email, 'studio@' || domain, 'press@' || domain, 'austin@' || domain, 'someone@gmail.com', 'x@other.io'], lambda m0: contains(m0, '@') AND m0 NOT LIKE '%@')"
_FILED = "list_filter([lower(replace(email, 'linda', 'owner')), 'hello@mail.' || domain], lambda f0: contains(f0, '@') AND f0 NOT LIKE '%@mail.' AND f0 NOT LIKE '%@')"


def _mails():
    at = lambda local: F.concat(F.lit(local + "@"), "domain")                                   # noqa: E731
    site = F.array(F.col("email"), at("studio"), at("press"), at("austin"), F.lit("someone@gmail.com"), F.lit("x@other.io"))
    filed = F.array(F.lower(F.replace("email", F.lit("linda"), F.lit("owner"))), F.concat(F.lit("hello@mail."), "domain"))
    ok = lambda e: F.contains(e, F.lit("@")) & ~e.endswith("@") & ~e.endswith("@mail.")         # noqa: E731
    return F.filter(site, ok), F.filter(filed, ok)


_DOOR = f"""CASE WHEN list_contains({C.items(V.FRONT_DOOR)}, split_part(e, '@', 1)) THEN list_position({C.items(V.FRONT_DOOR)}, split_part(e, '@', 1)) - 1
 WHEN {C.flat('city')} <> '' AND split_part(e, '@', 1) = {C.flat('city')} THEN 11 ELSE 12 END"""
_PICKED = f"""
SELECT x.id, coalesce(b.e, '') AS email, coalesce(b.came, '') AS came_from FROM ({L.COMPANIES}) x LEFT JOIN (
 SELECT id, e, came FROM (
  SELECT id, e, i, 'company website' AS came, CASE WHEN {C.same_site("split_part(e, '@', 2)", 'domain')} THEN 0 ELSE 2 END AS a,
    CASE WHEN {C.same_site("split_part(e, '@', 2)", 'domain')} THEN {_DOOR} ELSE 1 END AS b
  FROM (SELECT id, domain, city, unnest({_MAILS}) AS e, generate_subscripts({_MAILS}, 1) AS i FROM ({L.COMPANIES}) c) q
  WHERE NOT {C.not_a_contact("split_part(e, '@', 1)")} AND ({C.same_site("split_part(e, '@', 2)", 'domain')} OR {C.email_kind('e')} = 'free')
  UNION ALL SELECT id, e, i, 'state registry', 1, 1 FROM (SELECT id, domain, unnest({_FILED}) AS e, generate_subscripts({_FILED}, 1) AS i FROM ({L.COMPANIES}) c) q
  WHERE {C.email_kind('e')} = 'own' AND {C.same_site("split_part(e, '@', 2)", 'domain')} AND NOT {C.not_a_contact("split_part(e, '@', 1)")}) z
 QUALIFY row_number() OVER (PARTITION BY id ORDER BY a, b, i) = 1) b ON b.id = x.id
"""


@query("d10_pick_email", _PICKED)
def d10(spark, sf):
    site, filed = _mails()
    pick = choose.pick_email(site, filed, F.col("domain"), F.col("city"))
    return spread(L.landed(spark, sf, L.COMPANIES)).select("id", pick.alias("p")).select("id", "p.email", "p.came_from")


@query("d11_pick_phone", f"""SELECT id, coalesce(u[1], '') AS phone, CASE WHEN u[1] IS NULL THEN '' WHEN u[1][4:6] = '624' THEN '{V.LEGAL_ONLY}' ELSE 'company website' END AS came_from,
 array_to_string(u[1:4], ' ') AS phones FROM (SELECT id, CASE WHEN len(v) > 5 THEN [] ELSE v END AS u FROM (SELECT id, list_filter({C.distinct_in_order(_PH)}, lambda p1: {C.usable_phone('p1')} <> '')[1 + (k % 3):] AS v FROM {_CO}) q) z""")
def d11(spark, sf):
    from ..functions.phones import usable_phone
    usable = F.filter(F.array_distinct(_numbers()), lambda p: usable_phone(p) != "")
    some = F.slice(usable, (1 + F.col("k") % 3).cast("int"), F.lit(10))
    rows = companies(spark, sf).select("id", some.alias("n"))
    pick = choose.pick_phone(F.col("n"), F.filter("n", lambda p: F.substring(p, 4, 3) == "624"))
    return rows.select("id", pick.alias("p")).select("id", "p.phone", "p.came_from", F.array_join("p.phones", " ").alias("phones"))


_OFFICER = f"{C.person_name('officer', 'true')}"
_LEADER = f"CASE WHEN {C.clean_title('contact_title')} <> '' AND {C.is_lead(C.clean_title('contact_title'))} THEN {C.person_name('contact_name', 'false', C.core_tokens('name'))} END"


@query("d12_pick_contact", f"""SELECT id, CASE WHEN lead IS NOT NULL THEN lead ELSE coalesce(off, '') END AS contact, CASE WHEN lead IS NOT NULL THEN lead_title WHEN off IS NOT NULL THEN off_title ELSE '' END AS title,
 CASE WHEN lead IS NOT NULL THEN 'company website' WHEN off IS NOT NULL THEN 'state registry' ELSE '' END AS came_from
FROM (SELECT id, {_LEADER} AS lead, {C.clean_title('contact_title')} AS lead_title, {_OFFICER} AS off, {C.clean_title('officer_title')} AS off_title FROM ({L.COMPANIES}) c) q""")
def d12(spark, sf):
    from ..functions.people import clean_title, person_name
    c = L.landed(spark, sf, L.COMPANIES)
    leader = F.struct(person_name("contact_name", company_tokens=core_tokens("name")).alias("name"), clean_title("contact_title").alias("title"),
                      F.lit("").alias("email"), F.lit("").alias("linkedin"))
    filed = F.array(F.struct(F.col("officer").alias("name"), F.col("officer_title").alias("title")))
    contact = choose.pick_contact(F.filter(F.array(leader), lambda p: p["name"].isNotNull()), filed)
    return c.select("id", contact.alias("c")).select("id", F.coalesce("c.name", F.lit("")).alias("contact"), F.coalesce("c.title", F.lit("")).alias("title"),
                                                     F.coalesce("c.from", F.lit("")).alias("came_from"))


@query("d13_more_emails", f"""SELECT id, array_to_string(list_filter({_MAILS}, lambda m1: m1 <> email AND {C.same_site("split_part(m1, '@', 2)", 'domain')} AND NOT {C.not_a_contact("split_part(m1, '@', 1)")})[1:3], ' ') AS emails
FROM ({L.COMPANIES}) c""")
def d13(spark, sf):
    site, _filed = _mails()
    return L.landed(spark, sf, L.COMPANIES).select("id", F.array_join(choose.more_emails(site, F.col("email"), F.col("domain")), " ").alias("emails"))


_ROOTS = f"SELECT k, {L._picks('k', 'https://', 'HTTP://', 'ftp://', '')} || replace(base, ' ', '-') || {L._picks('k', '.com', '.com:8080', '.io.', '_x.com', '.com/path')} AS root FROM ({L.REG}) r"


@query("d14_plain_address", f"SELECT k, root, regexp_matches(lower(root), '^https?://[a-z0-9]([a-z0-9.\\-]*[a-z0-9])?(:\\d{{1,5}})?$') AS plain FROM ({_ROOTS}) r")
def d14(spark, sf):
    return L.landed(spark, sf, _ROOTS).select("k", "root", plain_web_address("root").alias("plain"))
