"""Landed tables derived from the driver tables, as portable SQL.

The jobs read registry snapshots, crawled pages, domain dates and a state table. The driver tables hold customers, parts,
pages and events instead, so this module words each landed table as one SELECT over them: every row comes from a driver row,
so the work grows with the tables. The text runs unchanged in Spark and in the check engine; it only shapes inputs and holds
none of the operators' logic.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TODAY = "2024-05-01"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
_TABLE_REF = re.compile(r"\b(FROM|JOIN) (" + "|".join(TABLES) + r")\b")


def _pick(expr: str, *values: str) -> str:
    """CASE over `expr` modulo the number of values; each value is SQL text."""
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"(CASE ({expr}) % {len(values)} {arms} END)"


def _s(text: str) -> str:
    return "'" + text + "'"


def _picks(expr: str, *texts: str) -> str:
    return _pick(expr, *[_s(t) for t in texts])


PAGE_HOSTS = """
SELECT page_id, host, split_part(root, '.', 1) AS label, split_part(root, '.', 3) AS tld,
       replace(host, '.example.', '.') AS site_host, split_part(url, '://', 1) AS scheme,
       substr(split_part(url, '://', 2), length(host) + 1) AS rest, html
FROM (SELECT page_id, url, html, host,
             CASE WHEN host LIKE 'www.%' THEN substr(host, 5) WHEN host LIKE 'm.%' THEN substr(host, 3)
                  WHEN host LIKE 'blog.%' THEN substr(host, 6) ELSE host END AS root
      FROM (SELECT page_id, url, html, split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages) q0) q1
"""

# one row per customer: the words and numbers the registry rows are made of
REG = f"""
SELECT k, base, label, p_name, nation, seg,
       {_pick("k", "upper(base) || ' LLC'", "upper(base) || ' TECHNOLOGIES INC.'", "upper(base) || ' & CO'", "upper(base)",
              "upper(base) || ' GMBH'", "base || ' Labs'", "upper(p_name)")} AS legal,
       {_pick("k", "''", "upper(base) || ' CLOUD'", "base || '/' || p_name", "upper(p_name) || ' STUDIOS'")} AS trade,
       CAST(k % 900 + 10 AS STRING) || {_picks("k", " N MAIN STREET", " market st", " 21ST AVENUE NW", " Elm Road Suite 5", "  w 3rd  st")} AS street,
       {_picks("k", "SAN FRANCISCO", "o-fallon", "WINSTON-SALEM", "Austin", "", "HARTFORD", "st. louis")} AS city,
       {_picks("k", "TX", "ct", "WA", "", "CA", "NY")} AS st,
       lpad(CAST((k * 7919) % 100000 AS STRING), 5, '0') AS zip5,
       DATE '2024-01-01' + CAST((k * 17) % 122 AS INT) AS filed,
       {_picks("k * 5 + CAST(floor(k / 7) AS INT)", "541511", "541512", "722511", "518210", "236220", "513210", "517911", "519290", "561110")} AS naics,
       {_picks("k", "Custom software", "Data (hosting) services", "Telecom", "Full-service restaurants")} AS naics_label,
       {_pick("k", "'(' || area || ') ' || exch || '-' || line", "area || '.' || exch || '.' || line", "'+1 ' || area || exch || line",
              "'1-' || area || '-555-' || line", "exch || '-' || line", "'(' || area || ') ' || exch || '-' || line || ' x12'")} AS phone,
       area, exch, line,
       {_picks("k", "Linda", "ROBERT", "Susan", "carlos", "Wei")} || ' ' || {_picks("k", "Marlow", "KELLER", "Ortiz", "nguyen", "Hale", "Solutions", "Okafor")} AS officer,
       {_pick("k", "'Info@' || base2 || '.com'", "''", "'owner' || CAST(k AS STRING) || '@gmail.com'", "'notice@registeredagent.com'",
              "'hello@mail.' || base2 || '.net'", "'press@' || base2 || '.org'")} AS email
FROM (SELECT c.c_custkey AS k, CASE WHEN h.label IS NULL THEN p.p_name ELSE h.label END AS base,
             replace(CASE WHEN h.label IS NULL THEN p.p_name ELSE h.label END, ' ', '') AS base2,
             h.label, p.p_name, n.n_name AS nation, c.c_mktsegment AS seg,
             CAST(200 + (c.c_custkey * 7) % 800 AS STRING) AS area, lpad(CAST((c.c_custkey * 13 + 180) % 1000 AS STRING), 3, '0') AS exch,
             lpad(CAST((c.c_custkey * 37) % 10000 AS STRING), 4, '0') AS line
      FROM customer c JOIN part p ON p.p_partkey = c.c_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
      LEFT JOIN ({PAGE_HOSTS}) h ON h.page_id = c.c_custkey) q
"""

_ID = "CAST(k - CASE WHEN k % 50 >= 45 THEN 5 ELSE 0 END AS STRING)"      # some filings repeat the id of an earlier one

RAW_TX = f"""
SELECT legal AS taxpayer_name, trade AS outlet_name, {_picks("k", "CL", "IS", "CF", "XX", "CI")} AS taxpayer_organization_type,
       '3' || {_ID} AS taxpayer_number, '1' AS outlet_number, st AS outlet_state, city AS outlet_city, street AS outlet_address,
       zip5 AS outlet_zip_code, CAST(filed AS STRING) || 'T00:00:00.000' AS outlet_permit_issue_date,
       CAST(naics AS BIGINT) AS outlet_naics_code
FROM ({REG}) r
"""

RAW_CT = f"""
SELECT 'b' || CAST(k AS STRING) AS id, {_pick("k", _ID, "''")} AS accountnumber, legal AS name,
       {_picks("k", "LLC", "Stock", "")} AS business_type, street AS billingstreet, city AS billingcity, st AS billingstate,
       zip5 || '-1234' AS billingpostalcode, CAST(filed AS STRING) || 'T00:00:00.000' AS date_registration,
       naics_label || ' (' || naics || ')' AS naics_code, email AS business_email_address
FROM ({REG}) r
"""

RAW_CT_OFFICERS = f"""
SELECT 'b' || CAST(o.o_custkey AS STRING) AS business_id, CAST(o.o_orderdate AS DATE) AS create_dt, r.officer AS name__c,
       {_picks("o.o_orderkey", "ANN", "", "peter", "Jobs", "María")} AS firstname,
       {_picks("o.o_orderkey", "STONE", "", "VAN DYKE", "Pipeline")} || CASE WHEN o.o_orderkey % 3 = 0 THEN '' ELSE ' ' END AS lastname,
       {_picks("o.o_orderkey", "MANAGING MEMBER", "president", "", "chief executive officer")} AS designation,
       CAST(o.o_orderkey AS STRING) AS officer_key
FROM orders o JOIN ({REG}) r ON r.k = o.o_custkey
"""

RAW_SEATTLE = f"""
SELECT legal AS business_legal_name, trade AS trade_name, {_picks("k", "LLC", "Sole Proprietorship", "Corporation", "SOLE PROP")} AS ownership_type,
       {_pick("k", _ID, _ID, "''")} AS city_account_number, 'u' || {_ID} AS ubi, street AS street_address, city, st AS state, zip5 AS zip,
       replace(CAST(filed AS STRING), '-', '') AS license_start_date, naics AS naics_code, naics_label AS naics_description,
       phone AS business_phone
FROM ({REG}) r
"""

RAW_SF = f"""
SELECT {_ID} AS uniqueid, 't' || CAST(k AS STRING) AS ttxid, {_pick("k", "legal", "officer", "legal")} AS ownership_name, trade AS dba_name,
       street AS full_business_address, city, st AS state, zip5 AS business_zip, CAST(filed AS STRING) || 'T00:00:00.000' AS location_start_date,
       naics AS self_reported_naics_code
FROM ({REG}) r
"""

RAW_LA = f"""
SELECT {_ID} AS location_account, {_pick("k", "legal", "officer", "legal")} AS business_name, trade AS dba_name, street AS street_address, city,
       zip5 || '-' AS zip_code, CAST(filed AS STRING) || 'T00:00:00.000' AS location_start_date, naics, naics_label AS primary_naics_description
FROM ({REG}) r
"""

RAW = {"tx": RAW_TX, "ct": RAW_CT, "seattle": RAW_SEATTLE, "sf": RAW_SF, "la": RAW_LA}

# five source rows: the last good fetch of each (one source never succeeded)
SOURCE_STATE = f"""
SELECT {_picks("n_nationkey", "tx", "ct", "seattle", "sf", "la")} AS key,
       max(CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE DATE '2024-04-10' + CAST(n_nationkey AS INT) END) AS last_ok
FROM nation GROUP BY {_picks("n_nationkey", "tx", "ct", "seattle", "sf", "la")}
"""

_PERSON = _picks("page_id", "Linda", "Robert", "Susan", "Carlos", "Wei") + " || ' ' || " + _picks(
    "page_id", "Marlow", "Keller", "Ortiz", "Nguyen", "Hale", "Brandt", "Okafor")
_PERSON2 = _picks("page_id", "Greta", "Omar", "Helen", "Louis") + " || ' ' || " + _picks("page_id", "Stone", "Fairbank", "O-Neil", "Lindqvist", "Haas")

_HEAD_BLOCK = f"""
'<meta name="description" content="' || {_picks("page_id", "Cloud software platform for data teams", "Family restaurant &amp; bakery", "",
  "Managed IT services and help desk")} || '">' ||
CASE WHEN page_id % 3 = 0 THEN '<script type="application/ld+json">{{"@context":"https://schema.org","@graph":[{{"@type":"Organization","name":"' || legal ||
  '","telephone":"+1 (' || area || ') ' || exch || '-' || line || '","email":"mailto:Office@' || site_host || '","founder":{{"@type":"Person","name":"' ||
  {_PERSON} || '","email":"' || 'boss@' || site_host || '"}}}},{{"@type":["Person","Thing"],"name":"' || {_PERSON2} || '","jobTitle":"' ||
  {_picks("page_id", "CEO", "Chief Executive Officer", "Engineer", "Owner", "")} || '","email":"x"}}]}}</script>' ELSE '' END
"""

_BODY_BLOCK = f"""
'<h2>Meet the team</h2><p>' || {_PERSON} || '</p><p>' || {_picks("page_id", "Chief Executive Officer", "Founder", "Office hours", "OWNER")} || '</p><p>' ||
{_PERSON2} || {_picks("page_id", " - ", ", ", " | ")} || {_picks("page_id", "Co-Founder and CTO", "President", "Principal", "Happy customer")} || '</p>' ||
CASE WHEN page_id % 4 = 1 THEN '<p>The studio was founded by ' || {_PERSON2} || '. Questions?</p>' ELSE '' END ||
CASE WHEN page_id % 5 = 2 THEN '<blockquote><p>Jane Marsh</p><p>CEO</p></blockquote><div class="card testimonial-box"><p>Rob Stone, Owner</p></div>' ELSE '' END ||
'<a href="mailto:' || {_picks("page_id", "Hello", "jobs", "linda.marlow", "rkeller")} || '@' || site_host || '?subject=Hi">Write us</a>' ||
CASE WHEN page_id % 6 = 0 THEN '<span class="m" data-cfemail="543931142127266c356c3e397a3d3b"></span>' ELSE '' END ||
CASE WHEN page_id % 5 = 1 THEN '<p>team [at] ' || site_host || ' or office' || CAST(page_id AS STRING) || '@gmail.com and me@example.com</p>' ELSE '' END ||
CASE WHEN page_id % 4 = 2 THEN '<a href="tel:+1-' || area || '-' || exch || '-' || line || ';ext=5">Call</a>' ELSE '' END ||
'<p>Phone (' || area || ') 624-' || line || '. Fax: (415) 777-2211</p>' ||
CASE WHEN page_id % 3 = 1 THEN '<p>Media contact: 212-' || exch || '-4444. Desk 650-253-0001</p>' ELSE '' END ||
'<p>' || CASE WHEN page_id % 2 = 0 THEN legal ELSE p_name END || ', ' || CASE WHEN page_id % 5 < 2 THEN street ELSE 'Suite 9' END || ', ' || city || ' ' || zip5 || '</p>' ||
'<div><p>' || {_PERSON} || '</p><a href="https://www.linkedin.com/in/' || {_picks("page_id", "linda-marlow-12", "profile-77", "greta-stone")} || '/?x=1">Profile</a></div>' ||
CASE WHEN page_id % 2 = 0 THEN '<a href="http://linkedin.com/company/' || label || '#a">Follow</a>' ELSE '' END ||
'<a href="/contact">Contact us</a><a href="about-us#top">About</a><a href="/privacy">Privacy</a><a href="/blog/team">Team blog</a><a href="https://other.example.org/contact">Partner</a>' ||
'<a href="//' || site_host || '/our-story">Story</a><a href="https://[YOUR-URL]/contact">Broken</a>'
"""

SITE_PAGES = f"""
SELECT page_id, scheme || '://' || site_host || CASE page_id % 4 WHEN 0 THEN '/' WHEN 1 THEN '/contact' WHEN 2 THEN '/privacy' ELSE rest END AS url,
       replace(replace(html, '</head>', {_HEAD_BLOCK} || '</head>'), '</body>', {_BODY_BLOCK} || '</body>') AS html
FROM (SELECT h.*, r.legal, r.p_name, r.street, r.city, r.zip5, r.area, r.exch, r.line
      FROM ({PAGE_HOSTS}) h JOIN ({REG}) r ON r.k = h.page_id) q
"""

_PERSON3 = _picks("page_id", "Martha", "Henry", "Diana", "Oscar", "Julia") + " || ' ' || " + _picks("page_id", "Vance", "Abbott", "Quigley")
_PERSON4 = _picks("page_id", "Laura", "Peter", "Rosa") + " || ' ' || " + _picks("page_id", "Winter", "Castle", "Barlow", "Imhof")
_PERSON5 = _picks("page_id", "Simon", "Nora", "Felix", "Clara") + " || ' ' || " + _picks("page_id", "Tanner", "Doyle", "Ferro", "Lund", "Mercer")
_CARD = "https://www.linkedin.com/in/card-' || CAST(page_id AS STRING) || '"

# what a team page shows: titles of five people, then cards that link profiles, and the text of each card
TEAM_CARDS = [
    ("a", f"'<div><p>' || {_PERSON3} || '</p><a href=\"{_CARD}-a\">Profile</a></div>'", f"{_PERSON3} || ' Profile'"),
    ("b", f"'<div><span>' || {_PERSON4} || ' and ' || {_PERSON5} || '</span><a href=\"{_CARD}-b\">Both</a></div>'", f"{_PERSON4} || ' and ' || {_PERSON5} || ' Both'"),
    ("c", f"'<div><p>Our office</p><a href=\"{_CARD}-c\" aria-label=\"' || {_PERSON5} || '\">in</a></div>'", "'Our office in'"),
    ("d", f"'<ul><li><b>' || {_PERSON4} || '</b><ul><li><a href=\"{_CARD}-d\">in</a></li></ul></li></ul>'", "'in'")]
TEAM_PAGES = f"""
SELECT page_id + 1000000000 AS page_id, url, CASE WHEN page_id % 5 = 4 THEN '<html><body><h1>Us</h1><p>' || {_PERSON3} || ' - CEO</p><div><a href="{_CARD}-e">Profile</a></div></body></html>'
  ELSE replace(html, '</body>', '<p>' || {_PERSON3} || ' - CEO</p><p>' || {_PERSON4} || ' - President</p><p>' || {_PERSON5} || ', Owner</p><section><h2>Faces</h2>' ||
  {" || ".join(c for _, c, _ in TEAM_CARDS)} || '</section></body>') END AS html, {", ".join(f"{t} AS card_{n}" for n, _, t in TEAM_CARDS)}, {_PERSON4} AS person4
FROM ({SITE_PAGES}) sp0
"""

DOMAIN_CREATED = f"""
SELECT CASE WHEN site_host LIKE 'www.%' THEN substr(site_host, 5) ELSE site_host END AS host,
       DATE '2023-09-01' + CAST((min(page_id) * 37) % 400 AS INT) AS created
FROM ({PAGE_HOSTS}) h GROUP BY CASE WHEN site_host LIKE 'www.%' THEN substr(site_host, 5) ELSE site_host END
"""

# the filings as the matching jobs read them, one row per customer
FILINGS = f"""
SELECT {_picks("k", "tx", "ct", "seattle", "sf", "la")} || ':' || CAST(k AS STRING) AS id, {_picks("k", "tx", "ct", "seattle", "sf", "la")} AS source,
       legal AS name, trade AS trade_name, k % 9 = 4 AS individual, st AS state, city, street AS address, zip5 AS zip, filed AS registered,
       naics_label AS industry, CASE WHEN k % 3 = 0 THEN area || exch || line ELSE '' END AS phone, lower(email) AS email, officer,
       {_picks("k", "Manager", "president", "")} AS officer_title
FROM ({REG}) r
"""

# the state table, flat
COMPANIES = f"""
SELECT {_picks("k", "tx", "ct", "seattle", "sf", "la")} || ':' || CAST(k AS STRING) AS id, {_picks("k", "tx", "ct", "seattle", "sf", "la")} AS source,
       legal AS name, trade AS trade_name, k % 9 = 4 AS individual, st AS state_code, city, CASE WHEN k % 11 = 5 THEN '' ELSE street END AS address,
       zip5 AS zip, filed AS registered, naics_label AS industry, officer, {_picks("k", "Manager", "president", "")} AS officer_title,
       state, state <> 'new' AND k % 10 <> 3 AS has_lookup,
       CASE WHEN k % 6 = 0 THEN '' ELSE 'https://' || base2 || '.com' END AS website, CASE WHEN k % 6 = 0 THEN '' ELSE base2 || '.com' END AS domain,
       CASE WHEN k % 4 = 0 THEN NULL ELSE DATE '2018-03-01' + CAST((k * 53) % 2500 AS INT) END AS created,
       {_pick("k", "'info@' || base2 || '.com'", "'legal@' || base2 || '.com'", "''", "'pam.hr@' || base2 || '.com'", "'studio' || CAST(k AS STRING) || '@gmail.com'",
              "'linda.marlow@' || base2 || '.com'", "'sales@mail.' || base2 || '.com'", "'remove-me@' || base2 || '.com'", "'office@' || base2 || '.com'")} AS email,
       {_picks("k", "company website", "state registry", "company website (privacy or terms page only)")} AS email_from,
       {_pick("k", "area || exch || line", "area || '555' || line", "''", "area || '624' || line")} AS phone,
       {_picks("k", "company website", "city licence", "company website")} AS phone_from,
       area || {_picks("k", "624", "555", "100")} || line AS phone2,
       {_picks("k", "Linda Marlow", "JOBS PIPELINE", "Wei Hale", "", "ROBERT KELLER", "New York")} AS contact_name,
       {_picks("k", "CEO", "OWNER OF", "Happy customer", "Co-Founder & CTO", "president")} AS contact_title,
       {_picks("k", "company website", "state registry", "company website", "company website")} AS contact_from,
       CASE WHEN k % 7 = 1 THEN 'https://www.linkedin.com/in/p' || CAST(k AS STRING) ELSE '' END AS linkedin,
       CASE WHEN k % 3 = 1 THEN 'https://www.linkedin.com/company/' || base2 ELSE '' END AS linkedin_company,
       {_picks("k", "strong", "weak", "unknown", "none", "strong")} AS it_level,
       {_picks("k", "phone on the site matches the filing", "full legal name on the site", "site mentions the same city")} AS why,
       DATE '2024-03-01' + CAST((k * 7) % 61 AS INT) AS first_seen, CAST(k % 4 AS INT) AS attempts, CAST(k % 3 AS INT) AS strikes,
       CASE WHEN state IN ('new', 'held') OR k % 8 = 0 THEN DATE '2024-04-20' + CAST(k % 20 AS INT) END AS next_due,
       CASE WHEN state = 'pushed' THEN DATE '2024-04-15' + CAST(k % 15 AS INT) END AS pushed_at,
       CASE WHEN state IN ('ready', 'pushed') AND k % 10 <> 2 THEN DATE '2024-04-12' + CAST(k % 20 AS INT) END AS ready_at
FROM (SELECT r.*, replace(base, ' ', '') AS base2, {_picks("CAST(floor(k / 3) AS INT)", "held", "ready", "pushed", "dropped", "new", "ready", "held")} AS state FROM ({REG}) r) q
"""

# runs of the daily job, from the events of each day
RUNS = """
SELECT CAST(min(event_id) AS BIGINT) AS id, CAST(CAST(ts AS DATE) AS STRING) || 'T07:00:00' AS started, CAST(CAST(ts AS DATE) AS STRING) || 'T07:21:00' AS finished,
       CASE CAST(min(event_id) AS BIGINT) % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'partial' WHEN 2 THEN 'offline' ELSE 'ok' END AS status,
       CASE CAST(min(event_id) AS BIGINT) % 3 WHEN 0 THEN 'schedule' WHEN 1 THEN 'manual' ELSE 'connect' END AS trigger_kind,
       CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS BIGINT) AS added, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS pushed,
       CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS held
FROM events GROUP BY CAST(ts AS DATE)
"""

ATTEMPTS = "SELECT event_id, CAST(user_id AS STRING) AS k, ts FROM events"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def landed(spark: SparkSession, sf_dir: str, sql: str, **given: DataFrame) -> DataFrame:
    """One landed table, over the driver tables its text names; `given` stands for tables of that name."""
    marked = _TABLE_REF.sub(r"\1 {\2}", sql.replace("{", "{{").replace("}", "}}"))
    named = {m.group(2): given[m.group(2)] if m.group(2) in given else table(spark, sf_dir, m.group(2)) for m in _TABLE_REF.finditer(sql)}
    return spark.sql(marked, **named)
