"""Filings matched to websites: candidate domains joined to hosts, pages scored for evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import fixed_values as V
from ..functions import markup as M
from ..functions.core import first_items, text
from ..functions.mail import email_kind, mail_domain
from ..functions.names import core, core_tokens, flat, name_parts, slugs
from ..functions.phones import norm_phone
from ..functions.places import mentions_word, street_pattern
from ..session import durable
from ..sources.crawl import located
from .pages import home_pages, page_texts
from .skew import salted_join, spread


def candidate_domains(name: Column, trade: Column, emails: Column, tlds: list[str] | None = None) -> Column:
    """Ordered distinct (domain, hinted): the domains of the filing's own mailboxes, then every label under every ending."""
    endings = F.array(*[F.lit(t) for t in (tlds or V.TLDS)])

    def spelled(s: Column) -> Column:
        ai = F.when(s.endswith("ai") & (F.length(s) >= 6) & ~F.contains(s, F.lit("-")),
                    F.array(F.concat(F.substring(s, 1, F.length(s) - 2), F.lit(".ai"))))
        return F.concat(F.transform(endings, lambda t: F.concat(s, F.lit("."), t)), F.coalesce(ai, F.array().cast("array<string>")))

    hinted = F.array_distinct(F.filter(F.transform(F.filter(emails, lambda e: email_kind(e) == "own"), lambda e: F.lower(mail_domain(e))), lambda d: d != ""))
    parts = F.concat(name_parts(name), name_parts(trade))
    guessed = F.array_distinct(F.flatten(F.transform(F.flatten(F.transform(parts, slugs)), spelled)))
    return F.concat(F.transform(hinted, lambda d: F.struct(d.alias("domain"), F.lit(True).alias("hinted"))),
                    F.transform(F.array_except(guessed, hinted), lambda d: F.struct(d.alias("domain"), F.lit(False).alias("hinted"))))


def candidates(filings: DataFrame, tlds: list[str] | None = None) -> DataFrame:
    """(id, pos, domain, hinted) in order."""
    doms = candidate_domains(text("name"), text("trade_name"), F.col("emails"), tlds)
    named = spread(filings.select("id", "name", "trade_name", "emails"))
    return named.select("id", F.posexplode(doms).alias("pos", "c")).select("id", "pos", "c.domain", "c.hinted")


def _label_rows(name: Column, trade: Column, emails: Column) -> Column:
    """Ordered (label, ending, hinted): what a candidate domain is before its ending. A null ending stands for every ending
    of the list, so a filing sends a dozen rows to the join instead of a dozen times the endings."""
    label = lambda d: F.regexp_replace(d, r"\.[^.]*$", "")                                      # noqa: E731
    ending = lambda d: F.regexp_extract(d, r"\.([^.]*)$", 1)                                    # noqa: E731
    any_ending = F.lit(None).cast("string")

    def row(lab: Column, end: Column, hinted: bool) -> Column:
        return F.struct(lab.alias("label"), end.alias("ending"), F.lit(hinted).alias("hinted"))

    def spelled(s: Column) -> Column:
        ai = s.endswith("ai") & (F.length(s) >= 6) & ~F.contains(s, F.lit("-"))
        both = F.array(row(s, any_ending, False), row(F.substring(s, 1, F.length(s) - 2), F.lit("ai"), False))
        return F.when(ai, both).otherwise(F.array(row(s, any_ending, False)))

    hinted = F.filter(F.transform(F.filter(emails, lambda e: email_kind(e) == "own"), lambda e: F.lower(mail_domain(e))), lambda d: d != "")
    parts = F.concat(name_parts(name), name_parts(trade))
    return F.concat(F.transform(hinted, lambda d: row(label(d), ending(d), True)),
                    F.flatten(F.transform(F.flatten(F.transform(parts, slugs)), spelled)))


def live_candidates(filings: DataFrame, hosts: DataFrame, tlds: list[str] | None = None, max_checks: int | None = None) -> DataFrame:
    """(id, pos, domain, hinted): the candidate domains of each filing that are hosts of the crawl, in order (the first `max_checks`
    where that is given).

    Joins on the label before the ending. Only narrow rows move: `hosts` is one short row per host, and what is gathered per
    filing is its own few candidates.
    """
    endings = F.array(*[F.lit(t) for t in (tlds or V.TLDS)])
    named = spread(filings.select("id", "name", "trade_name", "emails"))
    rows = (named.select("id", F.posexplode(_label_rows(text("name"), text("trade_name"), F.col("emails"))).alias("base", "c"))
            .select("id", "base", "c.label", "c.ending", "c.hinted"))
    names = hosts.select(F.regexp_replace("host", r"\.[^.]*$", "").alias("label"), F.regexp_extract("host", r"\.([^.]*)$", 1).alias("host_ending"),
                         F.col("host").alias("domain"))
    place = F.array_position(endings, F.col("host_ending")).cast("int")
    hits = (salted_join(rows, names, "label", "id").withColumn("place", F.when(F.col("ending").isNull(), place).otherwise(0))
            .where(F.when(F.col("ending").isNull(), F.col("place") > 0).otherwise(F.col("ending") == F.col("host_ending"))))
    listed = hits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("base", "place", "domain", "hinted"))).alias("all"))
    domains = F.transform("all", lambda x: x["domain"])
    first = F.filter("all", lambda x, i: F.array_position(domains, x["domain"]) == i + 1)
    return (listed.select("id", F.posexplode(first_items(first, max_checks)).alias("pos", "c")).select("id", "pos", "c.domain", "c.hinted"))


def parked(head: Column, body: Column) -> Column:
    """A parking page: parking words up front and little text."""
    return F.concat(head, F.lit(" "), F.substring(body, 1, 700)).rlike(V.PARKED) & (F.length(body) < 1500)


def home_facts(pages: DataFrame, homes: DataFrame) -> DataFrame:
    """What matching reads of a home page, once per host; parked pages are gone."""
    texts = page_texts(pages.join(homes.select("page_id"), "page_id", "left_semi"))
    return (texts.where(~parked(F.col("head"), F.col("body")))
            .select("host", "url", "head", F.lower("body").alias("low"), flat("head").alias("head_flat"), flat("body").alias("body_flat"),
                    M.phones(F.col("links"), F.col("body")).alias("site_phones"), flat(F.split_part("host", F.lit("."), F.lit(1))).alias("label")))


def filing_keys(filings: DataFrame) -> DataFrame:
    """What matching reads of a filing, worked out once per filing."""
    asked = spread(filings.select("id", "name", "trade_name", "city", "zip", "phone", "individual", "address", "registered"))
    return asked.select(
        "id", F.filter(F.array_distinct(F.array(core("name"), core("trade_name"))), lambda c: F.length(c) >= 3).alias("cores"),
        flat("name").alias("legal"), F.size(core_tokens("name")).alias("words"), F.lower(text("city")).alias("town"), text("zip").alias("zip"),
        norm_phone("phone").alias("line"), F.when(~F.coalesce("individual", F.lit(False)), street_pattern("address")).alias("street"), "registered")


def passes_name_gate(cores: Column, head_flat: Column, body_flat: Column, label: Column) -> Column:
    """The company's name is in the head, the text or the domain."""
    return F.exists(cores, lambda c: F.contains(head_flat, c) | F.contains(body_flat, c) | _in_domain(c, label))


def _in_domain(c: Column, label: Column) -> Column:
    return F.contains(label, c) | ((F.length(label) >= 4) & F.contains(c, label))


def age_note(delta: Column) -> Column:
    side = F.when(delta <= 0, "before").otherwise("after")
    return F.concat(F.lit("domain registered "), F.abs(delta).cast("string"), F.lit(" days "), side, F.lit(" the filing"))


def _street_on(low: Column, pattern: Column) -> Column:
    return F.coalesce(F.regexp_like(low, pattern), F.lit(False))


def scored(pairs: DataFrame) -> DataFrame:
    """Evidence of joined (candidate, filing, home page, domain date) rows that pass the name gate: `specific`, the age note
    and the signs the weak rule needs."""
    delta = F.datediff("created", "registered")
    near = delta.between(-300, 60)
    exact = F.array_contains("cores", F.col("label"))
    sure = (F.abs(delta) <= 21) | (exact & delta.between(-90, 30))
    city_hit = mentions_word(F.col("low"), F.col("town"))
    gated = pairs.where(passes_name_gate(F.col("cores"), F.col("head_flat"), F.col("body_flat"), F.col("label")))
    out = gated.withColumn("city_hit", city_hit).withColumn("delta", F.when(near, delta)).withColumn("exact", exact)
    specific = F.array_compact(F.array(
        F.when((F.col("line") != "") & F.array_contains("site_phones", F.col("line")), V.WHY_PHONE),
        F.when(_street_on(F.col("low"), F.col("street")), V.WHY_STREET),
        F.when((F.length("legal") >= 6) & F.contains("body_flat", F.col("legal")) & ((F.col("words") >= 2) | F.col("city_hit")), V.WHY_NAME),
        F.when(F.col("hinted"), V.WHY_EMAIL),
        F.when(F.col("delta").isNotNull() & sure, age_note(F.col("delta")))))
    return (out.withColumn("specific", specific).withColumn("note", F.when(F.col("delta").isNotNull() & ~sure, age_note(F.col("delta"))))
            .withColumn("in_head", F.exists("cores", lambda c: F.contains(F.col("head_flat"), c)))
            .withColumn("in_domain", F.exists("cores", lambda c: _in_domain(c, F.col("label")))))


def fine_print(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(domain, fine): the lower-case text of a host's terms, privacy and contact pages (one page per
    path). The pages are dealt by host once, and both groupings use that."""
    place = F.array_position(F.array(*[F.lit(p) for p in V.FINE_PRINT_PATHS]), F.regexp_replace("path", "/+$", "")).cast("int")
    fine = located(pages).withColumn("place", place).where("place > 0").select("page_id", "url", "html", "host", "place")
    wanted = fine.join(hosts.withColumnRenamed("domain", "host"), "host", "left_semi")
    first = wanted.groupBy("host", "place").agg(F.min_by(F.struct("page_id", "url", "html"), "page_id").alias("p"))
    texts = page_texts(first.select("host", "place", "p.*")).select("host", "place", "body")
    ordered = F.array_sort(F.collect_list(F.struct("place", "body")))
    return texts.groupBy(F.col("host").alias("domain")).agg(F.lower(F.array_join(F.transform(ordered, lambda p: p["body"]), " ")).alias("fine"))


def fine_evidence(rows: DataFrame) -> DataFrame:
    """Adds `specific` found in the fine print to rows that have none yet."""
    street = F.col("fine").isNotNull() & _street_on(F.col("fine"), F.col("street"))
    zip5 = F.substring("zip", 1, 5)
    where = mentions_word(F.col("fine"), F.col("town")) | (zip5.rlike(r"^\d+$") & F.contains("fine", zip5))
    name = F.col("fine").isNotNull() & (F.length("legal") >= 6) & F.contains(flat("fine"), F.col("legal")) & where
    found = F.when(street, F.array(F.lit(V.WHY_FINE_STREET))).when(name, F.array(F.lit(V.WHY_FINE_NAME))).otherwise(F.col("specific"))
    return rows.withColumn("specific", found)


def accepted(rows: DataFrame) -> DataFrame:
    """Rows with enough evidence, and `why`: something specific, or an age note and the city, or the exact name in head and
    domain and the city."""
    has = F.size("specific") > 0
    noted = F.col("note").isNotNull()
    none = F.array().cast("array<string>")
    weak = (F.when(noted & F.col("city_hit"), F.array(F.col("note"), F.lit(V.WHY_CITY)))
            .when(F.col("in_head") & F.col("in_domain") & F.col("city_hit") & F.col("exact"), F.array(F.lit(V.WHY_EXACT))))
    why = F.when(has, F.concat("specific", F.when(noted, F.array("note")).otherwise(none))).otherwise(weak)
    return rows.withColumn("why", why).where(F.col("why").isNotNull())


def evidence(filings: DataFrame, pages: DataFrame, domain_created: DataFrame, homes: DataFrame | None = None,
             tlds: list[str] | None = None) -> DataFrame:
    """All accepted (filing, domain) pairs with their evidence. Phase one scores home pages; phase two reads the fine print
    only of the hosts whose pairs have nothing specific. Filing keys join the candidates before any text does, so a page's text
    crosses one exchange, whatever the number of filings that want it. The narrow results of both steps are written once, so no page
    is parsed twice and a lost executor costs one step."""
    homes = home_pages(pages) if homes is None else homes
    live = durable(live_candidates(filings, homes, tlds))
    wanted = homes.join(live.select(F.col("domain").alias("host")).distinct(), "host", "left_semi")
    facts = home_facts(pages, wanted).withColumnRenamed("host", "domain")
    dated = facts.join(domain_created.select(F.col("host").alias("domain"), "created"), "domain", "left")
    keyed = durable(live.join(filing_keys(filings), "id"))
    rows = durable(scored(salted_join(keyed, dated, "domain", "id")).drop("low", "head_flat", "body_flat", "site_phones"))
    open_rows = rows.where(F.size("specific") == 0)
    fine = fine_print(pages, open_rows.select("domain").distinct())
    settled = rows.where(F.size("specific") > 0).withColumn("fine", F.lit(None).cast("string"))
    return accepted(settled.unionByName(fine_evidence(salted_join(open_rows, fine, "domain", "id", how="left"))))


def matched(filings: DataFrame, pages: DataFrame, domain_created: DataFrame, homes: DataFrame | None = None, tlds: list[str] | None = None) -> DataFrame:
    """The first accepted domain of every filing."""
    w = Window.partitionBy("id").orderBy("pos")
    found = evidence(filings, pages, domain_created, homes, tlds)
    return (found.withColumn("_r", F.row_number().over(w)).where("_r = 1")
            .select("id", "domain", "url", "why", "created", "head", "city_hit"))
