"""One run: all filings, new and known, matched to websites, contacts chosen, qualified, recorded in the next version of the state table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.cells import scrub
from ..functions.names import core_tokens
from ..functions.people import DEFAULT_LEXICON, Lexicon
from ..operators.lexicon import learned
from ..functions.links import plain_web_address
from ..operators import choose, classify, match, rules, sites, state
from ..operators import pages as P
from ..schemas import COMPANY, FILING, LOOKUP
from ..session import durable
from ..sources import crawl
from . import landed as L
from .companies import companies
from .section_a import all_filings


def lookups(filings: DataFrame, pages: DataFrame, domain_created: DataFrame, today: Column, lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """One row per filing: the filing columns and `enrich` in the stored schema, null when no website was found. A website that is
    no plain address counts as none."""
    pages = crawl.admitted(pages)
    homes = P.home_pages(pages)
    found = durable(match.matched(filings, pages, domain_created, homes))
    used = homes.join(found.select(F.col("domain").alias("host")).distinct(), "host", "left_semi")
    folded = sites.fold_sites(pages, used, lexicon).withColumnRenamed("site", "domain").drop("url", "pages")
    site = folded.withColumn("it", classify.classify(F.col("head"), F.col("body"))).drop("head", "body")
    pairs = (found.select("id", "domain", F.col("url").alias("site_url"), "why", "created").join(site, "domain")
             .join(filings.select("id", F.col("name").alias("_name"), "city", F.col("emails").alias("filed_emails"), "people"), "id"))
    people = choose.people_of_site(F.col("leaders"), core_tokens("_name"), F.col("page_emails"), F.col("linked"), F.col("domain"))
    linked = choose.with_linked(pairs, F.col("leaders"), core_tokens("_name"), F.col("profiles")).drop("profiles")
    picked = (linked.withColumn("mail", choose.pick_email(F.col("emails"), F.col("filed_emails"), F.col("domain"), F.col("city")))
              .withColumn("tel", choose.pick_phone(F.col("phones"), F.col("legal_only_phones")))
              .withColumn("contact", choose.pick_contact(people, F.col("people"), lexicon)))
    legal_mail = (F.col("mail.came_from") == "company website") & F.array_contains("legal_only_emails", F.col("mail.email"))
    root = F.regexp_extract("site_url", r"^(https?://[^/?#]+)", 1)
    values = {"checked": today, "website": F.when(plain_web_address(root), root).otherwise(""), "email": F.col("mail.email"),
              "email_from": F.when(legal_mail, "company website (privacy or terms page only)").otherwise(F.col("mail.came_from")),
              "emails": choose.more_emails(F.col("emails"), F.col("mail.email"), F.col("domain")), "phone": F.col("tel.phone"), "phone_from": F.col("tel.came_from"),
              "phones": F.col("tel.phones"), "linkedin": F.coalesce("contact.linkedin", F.lit("")), "linkedin_company": F.col("company_profile"),
              "missing": F.array().cast("array<string>"), "dropped_because": F.lit(None), "error": F.lit(None)}
    enrich = F.struct(*[values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in LOOKUP.fields])
    done = picked.select("id", enrich.alias("enrich"))
    clean = done.select("id", scrub(F.col("enrich"), done.schema["enrich"].dataType).alias("enrich"))
    return filings.join(clean, "id", "left")


def next_version(spark: SparkSession, sf_dir: str, conditions: rules.Rules | None = None, known: DataFrame | None = None) -> DataFrame:
    """The state table after one run over all filings. `known` is the whole table before it (an empty one on the first run): filings
    whose id it lacks are taken in, and every company of the table, whatever its state or attempts, is looked up and judged again by
    the filing landed now (the stored one where none landed). One company owns a domain: a listed one that still qualifies with the
    domain it had keeps it, then the first seen gets it. A sent company that still qualifies stays sent."""
    conditions, today = conditions or rules.Rules(), F.lit(L.TODAY).cast("date")
    known, filings = spark.createDataFrame([], COMPANY) if known is None else known, durable(all_filings(spark, sf_dir))
    filed = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FILING.fields])
    blank = {f.name: F.lit(None).cast(f.dataType) for f in COMPANY.fields if f.name in ("enrich", "domain", "pushed_hash", "pushed_at", "ready_at")}
    raw = F.struct(*[F.col(f"raw.{f.name}").cast(f.dataType).alias(f.name) for f in FILING.fields])
    fresh = state.intake(filings, known, today).withColumn("raw", raw).withColumns(blank)
    seen = known.join(filings.select("id", filed.alias("_filed")), "id", "left").withColumn("raw", F.coalesce("_filed", "raw")).drop("_filed")
    table = durable(seen.unionByName(fresh))
    officers = filings.select(F.explode("people").alias("p")).select("p.name")
    lexicon = learned(officers, filings.select("name").unionByName(filings.select(F.col("trade_name").alias("name"))))
    facts = table.select("id", *[F.col(f"raw.{f.name}").alias(f.name) for f in FILING.fields if f.name != "id"])
    looked = lookups(facts, L.landed(spark, sf_dir, L.SITE_PAGES), L.landed(spark, sf_dir, L.DOMAIN_CREATED), today, lexicon)
    rows = table.join(looked.select("id", F.col("enrich").alias("new_enrich")), "id").withColumn("q", rules.qualify(F.col("raw"), F.col("new_enrich"), conditions))
    why = F.when(F.col("q.state") == "dropped", F.col("q.missing"))
    told = F.when(F.col("new_enrich").isNotNull(), F.col("new_enrich").withField("missing", F.col("q.missing")).withField("dropped_because", why))
    good = F.col("q.state") == "ready"
    keeps = F.coalesce(F.col("state").isin(V.LISTED) & good & (F.col("domain") == F.col("new_enrich.domain")), F.lit(False))
    judged = durable(rows.withColumn("new_state", F.when(good & (F.col("state") == "pushed"), "pushed").otherwise(F.col("q.state")))
                     .withColumn("_other", ~keeps).withColumn("new_enrich", told).drop("q"))
    owners = judged.where(~F.col("_other")).groupBy("domain").agg(F.min_by("id", F.struct("first_seen", "id")).alias("id"))
    owned = state.owned_once(judged, owners, ["_other", "first_seen", "id"])
    return state.recorded(owned, today).select(*[f.name for f in COMPANY.fields])


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All companies of the next version by state and by what is missing."""
    version = next_version(spark, sf_dir, known=companies(spark, sf_dir))
    return (version.groupBy("state", F.coalesce(F.array_join("enrich.missing", ", "), F.lit("website")).alias("missing"))
            .agg(F.count(F.lit(1)).alias("n"), F.count("enrich").alias("with_website")))
