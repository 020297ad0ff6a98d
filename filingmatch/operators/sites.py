"""Pages folded into one row per site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import fixed_values as V
from ..functions.core import among, let, no_strings
from ..functions.links import page_key
from ..functions.mail import local_part, mail_domain, same_site
from ..functions.people import DEFAULT_LEXICON, Lexicon, is_lead
from ..session import durable, evaluated
from .pages import home_pages, legal_targets, page_facts, page_index, page_texts, role_targets, stays_on_site


def site_pages(pages: DataFrame, homes: DataFrame) -> DataFrame:
    """(site, rank, page_id): the home page of every site (rank 0), up to six role pages (1..6), up to two legal pages (7, 8).

    Only home pages are parsed here; the others are found by joining wanted addresses to the address index, so no page text
    moves. A page that a redirect took to another company's site is none of this site's. A page reached by two ranks keeps the first.
    """
    front = page_texts(pages.join(homes.select("page_id", F.col("host").alias("site")), "page_id", "left_semi"))
    plan = (front.select("page_id", "url", F.col("host").alias("site"), "links")
            .withColumn("roles", role_targets(F.col("url"), F.col("site"), F.col("links")))
            .withColumn("legal", legal_targets(F.col("url"), F.col("site"), F.col("links"), F.concat(F.array(page_key("url")), F.col("roles")))))
    wanted = plan.select("site", F.explode(F.concat(
        F.transform("roles", lambda u, i: F.struct((i + 1).alias("rank"), u.alias("url_key"))),
        F.transform("legal", lambda u, i: F.struct((i + 7).alias("rank"), u.alias("url_key"))))).alias("w")).select("site", "w.*")
    found = wanted.join(page_index(pages), "url_key").where(stays_on_site(F.col("page_host"), F.col("site"))).select("site", "rank", "page_id")
    chosen = homes.select(F.col("host").alias("site"), F.lit(0).alias("rank"), "page_id").unionByName(found)
    w = Window.partitionBy("site", "page_id").orderBy("rank")
    return chosen.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def fold_phones(pages: Column) -> Column:
    """Numbers of a site in order: data-node numbers go to the front as they turn up, text numbers to the back."""
    start = no_strings()

    def add(seen: Column, p: Column) -> Column:
        front = F.concat(F.reverse(F.array_except(p["ld_phones"], seen)), seen)
        return F.concat(front, F.array_except(p["phones"], front))

    return F.aggregate(pages, start, add)


def order_emails(emails: Column, site: Column) -> Column:
    """The site's own addresses first (front-door mailboxes before others), then everybody else's; order kept otherwise."""
    own = F.filter(emails, lambda e: same_site(mail_domain(e), site))
    front = F.filter(own, lambda e: among(local_part(e), V.FRONT_DOOR))
    return F.concat(front, F.array_except(own, front), F.array_except(emails, own))


def order_phones(phones: Column, real: Column) -> Column:
    """Numbers shown only on legal pages come last; six are kept."""
    return F.slice(F.concat(F.filter(phones, lambda p: F.array_contains(real, p)), F.filter(phones, lambda p: ~F.array_contains(real, p))), 1, 6)


def leaders(people: Column) -> Column:
    """The plain leaders among the people of a site, once per name, order kept."""

    def plain(p: Column) -> Column:
        organisation = F.exists(F.split(F.lower(p["name"]), " "), lambda w: among(F.trim(w, F.lit(".")), V.ORGWORDS))
        elsewhere = p["title"].rlike(V.SOMEONE_ELSES) & ~p["title"].rlike("&|and|/")
        return ~organisation & is_lead(p["title"]) & ~elsewhere

    def once(kept: Column) -> Column:
        names = F.transform(kept, lambda p: F.lower(p["name"]))
        return F.filter(kept, lambda p, i: F.array_position(names, F.lower(p["name"])) == i + 1)

    return let(F.filter(people, plain), once)


def fold_sites(pages: DataFrame, homes: DataFrame | None = None, lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """One row per site: head, body, emails, phones (each with the values only legal pages show), leaders, pages with profile links, company
    profile, page count. At most nine pages per site reach the fold, so no host is ever one large group."""
    homes = home_pages(pages) if homes is None else homes
    chosen = durable(site_pages(pages, homes))
    facts = page_facts(pages.join(chosen.select("page_id").distinct(), "page_id", "left_semi"), lexicon)
    placed = facts.join(chosen, "page_id")
    page = F.struct("rank", "page_id", "url", "is_legal", "head", "body", "emails", "phones", "ld_emails", "ld_phones", "company_profile", "people",
                    F.when(~F.col("is_legal") & (F.size("profiles.links") > 0), F.col("profiles")).alias("profiles"))
    site = placed.groupBy("site").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    real = F.filter("pages", lambda p: ~p["is_legal"])
    emails = F.array_distinct(F.flatten(F.transform("pages", lambda p: F.concat(p["ld_emails"], p["emails"]))))
    real_mail = F.flatten(F.transform(real, lambda p: F.concat(p["ld_emails"], p["emails"])))
    real_phones = F.flatten(F.transform(real, lambda p: F.concat(p["ld_phones"], p["phones"])))
    company = F.filter(F.transform("pages", lambda p: p["company_profile"]), lambda u: u != "")
    gathered = evaluated(site.withColumns({"_real_phones": real_phones, "_real_mail": real_mail, "page_emails": emails}))
    folded = evaluated(gathered.withColumn("phones", order_phones(fold_phones(F.col("pages")), F.col("_real_phones")))
              .withColumn("emails", order_emails(F.col("page_emails"), F.col("site"))))
    return folded.select(
        "site", F.get(F.col("pages"), F.lit(0))["head"].alias("head"), F.get(F.col("pages"), F.lit(0))["url"].alias("url"),
        F.array_join(F.transform("pages", lambda p: p["body"]), "\n").alias("body"),
        "page_emails", "emails", F.filter("emails", lambda e: ~F.array_contains(F.col("_real_mail"), e)).alias("legal_only_emails"),
        "phones", F.filter("phones", lambda p: ~F.array_contains(F.col("_real_phones"), p)).alias("legal_only_phones"),
        F.array_compact(F.transform("pages", lambda p: p["profiles"])).alias("profiles"),
        F.coalesce(F.get(company, F.lit(0)), F.lit("")).alias("company_profile"), F.size("pages").alias("pages"),
        leaders(F.flatten(F.transform(F.filter("pages", lambda p: p["people"].isNotNull()), lambda p: p["people"]))).alias("leaders"))
