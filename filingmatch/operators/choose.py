"""The best address, number and person of a matched site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.core import among, let, no_strings, text
from ..functions.mail import email_kind, local_part, mail_domain, not_a_contact, same_site
from ..functions.names import flat
from ..functions.people import DEFAULT_LEXICON, Lexicon, clean_title, is_lead, person_name
from ..functions.phones import usable_phone
from .profiles import with_profiles

_LEADERS = "array<struct<name:string,title:string,email:string,linkedin:string>>"


def pick_email(site_emails: Column, filing_emails: Column, domain: Column, city: Column) -> Column:
    """struct(email, came_from): the site's own mailbox, then the filing's when it is the site's, then a free mailbox the site
    shows; front-door mailboxes first, then the filing's city, then page order."""
    town = flat(city)

    def door(local: Column) -> Column:
        place = F.array_position(F.array(*[F.lit(x) for x in V.FRONT_DOOR]), local).cast("int")
        return F.when(place > 0, place - 1).when((town != "") & (local == town), len(V.FRONT_DOOR)).otherwise(len(V.FRONT_DOOR) + 1)

    def on_site(e: Column, i: Column) -> Column:
        local, own = local_part(e), same_site(mail_domain(e), domain)
        group = F.when(own, 0).when(email_kind(e) == "free", 2)
        return F.when(~not_a_contact(local) & group.isNotNull(), F.struct(
            group.alias("a"), F.when(own, door(local)).otherwise(1).alias("b"), i.alias("i"), e.alias("email"), F.lit(V.ON_SITE).alias("came_from")))

    def in_filing(e: Column, i: Column) -> Column:
        fits = (email_kind(e) == "own") & same_site(mail_domain(e), domain) & ~not_a_contact(local_part(e))
        return F.when(fits, F.struct(F.lit(1).alias("a"), F.lit(1).alias("b"), i.alias("i"), e.alias("email"), F.lit(V.IN_FILING).alias("came_from")))

    best = F.array_min(F.array_compact(F.concat(F.transform(site_emails, on_site), F.transform(filing_emails, in_filing))))
    return let(best, lambda x: F.struct(F.coalesce(x["email"], F.lit("")).alias("email"), F.coalesce(x["came_from"], F.lit("")).alias("came_from")))


def more_emails(site_emails: Column, chosen: Column, domain: Column) -> Column:
    """Up to three other mailboxes of the site that are no function mailboxes."""
    return F.slice(F.filter(site_emails, lambda e: (e != chosen) & same_site(mail_domain(e), domain) & ~not_a_contact(local_part(e))), 1, 3)


def pick_phone(phones: Column, legal_only: Column) -> Column:
    """struct(phone, came_from, phones): the first usable number; a long list is a directory and gives none."""
    usable = F.filter(phones, lambda p: usable_phone(p) != "")
    short = F.when(F.size(usable) <= 5, usable).otherwise(no_strings())

    def pick(p: Column) -> Column:
        first = F.get(p, F.lit(0))
        came = F.when(first.isNull(), "").when(F.array_contains(legal_only, first), V.LEGAL_ONLY).otherwise(V.ON_SITE)
        return F.struct(F.coalesce(first, F.lit("")).alias("phone"), came.alias("came_from"), F.slice(p, 1, 4).alias("phones"))

    return let(short, pick)


def own_people(leaders: Column, company_tokens: Column) -> Column:
    """Leaders whose name is not just words of the company's own name."""

    def is_company(p: Column) -> Column:
        words = F.transform(F.split(F.lower(p["name"]), " "), lambda w: F.trim(w, F.lit(".")))
        said = F.filter(words, lambda w: ~among(w, V.LEGAL_SUFFIX))
        return (F.size(company_tokens) > 0) & (F.size(F.array_except(said, company_tokens)) == 0)

    return F.filter(leaders, lambda p: ~is_company(p))


def person_email(name: Column, emails: Column, domain: Column) -> Column:
    """The first mailbox of the site that is made of the person's names."""
    words = F.split(F.lower(name), " ")
    first, last = F.get(words, F.lit(0)), F.element_at(words, -1)
    initial = F.substring(first, 1, 1)
    forms = F.array(first, F.concat(first, F.lit("."), last), F.concat(first, last), F.concat(initial, last), F.concat(first, F.lit("_"), last),
                    F.concat(initial, F.lit("."), last))
    hits = F.filter(emails, lambda e: same_site(mail_domain(e), domain) & F.array_contains(forms, local_part(e)))
    return F.coalesce(F.get(hits, F.lit(0)), F.lit(""))


def rank_people(people: Column) -> Column:
    """Chief executives, then founders, then the others, four at most; order kept otherwise."""

    def place(p: Column) -> Column:
        t = F.lower(p["title"])
        return F.when(t.rlike("ceo|chief executive"), 0).when(F.contains(t, F.lit("founder")), 1).otherwise(2)

    keyed = F.transform(people, lambda p, i: F.struct(place(p).alias("place"), i.alias("i"), p.alias("p")))
    return F.slice(F.transform(F.array_sort(keyed), lambda x: x["p"]), 1, 4)


def with_linked(rows: DataFrame, leaders: Column, company_tokens: Column, profiles: Column) -> DataFrame:
    """`rows` with `linked`: the profiles of a site's people in the order of `own_people`. `profiles`: the site's pages that link profiles."""
    return with_profiles(rows, F.transform(own_people(leaders, company_tokens), lambda p: p["name"]), profiles)


def people_of_site(leaders: Column, company_tokens: Column, page_emails: Column, linked: Column, domain: Column) -> Column:
    """The ranked people of a site for one filing: array of (name, title, email, linkedin). `linked`: what `with_linked` adds."""

    def dressed(people: Column) -> Column:
        return rank_people(F.transform(people, lambda p, i: F.struct(
            p["name"].alias("name"), p["title"].alias("title"),
            F.when(p["email"] != "", p["email"]).otherwise(person_email(p["name"], page_emails, domain)).alias("email"),
            F.coalesce(F.get(linked, i), F.lit("")).alias("linkedin"))))

    return F.coalesce(let(own_people(leaders, company_tokens), dressed), F.array().cast(_LEADERS))


def registry_contact(people: Column, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """The first person a filing names whose name is a person's, as a contact; null when there is none."""
    named = F.transform(people, lambda p: F.struct(person_name(p["name"], registry=True, lexicon=lexicon).alias("name"), clean_title(p["title"]).alias("title")))
    first = F.get(F.filter(named, lambda p: p["name"].isNotNull()), F.lit(0))
    return let(first, lambda p: F.when(p.isNotNull(), F.struct(
        p["name"].alias("name"), p["title"].alias("title"), F.lit("").alias("email"), F.lit("").alias("linkedin"), F.lit(V.IN_FILING).alias("from"))))


def pick_contact(site_people: Column, filing_people: Column, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """The first leader of the site, else the first officer of the filing; null when neither names a person."""
    leader = F.get(F.filter(site_people, lambda p: is_lead(p["title"])), F.lit(0))
    chosen = F.when(leader.isNotNull(), F.struct(
        leader["name"].alias("name"), leader["title"].alias("title"), text(leader["email"]).alias("email"),
        text(leader["linkedin"]).alias("linkedin"), F.lit(V.ON_SITE).alias("from")))
    return F.coalesce(chosen, registry_contact(filing_people, lexicon))
