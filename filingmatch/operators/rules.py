"""Rules: is a company listed, held or dropped; what today's checks refuse in a stored result."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.cells import site_age_years
from ..functions.core import let, no_strings, nonempty, strip, text
from ..functions.mail import local_part, not_a_contact
from ..functions.names import core_tokens
from ..functions.people import clean_title, is_lead, person_name
from ..functions.phones import usable_phone
from ..schemas import LOOKUP
from .choose import registry_contact


@dataclass(frozen=True)
class Rules:
    """What a company must show to be listed."""

    require: tuple[str, ...] = ("website", "email", "phone")
    require_it_signal: bool = True
    skip_established: bool = False
    contact_either: bool = False
    backfill_days: int = 45
    sources: dict[str, bool] = field(default_factory=lambda: {k: True for k in V.SOURCE_LABEL})


def has_usable_email(e: Column) -> Column:
    address = strip(text(e["email"]))
    return (address != "") & ~not_a_contact(local_part(address))


def has_usable_phone(e: Column) -> Column:
    return (usable_phone(e["phone"]) != "") & (text(e["phone_from"]) != V.CITY_LICENCE)


def qualify(raw: Column, e: Column, rules: Rules) -> Column:
    """struct(state, missing): ready, held or dropped, and what is missing or why it is dropped."""
    checks: list[Column] = []
    needs = [n for n in rules.require]
    if rules.contact_either and "email" in needs and "phone" in needs:
        needs = [n for n in needs if n not in ("email", "phone")]
        checks.append(F.when(~has_usable_email(e) & ~has_usable_phone(e), "email or phone"))
    tests = {"email": lambda: ~has_usable_email(e), "phone": lambda: ~has_usable_phone(e), "address": lambda: ~nonempty(raw["address"])}
    checks += [F.when(tests[n](), n) for n in needs if n in tests]
    missing = F.array_compact(F.array(*checks)) if checks else no_strings()
    unseen = e.isNull() | ~nonempty(e["website"])

    def verdict(state: str, *why: Column) -> Column:
        return F.struct(F.lit(state).alias("state"), (F.array(*why) if why else no_strings()).alias("missing"))

    out = F.when(F.coalesce(unseen, F.lit(True)), verdict("held", F.lit("website")))
    if rules.skip_established:
        age = site_age_years(e["created"], raw["registered"])
        since = F.concat(F.lit("established company (website since "), F.date_format(e["created"], "yyyy"), F.lit(")"))
        out = out.when(age >= V.ESTABLISHED_YEARS, verdict("dropped", since))
    if rules.require_it_signal:
        out = out.when(F.coalesce(e["it"]["level"], F.lit("none")) == "none", verdict("dropped", F.lit("no sign of IT work on the website")))
    return out.otherwise(let(missing, lambda m: F.struct(F.when(F.size(m) > 0, "held").otherwise("ready").alias("state"), m.alias("missing"))))


def clean_stored(raw: Column, e: Column) -> Column:
    """A stored result without what today's checks refuse: a placeholder phone gives way to the next stored number, a function
    mailbox is emptied, a contact who is no person gives way to the filing's officer. Applying it twice changes nothing."""
    no_mail = nonempty(e["email"]) & ~has_usable_email(e)
    c = e["contact"]
    filed = text(c["from"]) == V.IN_FILING
    read = F.struct(person_name(c["name"], registry=filed, company_tokens=core_tokens(raw["name"])).alias("name"), clean_title(c["title"]).alias("title"))

    def settled(p: Column) -> Column:
        good = p["name"].isNotNull() & (filed | ((p["title"] != "") & is_lead(p["title"])))
        same = F.struct(p["name"].alias("name"), p["title"].alias("title"), c["email"].alias("email"), c["linkedin"].alias("linkedin"), c["from"].alias("from"))
        return F.when(good, same).otherwise(registry_contact(raw["people"]))

    def numbers(ps: Column) -> Column:
        refused = nonempty(e["phone"]) & (usable_phone(e["phone"]) == "")
        first = F.coalesce(F.get(ps, F.lit(0)), F.lit(""))
        return F.struct(ps.alias("phones"), F.when(refused, first).otherwise(e["phone"]).alias("phone"),
                        F.when(refused & (first == ""), "").otherwise(e["phone_from"]).alias("phone_from"))

    kept = F.struct(let(F.filter(e["phones"], lambda p: usable_phone(p) != ""), numbers).alias("tel"), F.when(c.isNotNull(), let(read, settled)).alias("contact"))

    def whole(k: Column) -> Column:
        changed = {"phones": k["tel"]["phones"], "phone": k["tel"]["phone"], "phone_from": k["tel"]["phone_from"],
                   "email": F.when(no_mail, "").otherwise(e["email"]), "email_from": F.when(no_mail, "").otherwise(e["email_from"]), "contact": k["contact"],
                   "linkedin": F.when(c.isNotNull(), text(k["contact"]["linkedin"])).otherwise(e["linkedin"])}
        return F.struct(*[changed.get(f.name, e[f.name]).alias(f.name) for f in LOOKUP.fields])

    return F.when(e.isNotNull(), let(kept, whole))
