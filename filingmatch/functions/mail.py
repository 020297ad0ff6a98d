"""Email addresses and host names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V
from .core import among, col, let, strip, strings, text


def local_part(e: Column | str) -> Column:
    return F.split_part(text(e), F.lit("@"), F.lit(1))


def mail_domain(e: Column | str) -> Column:
    return F.split_part(text(e), F.lit("@"), F.lit(2))


def _agent(domain: Column) -> Column:
    owned = "|".join(re.escape(d) for d in V.AGENT_DOMAINS)
    out = domain.rlike(rf"(^|\.)({owned})$")
    for part in V.AGENT_FRAGMENTS:
        out = out | F.contains(domain, F.lit(part))
    return out


def email_kind(c: Column | str) -> Column:
    """own | free | agent | none"""

    def kind(e: Column) -> Column:
        domain = F.split_part(e, F.lit("@"), F.lit(2))
        return (F.when(~F.contains(e, F.lit("@")), "none").when(among(domain, V.FREE_MAIL), "free")
                .when(_agent(domain), "agent").otherwise("own"))

    return let(F.lower(strip(text(c))), kind)


def valid_email(c: Column | str) -> Column:
    e = text(c)
    return (F.length(e) <= V.EMAIL_MAX) & e.rlike(V.EMAIL_STRICT)


def email_reject_reason(c: Column | str) -> Column:
    """Why an address is not taken from a page ('' when it is)."""
    e = text(c)
    return (F.when(~valid_email(e), "not an address").when(e.rlike(V.BAD_EMAIL), "placeholder or robot").otherwise(""))


def not_a_contact(local: Column | str) -> Column:
    """True when a mailbox belongs to a function (law, press, hiring, removal ...)."""
    return let(F.lower(strip(text(local))), lambda s: s.rlike(V.FUNCTION_MAILBOX)
               | F.arrays_overlap(F.split(s, r"[._+\-]"), strings(V.FUNCTION_MAILBOX_WORDS)))


def email_key(c: Column | str) -> Column:
    """A short fixed-size stand-in for an address."""
    return F.substring(F.sha2(F.substring(F.lower(strip(text(c))), 1, V.EMAIL_MAX), 256), 1, 16)


def site_root(c: Column | str) -> Column:
    """The registered name of a host: mail.acme.io -> acme.io, www.acme.co.uk -> acme.co.uk."""

    def root(labels: Column) -> Column:
        n = F.size(labels)
        two = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), ".")
        three = F.array_join(F.slice(labels, F.greatest(n - 2, F.lit(1)), 3), ".")
        return F.when((n >= 3) & among(two, V.PUBLIC_SUFFIX_2), three).otherwise(two)

    return let(F.split(F.regexp_replace(F.lower(text(c)), r"^\.+|\.+$", ""), r"\."), root)


def same_site(host: Column | str, site: Column | str) -> Column:
    """True when `host` is the registered name of `site` or lies under it (never a look-alike)."""
    h = F.regexp_replace(F.lower(text(host)), r"^\.+|\.+$", "")
    return let(site_root(site), lambda r: (r != "") & ((h == r) | F.endswith(h, F.concat(F.lit("."), r))))


def bare_host(c: Column | str) -> Column:
    """Host of a URL, lower case, without a leading www."""
    return F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(col(c), F.lit("HOST")), F.lit(""))), r"^www\.", "")


def xor_decode(c: Column | str) -> Column:
    """An address hidden as hex text: the first byte is the key, the others are XORed with it. '' when it is no hex."""
    h = text(c)
    whole = h.rlike(r"^[0-9A-Fa-f]{2}([0-9A-Fa-f]{2})*$")

    def byte(i: Column) -> Column:
        return F.conv(h.substr(i, F.lit(2)), 16, 10).cast("int")

    places = F.when(whole & (F.length(h) >= 4), F.sequence(F.lit(3), F.length(h) - 1, F.lit(2))).otherwise(
        F.array().cast("array<int>"))
    chars = F.transform(places, lambda i: F.decode(F.unhex(F.lpad(F.hex(byte(i).bitwiseXOR(byte(F.lit(1)))), 8, "0")), "UTF-32"))
    return F.array_join(chars, "")
