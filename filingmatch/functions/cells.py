"""Values as they are stored and published: safe text, dates, labels, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as V
from .core import blank_to_null, let, nonempty, strip, text
from .mail import mail_domain, same_site


def clean_text(c: Column | str, limit: int = 600) -> Column:
    """Page text made safe to store: no control characters, stripped, cut to `limit`."""
    return F.substring(strip(F.regexp_replace(text(c), V.ILLEGAL_CHARS, "")), 1, limit)


def scrub(c: Column, kind: T.DataType, limit: int = 600) -> Column:
    """`clean_text` over every string inside a nested value (map keys are cut to 80)."""
    if isinstance(kind, T.StringType):
        return clean_text(c, limit)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: scrub(x, kind.elementType, limit))
    if isinstance(kind, T.MapType):
        keyed = F.transform_keys(c, lambda k, v: clean_text(k, 80)) if isinstance(kind.keyType, T.StringType) else c
        return F.transform_values(keyed, lambda k, v: scrub(v, kind.valueType, limit))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[scrub(c[f.name], f.dataType, limit).alias(f.name) for f in kind.fields]))
    return c


def iso_day(c: Column | str) -> Column:
    """The first ten characters when they are shaped like a date, else ''."""
    return F.regexp_extract(text(c), r"^(\d{4}-\d{2}-\d{2})", 1)


def day(c: Column | str) -> Column:
    """`iso_day` as a date, null when it is none."""
    return F.try_to_date(iso_day(c), "yyyy-MM-dd")


def site_age_years(created: Column, filed: Column) -> Column:
    return F.datediff(filed, created) / F.lit(365.25)


def csv_safe(c: Column | str) -> Column:
    """A value no spreadsheet program will run as a formula."""
    return let(F.regexp_replace(text(c), V.ILLEGAL_CHARS, ""),
               lambda v: F.when(v.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), v)).otherwise(v))


def row_hash(*names: str) -> Column:
    """SHA-1 over the named columns in name order."""
    return F.sha1(F.to_json(F.struct(*[F.col(n) for n in sorted(names)])))


def lookup(labels: dict[str, str], key: Column, default: Column | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit("") if default is None else default)


def fit_label(level: Column, created: Column, filed: Column) -> Column:
    """How sure the topic is, and a note when the website is years older than the filing."""
    years = site_age_years(created, filed)
    note = F.when(years >= V.ESTABLISHED_YEARS, F.concat(F.lit("site since "), F.date_format(created, "yyyy")))
    return F.concat_ws(" · ", blank_to_null(lookup(V.FIT_LABEL, level)), note)


def email_source(email: Column, came_from: Column, domain: Column, website: Column) -> Column:
    """Provenance of an address, with the domain check spelled out for one taken from the filing."""
    site = F.lower(F.coalesce(blank_to_null(domain), F.try_parse_url(website, F.lit("HOST")), F.lit("")))
    return F.when(came_from != V.IN_FILING, came_from).otherwise(F.concat(came_from, F.when(
        same_site(mail_domain(email), site), F.lit(" (same domain as the website)")).otherwise(
        F.lit(" (domain differs from the website)"))))


def day_label(d: Column) -> Column:
    return F.coalesce(F.date_format(d, "d MMM yyyy"), F.lit(""))


def moment_label(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "d MMM yyyy, HH:mm"), F.lit(""))


def run_lines(status: Column, added: Column, pushed: Column, held: Column) -> Column:
    """The two lines of a history entry."""
    first = (F.when(status == "offline", "Nothing changed").when(status == "failed", "Nothing added")
             .otherwise(F.concat(F.coalesce(added, pushed, F.lit(0)).cast("string"), F.lit(" added"))))
    second = (F.when(status == "offline", "no internet connection").when(status == "failed", "every registry failed")
              .otherwise(F.concat(F.coalesce(pushed, F.lit(0)).cast("string"), F.lit(" sent to the sheet · "),
                                  F.coalesce(held, F.lit(0)).cast("string"), F.lit(" held back"))))
    return F.struct(first.alias("line1"), second.alias("line2"))


__all__ = ["clean_text", "scrub", "iso_day", "day", "site_age_years", "csv_safe", "row_hash", "lookup", "fit_label", "email_source",
           "day_label", "moment_label", "run_lines", "nonempty"]
