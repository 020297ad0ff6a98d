"""North American phone numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V
from .core import among, let, text


def digits(c: Column | str) -> Column:
    return F.regexp_replace(text(c), r"\D", "")


def norm_phone(c: Column | str) -> Column:
    """Ten digits, or '' when the text is no such number."""

    def ten(d: Column) -> Column:
        local = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)
        return F.when(F.length(local) == 10, local).otherwise(F.lit(""))

    return let(digits(c), ten)


def _placeholder(d: Column) -> Column:
    area, exchange = F.substring(d, 1, 3), F.substring(d, 4, 3)
    return ((d == "") | area.rlike("^[01]") | exchange.rlike("^[01]") | (exchange == "555") | area.endswith("11")
            | d.rlike(r"^(\d)\1{9}$") | among(area, V.NON_GEOGRAPHIC_AREAS))


def placeholder_phone(c: Column | str) -> Column:
    """True when the text cannot be a company's own line."""
    return let(norm_phone(c), _placeholder)


def usable_phone(c: Column | str) -> Column:
    """The ten digits when they can be a company's own line, else ''."""
    return let(norm_phone(c), lambda d: F.when(_placeholder(d), F.lit("")).otherwise(d))


def phone_reject_reason(c: Column | str) -> Column:
    """Why a number is no company line ('' when it can be one)."""

    def reason(d: Column) -> Column:
        area, exchange = F.substring(d, 1, 3), F.substring(d, 4, 3)
        return (F.when(d == "", "not ten digits")
                .when(area.rlike("^[01]") | exchange.rlike("^[01]"), "starts with 0 or 1")
                .when(exchange == "555", "555 exchange")
                .when(area.endswith("11"), "service code")
                .when(d.rlike(r"^(\d)\1{9}$"), "one digit repeated")
                .when(among(area, V.NON_GEOGRAPHIC_AREAS), "area without a place")
                .otherwise(""))

    return let(norm_phone(c), reason)


def fmt_phone(c: Column | str) -> Column:
    return let(norm_phone(c), lambda d: F.when(d == "", F.lit("")).otherwise(
        F.concat(F.lit("("), F.substring(d, 1, 3), F.lit(") "), F.substring(d, 4, 3), F.lit("-"), F.substring(d, 7, 4))))
