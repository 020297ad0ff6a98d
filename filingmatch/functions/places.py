"""Addresses, ZIP codes and streets."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from .core import among, blank_to_null, is_upper, let, text, title_case
from .names import tidy_address


def clean_zip(c: Column | str) -> Column:
    return F.regexp_extract(text(c), r"^\s*(\d{5})", 1)


@lru_cache(maxsize=1)
def zip3_states() -> dict[str, str]:
    """The range table by ZIP prefix. Every range starts at ..00 and ends at ..99, so three digits decide; the first
    range that holds a prefix keeps it."""
    out: dict[str, str] = {}
    for state, lo, hi in V.ZIP_RANGES:
        for z3 in range(lo // 100, hi // 100 + 1):
            out.setdefault(f"{z3:03d}", state)
    return out


def state_from_zip(df: DataFrame, zip_col: str, out: str = "state_of_zip") -> DataFrame:
    """Adds the state of a ZIP code ('' when none): a broadcast hash join on the prefix table (at most 1,000 rows by
    construction), never a range join."""
    spark = df.sparkSession
    table = spark.createDataFrame(sorted(zip3_states().items()), "zip3 string, _zip_state string")
    keyed = df.withColumn("_zip3", F.substring(clean_zip(zip_col), 1, 3))
    return (keyed.join(F.broadcast(table), keyed["_zip3"] == table["zip3"], "left")
            .withColumn(out, F.coalesce("_zip_state", F.lit(""))).drop("_zip3", "zip3", "_zip_state"))


def compose_address(street: Column | str, city: Column | str, state: Column | str, zip_: Column | str) -> Column:
    town = let(F.trim(text(city)), lambda c: F.when(is_upper(c), title_case(c)).otherwise(c))
    tail = F.concat_ws(" ", blank_to_null(F.upper(F.trim(text(state)))), blank_to_null(F.substring(F.trim(text(zip_)), 1, 5)))
    return F.concat_ws(", ", blank_to_null(tidy_address(street)), blank_to_null(town), blank_to_null(tail))


def street_pattern(address: Column | str) -> Column:
    """A pattern that finds the street of an address in lower-case text: the house number, at most 18 filler characters,
    the first word of the street that is no direction and no number. Null when the address does not start with a number."""
    spaced = F.regexp_replace(F.lower(text(address)), "[^a-z0-9 ]", " ")

    def pattern(t: Column) -> Column:
        number = F.get(t, F.lit(0))
        word = F.get(F.filter(F.slice(t, 2, F.greatest(F.size(t), F.lit(1))),
                              lambda w: ~among(w, V.STREET_DIRECTIONS) & ~w.rlike(r"^\d+$")), F.lit(0))
        return F.when(number.rlike(r"^\d+$") & word.isNotNull(),
                      F.concat(F.lit(r"\b"), number, F.lit(r"\b[\s,\.#\-a-z]{0,18}?\b"), word))

    return let(F.filter(F.split(spaced, " +"), lambda w: w != ""), pattern)


def quoted(c: Column | str) -> Column:
    """Text as a literal inside a pattern."""
    return F.regexp_replace(text(c), r"([\\.\[\]{}()*+?^$|#\-])", r"\\$1")


def mentions_word(body: Column, word: Column) -> Column:
    """Whole-word search of a per-row word (already lower case); false for an empty word."""
    return (word != "") & F.contains(body, word) & F.regexp_like(body, F.concat(F.lit(r"\b"), quoted(word), F.lit(r"\b")))
