"""Small Column helpers shared by every function module."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

# every character that counts as a blank at the end of a text
BLANKS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def strip(c: Column | str) -> Column:
    """Blanks of every kind removed from both ends (`trim` alone removes spaces only)."""
    return F.trim(col(c), F.lit(BLANKS))


def squeeze(c: Column | str) -> Column:
    """Runs of blanks become one space, ends stripped."""
    return F.regexp_replace(strip(text(c)), r"\s+", " ")


def strings(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


_LISTS: dict[tuple[str, ...], object] = {}
_OWNER: list = [None]


def among(c: Column | str, words: Iterable[str]) -> Column:
    """Membership in a list of words: Catalyst makes one hashed set of it. A list goes to the JVM once and is handed over as a whole after that;
    `isin` would send every word anew with each use, which took longer than the queries."""
    context = SparkContext._active_spark_context
    if _OWNER[0] is not context:
        _OWNER[0] = context
        _LISTS.clear()
    key = tuple(words)
    if key not in _LISTS:
        held = context._jvm.java.util.ArrayList()
        for w in key:
            held.add(w)
        _LISTS[key] = held
    own = col(c)
    return F.coalesce(type(own)(own._jc.isInCollection(_LISTS[key])), F.lit(False))


def first_chars(c: Column, n: int | None) -> Column:
    """At most `n` characters; all of them where `n` is None."""
    return c if n is None else F.substring(c, 1, n)


def first_items(c: Column, n: int | None) -> Column:
    """At most `n` items of an array; all of them where `n` is None."""
    return c if n is None else F.slice(c, 1, n)


def rest_of(c: Column, start: int | Column) -> Column:
    """The characters from `start` on."""
    return F.substr(c, F.lit(start) if isinstance(start, int) else start)


def no_strings() -> Column:
    return F.array().cast("array<string>")


def is_upper(c: Column) -> Column:
    return (c == F.upper(c)) & (c != F.lower(c))


def is_lower(c: Column) -> Column:
    return (c == F.lower(c)) & (c != F.upper(c))


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(rest_of(c, 2)))


def title_case(c: Column | str) -> Column:
    """Every run of letters capitalized: O'HARE -> O'Hare, WINSTON-SALEM -> Winston-Salem (`initcap` looks at spaces only)."""
    runs = F.regexp_extract_all(text(c), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, capitalize), "")


def first_match(c: Column | str, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null when nothing matches."""
    return F.nullif(F.regexp_extract(col(c), pattern, group), F.lit(""))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def nonempty(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit("")) != ""
