"""Company names: normal forms, legal suffixes, candidate domain labels, readable case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V
from .core import among, capitalize, col, is_lower, is_upper, let, squeeze, text


def flat(c: Column | str) -> Column:
    """Lower case letters and digits only: the form two spellings of one name share."""
    return F.regexp_replace(F.lower(text(c)), "[^a-z0-9]", "")


def core_tokens(c: Column | str) -> Column:
    """The words of a company name without its legal form."""
    spaced = F.regexp_replace(F.replace(F.lower(text(c)), F.lit("&"), F.lit(" and ")), "[^a-z0-9 ]", " ")
    words = F.filter(F.split(spaced, " +"), lambda w: (w != "") & ~among(w, V.LEGAL_SUFFIX))
    return let(words, lambda t: F.when((F.size(t) > 1) & among(F.element_at(t, -1), V.FOREIGN_SUFFIX),
                                       F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0)))).otherwise(t))


def core(c: Column | str) -> Column:
    return F.array_join(core_tokens(c), "")


def slugs(c: Column | str) -> Column:
    """Candidate domain labels of a company, most likely first."""

    def labels(t: Column) -> Column:
        n = F.size(t)
        joined = F.array_join(t, "")
        plain = F.filter(t, lambda w: ~among(w, V.GENERIC))
        plain_joined = F.array_join(plain, "")
        short = F.replace(F.replace(joined, F.lit("technologies"), F.lit("tech")), F.lit("technology"), F.lit("tech"))
        without_last = F.array_join(F.slice(t, 1, F.greatest(n - 1, F.lit(0))), "")
        first = F.get(t, F.lit(0))

        def at_least(minimum: int, label: Column, when: Column | None = None) -> Column:
            fits = F.length(label) >= minimum
            return F.when(fits if when is None else fits & when, label)

        return F.array_distinct(F.array_compact(F.array(
            at_least(3, joined),
            at_least(3, F.array_join(t, "-")),
            at_least(4, plain_joined, F.size(plain) < n),
            at_least(4, short, short != joined),
            at_least(5, without_last, n >= 3),
            at_least(5, first, (n >= 2) & ~among(first, V.GENERIC)),
        )))

    return let(core_tokens(c), labels)


def _tidy_word(w: Column) -> Column:
    bare = F.regexp_replace(w, "[^A-Za-z]", "")
    kept = among(bare, V.UPPER_TOKENS) | F.contains(w, F.lit("&")) | (F.contains(w, F.lit(".")) & (F.length(bare) <= 2))
    return F.when(kept, w).otherwise(F.array_join(F.transform(F.split(w, "-"), capitalize), "-"))


def tidy_name(c: Column | str) -> Column:
    """A name typed in capitals in readable case; a name in mixed case is left alone."""
    return let(squeeze(c), lambda n: F.when(
        is_upper(n), F.array_join(F.transform(F.split(n, " "), _tidy_word), " ")).otherwise(n))


def tidy_address(c: Column | str) -> Column:
    """A street address in readable case, ordinals small (21st)."""

    def recased(a: Column) -> Column:
        words = F.transform(F.split(a, " "), lambda w: F.when(among(F.upper(w), V.UPPER_TOKENS), w).otherwise(capitalize(w)))
        out = F.array_join(words, " ")
        for suffix in ("St", "Nd", "Rd", "Th"):
            out = F.regexp_replace(out, rf"\b(\d+){suffix}\b", f"$1{suffix.lower()}")
        return out

    return let(squeeze(c), lambda a: F.when(is_upper(a) | is_lower(a), recased(a)).otherwise(a))


def looks_like_company(c: Column | str) -> Column:
    return text(c).rlike(V.COMPANY_SUFFIX)


def is_distinct_name(a: Column | str, b: Column | str) -> Column:
    """True when `b` is really another name than `a`: not the same letters and not part of it."""
    fa, fb = flat(a), flat(b)
    return (fb != "") & ~F.contains(fa, fb)


def name_parts(c: Column | str) -> Column:
    """'Jon Reed Co/Reed Jon': each part is a name."""
    parts = F.transform(F.split(text(c), "/"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def code_is_it(c: Column | str) -> Column:
    """Industry code predicate as `startswith` alternatives, the form a Parquet scan can push down."""
    code = col(c)
    tests = [code.startswith(p) for p in V.IT_PREFIXES]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def code_ranges() -> list[tuple[int, int]]:
    """The same prefixes as six-digit ranges, for a source that stores the code as a number."""
    out = []
    for p in V.IT_PREFIXES:
        room = 10 ** (6 - len(p))
        out.append((int(p) * room, int(p) * room + room - 1))
    return out


def number_is_it(c: Column | str) -> Column:
    n = col(c)
    lo, hi = code_ranges()[0]
    out = n.between(lo, hi)
    for lo, hi in code_ranges()[1:]:
        out = out | n.between(lo, hi)
    return out


def label_is_it(c: Column | str) -> Column:
    """The same predicate on a text such as 'Custom software (541511)'."""
    s = col(c)
    out = F.contains(s, F.lit("(" + V.IT_PREFIXES[0]))
    for p in V.IT_PREFIXES[1:]:
        out = out | F.contains(s, F.lit("(" + p))
    return out
