"""Person names and job titles, recognized with array expressions (no Python per row)."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from .core import among, capitalize, col, is_lower, is_upper, let, squeeze, strip, text

_MARKS = "̀-ͯ"
_LATIN = "\\u0000-\\u024F\\u1E00-\\u1EFF"
_NAME_EDGE = " ,.-–—|•:"
_TITLE_EDGE = r"[\s,;:.\-–—|•·]*"
_DASHES = "‐‑‒–—―−"
_JUNK = sorted(set(V.BIZ_WORDS) | set(V.PLACEHOLDER_WORDS) | set(V.UI_WORDS) | set(V.TRADE_WORDS) | set(V.ROLE_WORDS)
               | set(V.PLACE_WORDS) | set(V.BRAND_WORDS))
_NEVER = sorted(set(_JUNK) | set(V.NOT_NAME))


@dataclass(frozen=True)
class Lexicon:
    """Word knowledge a deployment supplies: the given names that settle 'Steve Jobs' against 'Jobs Pipeline'."""

    given_names: tuple[str, ...] = field(default=tuple(V.DEFAULT_GIVEN_NAMES))

    @staticmethod
    def from_file(spark: SparkSession, path: str) -> Lexicon:
        """A lexicon of the names in a text file, one per line, on any store Spark reads. The default list is short; a deployment
        supplies its own."""
        names = spark.read.text(path).select(F.lower(F.trim("value")).alias("n")).where("n <> ''").distinct().orderBy("n")
        return Lexicon(tuple(r.n for r in names.toLocalIterator()))


DEFAULT_LEXICON = Lexicon()


def _composition_table() -> str:
    """Decomposed Latin letter -> composed letter, from the Unicode database."""
    pairs = []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        loose = unicodedata.normalize("NFD", chr(cp))
        if len(loose) > 1:
            pairs.append(f"{loose}\x01{chr(cp)}")
    return "\x02".join(pairs)


def composed(c: Column | str) -> Column:
    """Latin letters followed by combining marks become single letters. The table is one constant map, read only for the
    few texts that hold a combining mark."""
    s = text(c)
    table = F.str_to_map(F.lit(_composition_table()), F.lit("\x02"), F.lit("\x01"))
    clusters = F.regexp_extract_all(s, F.lit(f"(?s).[{_MARKS}]*"), F.lit(0))
    merged = F.transform(clusters, lambda g: F.when(F.length(g) > 1, F.coalesce(F.try_element_at(table, g), g)).otherwise(g))
    return F.when(s.rlike(f"[{_MARKS}]"), F.array_join(merged, "")).otherwise(s)


def _no_dots(t: Column) -> Column:
    return F.rtrim(t, F.lit("."))


def _is_initial(t: Column) -> Column:
    return t.rlike(r"^(?:(?:\p{Lu}\.){1,3}|\p{Lu})$")


def _recase(w: Column, inside: Column) -> Column:
    low = F.replace(F.lower(w), F.lit("i̇"), F.lit("i"))
    pieces = F.regexp_extract_all(low, F.lit(r"['’\-.]|[^'’\-.]+"), F.lit(0))
    return (F.when(inside & among(F.lower(w), V.PARTICLES), F.lower(w))
            .when(F.lower(_no_dots(w)).isin("ii", "iii", "iv"), F.upper(w))
            .otherwise(F.array_join(F.transform(pieces, capitalize), "")))


def _is_particle(t: Column, inside: Column) -> Column:
    return inside & is_lower(_no_dots(t)) & among(F.lower(_no_dots(t)), V.PARTICLES)


def _word_ok(t: Column, i: Column, toks: Column, last: Column, lead: Column, given: Column) -> Column:
    """Does the word at place `i` fit a person's name? Its forms are worked out once, whatever asks for them."""
    inside = (i > 0) & (i < last)
    dotted = t.endswith(".")

    def judged(w: Column) -> Column:
        bare, letters, low, n = w["bare"], w["letters"], w["low"], w["n"]
        shaped = bare.rlike(rf"^[\p{{Lu}}&&[{_LATIN}]](?:[\p{{L}}&&[{_LATIN}]]|['-])*$")
        first = F.get(toks, F.lit(0))
        lone_surname = ((i == last) & (F.size(toks) == 2) & (lead == 0) & (F.length(_no_dots(first)) >= 2) & ~letters.isin("A", "I")
                        & ~among(F.lower(first), V.LABEL_WORDS) & ~dotted)
        surname = (i == last) & ((among(low, V.LAST_OK) & ~dotted) | (given & among(low, V.SURNAMEABLE)))
        return (F.when(~shaped | (F.length(bare) > 24) | (n == 0), False)
                .when(dotted & (n > 4), False)
                .when(n == 1, lone_surname)
                .when(among(low, V.NAME_SUFFIX) & (i == last), True)
                .when((n >= 3) & is_upper(letters), False)
                .when(bare.rlike("[a-z][A-Z]{2,}"), False)
                .when(surname, True)
                .when(among(low, _NEVER), False)
                .otherwise(~F.exists(F.split(F.lower(bare), "-"), lambda p: among(p, _JUNK))))

    def counted(w: Column) -> Column:
        return let(F.struct(w["bare"].alias("bare"), w["letters"].alias("letters"), F.lower(w["letters"]).alias("low"), F.length(w["letters"]).alias("n")), judged)

    forms = F.struct(_no_dots(t).alias("bare"), F.regexp_replace(_no_dots(t), "['-]", "").alias("letters"))
    return F.when(_is_particle(t, inside) | (i < lead) | (inside & _is_initial(t)), True).otherwise(let(forms, counted))


def person_name(c: Column | str, registry: Column | bool = False, company_tokens: Column | None = None,
                lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """The name tidied when it looks like a person's, else null.

    `registry` marks a name from a state filing (typed in small letters by many people); `company_tokens` are the words of
    the company's own name, which is no person when a page shows it alone.
    """
    in_filing = F.lit(registry) if isinstance(registry, bool) else registry

    def words_of(n: Column) -> Column:
        toks = F.filter(F.split(F.replace(n, F.lit("’"), F.lit("'")), " "), lambda t: t != "")
        polite = among(F.lower(F.trim(F.get(toks, F.lit(0)), F.lit("."))), V.HONORIFICS)
        return F.when((F.size(toks) > 2) & polite, F.slice(toks, 2, F.greatest(F.size(toks), F.lit(1)))).otherwise(toks)

    def cased(toks: Column) -> Column:
        last = F.size(toks) - 1
        spoken = F.array_join(F.filter(toks, lambda t, i: ~((i == last) & among(F.lower(_no_dots(t)), V.NAME_SUFFIX))), " ")
        again = is_upper(spoken) | (in_filing & is_lower(spoken))
        return F.when(again, F.transform(toks, lambda t, i: _recase(t, (i > 0) & (i < last)))).otherwise(toks)

    def judged(toks: Column) -> Column:
        return let(F.transform(toks, lambda t: F.lower(_no_dots(t))), lambda words: verdict_of(toks, words))

    def verdict_of(toks: Column, words: Column) -> Column:
        n = F.size(toks)
        last = n - 1
        before_last = F.slice(toks, 1, F.greatest(last, F.lit(0)))
        broken = F.array_position(F.transform(before_last, _is_initial), False).cast("int")
        lead_of = F.when(broken > 0, broken - 1).otherwise(last)
        final = F.element_at(words, -1)

        def verdict(known: Column) -> Column:
            lead, given = known["lead"], known["given"]
            lead_letters = F.length(F.replace(F.array_join(F.slice(toks, 1, F.greatest(lead, F.lit(0))), ""), F.lit("."), F.lit("")))
            names = F.size(F.filter(toks, lambda t, i: ~_is_particle(t, (i > 0) & (i < last))))
            fits = F.forall(F.transform(toks, lambda t, i: _word_ok(t, i, toks, last, lead, given)), lambda ok: ok)
            return (names.between(2, 4) & ((lead == 0) | ((lead <= 2) & (lead_letters + n - lead >= 3))) & fits)

        place = ((n == 2) & among(F.get(words, F.lit(1)), V.STATES)
                 & (among(F.get(words, F.lit(0)), V.CITIES) | among(F.get(words, F.lit(0)), V.STATES)))
        given = among(F.get(words, F.lit(0)), lexicon.given_names)
        listed = (among(F.array_join(words, " "), V.PHRASES) | (among(final, V.STREET_WORDS) & ~given)
                  | F.forall(words, lambda w: among(w, V.SCENERY)) | place)
        ok = n.between(2, V.NAME_TOKENS_MAX) & ~listed & let(F.struct(lead_of.alias("lead"), given.alias("given")), verdict)
        if company_tokens is not None:
            own = F.coalesce(company_tokens, F.array().cast("array<string>"))
            said = F.filter(words, lambda w: ~among(w, V.LEGAL_SUFFIX))
            ok = ok & ~(~in_filing & (F.size(own) > 0) & (F.size(F.array_except(said, own)) == 0))
        return F.when(ok, F.array_join(toks, " "))

    def read(n: Column) -> Column:
        usable = (n != "") & (F.length(n) <= V.NAME_MAX) & ~n.rlike(r"[\x00-\x1f]") & F.contains(n, F.lit(" "))
        return F.when(usable, let(let(words_of(n), cased), judged))

    return F.when(col(c).isNotNull(), let(F.trim(composed(c), F.lit(_NAME_EDGE)), read))


def _trim_title(t: Column) -> Column:
    rest = F.regexp_replace(t, f"^{_TITLE_EDGE}", "")
    rest = F.when(t.rlike(rf"^{_TITLE_EDGE}\.\p{{L}}"), F.concat(F.lit("."), rest)).otherwise(rest)
    return F.rtrim(rest, F.lit(" ,;:.-–—|•·"))


def _unshout(title: Column) -> Column:
    """A title typed in capitals in ordinary case, acronyms kept: VP OF SALES -> VP of Sales."""
    runs = F.regexp_extract_all(title, F.lit(r"[A-Za-z]+(?:[-'’][A-Za-z]+)*|[^A-Za-z]+"), F.lit(0))

    def fix(w: Column, i: Column) -> Column:
        letters = F.regexp_replace(w, "[-'’]", "")
        parts = F.transform(F.split(w, "-"), lambda p: F.when(among(p, V.TITLE_ABBREV), p).otherwise(capitalize(p)))
        return (F.when(~w.rlike("^[A-Za-z]"), w).when((i > 0) & among(w, V.TITLE_SMALL), F.lower(w))
                .when((F.length(letters) < 3) | among(w, V.TITLE_ABBREV), w).otherwise(F.array_join(parts, "-")))

    return F.array_join(F.transform(runs, fix), "")


def clean_title(c: Column | str, limit: int = V.TITLE_MAX) -> Column:
    """A job title as plain text of at most `limit` characters, '' when the text is no title."""
    front = F.translate(text(c), _DASHES, "-" * len(_DASHES))
    front = _trim_title(squeeze(front))
    for _ in range(3):
        front = F.regexp_replace(front, V.TITLE_FRONT, "")
    front = _trim_title(front)

    def cut(t: Column) -> Column:
        parts = F.transform(F.split(t, V.TITLE_SPLIT, -1), strip)
        part = F.get(F.filter(parts, lambda p: (p != "") & (F.length(p) <= limit) & p.rlike(V.LEAD_TITLE)), F.lit(0))
        return F.when(F.length(t) > limit, F.coalesce(part, F.lit(""))).otherwise(t)

    def unwrap(t: Column) -> Column:
        wrapped = t.startswith("(") & t.endswith(")") & (F.length(F.regexp_replace(t, r"[^(]", "")) == 1) & (F.length(t) >= 2)
        return F.when(wrapped, strip(t.substr(F.lit(2), F.greatest(F.length(t) - 2, F.lit(0))))).otherwise(t)

    def dress(t: Column) -> Column:
        fits = (t != "") & (F.length(t) <= limit) & t.rlike(V.TITLE_CHARS)
        calm = F.when(is_upper(t), _unshout(t)).otherwise(t)
        return F.when(fits, let(calm, lambda x: F.when(x.rlike("^[a-z][A-Z]"), x).otherwise(
            F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, limit + 1))))).otherwise(F.lit(""))

    tail = let(front, cut)
    for _ in range(3):
        tail = strip(F.regexp_replace(tail, V.TITLE_TAIL, ""))
    return let(let(tail, unwrap), dress)


def is_lead(c: Column | str) -> Column:
    return text(c).rlike(V.LEAD_TITLE)
