"""Expressions of the check SQL, worded for the check engine and written apart from the Spark functions."""

from __future__ import annotations

from .. import fixed_values as V


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def among(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def items(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def let(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def flat(e: str) -> str:
    return f"regexp_replace(lower(coalesce({e}, '')), '[^a-z0-9]', '', 'g')"


def squeeze(e: str) -> str:
    return f"regexp_replace(trim(coalesce({e}, '')), '\\s+', ' ', 'g')"


def core_tokens(e: str) -> str:
    words = (f"list_filter(string_split_regex(regexp_replace(replace(lower(coalesce({e}, '')), '&', ' and '), '[^a-z0-9 ]', ' ', 'g'), ' +'), "
             f"lambda w: w <> '' AND w NOT IN {among(V.LEGAL_SUFFIX)})")
    return let(words, "ct", f"CASE WHEN len(ct) > 1 AND ct[len(ct)] IN {among(V.FOREIGN_SUFFIX)} THEN ct[1:len(ct) - 1] ELSE ct END")


def join(e: str, sep: str = "") -> str:
    return f"coalesce(array_to_string({e}, {lit(sep)}), '')"


def core(e: str) -> str:
    return join(core_tokens(e))


def distinct_in_order(e: str, v: str = "dz") -> str:
    return let(e, v, f"list_filter({v}, lambda d1, d2: list_position({v}, d1) = d2)")


def slugs(e: str) -> str:
    joined = join("t")
    plain = f"list_filter(t, lambda w: w NOT IN {among(V.GENERIC)})"
    short = f"replace(replace({joined}, 'technologies', 'tech'), 'technology', 'tech')"
    options = [
        f"CASE WHEN length({joined}) >= 3 THEN {joined} END",
        f"CASE WHEN length({join('t', '-')}) >= 3 THEN {join('t', '-')} END",
        f"CASE WHEN len({plain}) < len(t) AND length({join(plain)}) >= 4 THEN {join(plain)} END",
        f"CASE WHEN {short} <> {joined} AND length({short}) >= 4 THEN {short} END",
        f"CASE WHEN len(t) >= 3 AND length({join('t[1:len(t) - 1]')}) >= 5 THEN {join('t[1:len(t) - 1]')} END",
        f"CASE WHEN len(t) >= 2 AND length(t[1]) >= 5 AND t[1] NOT IN {among(V.GENERIC)} THEN t[1] END"]
    some = f"list_filter([{', '.join(options)}], lambda o: o IS NOT NULL)"
    return let(core_tokens(e), "t", distinct_in_order(some))


def capital(e: str) -> str:
    return f"(upper({e}[1:1]) || lower({e}[2:]))"


def title_case(e: str) -> str:
    return join(f"list_transform(regexp_extract_all(coalesce({e}, ''), '\\p{{L}}+|\\P{{L}}+'), lambda r: {capital('r')})")


def tidy_name(e: str) -> str:
    bare = "regexp_replace(w, '[^A-Za-z]', '', 'g')"
    word = (f"CASE WHEN {bare} IN {among(V.UPPER_TOKENS)} OR contains(w, '&') OR (contains(w, '.') AND length({bare}) <= 2) THEN w "
            f"ELSE {join(f'list_transform(string_split(w, {lit(chr(45))}), lambda p: ' + capital('p') + ')', '-')} END")
    return let(squeeze(e), "n", f"CASE WHEN n = upper(n) AND n <> lower(n) THEN {join(f'list_transform(string_split(n, {lit(chr(32))}), lambda w: {word})', ' ')} ELSE n END")


def tidy_address(e: str) -> str:
    out = join(f"list_transform(string_split(a, ' '), lambda w: CASE WHEN upper(w) IN {among(V.UPPER_TOKENS)} THEN w ELSE {capital('w')} END)", " ")
    for s in ("St", "Nd", "Rd", "Th"):
        out = f"regexp_replace({out}, '\\b(\\d+){s}\\b', '\\1{s.lower()}', 'g')"
    return let(squeeze(e), "a", f"CASE WHEN (a = upper(a) OR a = lower(a)) AND upper(a) <> lower(a) THEN {out} ELSE a END")


def looks_like_company(e: str) -> str:
    return f"regexp_matches(coalesce({e}, ''), {lit(V.COMPANY_SUFFIX)})"


def is_distinct_name(a: str, b: str) -> str:
    return f"({flat(b)} <> '' AND NOT contains({flat(a)}, {flat(b)}))"


def norm_phone(e: str) -> str:
    d = f"regexp_replace(coalesce({e}, ''), '[^0-9]', '', 'g')"
    return let(d, "pd", "CASE WHEN length(pd) = 11 AND pd[1:1] = '1' THEN pd[2:] WHEN length(pd) = 10 THEN pd ELSE '' END")


def _placeholder(d: str) -> str:
    return (f"({d} = '' OR {d}[1:1] IN ('0', '1') OR {d}[4:4] IN ('0', '1') OR {d}[4:6] = '555' OR {d}[2:3] = '11' "
            f"OR replace({d}, {d}[1:1], '') = '' OR {d}[1:3] IN {among(V.NON_GEOGRAPHIC_AREAS)})")


def placeholder_phone(e: str) -> str:
    return let(norm_phone(e), "np", _placeholder("np"))


def usable_phone(e: str) -> str:
    return let(norm_phone(e), "np", f"CASE WHEN {_placeholder('np')} THEN '' ELSE np END")


def fmt_phone(e: str) -> str:
    return let(norm_phone(e), "np", "CASE WHEN np = '' THEN '' ELSE '(' || np[1:3] || ') ' || np[4:6] || '-' || np[7:] END")


def clean_zip(e: str) -> str:
    return f"regexp_extract(coalesce({e}, ''), '^\\s*(\\d{{5}})', 1)"


def state_from_zip(e: str) -> str:
    """First range wins, spelled as a CASE in table order."""
    arms = " ".join(f"WHEN z BETWEEN {lo} AND {hi} THEN '{st}'" for st, lo, hi in V.ZIP_RANGES)
    return let(f"TRY_CAST({clean_zip(e)} AS INTEGER)", "z", f"CASE {arms} ELSE '' END")


def compose_address(street: str, city: str, state: str, zip_: str) -> str:
    town = let(f"trim(coalesce({city}, ''))", "c", f"CASE WHEN c = upper(c) AND c <> lower(c) THEN {title_case('c')} ELSE c END")
    tail = f"concat_ws(' ', nullif(upper(trim(coalesce({state}, ''))), ''), nullif(trim(coalesce({zip_}, ''))[1:5], ''))"
    return f"concat_ws(', ', nullif({tidy_address(street)}, ''), nullif({town}, ''), nullif({tail}, ''))"


def email_kind(e: str) -> str:
    dom = "split_part(ek, '@', 2)"
    agents = " OR ".join(f"{dom} = '{d}' OR ends_with({dom}, '.{d}')" for d in V.AGENT_DOMAINS)
    return let(f"lower(trim(coalesce({e}, '')))", "ek", f"CASE WHEN NOT contains(ek, '@') THEN 'none' WHEN {dom} IN {among(V.FREE_MAIL)} THEN 'free' "
               f"WHEN contains({dom}, 'registeredagent') OR contains({dom}, 'registered-agent') OR {agents} THEN 'agent' ELSE 'own' END")


def valid_email(e: str) -> str:
    return f"(length({e}) <= 254 AND regexp_matches({e}, {lit(V.EMAIL_STRICT)}))"


def not_a_contact(e: str) -> str:
    return let(f"lower(trim(coalesce({e}, '')))", "lp", f"regexp_matches(lp, {lit(V.FUNCTION_MAILBOX)}) OR "
               f"list_has_any(string_split_regex(lp, '[._+\\-]'), {items(V.FUNCTION_MAILBOX_WORDS)})")


def site_root(e: str) -> str:
    parts = f"string_split(trim(lower(coalesce({e}, '')), '.'), '.')"
    two, three = "array_to_string(sr[greatest(len(sr) - 1, 1):], '.')", "array_to_string(sr[greatest(len(sr) - 2, 1):], '.')"
    return let(parts, "sr", f"CASE WHEN len(sr) >= 3 AND {two} IN {among(V.PUBLIC_SUFFIX_2)} THEN {three} ELSE {two} END")


def same_site(host: str, site: str) -> str:
    h = f"trim(lower(coalesce({host}, '')), '.')"
    return let(site_root(site), "rt", f"rt <> '' AND ({h} = rt OR ends_with({h}, '.' || rt))")


def bare_host(url: str) -> str:
    return f"regexp_replace(lower(regexp_extract({url}, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\\.', '')"


def clean_text(e: str, limit: int = 600) -> str:
    return f"trim(regexp_replace(coalesce({e}, ''), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), e' \\t\\n\\r')[1:{limit}]"


def iso(e: str) -> str:
    return f"regexp_extract(coalesce({e}, ''), '^(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1)"


def csv_safe(e: str) -> str:
    return f"CASE WHEN coalesce({e}, '')[1:1] IN ('=', '+', '-', '@', chr(9), chr(13)) THEN '''' || {e} ELSE coalesce({e}, '') END"


def label(table: dict[str, str], key: str, default: str = "''") -> str:
    arms = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items())
    return f"CASE {key} {arms} ELSE {default} END"


def is_it_text(e: str) -> str:
    return f"regexp_matches({e}, '^({'|'.join(V.IT_PREFIXES)})')"




# ------------------------------------------------------------------------------------------------------ names of people
_JUNK = V.BIZ_WORDS + V.PLACEHOLDER_WORDS + V.UI_WORDS + V.TRADE_WORDS + V.ROLE_WORDS + V.PLACE_WORDS + V.BRAND_WORDS


def _upper(e: str) -> str:
    return f"({e} = upper({e}) AND {e} <> lower({e}))"


def _lower(e: str) -> str:
    return f"({e} = lower({e}) AND {e} <> upper({e}))"


def _bare(t: str) -> str:
    return f"rtrim({t}, '.')"


def _initial(t: str) -> str:
    return f"regexp_matches({t}, '^((\\p{{Lu}}\\.){{1,3}}|\\p{{Lu}})$')"


def person_name(e: str, registry: str = "false", company: str | None = None, names: str | None = None) -> str:
    """Null unless the text looks like a person's name. `company` is a list of the company's own words, `names` one of given names."""
    n0 = f"trim(nfc_normalize({e}), ' ,.-–—|•:')"
    toks = "list_filter(string_split(replace(n0, '’', ''''), ' '), lambda a1: a1 <> '')"
    polite = let(toks, "k0", f"CASE WHEN len(k0) > 2 AND lower(trim(k0[1], '.')) IN {among(V.HONORIFICS)} THEN k0[2:] ELSE k0 END")
    spoken = f"array_to_string(CASE WHEN lower({_bare('k1[len(k1)]')}) IN {among(V.NAME_SUFFIX)} THEN k1[1:len(k1) - 1] ELSE k1 END, ' ')"
    pieces = "regexp_extract_all(lower(a2), '[''’\\-.]|[^''’\\-.]+')"
    recase = (f"CASE WHEN a3 > 1 AND a3 < len(k1) AND lower(a2) IN {among(V.PARTICLES)} THEN lower(a2) WHEN lower({_bare('a2')}) IN ('ii', 'iii', 'iv') THEN upper(a2) "
              f"ELSE array_to_string(list_transform({pieces}, lambda a4: {capital('a4')}), '') END")
    cased = let(polite, "k1", f"CASE WHEN coalesce({_upper(spoken)} OR ({registry} AND {_lower(spoken)}), false) THEN list_transform(k1, lambda a2, a3: {recase}) ELSE k1 END")
    particle = f"(a6 > 1 AND a6 < len(k2) AND {_lower(_bare('a5'))} AND lower({_bare('a5')}) IN {among(V.PARTICLES)})"
    given = f"(lower({_bare('k2[1]')}) IN {among(V.DEFAULT_GIVEN_NAMES)})" if names is None else f"coalesce(list_contains({names}, lower({_bare('k2[1]')})), false)"
    lead = (f"coalesce(list_position(list_transform(k2[1:len(k2) - 1], lambda a7: {_initial('a7')}), false) - 1, len(k2) - 1)")
    letters = f"replace(replace({_bare('a5')}, '''', ''), '-', '')"
    low = f"lower({letters})"
    word_ok = f"""CASE WHEN {particle} OR a6 <= ld OR (a6 > 1 AND a6 < len(k2) AND {_initial('a5')}) THEN true
 WHEN NOT regexp_matches({_bare('a5')}, '^\\p{{Lu}}(\\p{{L}}|[''-])*$') OR regexp_matches({_bare('a5')}, '[^\\x{{0000}}-\\x{{024F}}\\x{{1E00}}-\\x{{1EFF}}]')
   OR length({_bare('a5')}) > 24 OR {letters} = '' THEN false
 WHEN ends_with(a5, '.') AND length({letters}) > 4 THEN false
 WHEN length({letters}) = 1 THEN a6 = len(k2) AND len(k2) = 2 AND ld = 0 AND length({_bare('k2[1]')}) >= 2 AND {letters} NOT IN ('A', 'I')
   AND lower(k2[1]) NOT IN {among(V.LABEL_WORDS)} AND NOT ends_with(a5, '.')
 WHEN {low} IN {among(V.NAME_SUFFIX)} AND a6 = len(k2) THEN true
 WHEN length({letters}) >= 3 AND {_upper(letters)} THEN false
 WHEN regexp_matches({_bare('a5')}, '[a-z][A-Z][A-Z]') THEN false
 WHEN a6 = len(k2) AND (({low} IN {among(V.LAST_OK)} AND NOT ends_with(a5, '.')) OR ({given} AND {low} IN {among(V.SURNAMEABLE)})) THEN true
 WHEN {low} IN {among(V.NOT_NAME + _JUNK)} THEN false
 ELSE NOT list_has_any(string_split(lower({_bare('a5')}), '-'), {items(_JUNK)}) END"""
    words = f"list_transform(k2, lambda a8: lower({_bare('a8')}))"
    final = f"lower({_bare('k2[len(k2)]')})"
    place = (f"(len(k2) = 2 AND {words}[2] IN {among(V.STATES)} AND {words}[1] IN {among(V.STATES + V.CITIES)})")
    listed = (f"(array_to_string({words}, ' ') IN {among(V.PHRASES)} OR ({final} IN {among(V.STREET_WORDS)} AND NOT {given}) "
              f"OR len(list_filter({words}, lambda a9: a9 NOT IN {among(V.SCENERY)})) = 0 OR {place})")
    names = f"len(list_filter(k2, lambda a5, a6: NOT {particle}))"
    lead_letters = "length(replace(array_to_string(k2[1:ld], ''), '.', ''))"
    verdict = let(lead, "ld", f"{names} BETWEEN 2 AND 4 AND (ld = 0 OR (ld <= 2 AND {lead_letters} + len(k2) - ld >= 3)) "
                  f"AND len(list_filter(list_transform(k2, lambda a5, a6: {word_ok}), lambda b1: NOT b1)) = 0")
    own = ""
    if company:
        own = (f" AND NOT (NOT {registry} AND len({company}) > 0 AND len(list_filter({words}, lambda b2: b2 NOT IN {among(V.LEGAL_SUFFIX)} "
               f"AND NOT list_contains({company}, b2))) = 0)")
    judged = let(cased, "k2", f"CASE WHEN len(k2) BETWEEN 2 AND {V.NAME_TOKENS_MAX} AND NOT {listed} AND {verdict}{own} THEN array_to_string(k2, ' ') END")
    return let(n0, "n0", f"CASE WHEN n0 <> '' AND length(n0) <= {V.NAME_MAX} AND NOT regexp_matches(n0, '[\\x00-\\x1f]') AND contains(n0, ' ') THEN {judged} END")


def _trim_title(e: str) -> str:
    edge = "[\\s,;:.\\-–—|•·]*"
    rest = f"regexp_replace(tt, '^{edge}', '')"
    return let(e, "tt", f"rtrim(CASE WHEN regexp_matches(tt, '^{edge}\\.\\p{{L}}') THEN '.' || {rest} ELSE {rest} END, ' ,;:.-–—|•·')")


def clean_title(e: str) -> str:
    """A job title as plain text, '' when the text is none."""
    t = _trim_title(squeeze(f"translate(coalesce({e}, ''), '‐‑‒–—―−', '-------')"))
    for _ in range(3):
        t = f"regexp_replace({t}, {lit(V.TITLE_FRONT)}, '')"
    t = _trim_title(t)
    parts = f"list_filter(list_transform(string_split_regex(c0, {lit(V.TITLE_SPLIT)}), lambda p1: trim(p1)), lambda p2: p2 <> '' AND length(p2) <= 60 AND regexp_matches(p2, {lit(V.LEAD_TITLE)}))"
    t = let(t, "c0", f"CASE WHEN length(c0) > 60 THEN coalesce({parts}[1], '') ELSE c0 END")
    for _ in range(3):
        t = f"trim(regexp_replace({t}, {lit(V.TITLE_TAIL)}, ''))"
    t = let(t, "c1", "CASE WHEN c1 LIKE '(%)' AND length(replace(c1, '(', '')) = length(c1) - 1 THEN trim(c1[2:length(c1) - 1]) ELSE c1 END")
    word_letters = "replace(replace(replace(w1, '-', ''), '''', ''), '’', '')"
    fixed = (f"CASE WHEN NOT regexp_matches(w1, '^[A-Za-z]') THEN w1 WHEN i1 > 1 AND w1 IN {among(V.TITLE_SMALL)} THEN lower(w1) "
             f"WHEN length({word_letters}) < 3 OR w1 IN {among(V.TITLE_ABBREV)} THEN w1 "
             f"ELSE array_to_string(list_transform(string_split(w1, '-'), lambda p3: CASE WHEN p3 IN {among(V.TITLE_ABBREV)} THEN p3 ELSE {capital('p3')} END), '-') END")
    calm = f"CASE WHEN {_upper('c2')} THEN array_to_string(list_transform(regexp_extract_all(c2, '[A-Za-z]+([-''’][A-Za-z]+)*|[^A-Za-z]+'), lambda w1, i1: {fixed}), '') ELSE c2 END"
    return let(t, "c2", f"CASE WHEN c2 = '' OR length(c2) > 60 OR NOT regexp_matches(c2, {lit(V.TITLE_CHARS)}) THEN '' ELSE "
               + let(calm, "c3", "CASE WHEN regexp_matches(c3, '^[a-z][A-Z]') THEN c3 ELSE upper(c3[1:1]) || c3[2:] END") + " END")


def is_lead(e: str) -> str:
    return f"regexp_matches(coalesce({e}, ''), {lit(V.LEAD_TITLE)})"
