"""Page markup as regular expressions over the HTML column: visible text, headings, links, addresses, numbers."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V
from .core import col, first_items, let, no_strings, rest_of, strip, text
from .links import unquote
from .mail import valid_email, xor_decode
from .phones import usable_phone

CUT = "\x01"                                            # stands where markup was: text nodes lie between two of them
_HIDDEN = "(?is)<!--.*?-->|" + "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in V.HIDDEN_TAGS)
_TAG = r"<[!/?a-zA-Z][^>]*>"
_PHONE = r"(?<!\d)" + V.PHONE_BODY + r"(?!\d)"


def _entity_table() -> str:
    return "\x02".join(f"{name}\x01{chr(cp)}" for name, cp in sorted({**name2codepoint, "apos": 39}.items()))


def unescape(c: Column | str) -> Column:
    """Character references decoded: the named ones of HTML 4 and every numeric one."""
    s = text(c)
    table = F.str_to_map(F.lit(_entity_table()), F.lit("\x02"), F.lit("\x01"))

    def decode(part: Column, i: Column) -> Column:
        """Text after an ampersand: a name, a number or neither, then the rest."""
        ref = F.regexp_extract(part, r"^(#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]{1,31}(?=;))", 1)
        return F.when((i == 0) | (ref == ""), F.concat(F.when(i > 0, F.lit("&")).otherwise(F.lit("")), part)).otherwise(
            let(ref, lambda r: F.concat(character(r), F.regexp_replace(rest_of(part, F.length(r) + 1), "^;", ""))))

    def character(r: Column) -> Column:
        point = F.when(r.rlike("^#[xX]"), F.conv(F.substring(r, 3, 6), 16, 10)).otherwise(F.substring(r, 2, 7)).try_cast("int")
        known = point.between(1, 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        return (F.when(~r.startswith("#"), F.coalesce(F.try_element_at(table, r), F.concat(F.lit("&"), r, F.lit(";"))))
                .when(known, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd")))

    return F.when(F.contains(s, F.lit("&")), F.array_join(F.transform(F.split(s, "&"), decode), "")).otherwise(s)


def shown_markup(html: Column | str) -> Column:
    """The page without comments and the elements nobody sees."""
    return F.regexp_replace(text(html), _HIDDEN, CUT)


def text_nodes(markup: Column) -> Column:
    nodes = F.split(unescape(F.regexp_replace(markup, _TAG, CUT)), CUT)
    return F.filter(F.transform(nodes, strip), lambda t: t != "")


def visible_text(markup: Column) -> Column:
    """Text nodes, one per line, of `shown_markup`."""
    return F.array_join(text_nodes(markup), "\n")


def inner_text(fragment: Column) -> Column:
    return F.array_join(text_nodes(fragment), " ")


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute inside one opening tag, null when the tag has none."""
    written = F.regexp_extract(tag, rf"""(?is)^<[^>]*?[\s"']{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", 1)
    return F.when(written != "", unescape(F.regexp_replace(written, "^[\"']|[\"']$", "")))


def head_text(markup: Column, most: int | None = None) -> Column:
    """Title, description, preview tags and headings (the first `most` where that is given), joined by ' . '."""
    title = F.when(markup.rlike(r"(?i)<title\b"), F.array(F.regexp_extract(markup, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)))
    headings = first_items(F.regexp_extract_all(markup, F.lit(r"(?is)<h[12]\b[^>]*>(.*?)</h[12]\s*>"), F.lit(1)), most)
    tags = F.filter(F.regexp_extract_all(markup, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0)), lambda m: m.rlike("(?i)description|og:(title|site_name)"))
    metas = F.transform(tags, lambda m: F.struct(attribute(m, "(?:name|property)").alias("key"), attribute(m, "content").alias("content")))

    def joined(meta: Column) -> Column:
        wanted = F.array(*[F.lit(k) for k in ("description", "og:title", "og:description", "og:site_name")])
        contents = F.transform(wanted, lambda k: F.get(F.filter(meta, lambda m: m["key"] == k), F.lit(0))["content"])
        return F.filter(contents, lambda c: c.isNotNull() & (c != ""))

    shown = let(F.coalesce(title, no_strings()), lambda t: let(F.transform(F.concat(t, headings), inner_text), lambda x: F.concat(
        F.slice(x, 1, F.size(t)), let(metas, joined), F.slice(x, F.size(t) + 1, F.greatest(F.size(x) - F.size(t), F.lit(0))))))
    return F.array_join(shown, " . ")


def links(markup: Column, most: int | None = None) -> Column:
    """The links of a page: array of (href, label); of the first `most` anchors where that is given."""
    anchors = first_items(F.regexp_extract_all(markup, F.lit(r"(?is)<a\b[^>]*>.*?</a\s*>"), F.lit(0)), most)
    read = F.transform(anchors, lambda a: F.struct(attribute(a, "href").alias("href"), inner_text(a).alias("label")))
    return F.filter(read, lambda a: a["href"].isNotNull())


def _strict_form(e: Column) -> Column:
    return F.lower(F.trim(unquote(e), F.lit(".,;:()<>\"' ")))


def usable_emails(found: Column) -> Column:
    """Candidates in order, in their usual form, without placeholders, each once."""
    shaped = F.transform(found, _strict_form)
    return F.array_distinct(F.filter(shaped, lambda e: valid_email(e) & ~e.rlike(V.BAD_EMAIL)))


def text_addresses(body: Column) -> Column:
    """Every address written in a text, also as 'name [at] host [dot] tld'."""
    plain = F.regexp_replace(unescape(body), r"(?i)\s{0,3}[\[\(]\s{0,3}at\s{0,3}[\]\)]\s{0,3}", "@")
    plain = F.regexp_replace(plain, r"(?i)\s{0,3}[\[\(]\s{0,3}dot\s{0,3}[\]\)]\s{0,3}", ".")
    return F.when(F.contains(plain, F.lit("@")), F.regexp_extract_all(plain, F.lit(V.EMAIL), F.lit(0))).otherwise(no_strings())


def raw_addresses(markup: Column, page_links: Column, body: Column) -> Column:
    """Mail links, hidden addresses and addresses in the text, in that order."""
    mailto = F.filter(page_links, lambda a: a["href"].startswith("mailto"))
    listed = F.flatten(F.transform(mailto, lambda a: F.split(
        F.split_part(unquote(rest_of(a["href"], 8)), F.lit("?"), F.lit(1)), "[;,]")))
    hidden = F.transform(F.regexp_extract_all(markup, F.lit(r"""(?i)\sdata-cfemail\s*=\s*["']?([0-9A-Fa-f]+)"""), F.lit(1)), xor_decode)
    return F.concat(F.filter(F.transform(listed, strip), lambda e: F.contains(e, F.lit("@"))),
                    F.filter(hidden, lambda e: F.contains(e, F.lit("@"))), text_addresses(body))


def emails(markup: Column, page_links: Column, body: Column) -> Column:
    return usable_emails(raw_addresses(markup, page_links, body))


def numbers_in_text(body: Column | str) -> Column:
    """Every phone-shaped number of a text with the 80 characters before it, lower case: array of (number, before)."""
    s = col(body)

    def pair(cut: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            start = F.greatest(i - 8, F.lit(0))                 # a number is ten characters or more: eight back fill the 80
            earlier = F.transform(F.sequence(start, i), lambda j: F.concat(
                F.get(cut["between"], j), F.when(j < i, F.get(cut["found"], j)).otherwise(F.lit(""))))
            return F.struct(m.alias("number"), F.lower(F.right(F.array_join(earlier, ""), F.lit(80))).alias("before"))

        return F.transform(cut["found"], one)

    return let(F.struct(F.regexp_extract_all(s, F.lit(_PHONE), F.lit(0)).alias("found"), F.split(s, _PHONE, -1).alias("between")), pair)


def _belongs_to_others(before: Column) -> Column:
    sentence = F.element_at(F.split(before, r"[.\n]\s"), -1)
    return F.contains(F.right(before, F.lit(14)), F.lit("fax")) | sentence.rlike(V.OTHER_PEOPLES_PHONE)


def dialled_number(value: Column) -> Column:
    """A number as written in a link or data field, its extension cut off; '' when no company line."""
    return usable_phone(F.get(F.split(value, V.TEL_EXTENSION, 2), F.lit(0)))


def phones(page_links: Column, body: Column) -> Column:
    """Company lines in order: tel: links, then numbers of the text that are no fax and nobody else's."""
    tel = F.filter(page_links, lambda a: a["href"].startswith("tel"))
    dialled = F.transform(tel, lambda a: dialled_number(unquote(F.regexp_extract(a["href"], r"(?s)^[^:]*:(.*)$", 1))))
    written = F.transform(F.filter(numbers_in_text(body), lambda x: ~_belongs_to_others(x["before"])), lambda x: usable_phone(x["number"]))
    return F.array_distinct(F.filter(F.concat(dialled, written), lambda p: p != ""))
