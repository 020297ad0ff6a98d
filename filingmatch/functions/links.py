"""Links: absolute form, profile addresses, display form, percent escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V
from .core import let, strip, text


def unquote(c: Column | str) -> Column:
    """%40 -> @; text that is no valid escape stays as it is ('+' is not a blank here)."""
    s = text(c)
    return F.when(F.contains(s, F.lit("%")), F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)).otherwise(s)


def _merge_dots(path: Column) -> Column:
    """/a/../b -> /b and /a/./b -> /a/b."""
    parts = F.split(path, "/")

    def push(kept: Column, part: Column) -> Column:
        up = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))
        return F.when(part == ".", kept).when(part == "..", up).otherwise(F.concat(kept, F.array(part)))

    folded = F.array_join(F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), push), "/")
    trailing = path.rlike(r"/\.{1,2}$")
    return F.when(~path.rlike(r"/\.{1,2}(/|$)"), path).otherwise(
        F.when(trailing & ~folded.endswith("/"), F.concat(folded, F.lit("/"))).otherwise(folded))


def absolute_url(base: Column | str, href: Column | str) -> Column:
    """A link as a page at `base` would follow it, without its fragment; '' for a link no browser could follow."""
    b, h = text(base), F.regexp_replace(strip(text(href)), r"[\t\r\n]", "")
    scheme = F.coalesce(F.try_parse_url(b, F.lit("PROTOCOL")), F.lit("http"))
    origin = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    base_path = F.regexp_extract(b, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    folder = F.concat(F.regexp_extract(base_path, r"^(.*/)", 1))
    base_no_fragment = F.regexp_replace(b, "#.*$", "")
    base_no_query = F.regexp_replace(base_no_fragment, r"\?.*$", "")
    cut = F.regexp_replace(h, "#.*$", "")
    path, rest = F.regexp_extract(cut, r"^([^?]*)", 1), F.regexp_extract(cut, r"^[^?]*(\?.*)?$", 1)
    relative = F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path)
    out = (F.when(cut == "", base_no_fragment)
           .when(cut.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), cut)
           .when(cut.startswith("//"), F.concat(scheme, F.lit(":"), cut))
           .when(cut.startswith("?"), F.concat(base_no_query, cut))
           .when(cut.startswith("/"), F.concat(origin, _merge_dots(path), rest))
           .otherwise(F.concat(origin, _merge_dots(relative), rest)))
    broken = out.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*[\[\]]") & ~out.rlike(
        r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#@]*@)?\[[0-9A-Fa-f:.]+\](:\d*)?([/?#]|$)")
    return F.when(broken, F.lit("")).otherwise(out)


def page_key(url: Column | str) -> Column:
    """The form under which two addresses are one page: no fragment, no query left empty, no trailing slash."""
    return F.regexp_replace(F.regexp_replace(text(url), "#.*$", ""), "/+$", "")


def profile_url(href: Column | str) -> Column:
    """A plain profile or company address in its usual form, or ''."""
    plain = F.trim(F.split_part(F.split_part(text(href), F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)))
    return let(plain, lambda h: F.when(h.rlike(V.PROFILE_URL), F.concat(
        F.lit("https://www.linkedin.com/"), F.lower(F.regexp_extract(h, V.PROFILE_URL, 1)), F.lit("/"),
        F.regexp_extract(h, V.PROFILE_URL, 2))).otherwise(F.lit("")))


def display_site(url: Column | str) -> Column:
    bare = F.replace(F.replace(text(url), F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    return F.regexp_replace(F.regexp_replace(bare, r"^www\.", ""), "/+$", "")


def plain_web_address(root: Column | str) -> Column:
    """True for scheme://host in plain ASCII, the only form that is stored."""
    return F.lower(text(root)).rlike(r"^https?://[a-z0-9]([a-z0-9.\-]*[a-z0-9])?(:\d{1,5})?$")
