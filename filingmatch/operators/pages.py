"""Page facts: everything a page says by itself, worked out once per page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import markup as M
from ..functions.cells import clean_text
from ..functions.core import first_items, let, strip, text
from ..functions.links import absolute_url, page_key, profile_url
from ..functions.mail import bare_host, same_site, valid_email
from ..functions.people import DEFAULT_LEXICON, Lexicon, clean_title, is_lead, person_name
from ..session import evaluated
from ..sources.crawl import located
from .dom import dom_facts

def page_texts(pages: DataFrame) -> DataFrame:
    """Adds `markup`, `body`, `head` and `links`: expressions only, each worked out once per page."""
    shown = evaluated(located(pages).withColumn("markup", M.shown_markup("html")))
    return evaluated(shown.withColumns({"body": M.visible_text(F.col("markup")), "head": M.head_text(F.col("markup")), "links": M.links(F.col("markup"))}))


def page_facts(pages: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """One row per page: url, host, path, whether it is a legal page, head, body, links, emails, phones, people, profiles.
    The HTML itself is dropped, so what is stored and shuffled later is a fraction of the crawl."""
    facts = (page_texts(pages).withColumn("dom", dom_facts(F.col("html")))
            .select("page_id", "url", "host", "path", F.col("path").rlike(V.LEGAL_PATH).alias("is_legal"), "head", "body", "links",
                    M.emails(F.col("markup"), F.col("links"), F.col("body")).alias("emails"),
                    M.phones(F.col("links"), F.col("body")).alias("phones"),
                    ld_emails(F.col("dom.nodes")).alias("ld_emails"), ld_phones(F.col("dom.nodes")).alias("ld_phones"),
                    F.coalesce(F.col("dom.said"), F.col("body")).alias("said"), F.col("dom.nodes").alias("nodes"),
                    company_profile(F.col("links")).alias("company_profile"), person_profiles(F.col("dom.profiles")).alias("profiles")))
    return (evaluated(facts)
            .withColumn("people", F.when(~F.col("is_legal"), people_of_page(F.col("said"), F.col("nodes"), lexicon))).drop("said", "nodes"))


# ------------------------------------------------------------------------------------------------------------- page roles
def role_targets(url: Column, host: Column, page_links: Column) -> Column:
    """The pages to read beside a home page, in order, at most six: links of the same host whose path or label hints at
    contact, team or company, then the usual paths."""
    origin = F.regexp_extract(url, r"^([A-Za-z]+://[^/?#]+)", 1)

    def target(a: Column) -> Column:
        return F.struct(absolute_url(url, a["href"]).alias("u"), a["label"].alias("label"))

    def wanted(t: Column) -> Column:
        path = F.coalesce(F.try_parse_url(t["u"], F.lit("PATH")), F.lit(""))
        return ((t["u"] != "") & (F.replace(F.lower(_netloc(t["u"])), F.lit("www."), F.lit("")) == host) & ~path.rlike(V.SKIP_PATH)
                & F.concat(path, F.lit(" "), t["label"]).rlike(V.PAGE_HINT))

    linked = F.transform(F.filter(F.transform(page_links, target), wanted), lambda t: page_key(t["u"]))
    usual = F.transform(F.array(*[F.lit(p) for p in V.DEFAULT_PATHS]), lambda p: F.concat(origin, p))
    return F.slice(F.array_except(F.array_distinct(F.concat(linked, usual)), F.array(page_key(url))), 1, V.MAX_SUBPAGES)


def _netloc(u: Column) -> Column:
    return F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def legal_targets(url: Column, host: Column, page_links: Column, already: Column) -> Column:
    """At most two privacy or terms pages: the linked ones that are not read already, else the usual paths."""
    origin = F.regexp_extract(url, r"^([A-Za-z]+://[^/?#]+)", 1)
    legal = F.filter(page_links, lambda a: F.concat(a["href"], F.lit(" "), a["label"]).rlike(V.LEGAL_LINK))
    urls = F.transform(legal, lambda a: absolute_url(url, a["href"]))
    same = F.filter(urls, lambda u: (u != "") & (F.replace(F.lower(_netloc(u)), F.lit("www."), F.lit("")) == host))
    linked = F.slice(F.array_except(F.array_distinct(F.transform(same, page_key)), already), 1, V.MAX_LEGAL)
    usual = F.transform(F.array(*[F.lit(p) for p in V.DEFAULT_LEGAL]), lambda p: F.concat(origin, p))
    return F.when(F.size(linked) > 0, linked).otherwise(usual)


def stays_on_site(page_host: Column, home_host: Column) -> Column:
    """False for a page that a redirect took to another company's site."""
    return same_site(page_host, home_host) | same_site(home_host, page_host)


# --------------------------------------------------------------------------------------------------------- JSON-LD nodes
def ld_phones(nodes: Column) -> Column:
    """Numbers of the data nodes, in node order."""
    pairs = F.transform(nodes, lambda n: F.filter(F.transform(F.array_compact(F.array(n["telephone"], n["phone"])), M.dialled_number), lambda p: p != ""))
    return F.array_distinct(F.flatten(pairs))


def ld_emails(nodes: Column) -> Column:
    """Addresses of the data nodes, in node order."""
    found = F.flatten(F.transform(F.filter(nodes, lambda n: n["email"].isNotNull()), lambda n: M.text_addresses(n["email"])))
    return M.usable_emails(found)


def _ld_email(e: Column) -> Column:
    return let(F.lower(F.trim(F.replace(text(e), F.lit("mailto:"), F.lit("")))), lambda x: F.when(valid_email(x), x).otherwise(F.lit("")))


# ------------------------------------------------------------------------------------------------------- people of a page
_MENTION = "array<struct<part:int,pos:int,line:string,above:string,below:string,title:string,email:string>>"


def _mention(part: int, pos: Column, line: Column, title: Column, email: Column, above: Column | None = None, below: Column | None = None) -> Column:
    nothing = F.lit(None).cast("string")
    return F.struct(F.lit(part).alias("part"), pos.cast("int").alias("pos"), line.alias("line"), (nothing if above is None else above).alias("above"),
                    (nothing if below is None else below).alias("below"), title.alias("title"), email.alias("email"))


def ld_mentions(nodes: Column) -> Column:
    """Person nodes and founders of the data nodes (part 0)."""

    def of_node(n: Column) -> Column:
        zero = F.lit(0)
        own = F.when(F.contains(n["types"], F.lit("Person")) & (n["name"] != ""), F.array(_mention(
            0, zero, clean_text(n["name"], 120), clean_text(n["job_title"], 120), _ld_email(n["email"]))))
        founders = F.transform(n["founders"], lambda f: _mention(0, zero, clean_text(f["name"], 120), F.lit("Founder"), _ld_email(f["email"])))
        return F.concat(F.coalesce(own, F.array().cast(_MENTION)), founders)

    return F.transform(F.flatten(F.transform(nodes, of_node)), lambda m, i: m.withField("pos", i.cast("int")))


def line_mentions(said: Column) -> Column:
    """Lines with a leadership title and their neighbours (part 1): taken from the line array, so no shuffle is needed."""

    def titled(lines: Column) -> Column:
        every = F.transform(lines, lambda s, i: _mention(1, i, s, s, F.lit(""), F.when(i > 0, F.get(lines, i - 1)), F.get(lines, i + 1)))
        return F.filter(every, lambda m: (F.length(m["line"]) <= V.TITLE_LINE_MAX) & is_lead(m["line"]))

    lines = F.filter(F.transform(F.split(said, "\n"), strip), lambda s: s != "")
    return F.when(is_lead(said), let(lines, titled)).otherwise(F.array().cast(_MENTION))


def founder_mentions(said: Column) -> Column:
    """'founded by ...' phrases (part 2)."""
    return F.transform(F.regexp_extract_all(said, F.lit(V.FOUNDED_BY), F.lit(1)), lambda n, i: _mention(2, i, n, F.lit("Founder"), F.lit("")))


def recognized(mentions: Column, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """Mentions whose name is a person's and whose title is a title: array of (part, pos, name, title, email). A title line may
    hold both, before or after a mark; else the name stands on the line above or below."""

    def read(m: Column) -> Column:
        halves = F.struct(F.regexp_extract(m["line"], V.LINE_PARTS, 1).alias("left"),
                          F.rtrim(F.regexp_extract(m["line"], V.LINE_PARTS, 2), F.lit(")")).alias("right"))
        return let(halves, lambda h: with_names(m, h))

    def with_names(m: Column, h: Column) -> Column:
        line = m["part"] == 1
        texts = F.array(m["line"], F.when(line & is_lead(h["right"]) & ~is_lead(h["left"]), h["left"]),
                        F.when(line & is_lead(h["left"]) & ~is_lead(h["right"]), h["right"]),
                        F.when(line & ~is_lead(m["above"]), m["above"]), F.when(line & ~is_lead(m["below"]), m["below"]))
        return let(F.transform(texts, lambda t: person_name(t, lexicon=lexicon)), lambda n: decided(m, h, n))

    def decided(m: Column, h: Column, n: Column) -> Column:
        whole, left, right, above, below = (F.get(n, F.lit(i)) for i in range(5))
        name = F.when(m["part"] != 1, whole).otherwise(F.coalesce(left, right, F.when(whole.isNull(), F.coalesce(above, below))))
        title = (F.when(m["part"] != 1, m["title"]).when(left.isNotNull(), strip(h["right"])).when(right.isNotNull(), strip(h["left"]))
                 .otherwise(m["line"]))
        return F.struct(m["part"].alias("part"), m["pos"].alias("pos"), name.alias("name"), clean_title(title).alias("title"), m["email"].alias("email"))

    return F.filter(F.transform(mentions, read), lambda p: p["name"].isNotNull() & ((p["part"] == 0) | (p["title"] != "")))


def people_of_page(said: Column, nodes: Column, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """Everyone a page names with a title, in reading order."""
    return recognized(F.concat(ld_mentions(nodes), line_mentions(said), founder_mentions(said)), lexicon)


# ------------------------------------------------------------------------------------------------------------ profile links
def company_profile(page_links: Column) -> Column:
    """The company profile a page links first, '' when that link is no plain address."""
    tagged = F.filter(page_links, lambda a: F.contains(a["href"], F.lit("linkedin.com/company/")))
    plain = F.filter(F.transform(tagged, lambda a: profile_url(a["href"])), lambda u: u != "")
    return F.coalesce(F.get(plain, F.lit(0)), F.lit(""))


def person_profiles(profiles: Column, most: int | None = None) -> Column:
    """struct(told, links) of a page with its profile links in plain form, the first `most` where that is given; told is '' and links empty
    where there are none."""
    plain = F.transform(profiles["links"], lambda p: F.struct(profile_url(p["url"]).alias("url"), p["own"].alias("own"), p["blocks"].alias("blocks")))
    return F.struct(profiles["told"].alias("told"), first_items(F.filter(plain, lambda p: p["url"] != ""), most).alias("links"))


def page_index(pages: DataFrame) -> DataFrame:
    """(url_key, page_id, page_host) of every address, the lowest page id when an address was crawled more than once, and the host that
    answered. A crawl that follows redirects lands the address it asked for as `asked` beside the `url` that answered; the key is what was asked.
    Reads the address columns only and combines on the map side."""
    asked = F.coalesce("asked", "url") if "asked" in pages.columns else F.col("url")
    keyed = located(pages.select("page_id", "url", asked.alias("_asked"))).groupBy(page_key("_asked").alias("url_key"))
    return keyed.agg(F.min_by(F.struct("page_id", F.col("host").alias("page_host")), "page_id").alias("p")).select("url_key", "p.*")


def home_pages(pages: DataFrame) -> DataFrame:
    """(host, page_id, url) of the home page of every host, read from the address column only."""
    homes = located(pages.select("page_id", "url")).where(F.col("path").isin("", "/") & (F.col("host") != ""))
    return homes.groupBy("host").agg(F.min_by(F.struct("page_id", "url"), "page_id").alias("h")).select("host", "h.page_id", "h.url")
