"""The few page facts that need element nesting: quoted passages, blocks around profile links, JSON-LD nodes.

A page is read into one list of texts and an interval-coded element tree: an element is the range of texts it spans, so the block around
a link is two numbers into the page's text (`told`) and never a copy. What is kept grows with the page, however its elements nest.

Only pages that hold one of those reach Python: the caller passes null for the others, and the reader below is a small helper
around the standard parser.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .. import fixed_values as V

_STR = T.StringType()
_FOUNDER = T.StructType([T.StructField("name", _STR), T.StructField("email", _STR)])
LD_NODE = T.StructType([
    T.StructField("types", _STR), T.StructField("name", _STR), T.StructField("job_title", _STR), T.StructField("email", _STR),
    T.StructField("telephone", _STR), T.StructField("phone", _STR), T.StructField("founders", T.ArrayType(_FOUNDER))])
BLOCK = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("n", T.IntegerType())])
PROFILE = T.StructType([T.StructField("url", _STR), T.StructField("own", _STR), T.StructField("blocks", T.ArrayType(BLOCK))])
PROFILES = T.StructType([T.StructField("told", _STR), T.StructField("links", T.ArrayType(PROFILE))])
DOM = T.StructType([T.StructField("said", _STR), T.StructField("profiles", PROFILES), T.StructField("nodes", T.ArrayType(LD_NODE))])

_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_CLOSED_BY_BLOCK = set("p".split())
_BLOCKS = set("p div ul ol li table section article header footer nav h1 h2 h3 h4 h5 h6 blockquote form main aside".split())
#: Pages whose facts are Python objects at a time.
PAGES = 100
NEEDS_DOM = r"(?i)<(blockquote|q|cite)\b|testimonial|review|quote|linkedin\.com/|ld\+json"


class _Reader(HTMLParser):
    """Texts in document order with their elements: every element knows the range of texts it spans."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[tuple[str, bool]] = []                # (text, inside a quote)
        self.elements: list[list] = []                         # [tag, attributes, parent, first text, end text]
        self.open: list[int] = []
        self.tags: Counter[str] = Counter()                    # of the open elements
        self.anchor: int | None = None                         # the link whose text is being read
        self.quotes = self.hidden = 0
        self.ld: list[str] = []

    def _quoting(self, tag: str, attrs: dict) -> bool:
        return (tag in V.QUOTE_TAGS or any(c in (attrs.get("class") or "") for c in V.QUOTE_CLASSES)
                or any(i in (attrs.get("id") or "") for i in V.QUOTE_IDS))

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCKS and self.open and self.elements[self.open[-1]][0] in _CLOSED_BY_BLOCK:
            self._close()
        if tag == "li" and self.open and self.elements[self.open[-1]][0] == "li":
            self._close()
        if tag == "a":
            self._end_anchor()
        a = dict(attrs)
        self.elements.append([tag, a, self.open[-1] if self.open else None, len(self.texts), None])
        if tag in _VOID:
            self.elements[-1][4] = len(self.texts)
            return
        self.open.append(len(self.elements) - 1)
        self.tags[tag] += 1
        if tag == "a":
            self.anchor = self.open[-1]
        self.quotes += self._quoting(tag, a)
        self.hidden += tag in V.HIDDEN_TAGS

    def _end_anchor(self) -> None:
        """A link ends where the next one starts, closed or not, so the texts of links never overlap."""
        if self.anchor is not None:
            e = self.elements[self.anchor]
            e[4] = len(self.texts) if e[4] is None else e[4]
            if self.open and self.open[-1] == self.anchor:
                self._close()
            self.anchor = None

    def _close(self) -> None:
        e = self.elements[self.open.pop()]
        e[4] = len(self.texts) if e[4] is None else e[4]
        self.tags[e[0]] -= 1
        self.quotes -= self._quoting(e[0], e[1])
        self.hidden -= e[0] in V.HIDDEN_TAGS

    def handle_endtag(self, tag):
        if self.tags[tag]:
            while self.elements[self.open[-1]][0] != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        if self.hidden:
            e = self.elements[self.open[-1]]
            if e[0] == "script" and "ld+json" in (e[1].get("type") or ""):
                self.ld.append(data)
        elif data.strip():
            self.texts.append((data.strip(), self.quotes > 0))

    def profiles(self) -> dict:
        """The page's texts as one, and its links to people's profiles with their own text and the ranges of the four elements around
        them, nearest first. Ranges count characters of the text."""
        links = [e for e in self.elements if e[0] == "a" and "linkedin.com/in/" in (e[1].get("href") or "") and "linkedin.com/company/" not in e[1]["href"]]
        if not links:
            return {"told": "", "links": []}
        starts = [0]
        for t, _ in self.texts:
            starts.append(starts[-1] + len(t) + 1)

        def block(e: list) -> dict:
            end = len(self.texts) if e[4] is None else e[4]
            return {"at": starts[e[3]], "n": max(0, starts[end] - 1 - starts[e[3]])}

        out = []
        for e in links:
            around, up = [], e[2]
            while up is not None and len(around) < 4:
                around.append(block(self.elements[up]))
                up = self.elements[up][2]
            texts = " ".join(t for t, _ in self.texts[e[3]:len(self.texts) if e[4] is None else e[4]])
            out.append({"url": e[1]["href"], "own": " ".join([texts, e[1].get("aria-label") or "", e[1].get("title") or ""]), "blocks": around})
        return {"told": " ".join(t for t, _ in self.texts), "links": out}


def _nodes(x) -> Iterator[dict]:
    """Every object of a JSON-LD document, depth first, later siblings first."""
    if isinstance(x, dict):
        yield x
    kids = list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else []
    for kid in reversed(kids):
        if isinstance(kid, (dict, list)):
            yield from _nodes(kid)


def _text(v) -> str | None:
    return v if isinstance(v, str) else None


def _node(o: dict) -> dict:
    kinds = o.get("@type")
    founders = []
    for key in ("founder", "founders"):
        v = o.get(key)
        for p in v if isinstance(v, list) else [v] if v else []:
            if isinstance(p, dict) and p.get("name"):
                founders.append({"name": str(p["name"]), "email": _text(p.get("email"))})
            elif isinstance(p, str):
                founders.append({"name": p, "email": None})
    return {"types": " ".join(str(t) for t in kinds) if isinstance(kinds, list) else str(kinds), "name": str(o.get("name") or ""),
            "job_title": str(o.get("jobTitle") or ""), "email": _text(o.get("email")), "telephone": _text(o.get("telephone")),
            "phone": _text(o.get("phone")), "founders": founders}


def read_page(html: str | None) -> dict:
    if html is None:
        return {"said": None, "profiles": {"told": "", "links": []}, "nodes": []}
    r = _Reader()
    r.feed(html)
    r.close()
    nodes = []
    for body in r.ld:
        try:
            nodes += [_node(o) for o in _nodes(json.loads(body))]
        except (ValueError, RecursionError):
            continue
    return {"said": "\n".join(t for t, quoted in r.texts if not quoted), "profiles": r.profiles(), "nodes": nodes}


def dom_facts(html: Column, *parts: str) -> Column:
    """struct(said, profiles, nodes) of a page, or those of them that `parts` names; only pages that need the nesting are sent to Python.
    A batch is read in groups of `PAGES`, so that it is never held as Python objects, whatever the session's batch size."""
    facts = T.StructType([f for f in DOM.fields if not parts or f.name in parts])
    kind = to_arrow_type(facts)

    @F.arrow_udf(facts)
    def read(pages: pa.Array) -> pa.Array:
        groups = (pages.slice(i, PAGES).to_pylist() for i in range(0, max(1, len(pages)), PAGES))
        return pa.concat_arrays([pa.array([read_page(h) for h in g], kind) for g in groups])

    return read(F.when(html.rlike(NEEDS_DOM), html))
