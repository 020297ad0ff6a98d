"""Page HTML as a tree of blocks, and simple tree matching between such trees."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import xxhash

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(("html head body article main section div header footer nav aside form p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
                   "blockquote pre figure figcaption address fieldset details summary hgroup center dialog menu search").split())
SKIP = frozenset("head title script style noscript template svg math iframe object canvas nav footer aside form button select textarea label menu dialog search".split())
#: An element outside article and main is left out if a token of its class, id or role is one of these words or a compound that ends in one.
SKIP_WORDS = frozenset(("ad ads advert advertisement adverts sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar "
                        "cookie cookies consent notice banner popup modal newsletter subscribe signup share sharing social related comment comments respond reply "
                        "disqus widget toolbar pagination").split())
#: The same inside article and main, for whole tokens only: what readers and advertisers add to an article.
SKIP_INSIDE = frozenset("ad ads advert advertisement adverts sponsored comments comment-list comments-area comment-section".split())
CLOSES_P = BLOCK - {"html", "head", "body"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WALLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
_PARTS = re.compile(r"[\W_]+")
DEEPEST = 120


@dataclass(slots=True)
class Node:
    """A block element, or several of one label that stand side by side: their blocks of text, in page order by number."""

    label: str
    main: bool
    texts: list[tuple[int, str]] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)


def roles(attrs: list[tuple[str, str | None]]) -> list[str]:
    """Words of class, id and role. What follows has, with or no ("page has-sidebar") tells of something else and is left out."""
    out = []
    for k, v in attrs:
        if v and k in ("class", "id", "role"):
            for token in v.lower().split():
                for word in _PARTS.split(token):
                    if word in ("has", "with", "without", "no"):
                        break
                    if word:
                        out.append(word)
    return out


def left_out(attrs: list[tuple[str, str | None]], inside: bool) -> bool:
    """Do class, id or role say that an element is no part of an article? Numbers at the end of a token do not count."""
    for k, v in attrs:
        if v and k in ("class", "id", "role"):
            for token in v.lower().split():
                parts = [w for w in _PARTS.split(token) if w and not w.isdigit()]
                if inside:
                    if token in SKIP_INSIDE:
                        return True
                elif parts and parts[-1] in SKIP_WORDS and {"has", "with", "without", "no"}.isdisjoint(parts):
                    return True
    return False


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", False)
        self.open: list[tuple[str, Node, bool]] = [("#root", self.root, False)]     # tag, node its text belongs to, skipped
        self.words: list[str] = []
        self.blocks = 0

    def flush(self) -> None:
        if self.words:
            text = " ".join("".join(self.words).split())
            if text:
                self.open[-1][1].texts.append((self.blocks, text))
                self.blocks += 1
            self.words = []

    def leave(self, at: int) -> None:
        while len(self.open) > at:
            if self.open[-1][0] in BLOCK:
                self.flush()
            self.open.pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag == "br" and not self.open[-1][2]:
                self.words.append(" ")
            return
        if tag in CLOSES_P:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i][0] == "p":
                    self.leave(i)
                    break
                if self.open[i][0] in BLOCK:
                    break
        if tag in SIBLINGS:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i][0] in SIBLINGS[tag]:
                    self.leave(i)
                    break
                if self.open[i][0] in WALLS[tag]:
                    break
        _, above, skipped = self.open[-1]
        names = roles(attrs) if attrs else []
        skip = skipped or tag in SKIP or (tag == "header" and not above.main) or (bool(names) and tag not in ("html", "body", "article", "main") and left_out(attrs, above.main))
        node = above
        if tag in BLOCK:
            self.flush()
            if not skip and len(self.open) < DEEPEST:
                label = " ".join([tag, *names])
                if above.children and above.children[-1].label == label:
                    node = above.children[-1]
                else:
                    node = Node(label, above.main or tag in ("article", "main"))
                    above.children.append(node)
        self.open.append((tag, node, skip))

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)      # as browsers read it, whatever the section is called

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                self.leave(i)
                break

    def handle_data(self, data: str) -> None:
        if not self.open[-1][2]:
            self.words.append(data)


def read(html: str | None) -> Node:
    """The tree of a page. Inline elements dissolve in their block; elements that never belong to an article are left out; tags that
    were never closed end where HTML ends them."""
    r = _Reader()
    if html:
        r.feed(html)
        r.close()
    r.flush()
    return r.root


def _sums(a: list, b: list, memo: dict) -> list[int]:
    """Nodes of the largest match of the list `a` with every beginning of the list `b`."""
    row = [0] * (len(b) + 1)
    places: dict[str, list[int]] = {}
    for j, y in enumerate(b):
        places.setdefault(y.label, []).append(j)
    for x in a:
        last, best, at = row, 0, 0
        gains = [(j, last[j] + weight(x, b[j], memo)) for j in places.get(x.label, ())]
        if gains:
            row = last[:]
            for k, (j, gain) in enumerate(gains):
                best = max(best, gain)
                at, end = j + 1, gains[k + 1][0] + 1 if k + 1 < len(gains) else len(row)
                while at < end and row[at] < best:
                    row[at] = best
                    at += 1
    return row


def weight(a, b, memo: dict) -> int:
    """Nodes of the largest match of two trees that keeps order and levels."""
    if a.label != b.label:
        return 0
    if not a.children or not b.children:
        return 1
    key = (id(a), id(b))
    if key not in memo:
        memo[key] = 1 + _sums(a.children, b.children, memo)[-1]
    return memo[key]


def _pairs(a: list, b: list, memo: dict) -> list[tuple]:
    """The pairs of the largest match of two lists, in memory linear in them (Hirschberg's halving)."""
    out, todo = [], [(a, b)]
    while todo:
        a, b = todo.pop()
        if not a or not b:
            continue
        if len(a) == 1:
            best = max(b, key=lambda y: weight(a[0], y, memo))
            if best.label == a[0].label:
                out.append((a[0], best))
            continue
        half = len(a) // 2
        left, right = _sums(a[:half], b, memo), _sums(a[half:][::-1], b[::-1], memo)
        cut = max(range(len(b) + 1), key=lambda j: left[j] + right[len(b) - j])
        todo += [(a[:half], b[:cut]), (a[half:], b[cut:])]
    return out


def align(a, b, memo: dict | None = None) -> list[tuple]:
    """Matched pairs (node of a, node of b) of the largest match, parents first, however long the lists of children are."""
    memo = {} if memo is None else memo
    out, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        todo += _pairs(x.children, y.children, memo)
    return out


def written(tree: Node) -> str:
    """The labels of a tree, one line per node with its depth, parents first."""
    out, todo = [], [(0, tree)]
    while todo:
        depth, n = todo.pop()
        out.append(f"{depth}\t{n.label}")
        todo += [(depth + 1, c) for c in reversed(n.children)]
    return "\n".join(out)


def parsed(text: str) -> tuple[Node, list[Node]]:
    """The tree of `written` labels, and its nodes in that order."""
    path: list[Node] = []
    nodes = []
    for line in text.split("\n"):
        depth, label = line.split("\t", 1)
        n = Node(label, False)
        del path[int(depth):]
        if path:
            path[-1].children.append(n)
        path.append(n)
        nodes.append(n)
    return nodes[0], nodes


def merge(template: Node, other: Node) -> None:
    """Adds to `template` the nodes of `other` that its largest match with it leaves over, each at its place."""
    own = {id(y): x for x, y in align(template, other)}
    todo = [(template, other)]
    while todo:
        x, y = todo.pop()
        place = {id(c): i for i, c in enumerate(x.children)}
        children, at = [], 0
        for c in y.children:
            met = own.get(id(c))
            if met is None:
                children.append(c)
            else:
                end = place[id(met)] + 1
                children += x.children[at:end]
                at = end
                todo.append((met, c))
        x.children = children + x.children[at:]


def slots(template: str, tree: str) -> list[int]:
    """For each node of `tree` the number of the template's node it matches, -1 where none."""
    top, nodes = parsed(template)
    other, rest = parsed(tree)
    number = {id(n): i for i, n in enumerate(nodes)}
    own = {id(y): number[id(x)] for x, y in align(top, other)}
    return [own.get(id(n), -1) for n in rest]


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
