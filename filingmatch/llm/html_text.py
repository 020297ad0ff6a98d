"""Main text of pages by wrapper induction with simple tree matching.

A page is read as a tree of blocks. Its label tree (tag, class, id, role of each node, no text) is what pages of one making share. Spark
merges the distinct label trees of a host, in three rounds of groups, into the host's template: the largest order-keeping match of two
trees (simple tree matching) says which nodes are the same, and what is left over is added at its place. Every label tree is then aligned
to the template, which gives each node of each page a slot.

Slots are judged over all pages of a host, pages with the same blocks counting once. A value is constant if nearly all pages with the
slot show it (`NEARLY`, and `LEAST` pages or more). A slot is constant if nearly all of its values are common ones (on `LEAST` pages or more and at
least `SHARE` of the pages with the slot), so a line worded in several languages goes and a byline that a fifth of the pages share
stays. Constant values go, the values of varying slots are content.

Menus, headers, footers, sidebars, notices, adverts, forms and comments vary too, so elements with such a tag are left out, and elements
whose class, id or role says so: outside `article` and `main` by a token or the last word of a compound one, inside them by whole tokens
for adverts and comments only. If a page has an `article` or `main` element with text, only text inside it counts.

A null or empty page has an empty text; a null url, or one without host, belongs to the host ''. Broken markup is read as HTML reads it;
blocks more than 120 deep belong to the element there. Repeated rows come out repeated, an empty table gives no rows, null ids stay null, other columns do not
matter. Hosts and texts are compared by 64-bit hashes. Templates and constants of hosts with a thousandth of the pages or more are broadcast, a
thousand at most; other pages meet theirs in a shuffle. Both travel with each page of the host and grow with its layouts, not its pages.
"""

from __future__ import annotations

from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .caches import Cache
from .common import arrow_map, join_back
from .page_tree import Node, merge, parsed, read, slots, written
from .url_filter import host_and_path

LEAST = 4
SHARE = 0.1
NEARLY = 0.9
#: Groups in which the label trees of a host are merged, from the first round to the last.
GROUPS = (4096, 64, 1)
_ALIGNED = Cache(lambda key: slots(*key), 2000)


def hashed(text: str) -> int:
    n = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return n - (1 << 64) if n >> 63 else n


def in_order(tree: Node) -> list[Node]:
    """All nodes, parents first, as `written` puts them."""
    out, todo = [], [tree]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += reversed(n.children)
    return out


def blocks(tree: Node) -> list[tuple[bool, str]]:
    """(inside the main element, text) of all blocks in page order."""
    return [(m, t) for _, m, t in sorted((i, n.main, t) for n in in_order(tree) for i, t in n.texts)]


def facts(html: str | None) -> tuple[int, str, list[int], list[int]]:
    """Of a page: a hash of its blocks, its label tree, and pairs (node, text at it) once each."""
    tree = read(html)
    words = xxhash.xxh64()
    for _, t in blocks(tree):
        words.update(t.encode("utf-8", "surrogatepass") + b"\n")
    n = words.intdigest()
    pairs = sorted({(k, hashed(t)) for k, node in enumerate(in_order(tree)) for _, t in node.texts})
    return n - (1 << 64) if n >> 63 else n, written(tree), [k for k, _ in pairs], [t for _, t in pairs]


def extract(html: str | None, template: str | None, constants: frozenset[tuple[int, int]] | None) -> str:
    """The text of a page without the constants (slot, text) of its host."""
    tree = read(html)
    if constants and template:
        for slot, n in zip(_ALIGNED((template, written(tree))), in_order(tree), strict=True):
            n.texts = [(i, t) for i, t in n.texts if (slot, hashed(t)) not in constants]
    found = blocks(tree)
    inside = [t for m, t in found if m]
    return "\n".join(inside or [t for _, t in found])


def _merged(batches: Iterator[dict]) -> Iterator[dict]:
    """One template for each run of rows with the same host and group."""
    key, top, n = None, None, 0

    def row() -> dict:
        return {"host": [key[0]], "group": [key[1]], "tree": [written(top)], "n": [n]}

    for b in batches:
        for host, group, tree, pages in zip(*(b[c].to_pylist() for c in ("host", "group", "tree", "n")), strict=True):
            if key != (host, group):
                if key is not None:
                    yield row()
                key, top, n = (host, group), parsed(tree)[0], pages
            else:
                merge(top, parsed(tree)[0])
                n += pages
    if key is not None:
        yield row()


def templates(trees: DataFrame) -> DataFrame:
    """(host, tree): the template of each host of `trees` (host, tree, n). Trees on many pages are merged first; the order of merging is
    fixed, so a repeated task makes the same template."""
    rows = trees.withColumn("group", F.xxhash64("tree"))
    for groups in GROUPS:
        rows = rows.withColumn("group", F.pmod("group", F.lit(groups)))
        dealt = rows.repartition("host", "group").sortWithinPartitions("host", "group", F.desc("n"), "tree").select("host", "group", "tree", "n")
        rows, _ = stored(arrow_map(dealt, _merged, "host long, group long, tree string, n long"), "templates")
    return rows.select("host", "tree")


def _slots_of(trees: DataFrame, found: DataFrame) -> DataFrame:
    """(host, shape, slots) of each label tree."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"host": b["host"], "shape": b["shape"], "slots": [slots(t, x) for t, x in zip(b["template"].to_pylist(), b["tree"].to_pylist(), strict=True)]}

    return arrow_map(trees.join(found.withColumnRenamed("tree", "template"), "host").select("host", "shape", "tree", "template"), run, "host long, shape long, slots array<int>")


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, n, template, constants): one row per host (its hash), its number of pages, its template and its constant values (slot, text)."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            got = [facts(html) for html in b["html"].to_pylist()]
            yield {"host": b["host"], **{c: [x[k] for x in got] for k, c in enumerate(("page", "tree", "nodes", "texts"))}}

    read_, _ = stored(arrow_map(pages.select("host", "html"), run, "host long, page long, tree string, nodes array<int>, texts array<long>"), "facts")
    read_ = read_.withColumn("shape", F.xxhash64("tree"))
    trees, _ = stored(read_.groupBy("host", "shape").agg(F.min("tree").alias("tree"), F.count(F.lit(1)).alias("n")), "trees")
    found = templates(trees.select("host", "tree", "n"))
    once = read_.groupBy("host", "page").agg(F.min("shape").alias("shape"), F.min_by(F.arrays_zip("nodes", "texts"), "shape").alias("pairs"))
    slotted = once.join(_slots_of(trees, found), ["host", "shape"]).select("host", F.transform("pairs", lambda p: F.struct(F.get("slots", p["nodes"]).alias("slot"), p["texts"].alias("text"))).alias("pairs"))
    held = F.transform(F.array_distinct(F.transform("pairs", lambda p: p["slot"])), lambda s: F.struct(s.alias("slot"), F.lit(None).cast("long").alias("text")))
    values = slotted.select("host", F.explode(F.concat(F.array_distinct("pairs"), held)).alias("x")).where("x.slot >= 0")
    counts, _ = stored(values.groupBy("host", "x.slot", "x.text").agg(F.count(F.lit(1)).alias("n")), "counts")
    seen = counts.where("text IS NULL").select("host", "slot", F.col("n").alias("seen"))
    often = F.col("n") >= LEAST
    totals = counts.where("text IS NOT NULL").groupBy("host", "slot").agg(F.sum("n").alias("total"), F.max("n").alias("most")).where(F.col("most") >= LEAST)
    common = counts.where(F.col("text").isNotNull() & often).join(seen.join(totals, ["host", "slot"]), ["host", "slot"]).where(F.col("n") >= SHARE * F.col("seen"))
    shares = common.groupBy("host", "slot").agg((F.sum("n") >= NEARLY * F.first("total")).alias("fixed"),
                                               F.collect_list(F.struct("text", (F.col("n") >= NEARLY * F.col("seen")).alias("nearly"))).alias("all"))
    gone = shares.select("host", "slot", F.explode("all").alias("v"), "fixed").where("fixed OR v.nearly").groupBy("host").agg(
        F.array_sort(F.collect_list(F.struct("slot", "v.text"))).alias("constants"))
    return pages.groupBy("host").agg(F.count(F.lit(1)).alias("n")).join(gone, "host", "left").join(found.withColumnRenamed("tree", "template"), "host", "left")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of `pages` (page_id, url, html)."""
    rows = pages.select("page_id", "url", "html", F.xxhash64(host_and_path(F.col("url"))[0]).alias("host"))
    found, _ = stored(wrappers(rows), "wrappers")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        last, constants = None, None
        for b in batches:
            texts, sets, trees = [], b["constants"], b["template"]
            for i, html in enumerate(b["html"].to_pylist()):
                own = sets[i].values if sets[i].is_valid else None
                if own is None:
                    last, constants = None, None
                elif last is None or not own.equals(last):
                    last, constants = own, frozenset((x["slot"], x["text"]) for x in own.to_pylist())
                texts.append(extract(html, trees[i].as_py() if constants else None, constants))
            yield {"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    met = join_back(rows, found, "host", "n").select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "template", "constants")
    return arrow_map(met, run, "page_id long, url string, text string, n_chars long")
