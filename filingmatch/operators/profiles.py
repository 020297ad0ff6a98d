"""Which profile link of a page belongs to which person.

A profile is a person's if its address or its own label names them, else if the nearest block around the link that names them names nobody
else. Blocks are ranges of the page's text and lie inside one another, so the second rule asks one thing of each link: the smallest block that
names anybody, and whether it names one person only. All names are found in one pass over the text (Aho-Corasick); their places are sorted,
and a block is looked up by binary search, stepping over runs of one name. The work is linear in the page, the links and the names, where
trying each name on each block of each link would multiply them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows whose names and texts are Python objects at a time.
ROWS = 100


def lowered(text: str) -> str:
    """Lower case, letter by letter where a letter's lower case is longer, so that places stay the same."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _machine(words) -> ahocorasick.Automaton | None:
    found = ahocorasick.Automaton()
    for w in words:
        found.add_word(w, w)
    if not len(found):
        return None
    found.make_automaton()
    return found


class _Places:
    """Where a text names whom, in order."""

    def __init__(self, machine: ahocorasick.Automaton, text: str):
        found = sorted((end - len(name) + 1, end + 1, name) for end, name in machine.iter(text))
        self.starts = [f[0] for f in found]
        self.found = found
        self.change = [len(found)] * len(found)         # the next place that names somebody else
        for i in range(len(found) - 2, -1, -1):
            self.change[i] = i + 1 if found[i + 1][2] != found[i][2] else self.change[i + 1]

    def named(self, at: int, end: int) -> list[str]:
        """Up to two different names that stand wholly between `at` and `end`."""
        names: list[str] = []
        i = bisect_left(self.starts, at)
        while i < len(self.found) and self.starts[i] < end:
            _, over, name = self.found[i]
            if over > end:
                i += 1
                continue
            if name not in names:
                names.append(name)
                if len(names) == 2:
                    break
            i = self.change[i]
        return names


def matched_profiles(names: list[str], pages: list[dict]) -> list[str]:
    """For each name the profile that is theirs on `pages` (told, links), '' where none is."""
    keys = [lowered(n) for n in names]
    ends = {k: (k.split(" ")[0], k.split(" ")[-1]) for k in keys if k.strip()}
    people, words = _machine(ends), _machine({w for pair in ends.values() for w in pair if w})
    if people is None or words is None:
        return [""] * len(names)
    by_first: dict[str, list[str]] = {}
    for key, (first, _) in ends.items():
        by_first.setdefault(first, []).append(key)
    direct: dict[str, str] = {}
    nearby: dict[str, str] = {}
    for page in pages:
        places = _Places(people, lowered(page["told"]))
        for link in page["links"]:
            url = link["url"]
            said = {w for _, w in words.iter(lowered(url))}
            hits = [k for w in said for k in by_first.get(w, ()) if ends[k][1] in said]
            for key in (*hits, *(k for _, k in people.iter(lowered(link["own"])))):
                direct.setdefault(key, url)
            for b in link["blocks"]:
                inside = places.named(b["at"], b["at"] + b["n"])
                if inside:
                    if len(inside) == 1:
                        nearby.setdefault(inside[0], url)
                    break
    return [direct.get(k, nearby.get(k, "")) for k in keys]


def with_profiles(rows: DataFrame, names: Column, pages: Column, out: str = "linked") -> DataFrame:
    """`rows` with `out`, array<string>: for each of `names` the profile that is theirs, '' where none is; null where there are no names or no
    links, so such rows carry no page text to Python. `pages`: array of struct(told, links)."""
    some = (F.size(names) > 0) & F.exists(pages, lambda p: F.size(p["links"]) > 0)
    given = rows.withColumn("_names", F.when(some, names)).withColumn("_pages", F.when(some, pages))
    keep = len(rows.columns)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            linked = [None if n is None else matched_profiles(n, p) for n, p in zip(b.column(keep).to_pylist(), b.column(keep + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:keep], pa.array(linked, pa.list_(pa.string()))], [*b.schema.names[:keep], out])

    return given.mapInArrow(found, T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.StringType()))]))
