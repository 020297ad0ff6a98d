"""Does a page describe software and IT work? A weighted count of signs.

A sign is a pattern of literals, choices and optional parts between word boundaries, so it stands for a finite list of phrases. One
automaton (Aho-Corasick) over the phrases of all signs reads each text once, however many signs there are; a hit counts if the
characters around it are no parts of a word.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as V
from ..functions.core import first_chars, let, strip, text

#: Letters that equal i and s when case is ignored, and the dot that a small dotted capital I leaves.
_FOLD = str.maketrans({"ı": "i", "ſ": "s", "\u0307": None})


def phrases(pattern: str) -> list[str]:
    """Every text that a sign matches, its word boundaries left out. Signs hold literals, escapes, groups, choices, sets and '?'."""

    def choice(at: int) -> tuple[list[str], int]:
        found, part = [], [""]
        while at < len(pattern) and pattern[at] != ")":
            if pattern[at] == "|":
                found, part, at = found + part, [""], at + 1
                continue
            if pattern.startswith("\\b", at):
                at += 2
                continue
            if pattern[at] == "(":
                item, at = choice(at + 1)
            elif pattern[at] == "[":
                end = pattern.index("]", at)
                item, at = list(pattern[at + 1:end]), end
            elif pattern[at] == "\\":
                item, at = [pattern[at + 1]], at + 1
            elif pattern[at] in "*+{.^$":
                raise ValueError(f"no finite list of phrases: {pattern}")
            else:
                item = [pattern[at]]
            at += 1
            if at < len(pattern) and pattern[at] == "?":
                item, at = ["", *item], at + 1
            part = [p + i for p in part for i in item]
        return found + part, at

    return choice(0)[0]


def _of_word(c: str) -> bool:
    return c.isalnum() or c == "_" or c in "\u200c\u200d" or unicodedata.category(c) in ("Mn", "Mc", "Me", "Pc")


class Signs:
    """Counts of the signs of each list that occur in a text."""

    def __init__(self, *lists: list[str]):
        self.lists = len(lists)
        entries: dict[str, list[tuple[int, bool]]] = {}
        self.group: list[int] = []
        for g, patterns in enumerate(lists):
            for p in patterns:
                for phrase in phrases(p):
                    entries.setdefault(phrase, []).append((len(self.group), p.endswith("\\b")))
                self.group.append(g)
        self.machine = ahocorasick.Automaton()
        for phrase, signs in entries.items():
            self.machine.add_word(phrase, (len(phrase), signs))
        self.machine.make_automaton()

    def counts(self, said: str) -> list[int]:
        low = said.lower()
        if any(c in low for c in "ıſ\u0307"):
            low = low.translate(_FOLD)
        seen: set[int] = set()
        for end, (n, signs) in self.machine.iter(low):
            start = end - n + 1
            if start and _of_word(low[start - 1]):
                continue
            open_end = end + 1 == len(low) or not _of_word(low[end + 1])
            seen.update(s for s, closed in signs if open_end or not closed)
        out = [0] * self.lists
        for s in seen:
            out[self.group[s]] += 1
        return out


@lru_cache(1)
def _signs() -> Signs:
    return Signs(V.STRONG_SIGNS, V.WEAK_SIGNS, V.OTHER_TRADE_SIGNS)


def sign_counts(*texts: Column) -> Column:
    """array<int>: how many strong, weak and other-trade signs each text has, three numbers per text. A null text has none."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def counted(*columns: pd.Series) -> pd.Series:
        count = _signs().counts
        return pd.Series([[n for x in row for n in count(x or "")] for row in zip(*columns)], dtype=object)

    return counted(*texts)


def classify(head: Column, body: Column, body_chars: int | None = None) -> Column:
    """struct(level, score) of a page: strong, weak, unknown (almost no text) or none. The whole body is read; `body_chars` bounds
    what the signs see where a deployment prefers that."""
    h, b = text(head), first_chars(text(body), body_chars)
    thin = (F.length(strip(b)) < 400) & (F.length(strip(h)) < 120)

    def judge(c: Column) -> Column:
        sh, wh, nh, sb, wb, nb = (F.get(c["n"], F.lit(i)) for i in range(6))
        score = 3.0 * sh + F.least(sb, F.lit(8)) + wh + 0.5 * F.least(wb, F.lit(5)) - 3.0 * nh - 0.5 * F.least(nb, F.lit(4))
        level = F.when(score >= 6, "strong").when(score >= 2, "weak").when(c["thin"] & (nh == 0), "unknown").otherwise("none")
        return F.struct(level.alias("level"), F.round(score, 1).alias("score"))

    return let(F.struct(sign_counts(h, b).alias("n"), thin.alias("thin")), judge)
