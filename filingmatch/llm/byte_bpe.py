"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: it resolves a whole pre-token that is itself a token. Tier two merges
the bytes of a miss: neighbours are linked, and a heap yields the pair of lowest rank, leftmost first. Each Spark worker keeps a
bounded cache of what it has resolved. Vocabulary and hash are a few MB of fixed size and are broadcast.

A null text counts as empty; an empty text has no ids and decodes to nothing. Texts of any length are encoded whole. Repeated
rows come out repeated, an empty table gives no rows, other columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .caches import Cache
from .common import arrow_map, held

CACHED = 150_000
LONG = 64
_GAP = re.compile(r"(?<=\S) (?=\S)")
_RUN = re.compile(r"\s\s")
_MIX = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


def read_ranks(path: str) -> list[bytes]:
    """Tokens in order of rank from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    return [t for _, t in sorted((int(r), base64.b64decode(t)) for t, r in pairs)]


class PerfectHash:
    """A minimal perfect hash by displacement: keys fall into buckets; larger buckets choose the first displacement that sends
    all their keys to free slots, and buckets of one key are given the slots that remain."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = n // 2 + 1
        self.slots: list[int] = [-1] * n
        self.shift = [0] * self.buckets
        self.keys = keys
        groups: dict[int, list[tuple[int, int]]] = {}
        for i, k in enumerate(keys):
            h = xxhash.xxh64_intdigest(k)
            groups.setdefault(h % self.buckets, []).append((h, i))
        for b, members in sorted(groups.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(members) == 1:
                break
            d = 1
            while True:
                at = [self._slot(h, d) for h, _ in members]
                if len(set(at)) == len(at) and all(self.slots[s] < 0 for s in at):
                    break
                d += 1
            self.shift[b] = d
            for s, (_, i) in zip(at, members, strict=True):
                self.slots[s] = i
        free = iter([s for s in range(n) if self.slots[s] < 0])
        for b, members in sorted(groups.items()):
            if len(members) == 1:
                s = next(free)
                self.shift[b] = -s - 1
                self.slots[s] = members[0][1]

    def _slot(self, h: int, d: int) -> int:
        x = ((h ^ (d * _MIX)) * 0xD6E8FEB86659FD93) & _ALL
        return (x >> 20) % self.n

    def get(self, key: bytes) -> int:
        """The number of a key, -1 for anything else."""
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.buckets]
        if not d:
            return -1
        i = self.slots[-d - 1 if d < 0 else self._slot(h, d)]
        return i if self.keys[i] == key else -1


class Codec:
    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.whole = PerfectHash(tokens)
        # white space as the property of that name, whatever an engine's own class holds besides
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self._start()

    def _start(self) -> None:
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.tokens))]
        self.marks = {m: self.packed[self.rank[m.encode()]] for m in ".,;:!?" if m.encode() in self.rank}
        self.pretoken, self.word = Cache(self._pretoken, CACHED // 4), Cache(self._word, CACHED)

    def __getstate__(self):
        return (self.tokens, self.rank, self.whole, self.pattern.pattern)

    def __setstate__(self, state):
        self.tokens, self.rank, self.whole, pattern = state
        self.pattern = regex.compile(pattern)
        self._start()

    def merge(self, text: bytes) -> list[int]:
        """Ids of bytes that are no token: a heap over linked neighbours. An entry holds rank, start and end of a joined pair in
        one integer, so equal ranks come leftmost first; an entry whose parts have changed since is skipped."""
        n, get, push, pop = len(text), self.rank.get, heapq.heappush, heapq.heappop
        wide = n.bit_length()
        mask, two = (1 << wide) - 1, 2 * wide
        end = list(range(1, n + 1))             # of the part that starts here; 0 once it was joined to an earlier one
        before = list(range(-1, n))
        heap = []
        for i in range(n - 1):
            r = get(text[i:i + 2])
            if r is not None:
                heap.append((r << two) | (i << wide) | (i + 2))
        heapq.heapify(heap)
        while heap:
            x = pop(heap)
            i, stop = (x >> wide) & mask, x & mask
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                r = get(text[i:end[stop]])
                if r is not None:
                    push(heap, (r << two) | (i << wide) | end[stop])
            p = before[i]
            if p >= 0:
                r = get(text[p:stop])
                if r is not None:
                    push(heap, (r << two) | (p << wide) | stop)
        out, i = [], 0
        while i < n:
            out.append(get(text[i:end[i]]))
            i = end[i]
        return out

    def _pretoken(self, s: str) -> bytes:
        b = s.encode()
        i = self.whole.get(b)
        return self.packed[i] if i >= 0 else b"".join([self.packed[x] for x in self.merge(b)])

    def _word(self, s: str) -> bytes:
        """A piece that a single space precedes. All letters, or letters and one mark, are one and two matches of the pattern."""
        if s.isalpha():
            return self._pretoken(" " + s)
        if s[:-1].isalpha() and s[-1] in ".,;:!?":
            return self.word(s[:-1]) + self._pretoken(s[-1])
        return self._piece(" " + s)

    def _piece(self, s: str) -> bytes:
        return b"".join([self.pretoken(x) if len(x) < LONG else self._pretoken(x) for x in self.pattern.findall(s)])

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. A single space between other characters always begins a match of the
        pattern, so the text is cut there and each piece is looked up by itself."""
        if not text:
            return b""
        pieces = _GAP.split(text) if _RUN.search(text) else text.split(" ")
        get, word, marks = self.word.young.get, self.word, self.marks
        out = [self._piece(pieces[0])]
        for p in pieces[1:]:
            got = get(p)
            if got is None:
                if len(p) >= LONG:
                    got = self._word(p) if " " not in p else self._piece(" " + p)
                elif p and (m := marks.get(p[-1])) and p[:-1].isalpha():
                    got = (get(p[:-1]) or word(p[:-1])) + m
                else:
                    got = word(p)
                get = word.young.get
            out.append(got)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def encoded(docs: DataFrame, path: str, pattern: str, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens and `ids` (little-endian unsigned 32-bit integers) of every row of `docs` (doc_id, text). With `digests`,
    the ids are decoded too and SHA-256 digests of ids and decoded bytes are returned in place of `ids`."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(codec(path, pattern))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        c = held(shared)
        for b in batches:
            ids = [c.encode(t) for t in b["text"].to_pylist()]
            got = {"doc_id": b["doc_id"], "n_tokens": [len(x) // 4 for x in ids]}
            if digests:
                got["ids_sha256"] = [hashlib.sha256(x).hexdigest() for x in ids]
                got["decoded_sha256"] = [hashlib.sha256(c.decode(x)).hexdigest() for x in ids]
            else:
                got["ids"] = ids
            yield got

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow_map(plain, run, "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids binary"))


def decoded(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and `text`, the decoded bytes, of rows made by `encoded`."""
    shared = rows.sparkSession.sparkContext.broadcast(codec(path, pattern))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"doc_id": b["doc_id"], "text": [held(shared).decode(x) for x in b["ids"].to_pylist()]}

    return arrow_map(rows.select("doc_id", "ids"), run, "doc_id long, text binary")
