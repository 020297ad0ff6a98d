"""Conversation structure repair by Hirschberg's divide and conquer.

Rows of a conversation are taken by turn (nulls first), role and text. Each row's first fault counts: blank (no character but white
space), duplicate (role and text stood earlier in the conversation), truncated (the last character that is no white space is none of . ! ?).
Edits turn the roles into `(s?(ua)+)?`: Keep 0, Rerole to user or assistant 1, Delete 2 (the only one for blank and duplicate rows), Insert an
empty user or assistant turn 5, and 5 more for a truncated row that stays. Of the cheapest edits the ASCII-least letters count.

Only a code of one byte per row (class of the role, fault) meets in one place. Sorted rows are cut into blocks of at most `BLOCK` rows of one
conversation; each block becomes a 4 x 4 matrix (`turn_edits`), a conversation's matrices, one for each 4,096 rows, give the states at
the borders of its blocks, and each block is then solved alone between its border states: at both levels cost vectors from the
front and from the back meet in the middle. Edits go back to the rows by a join on the row number, so texts move once. A hot conversation
is many blocks in many tasks.

A null role or text is empty; a role without a first letter of s, u, a can be reroled or deleted. A null conv_id is a conversation of its own. Repeated
rows are duplicates. Columns beside the named ones do not matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from . import turn_edits as T
from .common import arrow_map
from .ordering import numbered

BLOCK = 4096
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_BLOCK = "conv_id long, first long, codes binary, costs array<long>, places array<int>, head string, tail string, blank long, duplicate long, truncated long, illegal long"
_LEGAL = {"su", "ua", "au"}


def coded(rows: DataFrame) -> DataFrame:
    """conv_id, nth and code of every row of `rows` (conv_id, nth, role, text)."""
    bare = F.rtrim("text", F.lit(SPACE))
    seen = rows.select("conv_id", "nth", "role", F.sha2("text", 256).alias("h")).groupBy("conv_id", "role", "h").agg(F.min("nth").alias("nth")).select("nth", F.lit(True).alias("new"))
    kind = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in T.CLASSES]), F.left("role", F.lit(1))), F.lit(0))
    plain = rows.select("conv_id", "nth", F.when(kind == 0, 3).otherwise(kind - 1).alias("kind"), (bare == "").alias("blank"), F.right(bare, F.lit(1)).isin(".", "!", "?").alias("whole"))
    fault = F.when(F.col("blank"), T.BLANK).when(F.col("new").isNull(), T.DUPLICATE).when(~F.col("whole"), T.TRUNCATED).otherwise(T.FINE)
    return plain.join(seen, "nth", "left").select("conv_id", "nth", (F.col("kind") * 4 + fault).cast("int").alias("code"))


def _illegal(classes: str) -> int:
    return sum(classes[i:i + 2] not in _LEGAL for i in range(len(classes) - 1))


def _block(conv, first: int, codes: bytes) -> tuple:
    """A row of `_BLOCK`."""
    costs, places = T.combined([T.ROWS[c] for c in codes])
    classes = "".join("sua?"[c >> 2] for c in codes)
    faults = [sum(c & 3 == k for c in codes) for k in (T.BLANK, T.DUPLICATE, T.TRUNCATED)]
    return conv, first, codes, costs, places, classes[0], classes[-1], *faults, _illegal(classes)


def _columns(rows: list[tuple], names: list[str]) -> dict:
    return dict(zip(names, (list(c) for c in zip(*rows))))


def blocks(codes: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each stretch of at most `block` rows of one conversation."""
    names = [f.split()[0] for f in _BLOCK.split(", ")]

    def run(batches: Iterator[dict]) -> Iterable[dict]:
        conv, first, held = None, None, bytearray()
        for b in batches:
            ids, nth, code = b["conv_id"].to_pylist(), b["nth"].to_numpy(), b["code"].to_numpy().astype(np.uint8).tobytes()
            done, at = [], 0
            while at < len(ids):
                end = at
                while end < len(ids) and ids[end] == ids[at] and (end == at or nth[end] == nth[end - 1] + 1):
                    end += 1
                joins = held and conv == ids[at] and first + len(held) == nth[at]
                if held and not joins:
                    done.append(_block(conv, first, bytes(held)))
                    held = bytearray()
                if not held:
                    conv, first = ids[at], int(nth[at])
                held += code[at:end]
                while len(held) > block:
                    done.append(_block(conv, first, bytes(held[:block])))
                    first, held = first + block, held[block:]
                at = end
            if done:
                yield _columns(done, names)
        if held:
            yield _columns([_block(conv, first, bytes(held))], names)

    return arrow_map(codes.repartitionByRange("nth").sortWithinPartitions("nth").select("conv_id", "nth", "code"), run, _BLOCK)


def borders(parts: DataFrame) -> DataFrame:
    """Of each conversation: cost, counts of faults, and the states before and after each of its blocks."""
    grouped = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("first", "costs", "places", "head", "tail"))).alias("parts"),
                                           *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])

    def run(batches: Iterator[dict]) -> Iterable[dict]:
        for b in batches:
            out = []
            for conv, ps, *counts in zip(*(b[c].to_pylist() for c in ("conv_id", "parts", "blank", "duplicate", "truncated", "illegal"))):
                chain = [(tuple(p["costs"]), tuple(p["places"])) for p in ps]
                end, cost = T.best_end(chain)
                states = [T.START, *T.crossings(chain, T.START, end)]
                counts[3] += sum(_illegal(x["tail"] + y["head"]) for x, y in zip(ps, ps[1:]))
                cuts = [{"first": p["first"], "p": states[k], "q": states[k + 1], "last": k == len(ps) - 1} for k, p in enumerate(ps)]
                out.append((conv, cost, *counts, cuts))
            yield _columns(out, ["conv_id", "cost", "blank", "duplicate", "truncated", "illegal", "cuts"])

    return arrow_map(grouped, run, "conv_id long, cost long, blank long, duplicate long, truncated long, illegal long, cuts array<struct<first: long, p: int, q: int, last: boolean>>")


def edits(parts: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv_id, first, audit (the block's letters) and turns (nth, seq, letter, role of each turn that stays or comes in) of each block."""
    cuts = conversations.select(F.explode("cuts").alias("c")).select("c.*")
    role = ("", "", "user", "assistant")

    def run(batches: Iterator[dict]) -> Iterable[dict]:
        for b in batches:
            out = []
            for conv, first, codes, p, q, last in zip(*(b[c].to_pylist() for c in ("conv_id", "first", "codes", "p", "q", "last"))):
                audit, turns, state = [], [], p
                for k, after in enumerate(T.crossings([T.ROWS[c] for c in codes], p, q)):
                    letters = T.LETTERS[codes[k]][state * 4 + after]
                    audit.append(letters)
                    for seq, letter in enumerate(letters):
                        if letter == "I" or letter == "R":
                            state = T.follows(state)
                        if letter != "D":
                            turns.append({"nth": first + k, "seq": seq, "letter": letter, "role": None if letter == "K" else role[state]})
                    state = after
                if last:
                    audit.append(T.CLOSING[state][1])
                    for seq in range(len(audit[-1])):
                        state = T.follows(state)
                        turns.append({"nth": first + len(codes) - 1, "seq": 9 + seq, "letter": "I", "role": role[state]})
                out.append((conv, first, "".join(audit), turns))
            yield _columns(out, ["conv_id", "first", "audit", "turns"])

    return arrow_map(parts.join(cuts, "first").select("conv_id", "first", "codes", "p", "q", "last"), run,
                     "conv_id long, first long, audit string, turns array<struct<nth: long, seq: int, letter: string, role: string>>")


def repaired(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Of `rows` (conv_id, turn, role, text): the conversations (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), and
    their repaired turns (conv_id, nth, seq, role, text), in the order of nth and seq."""
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    texts = numbered(plain, ["conv_id", "turn", "role", "text"])
    parts = durable(blocks(coded(texts), block))
    whole = durable(borders(parts))
    done = durable(edits(parts, whole))
    turns = done.select("conv_id", F.explode("turns").alias("t")).select("conv_id", "t.*")
    own = texts.select("nth", F.col("role").alias("own"), "text")
    stay = turns.where("letter <> 'I'").join(own, "nth").select("conv_id", "nth", "seq", F.coalesce("role", "own").alias("role"), "text")
    come = turns.where("letter = 'I'").select("conv_id", "nth", "seq", "role", F.lit("").alias("text"))
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    facts = [whole.drop("cuts"), texts.groupBy("conv_id").agg(F.coalesce(span, F.lit(0)).alias("gaps")),
             done.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "audit"))), lambda p: p["audit"]), "").alias("audit"))]
    return merged(facts, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]), stay.unionByName(come)


def merged(facts: list[DataFrame], columns: list[str]) -> DataFrame:
    """One row per conv_id (nulls too) of tables that hold at most one each; a column that none has a value for is null."""
    every = facts[0]
    for f in facts[1:]:
        every = every.unionByName(f, allowMissingColumns=True)
    return every.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in columns])


def report(original: DataFrame, damaged: DataFrame, block: int = BLOCK) -> DataFrame:
    """What `repaired` finds in `damaged`, with a digest of the repaired turns, for every conv_id of `original`. The digest is over one
    string per conversation."""
    whole, turns = repaired(damaged, block)
    said = F.array_sort(F.collect_list(F.struct("nth", "seq", F.concat("role", F.lit(":"), "text").alias("line"))))
    hashed = turns.groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(said, lambda x: x["line"]), "\n"), 256).alias("repaired_sha256"))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = merged([original.select("conv_id").distinct(), whole, hashed], [*counts, "audit", "repaired_sha256"])
    return every.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
