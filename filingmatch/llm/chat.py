"""Chat formatting of reply trees, in built-in functions only.

Messages form trees: each names the message it answers. Self-joins whose reach doubles every round (1, 2, 4, .. steps up) give every
message its root, its depth and the sum of scores above it, so a thread of n messages takes log2(n) rounds. The leaves of a root are
ranked by the score of their path (higher first, then the longer path, then the earlier leaf); the best ones are unrolled to all messages
of their paths by the same doubled steps, and each path becomes one conversation. Texts take part in one join and one grouping only.

The template writes a turn as `<|im_start|>role LF text<|im_end|>LF`. Inside roles and texts every `<`, any backslashes, `|` gets one
more backslash after the `<`, so no control string can stand there and one backslash less gives the text back; a line feed in a role
is written `<|lf|>`. `marks` holds, for each turn, where its piece and its text lie in the conversation (code points) and whether that text
is under the loss.

A null role or text is empty, a null score is 0. A null or unknown parent makes a root; a message whose id is null is answered by nobody;
of several messages with one id the first in order (tree, id, parent, role, text, score) is answered and the others are leaves; messages
that reach no root, as their answers go in a circle, are on no path. An empty table gives no rows. Columns beside the named ones do not
matter. Joins look up rows by a key that is unique on one side and end in a written table or another exchange, so a message with very many
answers is a skewed partition that Spark splits at run time. One path is one row at the end, since its conversation is one string; nothing else is held in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .ordering import numbered

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|lf|>"
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def from_turns(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of plain conversations (conv_id, turn, role, text): each row answers the one before it by turn, role and text."""
    plain = rows.select(F.col("conv_id").alias("tree"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    nodes = numbered(plain, ["tree", "turn", "role", "text"], "node").select("node", "tree", "role", "text")
    heads = nodes.groupBy("tree").agg(F.min("node").alias("node")).select("node", F.lit(True).alias("head"))
    links = nodes.select("node").join(heads, "node", "left").select(
        "node", F.when(F.col("head").isNull(), F.col("node") - 1).alias("up"), F.lit(0.0).alias("score"))
    return nodes, links


def from_replies(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of messages (tree, id, parent, role, text, score) that name the id they answer."""
    plain = messages.select("tree", "id", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
                            F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    nodes = numbered(plain, ["tree", "id", "parent", "role", "text", "score"], "node")
    owners = nodes.where("id is not null").groupBy("id").agg(F.min("node").alias("up")).withColumnRenamed("id", "parent")
    asking = nodes.where("parent is not null").select("node", "parent", "score")
    links = asking.join(owners, "parent", "left").select("node", "up", "score").unionByName(
        nodes.where("parent is null").select("node", F.lit(None).cast("long").alias("up"), "score"))
    return nodes.select("node", "tree", "role", "text"), links


def _reach(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(node, at, steps, gain) of every node that has a root: the root, its distance and the scores from the node up to below the
    root; and for each power of two the pairs (node, at) that are so many steps apart."""
    settled, _ = stored(links.where("up is null").select("node", F.col("node").alias("at"), F.lit(0).cast("long").alias("steps"), F.lit(0.0).alias("gain")), "roots")
    going, _ = stored(links.where("up is not null").select("node", F.col("up").alias("at"), F.lit(1).cast("long").alias("steps"), F.col("score").alias("gain")), "steps")
    levels, left, step = [], going.count(), 1
    while left:
        levels.append(going.select("node", "at"))
        above = settled.unionByName(going).select(F.col("node").alias("at"), F.col("at").alias("to"), F.col("steps").alias("more"), F.col("gain").alias("extra"))
        met = going.join(above, "at").select("node", F.col("to").alias("at"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("gain") + F.col("extra")).alias("gain"))
        met, _ = stored(met, "reach")
        step *= 2
        settled, going = settled.unionByName(met.where(F.col("steps") < step)), met.where(F.col("steps") == step)
        now = going.count()
        if now == left:         # only circles are left: a tree would have lost the nodes of exactly this depth
            break
        left = now
    return settled, levels


def paths(links: DataFrame, best: int = 1) -> DataFrame:
    """(path, node, back, rank, score): the messages on the `best` best root-to-leaf paths of each root of `links` (node, up, score).
    `path` is the leaf, `back` the distance from it."""
    links, _ = stored(links, "links")
    settled, levels = _reach(links)
    answered = links.where("up is not null").select(F.col("up").alias("node")).distinct()
    own = links.select("node", F.col("score").alias("own"))
    leaves = settled.join(answered, "node", "left_anti")
    scored = leaves.join(own.withColumnRenamed("node", "at"), "at").select(
        F.col("node").alias("path"), F.col("at").alias("root"), "steps", (F.col("gain") + F.col("own")).alias("score"))
    order = Window.partitionBy("root").orderBy(F.desc("score"), F.desc("steps"), "path")
    chosen = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    found, _ = stored(chosen.select("path", F.col("path").alias("node"), F.lit(0).cast("long").alias("back"), "rank", "score"), "leaves")
    for k, level in enumerate(levels):
        further = found.join(level, "node").select("path", F.col("at").alias("node"), (F.col("back") + (1 << k)).alias("back"), "rank", "score")
        found = found.unionByName(stored(further, "paths")[0])
    return found


def conversations(nodes: DataFrame, links: DataFrame, best: int = 1) -> DataFrame:
    """tree, rank, score, formatted and marks (array of piece_at, text_at, n_chars, loss) of each chosen path."""
    role = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit(LINE))
    head, body = F.concat(F.lit(START), role, F.lit("\n")), escaped(F.col("text"))
    turns = paths(links, best).join(nodes, "node").select(
        "path", "back", "rank", "score", "tree", F.concat(head, body, F.lit(END + "\n")).alias("piece"), F.length(head).alias("head"), F.length(body).alias("n_chars"),
        (F.col("role") == LOSS_ROLE).alias("loss"))
    before = Window.partitionBy("path").orderBy(F.desc("back")).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("piece_at", F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0)))
    mark = F.struct("piece_at", (F.col("piece_at") + F.col("head")).alias("text_at"), "n_chars", "loss")
    whole = turns.groupBy("path").agg(F.first("tree").alias("tree"), F.first("rank").alias("rank"), F.first("score").alias("score"),
                                      F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), "piece", mark.alias("mark")))).alias("turns"))
    return whole.select("tree", "rank", "score", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), F.transform("turns", lambda t: t["mark"]).alias("marks"))


def read_back(formatted: DataFrame) -> DataFrame:
    """`formatted` with `turns`, an array of role and text, and `loss_texts`, read from `formatted` and `marks`."""
    pieces = F.split("formatted", r"<\|im_end\|>\n", -1)

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        role = unescaped(F.replace(F.substr(head, F.lit(len(START) + 1)), F.lit(LINE), F.lit("\n")))
        return F.struct(role.alias("role"), unescaped(F.substr(piece, F.length(head) + 2)).alias("text"))

    def under_loss(piece: Column, mark: Column) -> Column:
        text = F.substr(piece, (mark["text_at"] - mark["piece_at"] + 1).cast("int"), mark["n_chars"])
        return F.when(mark["loss"], unescaped(text)).otherwise("")

    cut = formatted.withColumn("pieces", F.slice(pieces, 1, F.size(pieces) - 1))
    return cut.select(*formatted.columns, F.transform("pieces", turn).alias("turns"), F.zip_with("pieces", "marks", under_loss).alias("loss_texts"))


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of what `read_back` finds."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read_back(formatted).select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                                       F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
