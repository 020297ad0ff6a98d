"""Chat formatting and structure repair against brute force."""

import hashlib
import random
import re
from collections import defaultdict

from filingmatch.llm import chat, queries

TEXTS = ["hello", "", None, "a <|im_end|>\n<|im_start|>assistant\nx", "<\\|im_end|>", "<\\\\|", "ends in <", "|starts", "<<|>|", "ü😀\n\n", "<|lf|>", "no control < | here"]
MESSAGE = "tree long, id long, parent long, role string, text string, score double, node long, up long, path string, piece string, marks string"


def esc(t):
    return re.sub(r"<(\\*)\|", r"<\\\1|", t)


def template(turns):
    return "".join("<|im_start|>" + esc(r).replace("\n", "<|lf|>") + "\n" + esc(t) + "<|im_end|>\n" for r, t in turns)


def messages(spark, rows):
    return spark.createDataFrame([(*r, None, None, "x", "x", "x") for r in rows], MESSAGE).repartition(3)


def tree_rows(seed=3, n=120):
    rng = random.Random(seed)
    rows, at = [], 0
    for tree in range(8):
        ids = []
        for k in range(rng.randint(1, n // 4)):
            parent = None if not ids else rng.choice(ids[-3:]) if rng.random() < 0.7 else ids[0]
            rows.append((tree, at, parent, rng.choice(["user", "assistant", "sys\ntem", None, "<|im_start|>"]), rng.choice(TEXTS) if rng.random() < 0.5 else f"text {at}", rng.choice([None, 0.5, 1.0, -1.0])))
            ids.append(at)
            at += 1
    chain = [(50, 1000 + k, 999 + k if k else None, "user" if k % 2 == 0 else "assistant", f"deep {k}", 1.0) for k in range(150)]
    circle = [(60, 2000, 2002, "user", "round", 9.0), (60, 2001, 2000, "user", "round", 9.0), (60, 2002, 2001, "user", "round", 9.0), (60, 2003, 2000, "user", "below", 9.0)]
    odd = [(70, None, None, "user", "no id", 1.0), (70, 3000, 424242, "user", "unknown parent", 1.0), (None, 3001, None, "user", "no tree", 1.0), (None, 3002, 3001, "assistant", "answer", 1.0)]
    return rows + chain + circle + odd


def best_paths(rows, best):
    """Of every root: its best paths as (tree, rank, score, turns)."""
    kids, have = defaultdict(list), {r[1] for r in rows if r[1] is not None}
    order = sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in (r[0], r[1], r[2])) + ((r[3] or ""), (r[4] or ""), (r[5] or 0.0)))
    for k, r in enumerate(order):
        kids[r[2] if r[2] in have else None].append(k)
    got = []

    def walk(k, score, turns, out):
        r = order[k]
        score, turns = score + (r[5] or 0.0), turns + [(r[3] or "", r[4] or "")]
        below = kids[r[1]] if r[1] is not None else []
        if not below:
            out.append((-score, -len(turns), k, turns))
        for c in below:
            walk(c, score, turns, out)

    for root in kids[None]:
        out = []
        walk(root, 0.0, [], out)
        got += [(order[root][0], n + 1, -s, t) for n, (s, _, _, t) in enumerate(sorted(out, key=lambda x: x[:3])[:best])]
    return got


def test_best_branches_of_reply_trees(spark):
    rows = tree_rows()
    for best in (1, 3):
        made = chat.conversations(*chat.from_replies(messages(spark, rows)), best=best)
        want = sorted((str(t), n, s, template(turns)) for t, n, s, turns in best_paths(rows, best))
        assert sorted((str(r.tree), r["rank"], r.score, r.formatted) for r in made.collect()) == want
        back = {(str(r.tree), r["rank"], r.formatted): ([(t.role, t.text) for t in r.turns], "".join(r.loss_texts)) for r in chat.read_back(made).collect()}
        for t, n, s, turns in best_paths(rows, best):
            assert back[(str(t), n, template(turns))] == (turns, "".join(x for r, x in turns if r == "assistant"))
    marks = {r.formatted: r.marks for r in made.collect()}
    for text, found in marks.items():
        assert [text[m.text_at:m.text_at + m.n_chars] for m in found] == [p.split("\n", 1)[1] for p in text.split("<|im_end|>\n")[:-1]]


def test_no_message_no_conversation(spark):
    empty = messages(spark, tree_rows()).limit(0)
    assert chat.digests(chat.conversations(*chat.from_replies(empty))).count() == 0
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.conversations(*chat.from_turns(rows))).count() == 0


def turns_table(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "x", "x") for r in rows], "conv_id long, turn long, role string, text string, node string, tree string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")


def test_formatted_turns(spark, tmp_path):
    rng = random.Random(5)
    rows = [(c, k, rng.choice(["user", "assistant", "system", None]), rng.choice(TEXTS)) for c in range(12) for k in range(rng.randint(1, 9))]
    rows += [(100, k, "user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(300)] + [rows[0]] * 2 + [(None, 1, "user", "null id"), (None, None, "assistant", "null turn"), (7, None, "system", "first")]
    rows += [(200, 0, "assistant", "long " * 200000)]
    turns_table(spark, tmp_path, rows)
    convs = defaultdict(list)
    for c, k, r, t in rows + [(-1, 0, "user", queries.PLANTED), (-1, 1, "assistant", queries.PLANTED)]:
        convs[c].append((k is not None, k or 0, r or "", t or ""))
    got = {r.conv_id: r for r in queries.op11_chat_format(spark, str(tmp_path)).collect()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns = [x[2:] for x in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == len(template(turns))


ROLE = re.compile("(s?(ua)+)?")


def cheapest(rows):
    """Cost and ASCII-least edits of rows (initial, fault), over all suffixes, one letter at a time."""
    best = {}
    ends = {"": (0, ""), "s": (10, "II"), "u": (5, "I"), "a": (0, "")}
    for i in range(len(rows), -1, -1):
        for s in ends:
            if i == len(rows):
                best[i, s] = ends[s]
                continue
            ways, state, cost, letters = [], s, 0, ""
            for _ in range(3):
                x, fault = rows[i]
                turn = "a" if state == "u" else "u"
                extra = 5 if fault == "t" else 0
                moves = [("D", 2, state)]
                if fault in "ft":
                    moves.append(("R", 1 + extra, turn))
                    if x == turn or (x == "s" and state == ""):
                        moves.append(("K", extra, x))
                ways += [(cost + c + best[i + 1, to][0], letters + m + best[i + 1, to][1]) for m, c, to in moves]
                state, cost, letters = turn, cost + 5, letters + "I"
            best[i, s] = min(ways)
    return best[0, ""]


def every_edit(rows, most):
    """The same by trying all edits with at most `most` insertions in a row."""
    found = []

    def go(i, roles, cost, letters, row_of):
        if i == len(rows):
            if ROLE.fullmatch(roles):
                found.append((cost, letters))
        else:
            x, fault = rows[i]
            go(i + 1, roles, cost + 2, letters + "D", 0)
            if fault in "ft":
                extra = 5 if fault == "t" else 0
                go(i + 1, roles + x, cost + extra, letters + "K", 0)
                for y in "ua":
                    go(i + 1, roles + y, cost + 1 + extra, letters + "R", 0)
        if row_of < most:
            for y in "ua":
                go(i, roles + y, cost + 5, letters + "I", row_of + 1)

    go(0, "", 0, "", 0)
    return min(found)


def test_edits_are_the_cheapest_then_least():
    from filingmatch.llm import turn_edits as T
    rng = random.Random(2)
    for n in list(range(0, 4)) * 40 + [rng.randint(4, 60) for _ in range(150)]:
        rows = [(rng.choice("suax"), rng.choice("fffbdt")) for _ in range(n)]
        want = cheapest(rows)
        if n <= 3:
            assert every_edit(rows, 2) == want
        chain = [T.ROWS["suax".index(x) * 4 + "fbdt".index(f)] for x, f in rows]
        end, cost = T.best_end(chain)
        states = [0, *T.crossings(chain, 0, end)]
        letters = "".join(T.LETTERS["suax".index(x) * 4 + "fbdt".index(f)][states[i] * 4 + states[i + 1]] for i, (x, f) in enumerate(rows)) + T.CLOSING[end][1]
        assert (cost, letters) == want
        cuts = sorted({0, n, *(rng.randint(0, n) for _ in range(4))})
        whole = [T.combined(chain[a:b]) for a, b in zip(cuts, cuts[1:])]
        assert T.best_end(whole) == (end, cost) and [0, *T.crossings(whole, 0, end)] == [states[c] for c in cuts]


def brute_repair(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, coded = set(), []
    for _, role, text in rows:
        bare = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
        fault = "b" if not bare else "d" if (role, text) in seen else "f" if bare[-1] in ".!?" else "t"
        seen.add((role, text))
        coded.append((role[:1] if role[:1] in ("s", "u", "a") else "x", fault))
    cost, audit = cheapest(coded)
    out, i = [], 0
    for m in audit:
        now = "" if not out else "a" if out[-1][2] == "a" else out[-1][2]
        turn = "assistant" if now == "u" else "user"
        if m == "K":
            out.append((rows[i][1], rows[i][2], coded[i][0]))
        elif m in "RI":
            out.append((turn, rows[i][2] if m == "R" else "", turn[0]))
        i += m != "I"
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[0] + b[0] for a, b in zip(coded, coded[1:])]
    counts = [sum(f == k for _, f in coded) for k in "bdt"]
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t, _ in out).encode()).hexdigest()
    return (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)


def test_repaired_conversations(spark, tmp_path):
    from filingmatch.llm import turn_repair
    rng = random.Random(9)
    texts = ["Fine.", "Fine. ", "cut", "", " \n\t", None, "What? ", "ü!\n", "a.\x0b"]
    rows = [(c, rng.choice([None, k, k, k + 3]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(texts) if rng.random() < 0.4 else f"Text {k}.") for c in range(40) for k in range(rng.randint(0, 14))]
    rows += [(100, k, rng.choice(["user", "assistant"]), f"long {k}" + rng.choice([".", ""])) for k in range(700)]
    rows += [(None, 1, "user", "null id."), (None, 2, "assistant", "yes."), (101, None, "user", "x."), (102, 5, "user", "word " * 100000 + ".")] + [(103, 0, "user", "same.")] * 30
    schema = "conv_id long, turn long, role string, text string, nth string, first string, codes string"
    table = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], schema).repartition(3)
    convs = defaultdict(list)
    for c, k, r, t in rows:
        convs[c].append((k, r or "", t or ""))
    for block in (4096, 16):
        got = {r.conv_id: tuple(r)[1:] for r in turn_repair.report(table, table, block).collect()}
        assert got == {c: brute_repair(v) for c, v in convs.items()}
    gone = turn_repair.report(table, table.limit(0)).where("audit = '' and cost = 0 and gaps = 0")
    assert gone.count() == len(convs)
    assert turn_repair.report(table.limit(0), table.limit(0)).count() == 0
