"""Small tables with nulls, empty and long texts, ties, repeated rows and columns whose names clash with the operators' own."""

import random

CLASH = "doc_id long, text string, lang string, source string, n_chars long, kept string, h string, row string, shard string, hit string, fp string, root string, t string, d string, kt string, items string"


def documents(spark, rows):
    """rows: (doc_id, text, lang)."""
    return spark.createDataFrame([(i, t, lang, "s", None, *("x" * 11)) for i, t, lang in rows], CLASH).repartition(3)


def sample(seed=7, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgéü") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    long = " ".join(rng.choice(vocab) for _ in range(9000))
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 120))) for _ in range(n)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    rows += [(100, None, None), (101, "", "en"), (102, "  \n\t ", None), (103, long, "en"), (104, long + " end", "en"), (105, texts[0], "en"), (106, texts[0].replace(" ", "\n"), "en"),
             (107, texts[1] + " x", "en"), (None, texts[2], "en"), (None, None, "en"), (108, "a b a b " * 40, "en"), (109, passage, "en"), (110, texts[3] + " " + passage, "en"),
             (111, "Emoji 😀 and 12 words's.", "en"), (112, "12 34 !", "en"), (113, "a\x1cb\x85c\xa0d", "en")]
    rows += [rows[5]] * 2 + [(114, texts[4], "en")] * 3
    return rows
