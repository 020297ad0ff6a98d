"""Golden values of the column functions."""

from pyspark.sql import functions as F

from filingmatch.functions import links, mail, names, people, phones, places


def values(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t")).alias("v")).collect()]


def test_names(spark):
    assert values(spark, ["Fern & Quill Ledger LLC", "Zq Nordic Technologies, Inc.", "Pelmora Oy"], lambda t: F.array_join(names.slugs(t), " ")) == [
        "fernandquillledger fern-and-quill-ledger fernandquill", "zqnordictechnologies zq-nordic-technologies zqnordic zqnordictech", "pelmora"]
    assert values(spark, ["NORTHFELL-ORMA DATA LLC", "iGlow Lamps"], names.tidy_name) == ["Northfell-Orma Data LLC", "iGlow Lamps"]
    assert values(spark, ["12 21ST AVE NW"], names.tidy_address) == ["12 21st Ave NW"]


def test_phones(spark):
    assert values(spark, ["1 (415) 624-7812", "650-555-0100", "911-222-3333", "22"], phones.usable_phone) == ["4156247812", "", "", ""]


def test_mail(spark):
    assert values(spark, ["a@gmail.com", "a@x.legalzoom.com", "a@acme.io", "no"], mail.email_kind) == ["free", "agent", "own", "none"]
    assert values(spark, ["mail.acme.io", "www.acme.co.uk"], mail.site_root) == ["acme.io", "acme.co.uk"]
    assert values(spark, ["pam.hr", "hello", "remove_me"], mail.not_a_contact) == [True, False, True]


def test_people(spark):
    texts = ["Ada Marlow", "JAMES O'HARE III", "Software Solutions", "Linda Court", "Birch Court", "J. Smith", "José Ruiz", "New York"]
    assert values(spark, texts, lambda t: people.person_name(t)) == ["Ada Marlow", "James O'Hare III", None, "Linda Court", None, None, "José Ruiz", None]
    titles = ["Meet our Owner at", "VP OF SALES", "Owner: x", "(Founder)"]
    once = values(spark, titles, people.clean_title)
    assert once == ["Owner", "VP of Sales", "", "Founder"]
    assert values(spark, once, people.clean_title) == once


def test_links(spark):
    got = values(spark, ["/c", "d#e", "../f", "//b.io/x", "https://[YOUR]/c"], lambda t: links.absolute_url(F.lit("https://a.io/x/y?z=1"), t))
    assert got == ["https://a.io/c", "https://a.io/x/d", "https://a.io/f", "https://b.io/x", ""]


def test_zip_lookup_is_a_hash_join(spark):
    df = spark.createDataFrame([("20150",), ("84048-",), ("00001",)], "z string")
    out = places.state_from_zip(df, "z", "s")
    assert sorted(r["s"] for r in out.collect()) == ["", "DC", "UT"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_signs_equal_their_patterns():
    """Texts made of phrases, halves of phrases and odd letters: the automaton against each pattern by itself."""
    import random
    import re

    from filingmatch import fixed_values as V
    from filingmatch.operators import classify
    lists = (V.STRONG_SIGNS, V.WEAK_SIGNS, V.OTHER_TRADE_SIGNS)
    signs = classify.Signs(*lists)
    rng = random.Random(3)
    words = [p for ps in lists for x in ps for p in classify.phrases(x)]
    assert {"managed it", "managed services"} <= set(words) and "a.i.-native" in words and "café" in words
    assert all(re.fullmatch(x.replace("\\b", ""), p) for ps in lists for x in ps for p in classify.phrases(x))
    for _ in range(2000):
        said = "".join(rng.choice([w, w.upper(), w.title(), w[:-1], "é", "_", "9", "x"]) + rng.choice([" ", "-", ".", "", "\n", "s ", "é", "_"]) for w in rng.choices(words, k=rng.randint(0, 8)))
        assert signs.counts(said) == [sum(bool(re.search(x, said, re.I)) for x in ps) for ps in lists], said
    assert signs.counts("PLATFORMſ") == [1, 0, 0] and signs.counts("datá") == [0, 0, 0]
