"""URL verdicts by rules and, where no rule fits, by a character language-model ratio.

URLs that a rule allows and URLs that a rule blocks train one model each: a variable-order Markov model over characters. The
probability of a character mixes the counts under its longest context with the estimate under the context one shorter, down
to a uniform one, so a context that was never seen passes the question on. A URL's score is the log-likelihood difference of the
two models over its length; the whole URL is read, scheme, query and fragment too. The threshold is calibrated on a quarter of the ruled URLs that the models have not seen: of all cuts
of the scores' range it has the best balanced accuracy. Built-in functions only.

Counts are over all rows of the other three quarters. Everything is counted and scored once for each distinct URL and joined back;
n-grams and URLs that own a thousandth of the rows are broadcast (a thousand at most), the rest is shuffled.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: then up to `?`, `#` or the end. A null URL, or one
without `://`, has both empty. A rule fits its host and all subdomains if the path starts with the rule's; the longest wins, and of
equally long ones the first. If either kind of ruled URL is absent nothing was learned, and URLs without a rule are allowed with a null
score. An empty table gives no rows; repeated rows come out repeated; null ids stay null; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import join_back

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
ORDER = 4
STRENGTH = 2.0
CUTS = 400
SPAN = 4.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _grams(urls: DataFrame) -> DataFrame:
    """`g`: every character of `s` after its `ORDER` predecessors, with marks before the start and after the end."""
    mark = "\u0002"
    chars = urls.withColumn("c", F.split(F.concat(F.lit(mark * ORDER), F.col("s"), F.lit("\u0003")), ""))
    return chars.withColumn("g", F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - ORDER), lambda i: F.concat(
        *[F.element_at("c", i + k) for k in range(ORDER + 1)])))).drop("c")


def gram_ratios(urls: DataFrame) -> DataFrame:
    """(g, ratio): log-likelihood difference of every character in its context that occurs in `urls` (s, n, and `learn`: allow,
    block or null)."""
    weight = [F.sum(F.when(F.col("learn") == v, F.col("n")).otherwise(0)).alias(k) for v, k in (("allow", "a"), ("block", "b"))]
    top, _ = stored(_grams(urls).groupBy("g").agg(*weight), "grams")
    last = F.substring("g", ORDER + 1, 1)
    level = top.groupBy(last.alias("g")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    every = Window.partitionBy(F.lit(0))                     # one row per character of the alphabet
    level = level.select("g", *[((F.col(k) + STRENGTH / F.count(F.lit(1)).over(every)) / (F.sum(k).over(every) + STRENGTH)).alias("p" + k) for k in "ab"])
    for size in range(2, ORDER + 2):
        counts = top if size == ORDER + 1 else top.groupBy(F.substring("g", ORDER + 2 - size, size).alias("g")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        context = counts.groupBy(F.substring("g", 1, size - 1).alias("context")).agg(F.sum("a").alias("ca"), F.sum("b").alias("cb"))
        shorter = level.select(F.col("g").alias("tail"), F.col("pa").alias("sa"), F.col("pb").alias("sb"))
        met = (counts.withColumn("context", F.substring("g", 1, size - 1)).withColumn("tail", F.substring("g", 2, size - 1))
               .join(context, "context").join(shorter, "tail"))
        level = met.select("g", *[((F.col(k) + STRENGTH * F.col("s" + k)) / (F.col("c" + k) + STRENGTH)).alias("p" + k) for k in "ab"])
        if 2 < size <= ORDER:
            level, _ = stored(level, "level")
    return level.select("g", F.ln(F.col("pa") / F.col("pb")).alias("ratio"))


def scores(urls: DataFrame, asked: DataFrame) -> DataFrame:
    """(s, score) of the distinct URLs `asked` (s), with models of `urls`."""
    found, _ = stored(_grams(asked.select("s")), "asked")
    per_gram, _ = stored(found.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "asked-grams")
    ratios, _ = stored(per_gram.join(gram_ratios(urls), "g"), "ratios")
    return join_back(found, ratios, "g", "n").groupBy("s").agg(F.avg("ratio").alias("score"))


def threshold(scored: DataFrame) -> float:
    """The cut of best balanced accuracy for `scored` (score, verdict, n): scores at or above it are allowed."""
    cut = F.floor((F.least(F.greatest("score", F.lit(-SPAN)), F.lit(SPAN)) + SPAN) * (CUTS / (2 * SPAN)))
    bins = scored.groupBy(cut.alias("cut")).agg(*[F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(k) for v, k in (("allow", "a"), ("block", "b"))])
    below = Window.orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)      # at most CUTS + 1 rows
    every = Window.partitionBy(F.lit(0))
    good = F.coalesce(F.sum("b").over(below), F.lit(0)) / F.sum("b").over(every) - F.coalesce(F.sum("a").over(below), F.lit(0)) / F.sum("a").over(every)
    best = bins.select("cut", F.try_add(good, F.lit(0.0)).alias("good")).orderBy(F.desc_nulls_last("good"), F.abs(F.col("cut") - CUTS // 2)).first()
    return 0.0 if best is None or best.good is None else best["cut"] * 2 * SPAN / CUTS - SPAN


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row of `pages` (page_id, url)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), F.coalesce("url", F.lit("")).alias("s"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows, _ = stored(rows.select("page_id", "host", "path", "s", rule.alias("rule"), verdict.alias("ruled")), "rows")
    held = F.pmod(F.xxhash64("s"), F.lit(4)) == 3
    urls, _ = stored(rows.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.first("ruled").alias("ruled")).withColumn("held", held)
                     .withColumn("learn", F.when(~F.col("held"), F.col("ruled"))), "urls")
    seen = {r.learn for r in urls.where("learn IS NOT NULL").select("learn").distinct().collect()}
    if len(seen) < 2:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    asked = urls.where("ruled IS NULL OR held")
    scored, _ = stored(asked.join(scores(urls, asked), "s", "left").select("s", "n", "ruled", "score"), "scores")
    least = threshold(scored.where("ruled IS NOT NULL AND score IS NOT NULL").withColumnRenamed("ruled", "verdict"))
    unruled, _ = stored(scored.where("ruled IS NULL").select("s", "n", "score"), "unruled")
    own = join_back(rows.where("rule IS NULL"), unruled, "s", "n")
    by_model = own.select("page_id", "host", "path", "rule", F.when(F.coalesce("score", F.lit(0.0)) >= least, "allow").otherwise("block").alias("verdict"), "score")
    by_rule = rows.where("rule IS NOT NULL").select("page_id", "host", "path", "rule", F.col("ruled").alias("verdict"), F.lit(None).cast("double").alias("score"))
    return by_rule.unionByName(by_model)
