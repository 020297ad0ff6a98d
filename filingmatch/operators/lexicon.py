"""Given names learned from the tables: what begins the names of people and not those of companies.

Each distinct name counts once. A first word's score is the share of its uses that are people's, both sides weighted to the same size. The
threshold is fitted on a quarter of the names that the scores have not seen (dealt by a hash of the name): of `STEPS` cuts the one that best tells held-out people from
held-out companies by their first word. Counts are aggregates with map-side combine over all rows; what comes out is one row per first word
of people, which a language bounds, not the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.core import squeeze
from ..functions.people import Lexicon
from ..session import durable

STEPS = 9
#: Different names that a first word has to begin.
LEAST = 2
#: Words that a lexicon may hold: it becomes one set in the expressions that ask it.
MOST = 100_000


def _named(names: DataFrame, person: bool) -> DataFrame:
    """(word, person, held) of each distinct name of two words or more."""
    low = names.select(F.lower(squeeze(F.col(names.columns[0]))).alias("name")).distinct()
    words = F.split("name", " ")
    return low.where(F.size(words) >= 2).select(F.rtrim(F.get(words, F.lit(0)), F.lit(".")).alias("word"), F.lit(person).alias("person"), F.substring(F.md5("name"), 1, 1).isin(*"0123").alias("held"))


def scored(names: DataFrame) -> DataFrame:
    """(word, n, score): people's names that begin with the word, and its score in thousandths, from rows (word, person)."""
    both = names.groupBy("word").agg(F.count_if("person").alias("n"), F.count_if(~F.col("person")).alias("other"))
    people, others = (max(1, x) for x in names.agg(F.count_if("person"), F.count_if(~F.col("person"))).first())
    share = F.expr(f"(n * {others}L * 1000) div (n * {others}L + other * {people}L)")
    return both.where("n > 0").select("word", "n", share.alias("score"))


def given_names(people: DataFrame, companies: DataFrame) -> DataFrame:
    """(word, n, score, cut): the words that begin people's names, of the one-column tables `people` and `companies`."""
    names = durable(_named(people, True).unionByName(_named(companies, False)))
    known = scored(names.where(~F.col("held")))
    asked = names.where("held").join(known, "word", "left").select("person", F.coalesce("score", F.lit(-1)).alias("score"))
    cuts = F.array(*[F.lit(1000 * k // (STEPS + 1)) for k in range(1, STEPS + 1)])
    rates = asked.select("person", "score", F.explode(cuts).alias("cut")).groupBy("cut").agg(
        (F.count_if(F.col("person") & (F.col("score") >= F.col("cut"))) * F.greatest(F.count_if(~F.col("person")), F.lit(1))
         - F.count_if(~F.col("person") & (F.col("score") >= F.col("cut"))) * F.greatest(F.count_if("person"), F.lit(1))).alias("gain"))
    best = rates.agg(F.coalesce(F.max_by("cut", F.struct("gain", -F.col("cut"))), F.lit(500))).first()[0]
    return scored(names).withColumn("cut", F.lit(best)).where((F.col("score") >= F.col("cut")) & (F.col("n") >= LEAST))


def learned(people: DataFrame, companies: DataFrame) -> Lexicon:
    """The default names and the learned ones. More than `MOST` words are an error: such a list is no list of given names."""
    words = [r.word for r in given_names(people, companies).select("word").orderBy("word").limit(MOST + 1).collect()]
    if len(words) > MOST:
        raise ValueError(f"over {MOST} first words look like given names; check the table of people")
    return Lexicon(tuple(sorted({*V.DEFAULT_GIVEN_NAMES, *words})))
