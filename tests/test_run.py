"""The whole run, from filings to the next version of the state table, and what re-judging makes of it."""

from pyspark.sql import functions as F

from filingmatch.operators import rules, state
from filingmatch.plans import flagship
from filingmatch.plans.companies import companies
from filingmatch.plans.section_a import all_filings
from filingmatch.schemas import COMPANY
from filingmatch.session import durable

SF = "/root/testdata/sf0.001"


def test_the_run_feeds_the_second_judgement(spark):
    version = durable(flagship.next_version(spark, SF))
    assert [(f.name, f.dataType) for f in version.schema] == [(f.name, f.dataType) for f in COMPANY]
    assert version.count() == version.select("id").distinct().count() > 0
    assert version.where("attempts <> 1 OR state NOT IN ('held', 'ready', 'dropped')").count() == 0
    owners = version.where("state = 'ready'").groupBy("domain").count()
    assert owners.where("count > 1").count() == 0
    today = F.lit("2024-05-01").cast("date")
    plan = durable(state.rejudged(version, rules.Rules(), today))
    again = state.rejudged(durable(state.applied(plan)), rules.Rules(), today)
    assert state.change_log(again).count() == 0


def test_a_run_looks_at_every_company(spark):
    known = durable(companies(spark, SF))
    first = F.col("source") == "tx"                       # ids the table lacks are taken in, the others are looked up again
    version = durable(flagship.next_version(spark, SF, known=known.where(~first)))
    was = known.select("id", F.when(~first, F.col("attempts")).otherwise(0).alias("before"), F.when(~first, F.col("state")).alias("was"))
    both = durable(version.join(was, "id"))
    assert version.count() == both.count() == known.count() == all_filings(spark, SF).count()
    assert both.where("attempts <> before + 1 OR (state = 'pushed' AND was <> 'pushed')").count() == 0
    assert both.where("before >= 2 AND enrich IS NOT NULL").count() > 0
    listed = version.where("state IN ('ready', 'pushed')")
    assert listed.count() == listed.select("domain").distinct().count() > 0
    assert flagship.run(spark, SF).agg(F.sum("n")).first()[0] == known.count()


def test_a_domain_has_one_owner(spark):
    rows = spark.createDataFrame([("a", "x.com", 2), ("b", "x.com", 1), ("c", "y.com", 1), ("d", "", 1), ("e", None, 1), ("f", "z.com", 1)], "id string, domain string, seen int")
    listed = spark.createDataFrame([("q", "y.com"), ("f", "z.com")], "id string, domain string")
    got = {r.id: r.domain_taken for r in state.claim_domains(rows, listed, ["seen", "id"]).collect()}
    assert got == {"a": True, "b": False, "c": True, "d": False, "e": False, "f": False}


def test_a_source_that_fails_does_not_stop_the_others(spark):
    from filingmatch.sources import registries, windows  # noqa: F401
    from filingmatch.sources.spec import build

    specs = build({"tx": True, "ct": True, "la": True})

    def job(spec):
        if spec.key == "ct":
            raise RuntimeError("no answer")
        return 3

    got = windows.guarded(specs, job)
    assert [(k, s, n) for k, s, _, n in got] == [(x.key, "failed" if x.key == "ct" else "ok", 0 if x.key == "ct" else 3) for x in specs]
    outcome = spark.createDataFrame([(k, s) for k, s, _, _ in got], "key string, status string")
    assert windows.run_outcome(outcome).first().status == "partial"
    assert windows.run_outcome(outcome.withColumn("status", F.lit("failed"))).first().status == "failed"
