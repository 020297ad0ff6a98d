"""The state table: intake, retries, transitions, re-judging. Every job returns the rows of the next version; the version
being read is never overwritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..session import durable
from .rules import Rules, clean_stored, qualify
from .skew import spread

_TAKEN = ["same website as another company"]


# ------------------------------------------------------------------------------------------------------ intake and worklist
def new_only(filings: DataFrame, known: DataFrame) -> DataFrame:
    """Filings whose id the state table does not hold."""
    return filings.join(known.select("id"), "id", "left_anti")


def intake(filings: DataFrame, companies: DataFrame, today: Column) -> DataFrame:
    """Rows to append for filings seen for the first time."""
    fresh = new_only(filings, companies)
    raw = F.struct(*[F.col(c) for c in filings.columns])
    return fresh.select("id", "source", raw.alias("raw"), F.lit("new").alias("state"), today.alias("first_seen"), F.lit(0).alias("attempts"),
                        today.alias("next_due"), F.lit(0).alias("strikes"))


def due(companies: DataFrame, today: Column, limit: int | None = None) -> DataFrame:
    """Companies to look up now, newest first (the id settles ties); at most `limit` where one is given."""
    rows = companies.where(F.col("state").isin("new", "held", "ready") & (F.col("next_due") <= today)).orderBy(F.desc("first_seen"), F.asc("id"))
    return rows if limit is None else rows.limit(limit)


def claim_domains(rows: DataFrame, listed: DataFrame, order: list[str]) -> DataFrame:
    """Adds `domain_taken`: the domain belongs to a listed company (another one), or an earlier row of `rows` claims it.

    The owners are first reduced to one row per domain, and the first claimant of every domain is found by a min aggregate, so a
    domain that a third of all rows claim is combined on the map side and never sorted in one task.
    """
    owners = (listed.where(F.coalesce("domain", F.lit("")) != "").groupBy("domain")
              .agg(F.min("id").alias("_owner"), F.max("id").alias("_owner2")))
    claims = F.struct(*order)
    first = rows.where(F.coalesce("domain", F.lit("")) != "").groupBy("domain").agg(F.min_by("id", claims).alias("_first"))
    facts = first.join(owners, "domain", "left")
    owned = F.col("_owner").isNotNull() & ((F.col("_owner") != F.col("id")) | (F.col("_owner2") != F.col("id")))
    named = F.coalesce("domain", F.lit("")) != ""
    claimed = (rows.where(named).join(facts, "domain", "left").withColumn("domain_taken", F.coalesce(owned | (F.col("_first") != F.col("id")), F.lit(False)))
               .drop("_owner", "_owner2", "_first"))
    return claimed.unionByName(rows.where(~named).withColumn("domain_taken", F.lit(False)))     # rows without a domain never meet


def owned_once(rows: DataFrame, listed: DataFrame, order: list[str]) -> DataFrame:
    """Judged rows (`new_state`, `new_enrich`) with those dropped whose domain another company owns."""
    lookup = F.col("new_enrich")
    marked = claim_domains(rows.withColumn("domain", lookup["domain"]), listed, order)
    why = F.array(*[F.lit(x) for x in _TAKEN])
    told = lookup.withField("missing", why).withField("dropped_because", why)
    return (marked.withColumn("new_enrich", F.when(F.col("domain_taken"), told).otherwise(lookup))
            .withColumn("new_state", F.when(F.col("domain_taken"), "dropped").otherwise(F.col("new_state"))).drop("domain_taken"))


# ------------------------------------------------------------------------------------------------------------- one attempt
def recorded(rows: DataFrame, today: Column) -> DataFrame:
    """State after a judged lookup. `rows` carry the stored columns and the outcome: `new_state` and `new_enrich`. A company
    that stays open is looked up again 0, 3, 10, 30 days after first sight (never before tomorrow), then dropped."""
    attempts = F.col("attempts") + 1
    is_open = F.col("new_state").isin("new", "held")
    spent = is_open & (attempts >= len(V.RETRY_DAYS))
    wait = F.get(F.array(*[F.lit(d) for d in V.RETRY_DAYS]), F.least(attempts, F.lit(len(V.RETRY_DAYS) - 1)))
    after = F.greatest(F.date_add("first_seen", wait), F.date_add(today, 1))
    return (rows.withColumn("state", F.when(spent, "dropped").otherwise(F.col("new_state")))
            .withColumn("next_due", F.when(is_open & ~spent, after)).withColumn("attempts", attempts).withColumn("strikes", F.lit(0))
            .withColumn("ready_at", F.when(F.col("state") == "ready", F.coalesce("ready_at", today)).otherwise(F.col("ready_at")))
            .withColumn("enrich", F.col("new_enrich")).withColumn("domain", F.nullif(F.col("new_enrich.domain"), F.lit(""))).drop("new_state", "new_enrich"))


def outcome_of(kind: Column, strikes: Column, source_down: Column) -> Column:
    """What becomes of a lookup: 'judge' a good one, 'strike' (retry, no attempt used) while network trouble is new or the source
    of truth is down, 'miss' for a crash or the third strike in a row."""
    return (F.when(kind == "ok", "judge").when((kind == "transient") & (source_down | (strikes + 1 < V.TRANSIENT_LIMIT)), "strike").otherwise("miss"))


def with_strikes(rows: DataFrame, down: bool = False) -> DataFrame:
    """Adds `outcome` and the strikes after it (a strike while the source is down is not counted)."""
    out = rows.withColumn("outcome", outcome_of(F.col("kind"), F.col("strikes"), F.lit(down)))
    counted = (F.col("kind") == "transient") & ~F.lit(down)
    return out.withColumn("strikes", F.when(F.col("outcome") != "strike", 0).when(counted, F.col("strikes") + 1).otherwise(F.col("strikes")))


def miss_reason(kind: Column) -> Column:
    """What a lookup without a result is missing."""
    return F.when(kind == "crash", F.array(F.lit("lookup error"))).otherwise(F.array(F.lit("website")))


# -------------------------------------------------------------------------------------------------------------- re-judging
def rejudged(companies: DataFrame, rules: Rules, today: Column) -> DataFrame:
    """The planned change of every company under today's rules and checks: `action` (released, demoted, unlisted, cleaned or
    null) with the new state, result and dates beside the stored ones. Applying the plan and planning again gives no change.

    A held or dropped company that qualifies is released when no listed company owns its domain; of several that claim one domain
    the first seen gets it. A listed company is cleaned, or taken back: waiting ones to held (tomorrow) or dropped, sent ones to
    held (today). The cleaned results are written once: every later step reads them as stored values.
    """
    e, raw = F.col("enrich"), F.col("raw")
    listed = F.col("state").isin(V.LISTED)
    judged = durable(spread(companies).withColumn("_clean", F.when(listed, clean_stored(raw, e)).otherwise(e))).withColumn(
        "_q", qualify(raw, F.col("_clean"), rules))
    ready = F.col("_q.state") == "ready"
    wants = F.col("state").isin("held", "dropped") & e.isNotNull() & ready
    claims = judged.where(wants).select("id", F.coalesce("enrich.domain", F.lit("")).alias("domain"), "first_seen")
    free = claim_domains(claims, judged.where(listed).select("id", "domain"), ["first_seen", "id"]).where(~F.col("domain_taken"))
    marked = judged.join(free.select("id", F.lit(True).alias("_free")), "id", "left")
    sent = F.col("state") == "pushed"
    has = F.col("state").isin(V.LISTED) & e.isNotNull()
    action = (F.when(wants & F.col("_free"), "released").when(has & ~ready & sent, "unlisted").when(has & ~ready, "demoted")
              .when(has & ~F.col("_clean").eqNullSafe(e), "cleaned"))
    to = F.when(F.col("action") == "released", "ready").when(F.col("action") == "unlisted", "held").when(F.col("action") == "demoted", F.col("_q.state")).otherwise(F.col("state"))
    missing = F.when(F.col("action") == "released", F.array().cast("array<string>")).otherwise(F.col("_q.missing"))
    back = F.col("action").isin("unlisted", "demoted")
    result = F.when(F.col("action") == "released", e.withField("missing", missing).withField("dropped_because", F.lit(None).cast("array<string>"))).when(
        back, F.col("_clean").withField("missing", missing).withField("dropped_because", F.when(to == "dropped", missing).otherwise(F.col("_clean.dropped_because")))).when(
        F.col("action") == "cleaned", F.col("_clean")).otherwise(e)
    again = F.when(F.col("action") == "unlisted", today).when((F.col("action") == "demoted") & (to == "held"), F.date_add(today, 1)).when(
        F.col("action").isNull() | (F.col("action") == "cleaned"), F.col("next_due"))
    return (marked.withColumn("action", action)
            .withColumn("new_state", to).withColumn("new_enrich", result).withColumn("new_next_due", again)
            .withColumn("new_ready_at", F.when(F.col("action") == "released", today).otherwise(F.col("ready_at"))).drop("_clean", "_q", "_free"))


def applied(plan: DataFrame) -> DataFrame:
    """The next version of the state table from a plan."""
    names = [c for c in plan.columns if c not in ("action", "new_state", "new_enrich", "new_next_due", "new_ready_at")]
    swap = {"state": "new_state", "enrich": "new_enrich", "next_due": "new_next_due", "ready_at": "new_ready_at"}
    return plan.select(*[F.col(swap.get(c, c)).alias(c) for c in names])


def change_log(plan: DataFrame) -> DataFrame:
    """What a repair would change: the dry run."""
    return plan.where(F.col("action").isNotNull()).select("id", F.col("raw.name").alias("name"), "action", F.col("state").alias("was"),
                                                          F.col("new_state").alias("becomes"), F.array_join("new_enrich.missing", ", ").alias("missing"))


# ----------------------------------------------------------------------------------------------------- marks and bulk changes
def mark_pushed(companies: DataFrame, acknowledged: DataFrame, today: Column) -> DataFrame:
    """Ready companies the sink acknowledged (id, row_hash) become pushed; the others wait."""
    ack = acknowledged.groupBy("id").agg(F.max("row_hash").alias("_hash"))
    done = F.col("_hash").isNotNull() & (F.col("state") == "ready")
    return (companies.join(ack, "id", "left").withColumn("_done", done)
            .withColumn("state", F.when(F.col("_done"), "pushed").otherwise(F.col("state")))
            .withColumn("pushed_hash", F.when(F.col("_done"), F.col("_hash")).otherwise(F.col("pushed_hash")))
            .withColumn("pushed_at", F.when(F.col("_done"), today).otherwise(F.col("pushed_at"))).drop("_hash", "_done"))


def batches(rows: DataFrame, order: list[str], size: int = 80) -> DataFrame:
    """Adds `batch`: numbered groups of at most `size` rows in order, numbered without one global task."""
    from .publish import numbered
    return numbered(rows, order).withColumn("batch", F.floor((F.col("n") - 1) / size).cast("bigint")).drop("n")


def reset_pushed(companies: DataFrame) -> DataFrame:
    """A new, empty target: everything that was sent waits again."""
    sent = F.col("state") == "pushed"
    return (companies.withColumn("pushed_hash", F.when(sent, F.lit(None).cast("string")).otherwise(F.col("pushed_hash")))
            .withColumn("pushed_at", F.when(sent, F.lit(None).cast("date")).otherwise(F.col("pushed_at")))
            .withColumn("state", F.when(sent, "ready").otherwise(F.col("state"))))


def recheck_listed(companies: DataFrame, today: Column) -> DataFrame:
    return companies.withColumn("next_due", F.when(F.col("state") == "ready", today).otherwise(F.col("next_due")))


def set_state(companies: DataFrame, ids: DataFrame, state: str) -> DataFrame:
    chosen = ids.select("id", F.lit(True).alias("_set")).distinct()
    return companies.join(chosen, "id", "left").withColumn("state", F.when(F.col("_set"), state).otherwise(F.col("state"))).drop("_set")


def run_status(sources: DataFrame, lookups: DataFrame) -> DataFrame:
    """One row: ok, partial (a source failed, or ten lookups and more than 5% of them hit network trouble) or failed (every source)."""
    seen = sources.select(F.lit("source").alias("kind"), F.col("status").alias("what")).unionByName(lookups.select(F.lit("lookup").alias("kind"), F.col("outcome").alias("what")))
    source, lookup = F.col("kind") == "source", F.col("kind") == "lookup"
    both = seen.agg(F.count_if(source).alias("sources"), F.count_if(source & (F.col("what") != "ok")).alias("failed"),
                    F.count_if(lookup & (F.col("what") == "strike")).alias("errors"), F.count_if(lookup & (F.col("what") != "strike")).alias("checked"))
    trouble = (F.col("errors") >= 10) & (F.col("errors") > 0.05 * (F.col("checked") + F.col("errors")))
    return both.withColumn("status", F.when((F.col("failed") > 0) & (F.col("failed") == F.col("sources")), "failed").when(
        (F.col("failed") > 0) | trouble, "partial").otherwise("ok"))


__all__ = ["new_only", "intake", "due", "claim_domains", "recorded", "outcome_of", "with_strikes", "miss_reason", "rejudged", "applied",
           "change_log", "mark_pushed", "batches", "reset_pushed", "recheck_listed", "set_state", "run_status"]
