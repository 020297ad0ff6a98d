"""Published rows, upserts, exports and snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import fixed_values as V
from ..functions.cells import csv_safe, email_source, fit_label, lookup
from ..functions.core import blank_to_null, nonempty, text
from ..functions.phones import fmt_phone
from ..functions.places import compose_address
from ..schemas import PUBLISHED
from ..session import durable

FILLABLE = [c for c in PUBLISHED if c not in ("id", "linkedin_label")]


def published(companies: DataFrame) -> DataFrame:
    """The sixteen published cells of a company. A person trading under a name shows city and state only; a phone comes from the
    website only."""
    raw, e = F.col("raw"), F.col("enrich")
    own = F.coalesce(raw["individual"], F.lit(False))
    trade = F.when(nonempty(raw["trade_name"]), F.concat(F.lit(" ("), raw["trade_name"], F.lit(")"))).otherwise(F.lit(""))
    person, title = text(e["contact"]["name"]), text(e["contact"]["title"])
    profile, company_profile = text(e["linkedin"]), text(e["linkedin_company"])
    use_company = (profile == "") & (company_profile != "")
    since = F.when(e["created"].isNotNull(), F.concat(F.lit(" (domain registered "), e["created"].cast("string"), F.lit(")"))).otherwise(F.lit(""))
    proof = F.concat_ws(". ",
                        F.when(F.size(e["why"]) > 0, F.concat(F.lit("Website: "), F.array_join(e["why"], "; "), since)),
                        F.when(nonempty(e["email"]), F.concat(F.lit("Email: "), email_source(e["email"], text(e["email_from"]), e["domain"], e["website"]))),
                        F.when(nonempty(e["phone"]), F.concat(F.lit("Phone: "), text(e["phone_from"]))))
    cells = {
        "id": F.col("id"), "company": F.concat(raw["name"], trade), "website": text(e["website"]), "email": text(e["email"]), "phone": fmt_phone(e["phone"]),
        "address": compose_address(F.when(own, "").otherwise(raw["address"]), raw["city"], raw["state"], F.when(own, "").otherwise(raw["zip"])),
        "registered": F.coalesce(raw["registered"].cast("string"), F.lit("")),
        "contact": F.concat(person, F.when((person != "") & (title != ""), F.concat(F.lit(", "), title)).otherwise(F.lit(""))),
        "contact_email": text(e["contact"]["email"]), "linkedin": F.when(use_company, company_profile).otherwise(profile),
        "linkedin_label": F.when(use_company, "Company").otherwise("Profile"), "industry": text(raw["industry"]), "state": text(raw["state"]),
        "source": lookup(V.SOURCE_LABEL, raw["source"], raw["source"]), "fit": fit_label(text(e["it"]["level"]), e["created"], raw["registered"]), "proof": proof}
    return companies.select(*[cells[c].alias(c) for c in PUBLISHED])


def listed(companies: DataFrame) -> DataFrame:
    return companies.where(F.col("state").isin(V.LISTED) & F.col("enrich").isNotNull())


def upsert(sheet: DataFrame, incoming: DataFrame, today: Column, cells: list[str] | None = None, order: str | Column = "seq") -> DataFrame:
    """The next version of the sheet with the `action` per row (inserted, updated, kept). Incoming rows without id or company, and
    later rows of one id, are skipped. An existing row only has its empty cells filled; what a person typed stays."""
    cells = cells or FILLABLE
    ok = incoming.where(nonempty("id") & nonempty("company"))
    first = Window.partitionBy("id").orderBy(order)
    once = ok.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("id", *[F.col(c).alias(f"_{c}") for c in cells], F.lit(True).alias("_in"))
    both = sheet.withColumn("_out", F.lit(True)).join(once, "id", "full_outer")
    action = F.when(F.col("_out").isNull(), "inserted").when(F.col("_in"), "updated").otherwise("kept")
    filled = [F.coalesce(blank_to_null(c), blank_to_null(f"_{c}"), F.lit("")).alias(c) for c in cells]
    added = F.when(F.col("_out").isNull(), today).otherwise(F.col("added")).alias("added")
    return both.select("id", *filled, added, action.alias("action"))


def upsert_counts(incoming: DataFrame, merged: DataFrame) -> DataFrame:
    """One row: inserted, updated, skipped, total."""
    seen = merged.select("action").unionByName(incoming.select(F.lit("incoming").alias("action")))
    n = {a: F.count_if(F.col("action") == a) for a in ("inserted", "updated", "incoming")}
    return seen.agg(n["inserted"].alias("inserted"), n["updated"].alias("updated"), (n["incoming"] - n["inserted"] - n["updated"]).alias("skipped"),
                    F.count_if(F.col("action") != "incoming").alias("total"))


def csv_rows(rows: DataFrame) -> DataFrame:
    """The download: fourteen headed columns, no cell a spreadsheet would run."""
    return rows.select(*[csv_safe(key).alias(header) for header, key in V.CSV_COLUMNS])


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV files with a header each; a byte order mark in front lets spreadsheet programs read UTF-8."""
    first = V.CSV_COLUMNS[0][0]
    csv_rows(rows).withColumnRenamed(first, "﻿" + first).write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def incomplete(companies: DataFrame) -> DataFrame:
    """Companies looked up but not listed, with what is missing."""
    open_ = companies.where(F.col("state").isin("held", "new") & F.col("enrich").isNotNull())
    extra = open_.select("id", F.col("state").alias("stage"), F.array_join(F.coalesce("enrich.missing", F.array().cast("array<string>")), ", ").alias("missing"))
    cols = ["company", "website", "email", "phone", "address", "registered", "state", "source", "stage", "missing"]
    return published(open_).join(extra, "id").select(*[csv_safe(c).alias(c) for c in cols])


def numbered(rows: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """Adds 1, 2, 3 ... in order, without one global task: rows are range partitioned and sorted, written once, counted per
    partition, and shifted by the rows before their partition. The offset table has one row per partition."""
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = durable(spread.withColumn("_part", F.spark_partition_id()).withColumn(
        "_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
               .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")))
    return (placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_place") + 1)
            .drop("_part", "_place", "_before"))


def redacted(companies: DataFrame) -> DataFrame:
    """The copy that leaves: listed companies whole; the others keep their source, whether a website was found and their state,
    under a running number in id order."""
    shown = companies.where(F.col("state").isin(V.LISTED))
    hidden = numbered(companies.where(~F.col("state").isin(V.LISTED)), ["id"])
    kinds = {f.name: f.dataType for f in companies.schema.fields}
    raw, lookup_ = kinds["raw"], kinds["enrich"]
    nothing = lambda t: F.lit(None).cast(t)                                                       # noqa: E731
    bare = F.struct(*[(F.col("source") if f.name == "source" else nothing(f.dataType)).alias(f.name) for f in raw.fields])
    seen = F.when(F.col("enrich").isNotNull(), F.struct(*[
        (F.when(nonempty("enrich.website"), "yes").otherwise("") if f.name == "website" else nothing(f.dataType)).alias(f.name) for f in lookup_.fields]))
    values = {"id": F.concat("source", F.lit(":x"), F.col("n").cast("string")), "raw": bare, "enrich": seen}
    empty = ("domain", "pushed_hash", "next_due", "pushed_at", "ready_at")
    out = hidden.select(*[(values[c] if c in values else nothing(kinds[c]) if c in empty else F.col(c)).alias(c) for c in companies.columns])
    return shown.unionByName(out)


def leaks(snapshot: DataFrame) -> DataFrame:
    """Unlisted companies of a snapshot that still carry a detail, in the filing, in the lookup (where a website may only be '' or
    'yes') or in the domain: must be empty."""
    raw, seen = snapshot.schema["raw"].dataType, snapshot.schema["enrich"].dataType
    told = [F.col(f"raw.{f.name}").isNotNull() for f in raw.fields if f.name != "source"]
    told += [F.col(f"enrich.{f.name}").isNotNull() for f in seen.fields if f.name != "website"]
    told += [~F.coalesce("enrich.website", F.lit("")).isin("", "yes"), F.col("domain").isNotNull(), F.col("pushed_hash").isNotNull()]
    return snapshot.where(~F.col("state").isin(V.LISTED)).where(reduce(lambda a, b: a | b, told))


def log_row(runs: DataFrame) -> DataFrame:
    """Run log entries as they are appended, text cells inert."""
    return runs.select(csv_safe("started").alias("started"), "seconds", "added", "held", "updated", csv_safe("sources").alias("sources"),
                       csv_safe(F.coalesce(blank_to_null("status"), F.lit("ok"))).alias("status"), csv_safe("errors").alias("errors"))


def append_log(runs: DataFrame, path: str) -> None:
    log_row(runs).write.mode("append").parquet(path)


def write_version(table: DataFrame, folder: str, version: str) -> str:
    """A new version beside the earlier ones; an existing version is never written again."""
    path = f"{folder.rstrip('/')}/version={version}"
    table.write.mode("errorifexists").parquet(path)
    return path


def backed_up(table: DataFrame, folder: str, version: str) -> str:
    """A copy of the state table as it is before a repair, written beside the versions and read back: same rows by count and by the sum of
    their hashes, else an error. Returns its path; a copy of that name is never overwritten."""
    path = write_version(table, folder, version)
    told = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*[F.to_json(F.struct(c)) for c in table.columns]).cast("decimal(38,0)"))).first()
    if told(table) != told(table.sparkSession.read.schema(table.schema).parquet(path)):
        raise ValueError(f"the copy in {path} is not the table")
    return path
