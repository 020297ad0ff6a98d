"""The nested state table from its flat landed form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from . import landed as L


def companies(spark: SparkSession, sf: str) -> DataFrame:
    """The state table in the stored schema."""
    c = L.landed(spark, sf, L.COMPANIES)
    none = F.lit(None)
    raw = {"entity_type": F.lit(""), "state": F.col("state_code"), "naics": F.lit(""), "phone": F.lit(""), "coded": F.lit(True),
           "emails": F.array().cast("array<string>"), "extra": F.create_map().cast("map<string,string>"),
           "people": F.array(F.struct(F.col("officer").alias("name"), F.col("officer_title").alias("title")))}
    contact = F.when(F.col("contact_name") != "", F.struct(F.col("contact_name").alias("name"), F.col("contact_title").alias("title"), F.lit("").alias("email"),
                                                           F.col("linkedin").alias("linkedin"), F.col("contact_from").alias("from")))
    seen = {"checked": F.col("first_seen"), "why": F.array("why"), "emails": F.array().cast("array<string>"), "phones": F.array("phone2"), "contact": contact,
            "it": F.struct(F.col("it_level").alias("level"), F.lit(0.0).alias("score")), "missing": F.array().cast("array<string>"),
            "dropped_because": none.cast("array<string>"), "error": none.cast("string")}
    raw_col = F.struct(*[(raw[f.name] if f.name in raw else F.col(f.name)).cast(f.dataType).alias(f.name) for f in S.FILING.fields])
    seen_col = F.when(F.col("has_lookup"), F.struct(*[(seen[f.name] if f.name in seen else F.col(f.name)).cast(f.dataType).alias(f.name) for f in S.LOOKUP.fields]))
    return c.select("id", "source", raw_col.alias("raw"), seen_col.alias("enrich"), "state", "first_seen", "attempts", "next_due", F.nullif(F.col("domain"), F.lit("")).alias("domain"),
                    F.lit(None).cast("string").alias("pushed_hash"), "pushed_at", "ready_at", "strikes")
