"""What a registry is to the jobs: a schema, a scan predicate, a normalization and a publishing lag."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

FILING_COLUMNS = ["id", "source", "name", "trade_name", "entity_type", "individual", "state", "city", "address", "zip", "registered",
                  "naics", "industry", "phone", "emails", "coded", "extra"]


@dataclass(frozen=True)
class SourceSpec:
    """One registry. `scan(since, until)` is the predicate pushed to the landed snapshot, `normalize` maps its rows to
    filings (with a `_first` ordering column: the smallest wins when an id repeats)."""

    key: str
    label: str
    schema: T.StructType
    lag: int
    scan: Callable[[date, date], Column]
    normalize: Callable[[DataFrame], DataFrame]

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        reader = spark.read.schema(self.schema)
        return reader.json(path) if path.rstrip("/").endswith((".json", ".jsonl", "json")) else reader.parquet(path)

    def filings(self, raw: DataFrame, since: date, until: date) -> DataFrame:
        return first_per_id(self.normalize(raw.where(self.scan(since, until))))


REGISTRY: dict[str, SourceSpec] = {}


def register(spec: SourceSpec) -> SourceSpec:
    """Adds a registry to the ones `build` knows."""
    REGISTRY[spec.key] = spec
    return spec


def build(enabled: dict[str, bool], only: list[str] | None = None) -> list[SourceSpec]:
    """The registries switched on, in registration order, optionally a subset."""
    return [s for k, s in REGISTRY.items() if enabled.get(k) and (not only or k in only)]


def first_per_id(filings: DataFrame, order: str = "_first") -> DataFrame:
    """One row per id, the first in source order. The rank limit is applied before the shuffle as well, so an id that
    repeats without end sends one row per task."""
    w = Window.partitionBy("id").orderBy(order)
    return filings.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", order)


def page_scan(raw: DataFrame, where: Column, order: list[Column], select: list[str] | None = None, cap: int | None = None) -> DataFrame:
    """The scan of a registry: predicate and total order (it must end in a unique column); at most `cap` rows where one is given."""
    out = raw.where(where).orderBy(*order)
    out = out if cap is None else out.limit(cap)
    return out.select(*select) if select else out
