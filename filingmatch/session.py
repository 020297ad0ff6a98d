"""Session defaults, shared folders and durable cut points."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.ui.enabled": "false",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}
_MADE: list[tuple[SparkSession, str]] = []
_LOCAL: list[str] = []


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on. On a cluster leave `master` and `shuffle_partitions` to spark-submit."""
    b = SparkSession.builder.appName("filingmatch")
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def shared_folder(spark: SparkSession, name: str = "run") -> str:
    """A new folder name on the storage that driver and executors share: below `spark.checkpoint.dir`. Only a session on one
    machine (tests) may leave that unset and gets a temporary folder; a cluster without the setting is an error, as its
    executors would write to disks nobody else sees."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="filingmatch-"))
        base = _LOCAL[0]
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder made by `shared_folder`, on whatever store it lies."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _discard_all() -> None:
    for spark, path in _MADE:
        if spark.sparkContext._jsc is not None:
            discard(spark, path)


def stored(df: DataFrame, name: str = "table") -> tuple[DataFrame, str]:
    """The rows of `df` as a Parquet table on shared storage, read back with the same schema, and its folder."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def durable(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut at a Parquet table on shared storage, removed when the program ends."""
    return stored(df)[0]


def evaluated(df: DataFrame) -> DataFrame:
    """The same rows, every column worked out here and once. Adjacent projections are merged by the optimizer, which copies an expression
    into each of its uses, filters included: a page text used six times is parsed six times, and more where uses are nested. Columns that come
    out of a generator are not merged; nothing is written or shuffled."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
