"""Admission of crawled pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mail import bare_host


def admitted(pages: DataFrame, page_bytes: int | None = None) -> DataFrame:
    """Pages worth reading: not empty and (when the crawl recorded them) status under 400 and a text type. `page_bytes` refuses
    larger pages; by default none is too large."""
    size = F.octet_length("html")
    keep = size > 0 if page_bytes is None else size.between(1, page_bytes)
    if "status" in pages.columns:
        keep = keep & (F.col("status") < 400)
    if "content_type" in pages.columns:
        kind = F.lower(F.coalesce("content_type", F.lit("")))
        keep = keep & (F.contains(kind, F.lit("html")) | F.contains(kind, F.lit("text")))
    return pages.where(keep)


def located(pages: DataFrame) -> DataFrame:
    """Pages with their host and path."""
    return (pages.withColumn("host", bare_host("url"))
            .withColumn("path", F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit(""))))
