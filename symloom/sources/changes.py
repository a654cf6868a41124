"""Change detection between a scan and the indexed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKIPPED, CHANGED, FAILED, REMOVED = "skipped", "changed", "failed", "removed"


def outcomes(scan: DataFrame, files: DataFrame, failed: Column | None = None) -> DataFrame:
    """(path, content_hash, outcome) of every path that is on disk or indexed.

    A file is skipped if its hash is the one indexed, else it is changed, or
    failed where ``failed`` (a condition on ``scan``) holds. Indexed paths that
    are not on disk are removed. A failed file is on disk: what was indexed of it stays.
    """
    now = scan.select("path", "content_hash", (F.lit(False) if failed is None else F.coalesce(failed, F.lit(False))).alias("__failed"))
    old = files.select("path", F.col("content_hash").alias("__old"))
    both = now.withColumn("__on_disk", F.lit(True)).join(old, "path", "full")
    outcome = F.when(F.col("__on_disk").isNull(), REMOVED).when(F.col("content_hash") == F.col("__old"), SKIPPED).when(F.col("__failed"), FAILED).otherwise(CHANGED)
    return both.select("path", F.coalesce("content_hash", "__old").alias("content_hash"), outcome.alias("outcome"))


def stats(outcome: DataFrame) -> DataFrame:
    """One row (indexed, skipped, removed, errors)."""
    count = lambda kind: F.count_if(F.col("outcome") == kind)
    return outcome.agg(count(CHANGED).alias("indexed"), count(SKIPPED).alias("skipped"), count(REMOVED).alias("removed"), count(FAILED).alias("errors"))
