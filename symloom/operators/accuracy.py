"""Precision, recall and F1 of found places against a gold standard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(part: Column, whole: Column, empty: float) -> Column:
    return F.round(F.when(whole == 0, F.lit(empty)).otherwise(part / whole), 6)


def scores(found: DataFrame, gold: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """(by..., tp, fp, fn, precision, recall, f1): micro-averages over distinct places.

    ``found`` and ``gold`` have the columns ``by`` (the groups reported) and
    ``keys`` (which make up a place). With nothing found precision is 1, with
    nothing to find recall is 1.
    """
    marks = found.select(*by, *keys).distinct().withColumn("mark", F.lit(1)).unionByName(gold.select(*by, *keys).distinct().withColumn("mark", F.lit(2)))
    place = marks.groupBy(*by, *keys).agg(F.sum("mark").alias("mark"))
    counted = place.groupBy(*by).agg(F.count_if(F.col("mark") == 3).alias("tp"), F.count_if(F.col("mark") == 1).alias("fp"), F.count_if(F.col("mark") == 2).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counted.select(*by, "tp", "fp", "fn", _ratio(tp, tp + fp, 1.0).alias("precision"), _ratio(tp, tp + fn, 1.0).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn, 0.0).alias("f1"))
