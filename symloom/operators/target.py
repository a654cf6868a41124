"""From query targets to files: an indexed path, else a module, else a symbol name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.operators.lookups import file_modules, module_files
from symloom.schema import Graph


def target_files(graph: Graph, targets: DataFrame) -> DataFrame:
    """Distinct (target, path) of each target in column ``target``, by the first way that finds any."""
    targets = targets.select("target").distinct()
    as_file = graph.files.select(F.col("path").alias("target"), "path", F.lit(1).alias("way"))
    as_module = module_files(graph).select(F.col("module_path").alias("target"), "path", F.lit(2).alias("way"))
    as_symbol = graph.symbols.select(F.col("name").alias("target"), "path", F.lit(3).alias("way")).distinct()
    found = targets.join(as_file.unionByName(as_module).unionByName(as_symbol), "target")
    first = found.groupBy("target").agg(F.min("way").alias("way"))
    return found.join(first, ["target", "way"]).select("target", "path", "way").distinct()


def preferred_modules(graph: Graph, targets: DataFrame) -> DataFrame:
    """(target, preferred_module): of a file its shortest module, of a module itself, of a symbol the only module that defines it."""
    ways = target_files(graph, targets)
    of_file = ways.filter("way = 1").join(file_modules(graph), "path").groupBy("target").agg(F.min(F.struct(F.length("module_path"), "module_path"))["module_path"].alias("preferred_module"))
    of_module = ways.filter("way = 2").select("target", F.col("target").alias("preferred_module")).distinct()
    by_symbol = graph.symbols.groupBy("name").agg(F.min("module_path").alias("low"), F.max("module_path").alias("high"))
    of_symbol = ways.filter("way = 3").select("target").distinct().join(by_symbol, F.col("target") == F.col("name")).filter("low = high").select("target", F.col("low").alias("preferred_module"))
    return of_file.unionByName(of_module).unionByName(of_symbol)
