"""Modules that a target depends on, from its files' imports and references.

A file's imports come first, in their order, then its reference names in
alphabetical order; of several ways to one module the first in (file, phase,
name) order gives the defining file. That is a minimum, so partial results
combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.operators.lookups import first_file_of_module, reference_names
from symloom.operators.resolve import is_acceptable, top_matches
from symloom.schema import Graph


def import_modules(graph: Graph, imports: DataFrame | None = None) -> DataFrame:
    """(import_path, dep_module, dep_file) of each distinct import path.

    dep_module is the longest ``::``-prefix of the path (the path itself
    included) that defines symbols, or the path where none does; dep_file is null then.
    """
    paths = (graph.imports if imports is None else imports).select(F.col("module_path").alias("import_path")).distinct()
    parts = F.split("import_path", "::")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "::"))
    tried = paths.select("import_path", F.posexplode(prefixes).alias("n", "prefix"))
    known = tried.join(first_file_of_module(graph), F.col("prefix") == F.col("module_path")).groupBy("import_path").agg(F.max(F.struct("n", "prefix", "first_file")).alias("best"))
    return paths.join(known, "import_path", "left").select("import_path", F.coalesce("best.prefix", "import_path").alias("dep_module"), F.col("best.first_file").alias("dep_file"))


def file_dependencies(graph: Graph, paths: DataFrame | None = None) -> DataFrame:
    """(path, dep_module, first): ``first`` is the least struct<phase, name, dep_file> that leads from the file to the module."""
    imports, names = graph.imports, reference_names(graph)
    symbols = None
    if paths is not None:
        imports, names = imports.join(paths, "path", "left_semi"), names.join(paths, "path", "left_semi")
        symbols = graph.symbols.join(names.select("name").distinct(), "name", "left_semi")
    by_import = imports.join(import_modules(graph, imports), F.col("module_path") == F.col("import_path")).select("path", "dep_module", F.struct(F.lit(1).alias("phase"), F.lit("").alias("name"), "dep_file").alias("way"))
    top = top_matches(graph, names.select("name", F.col("path").alias("from_place")), symbols)
    meant = top.filter(is_acceptable() & (F.col("path") != F.col("from_place")) & (F.col("module_path") != ""))
    by_name = meant.select(F.col("from_place").alias("path"), F.col("module_path").alias("dep_module"), F.struct(F.lit(2).alias("phase"), "name", F.col("path").alias("dep_file")).alias("way"))
    return by_import.unionByName(by_name).groupBy("path", "dep_module").agg(F.min("way").alias("first"))


def dependencies(graph: Graph, target_paths: DataFrame, narrow: bool = False) -> DataFrame:
    """(target, module_path, file) of all targets in ``target_paths`` (target, path).

    ``narrow`` restricts the plan to those paths first, for few targets.
    """
    pairs = target_paths.select("target", "path").distinct()
    by_file = file_dependencies(graph, pairs.select("path").distinct() if narrow else None)
    first = pairs.join(by_file, "path").groupBy("target", "dep_module").agg(F.min(F.struct("path", "first")).alias("way"))
    return first.select("target", F.col("dep_module").alias("module_path"), F.col("way.first.dep_file").alias("file"))
