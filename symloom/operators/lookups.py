"""Point and set lookups. Each takes a column condition, so a point query is the bulk one plus a filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.schema import Graph

POSITION = ["path", "start_line", "start_col"]


def definitions(graph: Graph, name: str, module: str | None = None) -> DataFrame:
    found = graph.symbols.filter(F.col("name") == name)
    if module is not None:
        found = found.filter(F.col("module_path") == module)
    return found.orderBy(*POSITION)


def references(graph: Graph, name: str) -> DataFrame:
    return graph.refs.filter(F.col("name") == name).orderBy(*POSITION)


def implementations(graph: Graph, trait: str) -> DataFrame:
    """Implementations of a trait; inherent ones have no trait and are never found."""
    return graph.impls.filter(F.col("trait_name") == trait).orderBy(*POSITION)


def imports_of_file(graph: Graph, path: str) -> DataFrame:
    return graph.imports.filter(F.col("path") == path).select("module_path", "alias").orderBy("module_path", F.asc_nulls_first("alias"))


def file_modules(graph: Graph) -> DataFrame:
    """Distinct (path, module_path)."""
    return graph.symbols.select("path", "module_path").distinct()


def module_files(graph: Graph) -> DataFrame:
    """Distinct (module_path, path)."""
    return graph.symbols.select("module_path", "path").distinct()


def first_file_of_module(graph: Graph) -> DataFrame:
    """(module_path, first_file): the smallest path of each module."""
    return graph.symbols.groupBy("module_path").agg(F.min("path").alias("first_file"))


def reference_names(graph: Graph) -> DataFrame:
    """Distinct (path, name) over all references."""
    return graph.refs.select("path", "name").distinct()


def file_is_indexed(graph: Graph, path: str) -> bool:
    return not graph.files.filter(F.col("path") == path).isEmpty()
