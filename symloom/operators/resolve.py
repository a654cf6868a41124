"""Name resolution: which definition does a name mean in a file?

Candidates are all definitions of the name. Tier 1: an import of the file
reaches the candidate. Tier 2: the candidate's module is the place asked from,
or one of the modules defined in that file. Tier 3: all others. Ties go by path
(component by component), line and column.

The disjunction over import paths, last segments and aliases is rewritten into
equality keys. For the top candidate alone, definitions are never enumerated per
file: tiers 1 and 2 are reached through the few modules that a file imports or
defines, and in tier 3 the first definition of the name is the same for all
files. Hot names therefore cost as much as their distinct (name, file) pairs,
not the product of their uses and definitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symloom.functions.names import last_segment, leading_segments, looks_like_path, path_order
from symloom.operators.lookups import POSITION, file_modules
from symloom.schema import Graph

SYMBOL = ["name", "kind", "path", "start_line", "start_col", "module_path"]


def import_keys(imports: DataFrame) -> DataFrame:
    """Distinct (path, module_key, name_key): a file's imports reach the symbols of module_key that are called name_key.

    A null name_key stands for every symbol of the module.
    """
    p, alias = F.col("module_path"), F.col("alias")

    def ways(path: Column) -> Column:
        return F.array_distinct(F.array(path, last_segment(path, "/"), last_segment(path)))

    last, leading = last_segment(p), leading_segments(p)
    whole = F.transform(ways(p), lambda m: F.struct(m.alias("module_key"), alias.alias("name_key")))
    item = F.transform(ways(leading), lambda m: F.struct(m.alias("module_key"), last.alias("name_key")))
    keys = F.when(alias.isNull() | (alias == last), F.concat(whole, item)).otherwise(whole)
    return imports.select("path", F.explode(keys).alias("k")).select("path", "k.module_key", "k.name_key").distinct()


def _best(prefix: list[Column]) -> Column:
    """The least candidate by the given columns, then by position; further columns make it deterministic."""
    order = [path_order(F.col("path")).alias("path_order"), *(F.col(c) for c in ("start_line", "start_col", "path", "module_path", "kind"))]
    return F.min(F.struct(*prefix, *order))


def top_matches(graph: Graph, keys: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """The first-ranked definition for each distinct (name, from_place) of ``keys`` that has any.

    ``symbols`` narrows the candidates, for queries about few names. Columns:
    name, from_place, tier, n_candidates, kind, path, start_line, start_col, module_path.
    """
    symbols = graph.symbols if symbols is None else symbols
    keys = keys.select("name", "from_place").distinct()
    by_name = symbols.groupBy("name").agg(F.count("*").alias("n_candidates"), _best([]).alias("first"))
    known = keys.join(by_name, "name")
    by_module = symbols.groupBy("name", "module_path").agg(_best([]).alias("first")).select("name", F.col("module_path").alias("module_key"), "first")
    modules = by_module.select("module_key").distinct()
    reach = import_keys(graph.imports).join(modules, "module_key", "left_semi").withColumnRenamed("path", "from_place")
    named = reach.filter("name_key is not null").select(F.col("name_key").alias("name"), "from_place", "module_key", F.lit(1).alias("tier"))
    asked = keys.alias("keys")
    whole = asked.join(reach.filter("name_key is null").select("from_place", "module_key"), "from_place").select("name", "from_place", "module_key", F.lit(1).alias("tier"))
    local = file_modules(graph).select(F.col("path").alias("from_place"), F.col("module_path").alias("module_key"))
    own = asked.filter(looks_like_path(F.col("from_place"))).join(local, "from_place").select("name", "from_place", "module_key", F.lit(2).alias("tier"))
    itself = keys.select("name", "from_place", F.col("from_place").alias("module_key"), F.lit(2).alias("tier"))
    near = named.unionByName(whole).unionByName(own).unionByName(itself)
    near = near.join(by_module, ["name", "module_key"]).groupBy("name", "from_place").agg(F.min(F.struct("tier", "first")).alias("near"))
    best = known.join(near, ["name", "from_place"], "left").select("name", "from_place", "n_candidates", F.coalesce("near.tier", F.lit(3)).alias("tier"), F.coalesce("near.first", "first").alias("d"))
    return best.select("name", "from_place", "tier", "n_candidates", *(F.col(f"d.{c}").alias(c) for c in ("kind", "path", "start_line", "start_col", "module_path")))


def is_acceptable() -> Column:
    """Whether a top match counts: the only candidate always does, others up to tier 2."""
    return (F.col("n_candidates") == 1) | (F.col("tier") <= 2)


def ranked_matches(graph: Graph, keys: DataFrame) -> DataFrame:
    """Every definition of each (name, from_place) with its tier and rank; the output is as large as the candidates."""
    keys = keys.select("name", "from_place").distinct()
    candidates = keys.join(graph.symbols, "name")
    reach = import_keys(graph.imports).withColumnRenamed("path", "from_place").withColumnRenamed("module_key", "module_path")
    whole = reach.filter("name_key is null").select("from_place", "module_path", F.lit(True).alias("by_module"))
    named = reach.filter("name_key is not null").select("from_place", "module_path", F.col("name_key").alias("name"), F.lit(True).alias("by_name"))
    local = file_modules(graph).select(F.col("path").alias("from_place"), "module_path", F.lit(True).alias("local"))
    seen = candidates.join(whole, ["from_place", "module_path"], "left").join(local, ["from_place", "module_path"], "left").join(named, ["from_place", "module_path", "name"], "left")
    place = F.col("from_place")
    same = (F.col("module_path") == place) | (looks_like_path(place) & F.coalesce("local", F.lit(False)))
    tier = F.when(F.coalesce("by_module", "by_name", F.lit(False)), 1).when(same, 2).otherwise(3)
    order = Window.partitionBy("name", "from_place").orderBy("tier", path_order(F.col("path")), "start_line", "start_col", "path", "module_path", "kind")
    return seen.withColumn("tier", tier).withColumn("rank", F.row_number().over(order)).select("from_place", "rank", "tier", *SYMBOL)


def reference_matches(graph: Graph) -> DataFrame:
    """Each reference with its file's top match: tier, n_candidates and the match's columns as top_*."""
    keys = graph.refs.select("name", F.col("path").alias("from_place"))
    return graph.refs.join(_as_top(top_matches(graph, keys)), ["name", "path"])


def _as_top(top: DataFrame) -> DataFrame:
    columns = ("kind", "path", "start_line", "start_col", "module_path")
    return top.select("name", F.col("from_place").alias("__from"), "tier", "n_candidates", *(F.col(c).alias(f"top_{c}") for c in columns)).withColumnRenamed("__from", "path")


def callers(graph: Graph) -> DataFrame:
    """References by the definition they mean: target_module, then the columns of ``refs``.

    A name with several definitions counts only where its match is of tier 1 or 2.
    """
    return reference_matches(graph).filter(is_acceptable()).select(F.col("top_module_path").alias("target_module"), *graph.refs.columns)


def callers_of(graph: Graph, name: str, module: str | None) -> DataFrame:
    """The point form: all references by name, or those that mean the definition in ``module``."""
    refs = graph.refs.filter(F.col("name") == name)
    if module is not None:
        keys = refs.select("name", F.col("path").alias("from_place"))
        top = top_matches(graph, keys, graph.symbols.filter(F.col("name") == name))
        meant = top.filter(is_acceptable() & (F.col("module_path") == module)).select("name", F.col("from_place").alias("path"))
        refs = refs.join(meant, ["name", "path"], "left_semi")
    return refs.select(*graph.refs.columns).orderBy(*POSITION)
