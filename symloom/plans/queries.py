"""The registered queries: each operator over the star-schema graph, for all names at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symloom.functions.names import identity
from symloom.operators import accuracy, dependencies, envelope, impact, lookups, resolve, target
from symloom.plans import pages
from symloom.plans.projection import meant_definitions, star_graph
from symloom.plans.storage import stored
from symloom.schema import Graph
from symloom.sources import changes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(make: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
    """Register a function of the graph under its name."""
    QUERIES[make.__name__] = lambda spark, sf_dir: make(star_graph(spark, sf_dir))
    return make


def _ranked(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


@query
def definition(g: Graph) -> DataFrame:
    return _ranked(g.symbols, ["name"], [*lookups.POSITION, "module_path", "kind"])


@query
def definition_qualified(g: Graph) -> DataFrame:
    ids = g.symbols.withColumn("qualified_name", identity(F.col("module_path"), F.col("name")))
    return _ranked(ids, ["qualified_name"], [*lookups.POSITION, "kind"]).drop("name", "module_path")


@query
def references(g: Graph) -> DataFrame:
    return _ranked(g.refs, ["name"], [*lookups.POSITION, "kind", "container"])


@query
def implementations(g: Graph) -> DataFrame:
    return _ranked(g.impls.filter("trait_name is not null"), ["trait_name"], [*lookups.POSITION, "type_name"])


@query
def inherent_impls(g: Graph) -> DataFrame:
    return g.impls.filter("trait_name is null").groupBy("type_name", "path").agg(F.count("*").alias("n_impls"))


@query
def imports_of_file(g: Graph) -> DataFrame:
    return _ranked(g.imports, ["path"], ["module_path", F.asc_nulls_first("alias")])


@query
def modules_of_file(g: Graph) -> DataFrame:
    return lookups.file_modules(g)


@query
def files_of_module(g: Graph) -> DataFrame:
    return _ranked(lookups.module_files(g), ["module_path"], ["path"])


@query
def first_file_of_module(g: Graph) -> DataFrame:
    return lookups.first_file_of_module(g)


@query
def ref_names_of_file(g: Graph) -> DataFrame:
    return lookups.reference_names(g)


@query
def existing_hashes(g: Graph) -> DataFrame:
    return g.files


@query
def import_keys(g: Graph) -> DataFrame:
    return resolve.import_keys(g.imports)


def _reference_keys(g: Graph) -> DataFrame:
    return g.refs.select("name", F.col("path").alias("from_place"))


@query
def resolve_ranked(g: Graph) -> DataFrame:
    return resolve.ranked_matches(g, _reference_keys(g))


@query
def resolve_from_module(g: Graph) -> DataFrame:
    """Asked from a module instead of a file: its own symbols rank first."""
    places = g.symbols.select("name", F.col("module_path").alias("from_place"))
    return resolve.top_matches(g, places).drop("n_candidates", "kind")


@query
def top_match(g: Graph) -> DataFrame:
    return resolve.top_matches(g, _reference_keys(g)).drop("kind")


@query
def acceptable_top(g: Graph) -> DataFrame:
    top = resolve.top_matches(g, _reference_keys(g)).filter(resolve.is_acceptable())
    return top.select("name", "from_place", "tier", "path", "start_line", "module_path")


@query
def callers(g: Graph) -> DataFrame:
    """How many references mean each module's definition, by tier."""
    meant = resolve.reference_matches(g).filter(resolve.is_acceptable())
    return meant.groupBy("name", F.col("top_module_path").alias("target_module"), "tier").agg(F.count("*").alias("n_refs"))


@query
def callers_precise(g: Graph) -> DataFrame:
    return resolve.callers(g)


@query
def target_normalize(g: Graph) -> DataFrame:
    return target.target_files(g, _targets(g))


@query
def preferred_module(g: Graph) -> DataFrame:
    return target.preferred_modules(g, _targets(g))


def _targets(g: Graph) -> DataFrame:
    """Every path, module and symbol name."""
    paths, modules, names = g.files.select(F.col("path").alias("target")), g.symbols.select("module_path"), g.symbols.select("name")
    return paths.union(modules).union(names).distinct()


@query
def dependencies_all(g: Graph) -> DataFrame:
    return dependencies.dependencies(g, lookups.module_files(g).withColumnRenamed("module_path", "target"))


@query
def dependencies_of_symbols(g: Graph) -> DataFrame:
    return dependencies.dependencies(g, target.target_files(g, g.symbols.select(F.col("name").alias("target"))))


@query
def import_longest_prefix(g: Graph) -> DataFrame:
    return dependencies.import_modules(g)


@query
def call_edges(g: Graph) -> DataFrame:
    return impact.call_edges(g)


@query
def impact_closure(g: Graph) -> DataFrame:
    return impact.closure_of_all(stored(impact.call_edges(g), "call-edges"), impact.seeds_of_definitions(g.symbols))


@query
def impact_symbols(g: Graph) -> DataFrame:
    return impact.impact_of_all(g, impact.seeds_of_definitions(g.symbols))


@query
def container_symbols(g: Graph) -> DataFrame:
    return impact.container_symbols(g, g.refs.select("container")).distinct()


def _with_notes(df: DataFrame) -> DataFrame:
    return df.withColumn("notes", F.array_join("notes", "|"))


@query
def envelope_definition(g: Graph) -> DataFrame:
    return _with_notes(envelope.definition_envelopes(g))


@query
def envelope_references(g: Graph) -> DataFrame:
    return _with_notes(envelope.reference_envelopes(g))


@query
def envelope_callers(g: Graph) -> DataFrame:
    return _with_notes(envelope.reference_envelopes(g, as_callers=True))


def _simulated_scan(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Some files gone from the index, some from disk, some changed."""
    key = F.regexp_extract("path", r"/s([0-9]+)\.rs$", 1).cast("long")
    files = g.files.withColumn("key", key)
    old = files.filter("key % 10 <> 0").withColumn("content_hash", F.when(F.col("key") % 7 == 0, F.sha2(F.concat("content_hash", F.lit("x")), 256)).otherwise(F.col("content_hash")))
    return files.filter("key % 11 <> 0"), old


@query
def hash_diff(g: Graph) -> DataFrame:
    scan, old = _simulated_scan(g)
    return changes.outcomes(scan, old, failed=F.col("key") % 13 == 0)


@query
def hash_diff_stats(g: Graph) -> DataFrame:
    scan, old = _simulated_scan(g)
    return changes.stats(changes.outcomes(scan, old, failed=F.col("key") % 13 == 0))


def accuracy_prf1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the acceptable match is the definition a reference was made from, by kind of definition."""
    g = star_graph(spark, sf_dir)
    found = resolve.top_matches(g, _reference_keys(g)).filter(resolve.is_acceptable()).select("name", "from_place", "path", "start_line").withColumn("method", F.lit("resolver"))
    first = resolve.top_matches(g, _reference_keys(g)).select("name", "from_place", "path", "start_line").withColumn("method", F.lit("name only"))
    gold = meant_definitions(spark, sf_dir)
    both = gold.withColumn("method", F.lit("resolver")).unionByName(gold.withColumn("method", F.lit("name only")))
    return accuracy.scores(found.unionByName(first), both, ["method"], ["name", "from_place", "path", "start_line"])


QUERIES |= {f.__name__: f for f in (accuracy_prf1, pages.plugin_symbols, pages.plugin_references, pages.plugin_files)}
