"""The library's front: an index, opened from a folder or held as frames, and its queries."""

from __future__ import annotations

import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions.names import identity, symbol_target
from symloom.operators import dependencies, envelope, impact, lookups, resolve, target
from symloom.operators.envelope import QueryResult
from symloom.plans.storage import stored
from symloom.schema import Graph, from_frames
from symloom.sources.extract import Registry, default_registry
from symloom.sources.ingest import IndexStats, index_path
from symloom.sources.store import Store


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    return [r.asDict() for r in df.collect()]


def symbol_dto(r: dict[str, Any]) -> dict[str, Any]:
    return {"name": r["name"], "kind": r["kind"], "file": r["path"], "start_line": r["start_line"], "start_col": r["start_col"], "module_path": r["module_path"]}


def reference_dto(r: dict[str, Any]) -> dict[str, Any]:
    return {"name": r["name"], "file": r["path"], "start_line": r["start_line"], "start_col": r["start_col"], "kind": r["kind"], "container": r["container"]}


def impl_dto(r: dict[str, Any]) -> dict[str, Any]:
    return {"type_name": r["type_name"], "trait_name": r["trait_name"], "file": r["path"], "start_line": r["start_line"], "start_col": r["start_col"]}


def dependency_dto(r: dict[str, Any]) -> dict[str, Any]:
    return {"module_path": r["module_path"], "file": r["file"]}


class SymbolIndex:
    """Queries over one snapshot. Every query has a plain form (rows) and one with confidence, tier and notes."""

    def __init__(self, spark: SparkSession, store: Store | None, graph: Graph | None, registry: Registry | None = None, root: str | None = None):
        self.spark, self.store, self._graph, self.root = spark, store, graph, root
        self.registry = registry or default_registry()
        self._edges: DataFrame | None = None

    @classmethod
    def open(cls, spark: SparkSession, folder: str, registry: Registry | None = None, root: str | None = None) -> SymbolIndex:
        """An index in a folder; it need not exist yet. With ``root``, queries given ``auto_index`` bring it up to date first."""
        folder = folder if "://" in folder else os.path.abspath(folder)
        return cls(spark, Store(spark, folder), None, registry, root)

    @classmethod
    def from_frames(cls, spark: SparkSession, **frames: DataFrame) -> SymbolIndex:
        return cls(spark, None, from_frames(spark, **frames))

    @property
    def graph(self) -> Graph:
        if self._graph is None:
            assert self.store is not None
            self._graph = self.store.graph()
        return self._graph

    @property
    def edges(self) -> DataFrame:
        """The call edges of the snapshot, computed once."""
        if self._edges is None:
            self._edges = stored(impact.call_edges(self.graph), "call-edges")
        return self._edges

    def refresh(self) -> None:
        """Look at the latest snapshot."""
        if self.store is not None:
            self._graph = self._edges = None

    def index_path(self, root: str) -> IndexStats:
        if self.store is None:
            raise ValueError("an index made of frames has no folder to write to")
        stats = index_path(self.spark, root, self.store.folder, self.registry)
        self.refresh()
        return stats

    def auto_index(self) -> IndexStats:
        """An incremental pass over the root; nothing without one."""
        return self.index_path(self.root) if self.root is not None and self.store is not None else IndexStats()

    def _definitions(self, name: str, module: str | None) -> tuple[str | None, str, list[dict[str, Any]]]:
        module, bare = symbol_target(name, module)
        return module, bare, _rows(lookups.definitions(self.graph, bare, module))

    def definition_rows(self, name: str) -> list[dict[str, Any]]:
        """Definitions of exactly this name; a qualified one is not split."""
        return _rows(lookups.definitions(self.graph, name))

    @staticmethod
    def _missing(module: str | None, name: str) -> list[str]:
        return [envelope.NOTE_NOT_IN_MODULE.format(name=name, module=module)] if module is not None else []

    def definition_with_meta(self, name: str, module: str | None = None) -> QueryResult:
        module, bare, found = self._definitions(name, module)
        if len(found) > 1:
            return QueryResult.of(found, [3], True, [envelope.NOTE_MANY_DEFINITIONS.format(n=len(found), name=bare)])
        return QueryResult.of(found, [2] if found else [], False, [] if found else self._missing(module, bare))

    def _references(self, name: str, module: str | None, as_callers: bool) -> QueryResult:
        module, bare, defined = self._definitions(name, module)
        several = len(defined) > 1
        modules = {d["module_path"] for d in defined}
        meant = module if module is not None else next(iter(modules)) if len(modules) == 1 else None
        found = _rows(resolve.callers_of(self.graph, bare, meant))
        tier = 1 if meant is not None and not several else 3 if several or as_callers else 2
        notes = [envelope.NOTE_MANY_CALLERS if as_callers else envelope.NOTE_MANY_REFERENCES] if several else []
        if not found and not defined:
            notes += self._missing(module, bare)
        return QueryResult.of(found, [tier] if found else [], several, notes)

    def references_with_meta(self, name: str, module: str | None = None) -> QueryResult:
        return self._references(name, module, as_callers=False)

    def callers_with_meta(self, name: str, module: str | None = None) -> QueryResult:
        return self._references(name, module, as_callers=True)

    def implementations_with_meta(self, trait: str) -> QueryResult:
        found = _rows(lookups.implementations(self.graph, trait))
        return QueryResult.of(found, [2] if found else [], False, [] if found else [envelope.NOTE_NO_IMPLEMENTATIONS])

    def _target_files(self, name: str) -> DataFrame:
        asked = self.spark.range(1).select(F.lit(name).alias("target"))
        g = self.graph
        near = Graph(g.files.filter(F.col("path") == name), g.symbols.filter((F.col("module_path") == name) | (F.col("name") == name)), g.refs, g.imports, g.impls)
        return target.target_files(near, asked).select("target", "path")

    def dependencies_with_meta(self, name: str) -> QueryResult:
        paths = [r.path for r in self._target_files(name).collect()]
        if not paths:
            return QueryResult.of([], [], False, [envelope.NOTE_NO_FILES.format(name=name)])
        pairs = self.spark.createDataFrame([(name, p) for p in paths], "target string, path string")
        found = _rows(dependencies.dependencies(self.graph, pairs, narrow=True).select("module_path", "file").orderBy("module_path"))
        return QueryResult.of(found, [1] if found else [], False, [] if found else [envelope.NOTE_NO_DEPENDENCIES.format(n=len(paths))])

    def impact_with_meta(self, name: str, module: str | None = None, structural: bool = False) -> QueryResult:
        module, bare, defined = self._definitions(name, module)
        if not defined:
            return QueryResult.of([], [], False, self._missing(module, bare))
        several = len(defined) > 1
        notes = [envelope.NOTE_MANY_IMPACT] if several else []
        named = lookups.definitions(self.graph, bare, module)
        found = self._impact(named.select(F.lit(bare).alias("seed"), identity(F.col("module_path"), F.col("name")).alias("id")), structural)
        if not found:
            return QueryResult.of([], [], several, notes)
        level, tier = (envelope.LOW, envelope.MIXED) if several else (envelope.MEDIUM, 2)
        return QueryResult(found, level, tier, [*notes, envelope.NOTE_IMPACT])

    def _impact(self, seeds: DataFrame, structural: bool) -> list[dict[str, Any]]:
        return _rows(impact.impact(self.graph, seeds.distinct(), self.edges, structural).drop("seed").orderBy(*impact.impact_order()))

    def impact_of_name(self, name: str) -> list[dict[str, Any]]:
        """Impact seeded by every definition of a name, or by the bare name where it has none."""
        found = lookups.definitions(self.graph, name)
        if found.isEmpty():
            seeds = self.spark.range(1).select(F.lit(name).alias("seed"), F.lit(name).alias("id"))
        else:
            seeds = impact.seeds_of_definitions(found)
        return self._impact(seeds, structural=False)

    def definition(self, name: str, module: str | None = None) -> list[dict[str, Any]]:
        return self.definition_with_meta(name, module).results

    def references(self, name: str, module: str | None = None) -> list[dict[str, Any]]:
        return self.references_with_meta(name, module).results

    def callers(self, name: str, module: str | None = None) -> list[dict[str, Any]]:
        return self.callers_with_meta(name, module).results

    def implementations(self, trait: str) -> list[dict[str, Any]]:
        return self.implementations_with_meta(trait).results

    def dependencies(self, name: str) -> list[dict[str, Any]]:
        return self.dependencies_with_meta(name).results

    def impact(self, name: str, module: str | None = None) -> list[dict[str, Any]]:
        return self.impact_with_meta(name, module).results
