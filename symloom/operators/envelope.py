"""Confidence, resolution tier and notes of a result."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.operators.resolve import callers
from symloom.schema import Graph

HIGH, MEDIUM, LOW, MIXED = "high", "medium", "low", "mixed"

# Clients compare these texts.
NOTE_EMPTY = "No matching symbols found."
NOTE_FALLBACK = "Resolution used name-only fallback; results may include unrelated same-named symbols."
NOTE_MANY_DEFINITIONS = "Found {n} definitions for `{name}`; disambiguate with module arg or qualified name (e.g. `crate::mcp::{name}`)."
NOTE_NOT_IN_MODULE = "No definition for `{name}` in module `{module}`."
NOTE_MANY_REFERENCES = "Multiple definitions share this name; references fall back to name matching. Pass module or a qualified name to narrow."
NOTE_MANY_CALLERS = "No unique definition module; callers fall back to name matching. Pass module or a qualified name."
NOTE_NO_IMPLEMENTATIONS = "No implementations found (Rust traits only today; other languages stay empty when unambiguous extraction is unavailable)."
NOTE_NO_FILES = "No indexed files found for target `{name}`."
NOTE_NO_DEPENDENCIES = "Target resolved to {n} file(s) but no import/cross-file dependencies were recorded."
NOTE_MANY_IMPACT = "Multiple definitions; impact expands each qualified identity and may over-approximate. Pass module or a qualified name to narrow."
NOTE_IMPACT = "Impact is a candidate blast radius and may over-approximate; verify before edits."


def confidence(tiers: Sequence[int], several: bool) -> str:
    """Confidence from the tiers of the hits: without any it is low."""
    precise = [t <= 2 for t in tiers]
    if not any(precise):
        return LOW
    return HIGH if all(precise) and not several else MEDIUM


def resolution_tier(tiers: Sequence[int]) -> int | str:
    """0 without tiers, the tier if there is one, or 'mixed'."""
    distinct = set(tiers)
    return MIXED if len(distinct) > 1 else next(iter(distinct), 0)


@dataclass
class QueryResult:
    results: list[dict[str, Any]]
    confidence: str
    resolution_tier: int | str
    notes: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, results: list[dict[str, Any]], tiers: Sequence[int], several: bool, notes: Sequence[str] = ()) -> QueryResult:
        """No results are a confident miss; low confidence always carries a note."""
        notes = list(notes)
        if not results:
            return cls([], HIGH, resolution_tier(tiers), notes or [NOTE_EMPTY])
        level = confidence(tiers, several)
        if level == LOW and not notes:
            notes.append(NOTE_FALLBACK)
        return cls(results, level, resolution_tier(tiers), notes)

    def map_results(self, change: Callable[[dict[str, Any]], Any]) -> QueryResult:
        return QueryResult([change(r) for r in self.results], self.confidence, self.resolution_tier, list(self.notes))

    def as_dict(self) -> dict[str, Any]:
        return {"results": self.results, "confidence": self.confidence, "resolution_tier": self.resolution_tier, "notes": self.notes}


def _note(template: str):
    """A note over columns ``name`` and ``n_definitions``."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        key, _, rest = rest.partition("}")
        parts += [F.lit(before), F.col({"n": "n_definitions", "name": "name"}[key]).cast("string")]
    return F.concat(*parts, F.lit(rest))


def definition_envelopes(graph: Graph) -> DataFrame:
    """(name, n_results, confidence, resolution_tier, notes) of the definition query of every defined name."""
    counted = graph.symbols.groupBy("name").agg(F.count("*").alias("n_definitions"))
    several = F.col("n_definitions") > 1
    return counted.select(
        "name",
        F.col("n_definitions").alias("n_results"),
        F.when(several, LOW).otherwise(HIGH).alias("confidence"),
        F.when(several, "3").otherwise("2").alias("resolution_tier"),
        F.when(several, F.array(_note(NOTE_MANY_DEFINITIONS))).otherwise(F.array().cast("array<string>")).alias("notes"),
    )


def reference_envelopes(graph: Graph, as_callers: bool = False) -> DataFrame:
    """The same of the references query, or the callers query, of every name that is defined or referred to."""
    defined = graph.symbols.groupBy("name").agg(F.count("*").alias("n_definitions"), F.min("module_path").alias("low"), F.max("module_path").alias("high"))
    used = graph.refs.groupBy("name").agg(F.count("*").alias("n_refs"))
    meant = callers(graph).groupBy("name", "target_module").agg(F.count("*").alias("n_meant"))
    rows = defined.join(used, "name", "full").withColumn("n_definitions", F.coalesce("n_definitions", F.lit(0)))
    rows = rows.withColumn("module", F.when(F.col("low") == F.col("high"), F.col("low"))).join(meant.withColumnRenamed("target_module", "module"), ["name", "module"], "left")
    several, known = F.col("n_definitions") > 1, F.col("module").isNotNull()
    rows = rows.withColumn("n_results", F.coalesce(F.when(known, F.col("n_meant")).otherwise(F.col("n_refs")), F.lit(0)))
    none = F.col("n_results") == 0
    tier = F.when(known & ~several, 1).when(F.lit(as_callers) | several, 3).otherwise(2)
    many = NOTE_MANY_CALLERS if as_callers else NOTE_MANY_REFERENCES
    low = ~none & (tier == 3)
    notes = F.when(several, F.array(F.lit(many))).when(none, F.array(F.lit(NOTE_EMPTY))).when(low, F.array(F.lit(NOTE_FALLBACK))).otherwise(F.array().cast("array<string>"))
    return rows.select("name", "n_results", F.when(low, LOW).otherwise(HIGH).alias("confidence"), F.when(none, "0").otherwise(tier.cast("string")).alias("resolution_tier"), notes.alias("notes"))
