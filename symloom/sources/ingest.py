"""Incremental indexing: scan, compare hashes, extract what changed, commit.

Only changed files reach the extractors: the anti-join with the stored hashes
comes before the Python stage. One pass over a file gives all of its facts as
one row of arrays, which the five tables are split from.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.errors import ParseError
from symloom.plans.storage import stored
from symloom.schema import TABLES
from symloom.sources import changes
from symloom.sources.crawl import scan
from symloom.sources.extract import Registry, default_registry
from symloom.sources.store import Store

_FACTS = """path string, content_hash string, failed boolean,
symbols array<struct<name:string,kind:string,start_line:int,start_col:int,module_path:string>>,
refs array<struct<name:string,start_line:int,start_col:int,kind:string,container:string>>,
imports array<struct<module_path:string,alias:string>>,
impls array<struct<type_name:string,trait_name:string,start_line:int,start_col:int>>"""
_FIELDS = {
    "symbols": (("name", pa.string()), ("kind", pa.string()), ("start_line", pa.int32()), ("start_col", pa.int32()), ("module_path", pa.string())),
    "refs": (("name", pa.string()), ("start_line", pa.int32()), ("start_col", pa.int32()), ("kind", pa.string()), ("container", pa.string())),
    "imports": (("module_path", pa.string()), ("alias", pa.string())),
    "impls": (("type_name", pa.string()), ("trait_name", pa.string()), ("start_line", pa.int32()), ("start_col", pa.int32())),
}


@dataclass(frozen=True)
class IndexStats:
    indexed: int = 0
    skipped: int = 0
    removed: int = 0
    errors: int = 0

    def changed(self) -> bool:
        return self.indexed + self.removed + self.errors > 0

    def as_dict(self) -> dict[str, int]:
        return asdict(self)


def _extractor(registry: Registry):
    kinds = {t: pa.list_(pa.struct(list(fields))) for t, fields in _FIELDS.items()}

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, hashes, texts = (batch.column(k).to_pylist() for k in range(3))
            failed: list[bool] = []
            facts: dict[str, list] = {t: [] for t in _FIELDS}
            for path, text in zip(paths, texts, strict=True):
                language = registry.for_extension(path.rpartition(".")[2])
                found = None
                if language is not None and text is not None:
                    try:
                        found = language.extract(path, text)
                    except (ParseError, RecursionError, IndexError, ValueError):
                        found = None
                failed.append(found is None)
                for t, fields in _FIELDS.items():
                    rows = [] if found is None else getattr(found, t)
                    facts[t].append([dict(zip((n for n, _ in fields), r, strict=True)) for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(hashes, pa.string()), pa.array(failed), *(pa.array(facts[t], kinds[t]) for t in _FIELDS)], ["path", "content_hash", "failed", *_FIELDS])

    return extract


def extract_facts(files: DataFrame, registry: Registry) -> DataFrame:
    """Facts of ``files`` (path, content_hash, content): a row of arrays each; ``failed`` where the text is not UTF-8 or cannot be parsed."""
    text = F.when(F.expr("is_valid_utf8(cast(content as string))"), F.decode("content", "UTF-8"))
    return files.select("path", "content_hash", text.alias("text")).mapInArrow(_extractor(registry), _FACTS)


def split_facts(facts: DataFrame) -> dict[str, DataFrame]:
    """The five tables of facts that did not fail."""
    good = facts.filter(~F.col("failed"))
    tables = {"files": good.select("path", "content_hash")}
    for t in _FIELDS:
        tables[t] = good.select("path", F.explode(t).alias("x")).select("path", "x.*")
    return tables


def update(store: Store, scanned: DataFrame, registry: Registry | None = None) -> IndexStats:
    """Bring an index in line with a scan (path, content): all or nothing.

    A file that fails is on disk, so what was indexed of it stays and it counts
    as an error each time. Paths that are indexed but not in the scan are removed.
    """
    registry = registry or default_registry()
    files = store.graph().files
    hashed = scanned.withColumn("content_hash", F.sha2(F.coalesce("content", F.lit(b"")), 256))
    fresh = hashed.join(files, ["path", "content_hash"], "left_anti")
    facts = stored(extract_facts(fresh, registry), "facts")
    on_disk = stored(hashed.select("path", "content_hash"), "scan")
    outcome = changes.outcomes(on_disk.join(facts.select("path", "failed"), "path", "left"), files, F.col("failed"))
    outcome = stored(outcome, "outcome")
    stats = IndexStats(**changes.stats(outcome).first().asDict())
    if stats.indexed or stats.removed:
        dropped = outcome.filter(F.col("outcome").isin(changes.CHANGED, changes.REMOVED)).select("path")
        store.commit(split_facts(facts), dropped)
    elif not store.exists():
        store.commit({t: store.spark.createDataFrame([], s) for t, s in TABLES.items()}, store.spark.createDataFrame([], "path string"))
    return stats


def index_path(spark: SparkSession, root: str, folder: str, registry: Registry | None = None) -> IndexStats:
    """Index the tree at ``root`` into the index at ``folder``.

    Paths are relative to ``root``: indexing a subfolder into the same index
    takes away everything outside it.
    """
    registry = registry or default_registry()
    root = os.path.realpath(root) if "://" not in root else root
    return update(Store(spark, folder), scan(spark, root, registry.extensions()), registry)
