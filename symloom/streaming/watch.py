"""Watching a source tree: a streaming source of file changes, and the query that indexes them.

Spark's file source takes files for immutable, so changes and removals need a
source of their own. It compares listings (path, time, size) and, once something
changed, waits until the tree has been quiet for the debounce time. Each batch
is one incremental pass; the index itself is the state, so a restarted query
that reports every file again costs a hash comparison.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from symloom.sources.crawl import walk
from symloom.sources.extract import Registry, default_registry
from symloom.sources.ingest import IndexStats, index_path

FORMAT = "symloom_tree"
DEBOUNCE_S = 0.2
SCHEMA = "path string, op string"


def listing(root: str, extensions: list[str]) -> dict[str, tuple[int, int]]:
    """(time, size) of each source file."""
    out = {}
    for path in walk(root, extensions):
        try:
            status = os.stat(os.path.join(root, path))
        except OSError:
            continue
        out[path] = (status.st_mtime_ns, status.st_size)
    return out


def difference(old: dict, new: dict) -> list[tuple[str, str]]:
    """(path, op) of what was created, modified or removed."""
    changed = [(p, "create" if p not in old else "modify") for p, s in new.items() if old.get(p) != s]
    return sorted([*changed, *((p, "remove") for p in old if p not in new)])


class TreeReader(SimpleDataSourceStreamReader):
    def __init__(self, root: str, extensions: list[str], debounce: float):
        self.root, self.extensions, self.debounce = root, extensions, debounce
        self.seen: dict[str, tuple[int, int]] = {}
        self.batches: dict[int, list[tuple[str, str]]] = {}

    def initialOffset(self) -> dict:
        return {"batch": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = listing(self.root, self.extensions)
        if now == self.seen:
            return iter([]), start
        while True:  # the deadline moves with each change
            time.sleep(self.debounce)
            later = listing(self.root, self.extensions)
            if later == now:
                break
            now = later
        end = {"batch": start["batch"] + 1}
        rows = difference(self.seen, now)
        self.batches[end["batch"]] = rows
        self.seen = now
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """What a restarted query left unfinished; the whole tree where that is no longer known."""
        wanted = range(start["batch"] + 1, end["batch"] + 1)
        if all(k in self.batches for k in wanted):
            return iter([r for k in wanted for r in self.batches[k]])
        return iter(difference({}, listing(self.root, self.extensions)))

    def commit(self, end: dict) -> None:
        self.batches = {k: v for k, v in self.batches.items() if k > end["batch"]}


class TreeSource(DataSource):
    """Options: root, extensions (JSON list), debounce (seconds)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> TreeReader:
        return TreeReader(self.options["root"], json.loads(self.options["extensions"]), float(self.options.get("debounce", DEBOUNCE_S)))


def read_changes(spark: SparkSession, root: str, extensions: list[str], debounce: float = DEBOUNCE_S) -> DataFrame:
    """The changes below a local root as a stream (path, op)."""
    spark.dataSource.register(TreeSource)
    return spark.readStream.format(FORMAT).option("root", os.path.realpath(root)).option("extensions", json.dumps(extensions)).option("debounce", str(debounce)).load()


def reindex_on_change(spark: SparkSession, root: str, folder: str, registry: Registry | None = None) -> IndexStats:
    """What a batch of changes calls for: one incremental pass."""
    return index_path(spark, root, folder, registry)


def watch(spark: SparkSession, root: str, folder: str, registry: Registry | None = None, checkpoint: str | None = None, on_pass=None) -> StreamingQuery:
    """Index ``root`` into ``folder``, now and after each change, until the query is stopped.

    ``on_pass`` is called with the statistics of each pass.
    """
    registry = registry or default_registry()

    def handle(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            stats = reindex_on_change(spark, root, folder, registry)
            if on_pass is not None:
                on_pass(stats)

    reindex_on_change(spark, root, folder, registry)  # an empty tree has no changes but gets an index
    writer = read_changes(spark, root, registry.extensions()).writeStream.foreachBatch(handle).trigger(processingTime="200 milliseconds")
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
