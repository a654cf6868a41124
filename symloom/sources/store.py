"""Snapshots of an index in a folder of any Hadoop file system.

A snapshot is a list of segments. An update writes one segment: the new rows of
the files it touched, and the paths whose older rows it takes away. Reading
leaves out rows that a later segment has taken away, so that an update costs
what changed and not what there is. When segments become many they are merged.
The pointer file is replaced by one rename, so a reader sees the old snapshot or
the new one; segments of replaced snapshots stay until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.errors import StorageError, UnsupportedSchema
from symloom.schema import TABLES, VERSION, Graph, conform

POINTER = "_CURRENT"
MAX_SEGMENTS = 8
#: The column that point lookups filter by, which each table's files are sorted by.
SORT_KEYS = {"files": "path", "symbols": "name", "refs": "name", "imports": "path", "impls": "trait_name"}


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self._fs.exists(self._path(f"{self.folder}/{POINTER}"))

    def _manifest(self) -> dict:
        """The current pointer; an empty index where there is none."""
        if not self.exists():
            return {"schema_version": VERSION, "segments": []}
        stream = self._fs.open(self._path(f"{self.folder}/{POINTER}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            found = json.loads(text)
        except ValueError as e:
            raise StorageError(f"{self.folder}/{POINTER} is not a pointer") from e
        if found["schema_version"] > VERSION:
            raise UnsupportedSchema(found["schema_version"], VERSION)
        return found

    def _point(self, segments: list[str]) -> None:
        text = json.dumps({"schema_version": VERSION, "segments": segments})
        new = self._path(f"{self.folder}/_{uuid.uuid4().hex}")
        stream = self._fs.create(new)
        stream.write(bytearray(text.encode()))
        stream.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri() if new.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._fs.makeQualified(new), self._fs.makeQualified(self._path(f"{self.folder}/{POINTER}")), options)

    def _read(self, segment: str, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{segment}/{table}")

    def graph(self) -> Graph:
        """The current snapshot. The frames name its segments, so later updates do not change what they read."""
        return self._graph(self._manifest()["segments"])

    def _graph(self, segments: list[str]) -> Graph:
        tables = {}
        gone: DataFrame | None = None
        parts: dict[str, list[DataFrame]] = {t: [] for t in TABLES}
        for segment in reversed(segments):
            for t in TABLES:
                rows = conform(self._read(segment, t), t)
                parts[t].append(rows if gone is None else rows.join(gone, "path", "left_anti"))
            dropped = self._read(segment, "dropped")
            gone = dropped if gone is None else gone.unionByName(dropped)
        for t, schema in TABLES.items():
            tables[t] = reduce(DataFrame.unionByName, parts[t]).select(*schema.names) if parts[t] else self.spark.createDataFrame([], schema)
        return Graph(**tables)

    def _write(self, segment: str, frames: dict[str, DataFrame], dropped: DataFrame) -> None:
        for t, df in frames.items():
            key = SORT_KEYS[t]
            # Ranges of (key, path) keep a key's rows together and still split a very frequent one.
            ordered = conform(df, t).repartitionByRange(F.col(key), F.col("path")).sortWithinPartitions(key, "path")
            ordered.write.option("parquet.bloom.filter.enabled#" + key, "true").parquet(f"{self.folder}/{segment}/{t}")
        dropped.select("path").write.parquet(f"{self.folder}/{segment}/dropped")

    def commit(self, frames: dict[str, DataFrame], dropped: DataFrame) -> None:
        """Add ``frames`` (all five tables) and take away older rows of the paths in ``dropped``, all at once."""
        segments = self._manifest()["segments"]
        new = f"seg-{len(segments)}-{uuid.uuid4().hex}"
        self._write(new, frames, dropped)
        self._point([*segments, new])
        if len(segments) + 1 > MAX_SEGMENTS:
            self.compact()

    def compact(self) -> None:
        """Merge all segments into one."""
        g = self.graph()
        new = f"seg-0-{uuid.uuid4().hex}"
        self._write(new, {t: g.table(t) for t in TABLES}, self.spark.createDataFrame([], "path string"))
        self._point([new])

    def vacuum(self) -> None:
        """Delete segments that the current snapshot does not name; readers of older snapshots must be done."""
        kept = set(self._manifest()["segments"])
        for status in self._fs.listStatus(self._path(self.folder)):
            name = status.getPath().getName()
            if name.startswith("seg-") and name not in kept:
                self._fs.delete(status.getPath(), True)
