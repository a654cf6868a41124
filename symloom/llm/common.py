"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import math
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

SLICE_ROWS = 512
BATCH_ROWS = 1000
#: The share of the driver's largest heap above which what is committed of it is given back.
HEAP_SHARE = 0.5
#: How much of the driver's heap a full collection leaves free, in percent, at least and at most.
HEAP_FREE = {"MinHeapFreeRatio": 10, "MaxHeapFreeRatio": 25}
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
_CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_folder: list[str] = []
_scopes: list[list[str]] = [[]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one corpus table by Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Where the setting is missing, a temporary folder stands in for it, on a
    single-JVM ``local[*]`` master only.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="symloom-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return f"file://{_own_folder[0]}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    A lost executor then costs a re-read, never a recomputation of what came before.
    The shuffles that made it go at once, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/symloom-{label}-{uuid.uuid4().hex}"
    with _shuffles_go(spark):
        df.write.parquet(path)
    _scopes[-1].append(path)
    give_back(spark)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Executions that begin inside delete their shuffle files when they end."""
    before = spark.conf.get(_CLEANUP_SETTING, None)
    spark.conf.set(_CLEANUP_SETTING, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP_SETTING)
        else:
            spark.conf.set(_CLEANUP_SETTING, before)


def give_back(spark: SparkSession) -> None:
    """Give memory of the driver that holds nothing back to the system.

    The driver's JVM lets its heap grow with the plans and broadcasts of each
    job to several times what lives, and shrinks it in full collections only;
    Python's freed arrays stay with its allocators. Unless told otherwise, such
    a collection keeps a heap over three times as large as what lives.
    """
    jvm = spark._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > HEAP_SHARE * heap.maxMemory():
        for option, percent in HEAP_FREE.items():
            _manage(spark, "HotSpotDiagnostic", "setVMOption", option, str(percent))
        jvm.java.lang.System.gc()
        _manage(spark, "DiagnosticCommand", "systemTrimNativeHeap")
    trim()


def _manage(spark: SparkSession, bean: str, operation: str, *arguments: str) -> None:
    """Call an operation of the driver's JVM on itself; nothing happens if this JVM lacks it."""
    java, array = spark._jvm.java, spark.sparkContext._gateway.new_array

    def of(kind, items: list):
        out = array(kind, len(items))
        for i, x in enumerate(items):
            out[i] = x
        return out

    kinds = [java.lang.Class.forName(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
    name = spark._jvm.javax.management.ObjectName(f"com.sun.management:type={bean}")
    given = [name, operation, of(java.lang.Object, list(arguments)), of(java.lang.String, ["java.lang.String"] * len(arguments))]
    with suppress(Py4JError):  # by the interface's method, as the server's own class is not open to callers
        call = java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", of(java.lang.Class, kinds))
        call.invoke(java.lang.management.ManagementFactory.getPlatformMBeanServer(), of(java.lang.Object, given))


def trim() -> None:
    """Give what this Python process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if release:
        release(0)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialize`` writes inside are deleted at the end, all but the last, which is the result."""
    _scopes.append([])
    try:
        yield
    finally:
        *inner, result = _scopes.pop() or [None]
        for path in inner:
            drop_table(spark, path)
        if result is not None:
            _scopes[-1].append(result)


def written() -> list[str]:
    """The tables of the current scope, oldest first."""
    return list(_scopes[-1])


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table that ``materialize`` wrote; nothing may read it any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    for scope in _scopes:
        if path in scope:
            scope.remove(path)


def tasks_for(rows: int, rows_per_task: int) -> int:
    """How many tasks ``rows`` need if each is to hold about ``rows_per_task``."""
    return max(1, math.ceil(rows / rows_per_task))


def spread(df: DataFrame, rows: int, rows_per_task: int, *keys: str) -> DataFrame:
    """Deal ``rows`` rows evenly by ``keys``, so that what multiplies them later runs on all cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, tasks_for(rows, rows_per_task)), *keys)


def crc_bucket(id_column: str, modulus: int):
    """crc32 of the id written as text, modulo ``modulus`` (a null id counts as empty text)."""
    return F.crc32(F.encode(F.coalesce(F.col(id_column).cast("string"), F.lit("")), "UTF-8")) % modulus


def map_batches(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow``, with batches of at most ``BATCH_ROWS`` rows unless the session sets a size of its own.

    Spark's 10,000 rows of whole texts make batches that weigh on an executor
    several times over, in the JVM and in its Python workers. Workers stay for
    later tasks, and keep nothing that a task has freed.
    """

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        trim()

    conf = df.sparkSession.conf
    if conf.get(_BATCH_SETTING) == _BATCH_DEFAULT:
        conf.set(_BATCH_SETTING, str(BATCH_ROWS))
    return df.mapInArrow(trimmed, schema)


def slices(batches: Iterator) -> Iterator:
    """The batches in parts of at most ``SLICE_ROWS`` rows, so that few texts at a time are Python objects."""
    for batch in batches:
        for k in range(0, max(1, batch.num_rows), SLICE_ROWS):
            yield batch.slice(k, SLICE_ROWS)


def texts_of(batches: Iterator, column: int) -> Iterator[tuple]:
    """Each part of the batches with one of its columns as a list of str, null as ''."""
    for batch in slices(batches):
        yield batch, [x or "" for x in batch.column(column).to_pylist()]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most_chars: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` rows (doc_id, text, label) of each class, and how many labelled ids each class has in all.

    The texts of both classes together hold at most ``most_chars`` characters:
    rows are taken whole, in order, while their class's half lasts, and none
    whose text alone takes over a sixteenth of it.

    ``labels`` holds the rows that may be learned from. Labels other than 0 and
    1 are left out, of repeated ids the larger label and the smaller text count.
    The choice follows a hash of the id. The ids chosen are at most
    2 x ``per_class`` rows, which is what makes it right to broadcast them.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    totals = {0: 0, 1: 0} | {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    ranked = [known.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    chosen = F.broadcast(ranked[0].unionByName(ranked[1]))
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = texts.join(chosen, "doc_id").filter(F.length("text") <= most_chars // 32).groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    so_far = F.sum(F.length("text")).over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id"))
    return sample.withColumn("__chars", so_far).filter(F.col("__chars") <= most_chars // 2).select("doc_id", "text", "label"), totals


def with_columns(docs: DataFrame, text_column: str, columns: dict[str, str], make) -> DataFrame:
    """``docs`` with more columns (name: 'double', 'int', 'long', 'string' or 'boolean') computed from one text column.

    ``make()`` is called once per task and returns a function from a text to the
    tuple of new values; null texts come as ''.
    """

    def make_all():
        value = make()
        return lambda texts: map(value, texts)

    return with_columns_at_once(docs, text_column, columns, make_all)


def with_columns_at_once(docs: DataFrame, text_column: str, columns: dict[str, str], make) -> DataFrame:
    """As ``with_columns``, with a function from a list of at most ``SLICE_ROWS`` texts to the tuples of all."""
    kinds = {"double": pa.float64(), "int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = make()
        for batch, texts in texts_of(batches, place):
            new = list(zip(*values(texts), strict=True)) or [()] * len(columns)
            fields = [batch.schema.field(i) for i in range(batch.num_columns)] + [pa.field(c, kinds[t]) for c, t in columns.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, kinds[t]) for x, t in zip(new, columns.values(), strict=True))], schema=pa.schema(fields))

    place = docs.columns.index(text_column)
    schema = docs.schema
    for name, kind in columns.items():
        schema = T.StructType([*schema.fields, T.StructField(name, T._parse_datatype_string(kind))])
    return map_batches(docs, add, schema)


def logistic_fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Coefficients, the last one the intercept, of a weighted logistic regression by Newton steps."""
    x = np.column_stack((x, np.ones(len(x))))
    beta, penalty = np.zeros(x.shape[1]), ridge * np.diag([*[1.0] * (x.shape[1] - 1), 1e-6])
    weight = weight / max(weight.sum(), 1e-12)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def logistic(z: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
