"""The five fact tables: columns, types, defaults and the schema version."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 2

_INTEGERS = {"start_line", "start_col"}
_COLUMNS = {
    "files": ("path", "content_hash"),
    "symbols": ("name", "kind", "path", "start_line", "start_col", "module_path"),
    "refs": ("name", "path", "start_line", "start_col", "kind", "container"),
    "imports": ("path", "module_path", "alias"),
    "impls": ("type_name", "trait_name", "path", "start_line", "start_col"),
}
TABLES: dict[str, T.StructType] = {t: T.StructType([T.StructField(c, T.IntegerType() if c in _INTEGERS else T.StringType()) for c in columns]) for t, columns in _COLUMNS.items()}
#: What columns that an older index lacks are filled with.
DEFAULTS = {"module_path": "", "container": "", "kind": "call"}
REFERENCE_KINDS = ["call", "macro", "method", "type", "path"]


@dataclass(frozen=True)
class Graph:
    """The fact tables of one snapshot."""

    files: DataFrame
    symbols: DataFrame
    refs: DataFrame
    imports: DataFrame
    impls: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.symbols.sparkSession

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with exactly the columns of a table; missing ones get their default, unknown reference kinds count as calls."""
    schema = TABLES[table]
    columns = []
    for field in schema:
        value = F.col(field.name) if field.name in df.columns else F.lit(DEFAULTS.get(field.name))
        if table == "refs" and field.name == "kind":
            value = F.when(value.isin(REFERENCE_KINDS), value).otherwise("call")
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def from_frames(spark: SparkSession, **frames: DataFrame) -> Graph:
    """A graph from any of the five tables; those not given are empty."""
    unknown = set(frames) - set(TABLES)
    if unknown:
        raise ValueError(f"unknown tables: {sorted(unknown)}")
    return Graph(**{t: conform(frames[t], t) if t in frames else spark.createDataFrame([], schema) for t, schema in TABLES.items()})
