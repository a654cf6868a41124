"""A deterministic symbol graph over the star schema, so that every operator runs on tables of any size.

Suppliers are files, parts symbols and impls, line items references, customers
imports; every row of these tables takes part. Part keys are dense, so that names repeat across files and modules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from symloom.schema import Graph, conform

_FILE = "concat('src/m', s_nationkey, '/s', s_suppkey, '.rs')"
_MODULE = "concat('crate::m', s_nationkey)"

FILES = f"SELECT {_FILE} AS path, sha2(s_name, 256) AS content_hash FROM {{supplier}}"

_PARTS = f"""
  SELECT p.*, {_FILE} AS path, {_MODULE} AS module_path,
         concat('sym_', p_partkey % {{names}}) AS name
  FROM {{part}} p JOIN {{supplier}} s ON s_suppkey = p_partkey % {{suppliers}}"""

SYMBOLS = f"""
SELECT name, element_at(array('function', 'struct', 'trait', 'impl'), CAST(p_size % 4 AS INT) + 1) AS kind,
       path, p_size AS start_line, 1 AS start_col, module_path
FROM ({_PARTS})"""

REFS = f"""
SELECT concat('sym_', l_partkey % {{names}}) AS name, {_FILE} AS path,
       CAST(l_orderkey % 2147483647 AS INT) AS start_line, l_linenumber AS start_col,
       CASE l_returnflag WHEN 'A' THEN 'call' WHEN 'R' THEN 'method' ELSE 'type' END AS kind,
       concat(c.module_path, '::', c.name) AS container, l_partkey
FROM {{lineitem}}
JOIN {{supplier}} s ON s_suppkey = l_suppkey
JOIN ({_PARTS}) c ON c.p_partkey = l_orderkey % {{parts}}"""

IMPORTS = f"""
SELECT {_FILE} AS path,
       concat('crate::m', c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('::sym_', c_custkey % {{names}}) END) AS module_path,
       CASE WHEN c_custkey % 5 = 0 THEN concat('sym_', c_custkey % {{names}}) END AS alias
FROM {{customer}} JOIN {{supplier}} s ON s_suppkey = c_custkey % {{suppliers}}"""

IMPLS = f"""
SELECT p_brand AS type_name, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_type END AS trait_name, path, p_size AS start_line, 1 AS start_col
FROM ({_PARTS})"""


class _Star:
    """The tables a graph is made of, and their sizes, which the keys are taken modulo of."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "part", "lineitem", "customer")}
        parts = self.tables["part"].count()
        self.sizes = {"parts": max(1, parts), "names": max(1, parts // 3), "suppliers": max(1, self.tables["supplier"].count())}

    def select(self, text: str) -> DataFrame:
        used = {t: df for t, df in self.tables.items() if f"{{{t}}}" in text}
        return self.spark.sql(text, **used, **self.sizes)


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    star = _Star(spark, sf_dir)
    texts = {"files": FILES, "symbols": SYMBOLS, "refs": REFS, "imports": IMPORTS, "impls": IMPLS}
    return Graph(**{name: conform(star.select(text), name) for name, text in texts.items()})


def meant_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gold standard: (name, from_place, path, start_line) of the part that each reference was made from."""
    star = _Star(spark, sf_dir)
    refs = star.select(REFS).selectExpr("name", "path AS from_place", "l_partkey")
    parts = star.select(_PARTS).selectExpr("p_partkey AS l_partkey", "path", "p_size AS start_line")
    return refs.join(parts, "l_partkey").select("name", "from_place", "path", "start_line").distinct()
