"""Approximate nearest neighbours by an adaptive dimension scan within probed lists.

Vectors are put into lists by their nearest centroid, and every query probes its
nearest lists. There, vectors are turned by a random rotation and compared in
blocks of columns: after each block a hypothesis test on the partial distance
abandons candidates that are beyond the k-th best so far with high confidence.
What survives is measured exactly, on the original vectors in double precision.

Centroids are fitted on a bounded sample, on which the number of lists to probe
is tuned too: it is the one that holds ``TARGET_RECALL`` of the sample's true
neighbours. Every row is indexed. Lists and the queries that probe them are cut
into blocks by hash, so that no task holds a list, however full, at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symloom.llm.common import map_batches, materialize, table

NEIGHBOURS = 10
QUERY_MODULUS = 100
#: Bounds of the sample: rows, and bytes of it as doubles.
SAMPLE_ROWS = 20_000
SAMPLE_BYTES = 64 << 20
MAX_LISTS = 4096
TARGET_RECALL = 0.99
TUNING_QUERIES = 200
#: Rows of a list, and queries, that one task compares at once.
BLOCK_ROWS = 8192
BLOCK_QUERIES = 1024
COLUMNS = 16
#: Significance of the test: larger abandons later.
EPSILON = 2.1
_CHUNK = 1024


@dataclass
class ListIndex:
    centroids: np.ndarray
    rotation: np.ndarray
    probes: int

    def nearest_lists(self, x: np.ndarray, k: int) -> np.ndarray:
        score = (self.centroids**2).sum(axis=1) - 2 * x @ self.centroids.T
        return np.argsort(score, axis=1, kind="stable")[:, :k]


def usable(vectors: Column) -> Column:
    """True for vectors without null or non-finite components that are neither null, empty nor zero."""
    finite = F.forall(vectors, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(vectors.isNotNull() & finite & F.exists(vectors, lambda x: x != 0), F.lit(False))


def usable_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part.

    A null vec_id takes no part, nor do vectors of another length than the most
    frequent one (the shorter on a tie).
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("v") == most.d) if most else rows


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: np.random.Generator) -> np.ndarray:
    centres = np.unique(x[seed.choice(len(x), k, replace=False)], axis=0)
    for _ in range(rounds):
        score = (centres**2).sum(axis=1) - 2 * x @ centres.T
        near = score.argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        count = np.bincount(near, minlength=len(centres))
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def fit_lists(rows: DataFrame, total: int, neighbours: int = NEIGHBOURS, target_recall: float = TARGET_RECALL, seed: int = 7) -> ListIndex:
    """Centroids, rotation and number of probes from at most ``SAMPLE_ROWS`` rows, chosen by a hash of their ids."""
    d = len(rows.first().v)
    bound = min(SAMPLE_ROWS, max(SAMPLE_BYTES // (8 * d), 1000))
    share = min(1.0, 1.1 * bound / total + 20 / total)
    order = F.xxhash64(F.lit("sample"), "vec_id")
    sample = rows.filter(F.shiftrightunsigned(order, 11) < share * float(1 << 53)).orderBy(order, "vec_id", "v").limit(bound)
    x = np.array([r.v for r in sample.select("v").toLocalIterator()])
    random = np.random.default_rng(seed)
    rotation = np.linalg.qr(random.standard_normal((d, d)))[0]
    lists = max(1, min(MAX_LISTS, math.isqrt(total), len(x) // 4 or 1))
    index = ListIndex(_kmeans(x, lists, 10, random), rotation, 1)
    tests = x[random.choice(len(x), min(TUNING_QUERIES, len(x)), replace=False)]
    home = index.nearest_lists(x, 1)[:, 0]
    rank = np.argsort(index.nearest_lists(tests, len(index.centroids)), axis=1)  # place of each list in each test's order
    needed = []
    for i, t in enumerate(tests):
        distance = ((x - t) ** 2).sum(axis=1)
        near = np.argsort(distance, kind="stable")[: neighbours + 1]
        needed += rank[i, home[near[distance[near] > 0]]].tolist()
    index.probes = 1 + int(np.quantile(needed, target_recall, method="higher")) if needed else 1
    return index


def scan(candidates: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, rotation: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """(query id, candidate id, distance) of each query's k nearest of the candidates, ties to the smaller id; its own id is left out."""
    order = np.argsort(ids, kind="stable")
    ids, candidates = ids[order], candidates[order]
    turned, asked = candidates @ rotation, queries @ rotation
    d = candidates.shape[1]
    for q, (query, query_id) in enumerate(zip(queries, query_ids.tolist(), strict=True)):
        best, best_ids, limit = np.zeros(0), np.zeros(0, np.int64), math.inf
        for at in range(0, len(ids), _CHUNK):
            alive = np.arange(at, min(at + _CHUNK, len(ids)))
            alive = alive[ids[alive] != query_id]
            partial = np.zeros(len(alive))
            if limit < math.inf:
                for c in range(0, d, COLUMNS):
                    seen = min(c + COLUMNS, d)
                    partial = partial + ((turned[alive, c:seen] - asked[q, c:seen]) ** 2).sum(axis=1)
                    slack = (1 + EPSILON / math.sqrt(seen)) ** 2 if seen < d else 1 + 1e-9
                    keep = partial * (d / seen) <= limit * slack
                    alive, partial = alive[keep], partial[keep]
                    if not len(alive):
                        break
            if len(alive):
                best = np.concatenate((best, ((candidates[alive] - query) ** 2).sum(axis=1)))
                best_ids = np.concatenate((best_ids, ids[alive]))
                top = np.lexsort((best_ids, best))[:k]
                best, best_ids = best[top], best_ids[top]
                limit = float(best[-1]) if len(best) == k else math.inf
        for distance, other in zip(np.sqrt(best).tolist(), best_ids.tolist(), strict=True):
            yield query_id, other, distance


def search(rows: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, target_recall: float = TARGET_RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found of each query, by Euclidean distance.

    ``rows`` and ``queries`` come from ``usable_rows``. Rows with a query's own
    vec_id are no candidates of it; a query id that repeats counts once, with its
    smallest vector, while candidate rows that repeat count each. Ties go to the smaller vec_id.
    """
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = materialize(rows, "vectors")
    total = rows.count()
    if not total:
        return empty
    index = fit_lists(rows, total, k, target_recall)
    sent = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = sent.value.nearest_lists(_matrix(batch.column(1)), 1)[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32))], ["vec_id", "v", "list"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = sent.value.nearest_lists(_matrix(batch.column(1)), sent.value.probes)
                rows_of = np.repeat(np.arange(batch.num_rows), near.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows_of)), pa.array(near.ravel().astype(np.int32))], ["query_id", "list"])

    listed = materialize(map_batches(rows.select("vec_id", "v"), assign, "vec_id long, v array<double>, list int"), "lists")
    asked = materialize(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    probes = materialize(map_batches(asked.select("vec_id", "v"), probe, "query_id long, list int"), "probes")
    # One row for each list, at most MAX_LISTS: small enough to broadcast.
    blocks = listed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("row_blocks"))
    blocks = F.broadcast(blocks.join(probes.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("query_blocks")), "list"))
    left = listed.join(blocks, "list").select("list", F.pmod(F.xxhash64("vec_id"), "row_blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("part"), "vec_id", "v")
    cut = probes.join(blocks, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)).alias("block"), F.pmod(F.xxhash64("query_id"), "query_blocks").cast("int").alias("part"), "query_id")
    right = cut.join(asked.select(F.col("vec_id").alias("query_id"), "v"), "query_id").select("list", "block", "part", "query_id", "v")

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = list(scan(np.stack(a["v"]), a["vec_id"].to_numpy(), np.stack(b["v"]), b["query_id"].to_numpy(), sent.value.rotation, k)) if len(a) and len(b) else []
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    keys = ["list", "block", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable_rows(table(spark, sf_dir, "embeddings"))
    return search(rows, rows.filter(F.col("vec_id") % QUERY_MODULUS == 0))
