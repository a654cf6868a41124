"""The corpus pipeline: toxicity, near-duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept. All stages but the last return the columns of ``documents``. A stage's
result is written as Parquet to the shared folder and read again as the next
one's input, so that a lost executor never costs more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm.common import crc_bucket, drop_table, materialize, scratch, table, written
from symloom.llm.decontaminate import decontaminate
from symloom.llm.packing import pack_documents
from symloom.llm.pii import sanitise
from symloom.llm.simhash import representatives
from symloom.llm.toxicity import THRESHOLD, fit_toxicity, score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose toxicity score is below the threshold, as they are."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").filter(crc_bucket("doc_id", 5) != 0))
    return score_toxicity(docs, model, "__symloom_score").filter(F.col("__symloom_score") < THRESHOLD).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, by fingerprints or five-word shingles, that with the smallest doc_id."""
    return representatives(docs, shingles=True)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut from the texts; documents that consist mostly of them go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it are replaced by their kind."""
    return sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of what is left, packed into sequences."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("personal_data", hide_personal_data),
    ("packing", pack),
]

#: SQL can express neither the toxicity model nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order. A stage's own tables, and its input, are deleted once its result is written."""
    docs, previous = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if previous is not None:
            drop_table(spark, previous)
        previous = written()[-1]
    return docs
