"""Language identification by nearest centroids of character n-gram vectors.

A text's letters give hashed bigrams and trigrams; its vector is their
normalised TF-IDF. Each language has several centroids, from a spherical
k-means over a bounded sample of its training rows. A text takes the language of
the nearest centroid by cosine, and is marked as rejected where even that one is
further away than nearly all training texts are from theirs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symloom.llm.common import crc_bucket, map_batches, table, texts_of

DIMENSIONS = 1 << 15
CENTROIDS = 4
#: Bound of the sample that the centroids of one language are fitted on.
SAMPLE_PER_LANGUAGE = 1000
#: Largest weights kept of a centroid.
CENTROID_TERMS = 8192
#: Share of a language's training texts that are further from their centroid than its rejection distance.
REJECTED_SHARE = 0.005
_TEMPERATURE = 25.0
_BLOCK = 1 << 20
UNDETERMINED = "und"
_letters: list[np.ndarray] = []


def _is_letter(points: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x10000)]))
    low = points < 0x10000
    known = _letters[0][np.where(low, points, 0)]
    if low.all():
        return known
    return np.where(low, known, np.array([chr(p).isalpha() for p in points.tolist()]))


def ngram_counts(text: str) -> np.ndarray | None:
    """Counts of the hashed letter bigrams and trigrams of a whole text; None if it has no letter.

    The text is lower-cased and stretches of other characters count as one space.
    """
    total = None
    for at in range(0, len(text), _BLOCK):
        points = np.frombuffer(text[at : at + _BLOCK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _is_letter(points)
        if not letter.any():
            continue
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        c = np.concatenate(([32], np.where(letter, points, 32)[keep], [32])).astype(np.uint64)
        two = (c[:-1] * 0x9E3779B1 + c[1:] * 0x85EBCA77) & 0xFFFFFFFF
        three = (two[:-1] * 0xC2B2AE3D + c[2:] * 0x27D4EB2F + 1) & 0xFFFFFFFF
        codes = (np.concatenate((two, three)) >> np.uint64(32 - DIMENSIONS.bit_length() + 1)).astype(np.int64)
        counts = np.bincount(codes, minlength=DIMENSIONS)
        total = counts if total is None else total + counts
    return total


def _vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a normalised TF-IDF vector."""
    at = np.flatnonzero(counts)
    value = (1 + np.log(counts[at])) * idf[at]
    return at, (value / max(np.linalg.norm(value), 1e-12)).astype(np.float32)


def _count_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(DIMENSIONS, np.int64), 0
    for _, texts in texts_of(batches, 0):
        for text in texts:
            if (counts := ngram_counts(text)) is not None:
                df += counts > 0
                n += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([n, *df[at].tolist()], pa.int64())], ["term", "df"])


def inverse_document_frequencies(texts: DataFrame) -> np.ndarray:
    """Smoothed IDF of each hashed n-gram over all rows of the one text column (at most ``DIMENSIONS`` sums reach the driver)."""
    sums = map_batches(texts, _count_documents, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    df, n = np.zeros(DIMENSIONS), 0
    for term, k in zip(sums["term"].tolist(), sums["df"].tolist(), strict=True):
        if term < 0:
            n = k
        else:
            df[term] = k
    return np.log((1 + n) / (1 + df)) + 1


def _spherical_kmeans(rows: list[tuple[np.ndarray, np.ndarray]], k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(unit centroids, each row's cosine to its centroid); seeded by the rows furthest from those chosen."""
    x = np.zeros((len(rows), DIMENSIONS), np.float32)
    for i, (at, value) in enumerate(rows):
        x[i, at] = value
    mean = x.mean(axis=0)
    chosen = [int(np.argmax(x @ mean))]
    while len(chosen) < min(k, len(rows)):
        chosen.append(int(np.argmin((x @ x[chosen].T).max(axis=1))))
    centres = x[chosen]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        centres = np.stack([x[near == j].mean(axis=0) if (near == j).any() else centres[j] for j in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres, (x @ centres.T).max(axis=1)


def _fitter(idf, centroids: int):
    def fit(key: tuple, sample: pd.DataFrame) -> pd.DataFrame:
        rows = [_vector(c, idf.value) for text in sample.sort_values(["__order", "text"])["text"] if (c := ngram_counts(text)) is not None]
        out = []
        if rows:
            centres, cosine = _spherical_kmeans(rows, centroids)
            limit = float(np.quantile(cosine, REJECTED_SHARE))
            for c in centres:
                top = np.sort(np.argpartition(-c, CENTROID_TERMS)[:CENTROID_TERMS]).astype(np.int32)
                value = c[top] / max(np.linalg.norm(c[top]), 1e-12)
                out.append((key[0], limit, top.tobytes(), value.astype(np.float32).tobytes()))
        return pd.DataFrame(out, columns=["lang", "least", "terms", "weights"])

    return fit


@dataclass
class LanguageModel:
    idf: np.ndarray
    languages: list[str]
    #: Language number of each centroid, centroids by columns, and the least cosine each language accepts.
    owner: np.ndarray
    centroids: np.ndarray
    least: np.ndarray

    def predict(self, text: str) -> tuple[str, float, bool]:
        """(language, score, rejected); a text without a letter is undetermined with score 0."""
        counts = ngram_counts(text)
        if counts is None or not self.languages:
            return UNDETERMINED, 0.0, True
        at, value = _vector(counts, self.idf)
        cosine = np.full(len(self.languages), -1.0)
        np.maximum.at(cosine, self.owner, value @ self.centroids[at])
        best = int(cosine.argmax())
        share = np.exp(_TEMPERATURE * (cosine - cosine[best]))
        return self.languages[best], float(1 / share.sum()), bool(cosine[best] < self.least[best])


def fit_languages(training: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE, centroids: int = CENTROIDS) -> LanguageModel:
    """Learn from the rows (doc_id, text, lang) whose lang is not null; IDF comes from all their texts."""
    spark = training.sparkSession
    rows = training.filter("lang is not null").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string"))
    idf = inverse_document_frequencies(rows.select("text"))
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not sizes:
        return LanguageModel(idf, [], np.zeros(0, int), np.zeros((DIMENSIONS, 0), np.float32), np.zeros(0))
    # A hash below a language's share thins its rows first, so that the ranking sees few; about twice the bound pass.
    shares = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 2 * sample_per_language / n + 100 / n))))
    hashed = rows.withColumn("__order", F.xxhash64(F.lit("sample"), "doc_id"))
    thin = hashed.filter(F.shiftrightunsigned("__order", 11) < shares[F.col("lang")] * float(1 << 53))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("__order", "text"))
    sample = thin.withColumn("__rank", rank).filter(F.col("__rank") <= sample_per_language).drop("__rank", "doc_id")
    fitted = sample.groupBy("lang").applyInPandas(_fitter(spark.sparkContext.broadcast(idf), centroids), "lang string, least double, terms binary, weights binary").collect()
    fitted.sort(key=lambda r: (r.lang, bytes(r.terms), bytes(r.weights)))
    languages = sorted({r.lang for r in fitted})
    matrix = np.zeros((DIMENSIONS, len(fitted)), np.float32)
    for j, r in enumerate(fitted):
        matrix[np.frombuffer(r.terms, np.int32), j] = np.frombuffer(r.weights, np.float32)
    least = {r.lang: r.least for r in fitted}
    return LanguageModel(idf, languages, np.array([languages.index(r.lang) for r in fitted], int), matrix, np.array([least[x] for x in languages]))


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """One row (doc_id, lang_pred, score, rejected) per row of ``docs`` (doc_id, text).

    A null text, an empty one and one without a letter are ``und``. Only the text is looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in texts_of(batches, 1):
            found = [sent.value.predict(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), predict, "doc_id long, lang_pred string, score double, rejected boolean")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.filter(crc_bucket("doc_id", 4) != 2))
    return identify_languages(docs, model).select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
