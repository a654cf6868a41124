"""Benchmark decontamination by a generalised suffix automaton of the normalised test items.

Documents stream through the automaton word by word; where the longest match
reaches the window length, the words are hit. Words that no item has send the
automaton to its root, so only runs of known words are walked.

The automaton is sent to the executors. Its size is checked: items are dealt to
as many automata of at most about ``WORDS_PER_AUTOMATON`` words as they need,
and the documents pass one after the other, so that no item is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm.automaton import SuffixAutomaton
from symloom.llm.common import map_batches, materialize, slices, table, tasks_for

WINDOW = 10
WORDS_PER_AUTOMATON = 200_000
#: Documents of which more than this share of the words is hit are dropped whole.
COVERAGE_LIMIT = 0.5
_BLOCK = 1 << 20
_MARKS = "__symloom_n_words long, __symloom_spans array<int>, __symloom_items array<string>"

#: Words are digits, letters a-z (A-Z lower-cased) and everything beyond ASCII.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normal_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def _codes(normal: bytes, vocabulary: dict[bytes, int]) -> np.ndarray:
    """The words' numbers, 0 for unknown ones, taken block by block to bound the memory of long texts."""
    parts, at = [], 0
    while at < len(normal):
        cut = normal.find(b" ", at + _BLOCK)
        cut = len(normal) if cut < 0 else cut
        words = normal[at:cut].split()
        parts.append(np.fromiter(map(vocabulary.get, words, repeat(0)), np.int32, len(words)))
        at = cut
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _merged(hits: list[tuple[int, int]]) -> list[int]:
    """Spans as a flat list first, last, first, last ... without overlap or contact."""
    flat: list[int] = []
    for first, last in sorted(hits):
        if flat and first <= flat[-1] + 1:
            flat[-1] = max(flat[-1], last)
        else:
            flat += (first, last)
    return flat


def find_hits(text: str, automaton: SuffixAutomaton) -> tuple[int, list[int], set[str]]:
    """(number of words, spans of hit words, items with occurring windows) of one text."""
    codes = _codes(text.encode("utf-8", "surrogatepass").translate(_NORMAL), automaton.vocabulary)
    hits: list[tuple[int, int]] = []
    found: set[str] = set()
    if automaton.shortest:
        known = np.flatnonzero(np.diff(np.concatenate(([0], codes > 0, [0]))))
        for first, after in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if after - first >= automaton.shortest:
                automaton.scan(codes[first:after].tolist(), hits, found, first)
    return len(codes), _merged(hits), found


def _marker(automaton, coverage_limit: float | None):
    """Mark hits; with a limit, also leave out rows beyond it and cut the spans of the others from their text."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sa = automaton.value
        for batch in slices(batches):
            place, kept = batch.schema.get_field_index("text"), batch.num_columns - 3
            texts, n, spans, items = batch.column(place).to_pylist(), [], [], []
            for text, s, i in zip(texts, batch.column(kept + 1).to_pylist(), batch.column(kept + 2).to_pylist(), strict=True):
                count, hit, found = find_hits(text or "", sa)
                n.append(count)
                spans.append(_merged(list(zip(s[::2] + hit[::2], s[1::2] + hit[1::2], strict=True))) if s else hit)
                items.append(sorted(found.union(i)))
            columns = [*batch.columns[:kept], pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            if coverage_limit is not None:
                columns[place] = pa.array([cut_spans(t, s) if s else t for t, s in zip(texts, spans, strict=True)], batch.schema.field(place).type)
            out = pa.RecordBatch.from_arrays(columns, schema=pa.schema([*(batch.schema.field(k) for k in range(kept)), *_ARROW]))
            if coverage_limit is not None:
                out = out.filter(pa.array([_n_words_of(s) <= coverage_limit * count for s, count in zip(spans, n, strict=True)], pa.bool_()))
            yield out

    return mark


def _n_words_of(spans: list[int]) -> int:
    return sum(spans[1::2]) - sum(spans[::2]) + len(spans) // 2


_ARROW = pa.schema([("__symloom_n_words", pa.int64()), ("__symloom_spans", pa.list_(pa.int32())), ("__symloom_items", pa.list_(pa.string()))])


def mark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, words_per_automaton: int = WORDS_PER_AUTOMATON, coverage_limit: float | None = None) -> DataFrame:
    """``docs`` with the columns __symloom_n_words, __symloom_spans and __symloom_items.

    Spans are first and last word numbers, flat. Items without words have no
    windows; a null item_id counts as the text ''. With a ``coverage_limit`` rows
    of whose words a larger share is hit are left out and spans are cut from the
    others' text, in the pass of the last automaton.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.size(F.split("text", "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")))).first()[0] or 0
    shards = tasks_for(size, words_per_automaton)
    marked = docs.selectExpr("*", "0L as __symloom_n_words", "cast(array() as array<int>) as __symloom_spans", "cast(array() as array<string>) as __symloom_items")
    for k in range(shards):
        own = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == k) if shards > 1 else items
        automaton = SuffixAutomaton(((x.item, normal_words(x.text)) for x in own.toLocalIterator()), window)
        marked = map_batches(marked, _marker(spark.sparkContext.broadcast(automaton), coverage_limit if k + 1 == shards else None), marked.schema)
        if k + 1 < shards:
            marked = materialize(marked, "marked")
    return marked


def _n_hit():
    spans = F.col("__symloom_spans")
    return F.aggregate(spans, F.lit(0), lambda a, x: x - a) + (F.size(spans) / 2).cast("int")


def decontamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, words_per_automaton: int = WORDS_PER_AUTOMATON) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans) per row of ``docs`` (doc_id, text).

    A null or empty text has no words and is clean. Repeated rows stay
    repeated. Empty tables are allowed on either side. Other columns are ignored.
    """
    marked = mark_hits(docs.select("doc_id", F.col("text").cast("string")), benchmark, window, words_per_automaton)
    return marked.select(
        "doc_id",
        F.col("__symloom_n_words").alias("n_words"),
        _n_hit().cast("long").alias("n_hit"),
        F.size("__symloom_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("__symloom_items")), 256).alias("items_sha256"),
        (F.size("__symloom_spans") > 0).alias("contaminated"),
        F.col("__symloom_spans").alias("spans"),
    )


def cut_spans(text: str, spans: list[int]) -> str:
    """``text`` without the words in ``spans`` and what stands between the words of one span."""
    data = text.encode("utf-8", "surrogatepass")
    is_word = np.frombuffer(data.translate(_NORMAL), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], is_word, [0]))))
    parts, at = [], 0
    for first, last in zip(spans[::2], spans[1::2], strict=True):
        parts.append(data[at : edges[2 * first]])
        at = int(edges[2 * last + 1])
    return b"".join([*parts, data[at:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage_limit: float = COVERAGE_LIMIT, words_per_automaton: int = WORDS_PER_AUTOMATON) -> DataFrame:
    """``docs`` with hit spans cut from ``text``, without those of whose words more than ``coverage_limit`` are hit.

    Clean rows come through unchanged. All columns stay; ``n_chars``, where
    there is such a column, follows the new text.
    """
    done = mark_hits(docs, benchmark, window, words_per_automaton, coverage_limit)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.size("__symloom_spans") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return done.select(docs.columns)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


OP8_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
ip AS (
  SELECT item, w, CAST(least(len(w), 10) AS BIGINT) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p
  FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item, k, array_to_string(w[p:p + k - 1], ' ') AS win FROM ip),
dp AS (
  SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS p
  FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k),
dw AS (SELECT rid, k, p, array_to_string(w[p:p + k - 1], ' ') AS win FROM dp),
h AS (SELECT dw.rid, dw.k, dw.p, iw.item FROM dw JOIN iw ON dw.k = iw.k AND dw.win = iw.win),
n AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + k)) AS q FROM h) GROUP BY rid),
s AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(s.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s.items, '')) AS items_sha256,
       coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN s USING (rid)
"""
