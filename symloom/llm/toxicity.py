"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine.

The terms are all words of a bounded sample of labelled rows; none is left out.
A term's weight is its IDF over all documents times the standardised difference
z of its shares of the two classes (supervised term weighting), so that the
everyday words of a language add little to a cosine and the words that set a
class apart add much. z is computed for every term alike, whatever the size of
the sample; where one class has no example it is 1 for all.

The examples' vectors stand in an inverted index whose postings are cut into
blocks of examples, each with its largest weight: a block is left out if its
bound can't reach the k-th best of what the usual terms alone make up of the
cosines, so the neighbours are exact.
Votes weighted by squared cosine, and how near the neighbours are, give a
calibrated probability; the neighbours and the heaviest terms are the evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm.common import crc_bucket, give_back, labelled_sample, logistic, logistic_fit, map_batches, materialize, table, texts_of, with_columns_at_once

#: Bounds of the sample of labelled rows that are kept as examples: rows of each class, characters in all.
SAMPLE_PER_CLASS = 4000
SAMPLE_CHARS = 64_000_000
NEIGHBOURS = 20
BLOCK = 128
#: Terms, those of most examples first, whose weights stand in a dense matrix, and queries multiplied by it at once.
DENSE_TERMS = 512
AT_ONCE = 64
THRESHOLD = 0.5
#: About how many words of several texts are numbered at once.
WORDS_AT_ONCE = 100_000
_TEXT_BLOCK = 1 << 20
_WORD = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"\w+")
#: ASCII's letters in lower case, and blanks for all else.
_ASCII = "".join(chr(c).lower() if chr(c).isalpha() else " " for c in range(128))


def _words(part: str) -> list[str]:
    """What ``_WORD`` finds in the lower-cased text, by ways that take less time."""
    if part.isascii():
        return part.translate(_ASCII).split()
    runs = _RUN.findall(part.lower())
    return runs if all(map(str.isalpha, runs)) else [w for run in runs for w in ((run,) if run.isalpha() else _WORD.findall(run))]


def words_of(text: str) -> Iterator[list[str]]:
    """The words of a text, lower-cased, in parts of bounded size cut at blanks."""
    at = 0
    while at < len(text):
        cut = text.find(" ", at + _TEXT_BLOCK)
        cut = len(text) if cut < 0 else cut
        yield _words(text[at:cut])
        at = cut


def bag_of(text: str) -> Counter:
    bag: Counter = Counter()
    for words in words_of(text):
        bag.update(words)
    return bag


def term_counts(texts: list[str], vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, term, count) of the known words of each text, ascending.

    The vocabulary, which is large, is asked once for each different word of many texts.
    """
    terms, keys, counts = max(1, len(vocabulary)), [], []
    words: list[str] = []
    whose: list[int] = []
    sizes: list[int] = []

    def number() -> None:
        coded = pc.dictionary_encode(pa.array(words, pa.large_string()))
        code = np.frombuffer(coded.indices.buffers()[1], np.int32, len(words)) if words else np.zeros(0, np.int32)
        place = np.zeros(len(coded.dictionary), np.int64)  # where each different word stands
        place[code] = np.arange(len(words))
        term = np.fromiter(map(vocabulary.get, map(words.__getitem__, place.tolist()), repeat(-1)), np.int64, len(place))[code]
        key, count = np.unique((np.repeat(np.array(whose, np.int64), sizes) * terms + term)[term >= 0], return_counts=True)
        keys.append(key)
        counts.append(count)
        for x in (words, whose, sizes):
            x.clear()

    for i, text in enumerate(texts):
        for part in words_of(text):
            words += part
            whose.append(i)
            sizes.append(len(part))
            if len(words) >= WORDS_AT_ONCE:
                number()
    number()
    key, count = keys[0], counts[0]
    if len(keys) > 1:  # a text may stand in several
        key, place = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(place, np.concatenate(counts), minlength=len(key)).astype(np.int64)
    return key // terms, key % terms, count


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., start[0] + size[0] - 1, start[1], ..."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _nearly(scores: np.ndarray, n: int) -> float:
    """At most the n-th largest score, and close to it: the n-th largest of the best of groups of eight."""
    best = scores.reshape(8, -1).max(axis=0)
    return float(np.partition(best, -n)[-n]) if len(best) >= n else 0.0


class BlockMaxIndex:
    """Unit vectors by postings, in blocks of examples with their largest weights.

    The terms that most examples hold would make up most postings; their
    weights stand in a dense matrix instead, whose product with a batch of
    queries gives the exact part of every cosine that they make up. A block's
    bound is the largest such part in it and the block's bounds of the other
    terms.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, alike: list | None = None, dense: int = DENSE_TERMS):
        """``vectors`` are (terms, weights) of each example; examples next to each other by ``alike`` share blocks."""
        order = sorted(range(len(vectors)), key=lambda i: (alike[i], i) if alike else i)
        self.example = np.array(order, np.int64)
        self.blocks = max(1, -(-len(order) // BLOCK))
        sizes = np.array([len(vectors[i][0]) for i in order], np.int64)
        place = np.repeat(np.arange(len(order)), sizes)
        term = np.concatenate([np.zeros(0, np.int32), *(vectors[i][0] for i in order)])
        weight = np.concatenate([np.zeros(0), *(vectors[i][1] for i in order)])
        usual = np.argsort(-np.bincount(term, minlength=terms), kind="stable")[:dense]
        #: Row of each term in the dense matrix, or -1.
        self.row = np.full(terms, -1)
        self.row[usual] = np.arange(len(usual))
        self.matrix = np.zeros((len(usual), self.blocks * BLOCK))
        of_all = self.row[term] >= 0
        self.matrix[self.row[term[of_all]], place[of_all]] = weight[of_all]
        term, place, weight = term[~of_all], place[~of_all], weight[~of_all]
        by = np.argsort(term, kind="stable")  # places ascend within a term
        term, self.place, self.weight = term[by], place[by], weight[by]
        block = self.place // BLOCK
        first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])]) if len(term) else np.zeros(0, np.int64)
        #: One entry for each term and block it has postings in: block, bound, first posting, number of postings.
        self.block, self.first = block[first], first
        self.size = np.diff(np.r_[first, len(term)])
        self.bound = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.entry = np.searchsorted(term[first], np.arange(terms + 1))
        #: The first posting of each term.
        self.begin = np.searchsorted(term, np.arange(terms + 1))

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (terms, values), (example numbers, cosines) of the exact k best above zero, to nine places; ties go to the smaller number."""
        head = np.zeros((len(queries), len(self.matrix)))
        for q, (terms, values) in enumerate(queries):
            row = self.row[terms]
            head[q, row[row >= 0]] = values[row >= 0]
        return [self._nearest(*query, part, k, without[q] if without else -1) for q, (query, part) in enumerate(zip(queries, head @ self.matrix, strict=True))]

    def _nearest(self, terms: np.ndarray, values: np.ndarray, head: np.ndarray, k: int, without: int) -> tuple[np.ndarray, np.ndarray]:
        other = self.row[terms] < 0
        terms, values = terms[other], values[other]
        start = self.entry.take(terms)
        size = self.entry.take(terms + 1) - start
        entry, value = _ranges(start, size), np.repeat(values, size)
        block = self.block.take(entry)
        bounds = (head.reshape(self.blocks, BLOCK).max(axis=1) + np.bincount(block, self.bound.take(entry) * value, minlength=self.blocks)) * (1 + 1e-9)
        least = max(_nearly(head, k + 1) - 2e-9, 1e-9)  # one may be left out, and cosines are rounded
        here = np.flatnonzero((bounds >= least).take(block))
        if 2 * len(here) > len(block):  # whole postings are read in less time than most of their blocks
            start, size, value = self.begin.take(terms), self.begin.take(terms + 1) - self.begin.take(terms), values
        else:
            entry, value = entry.take(here), value.take(here)
            start, size = self.first.take(entry), self.size.take(entry)
        posting = _ranges(start, size)
        # what of a block left out is scored stays below its bound
        score = head + np.bincount(self.place.take(posting), self.weight.take(posting) * np.repeat(value, size), minlength=len(head))
        near = np.flatnonzero(score > max(_nearly(score, k + 1) - 2e-9, least))
        example, cosine = self.example[near], np.round(score[near], 9)
        kept = example != without
        example, cosine = example[kept], cosine[kept]
        best = np.lexsort((example, -cosine))[:k]
        return example[best], cosine[best]


@dataclass
class ToxicityModel:
    vocabulary: dict[str, int]
    #: IDF times relevance of each term.
    weight: np.ndarray
    index: BlockMaxIndex | None
    ids: list[int]
    labels: np.ndarray
    #: What a vote of an example of each class counts, so that the classes stand as in all labels.
    vote: np.ndarray
    #: The score of texts without a known term.
    blank: float
    curve: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def vector(self, bag: Counter) -> tuple[np.ndarray, np.ndarray]:
        """The unit vector of a bag of words; words that no example holds have no coordinate."""
        terms = np.fromiter(map(self.vocabulary.get, bag, repeat(-1)), np.int64, len(bag))
        known = terms >= 0
        return self.unit(terms[known], np.fromiter(bag.values(), float, len(bag))[known])

    def unit(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values = (1 + np.log(counts)) * self.weight[terms]
        return terms, values / max(np.linalg.norm(values), 1e-300)

    def vectors(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The unit vectors of many texts."""
        whose, terms, counts = term_counts(texts, self.vocabulary)
        values = (1 + np.log(counts)) * self.weight[terms]
        norms = np.sqrt(np.bincount(whose, values**2, minlength=len(texts)))
        values /= np.maximum(norms, 1e-300)[whose]
        cuts = np.searchsorted(whose, np.arange(1, len(texts)))
        return list(zip(np.split(terms, cuts), np.split(values, cuts), strict=True))

    def votes(self, texts: list[str], without: list[int] | None = None) -> list[tuple[float, float, np.ndarray]]:
        """(share of the votes for label 1, nearest cosine, neighbours) of each text."""
        vectors, out = self.vectors(texts) if texts else [], []
        for k in range(0, len(texts), AT_ONCE):
            for near, cosine in self.index.nearest(vectors[k : k + AT_ONCE], NEIGHBOURS, without and without[k : k + AT_ONCE]):
                weight = cosine**2 * self.vote[self.labels[near]]
                out.append((float(weight[self.labels[near] == 1].sum() / weight.sum()), float(cosine[0]), near) if len(near) else (0.0, 0.0, near))
        return out

    def scores(self, texts: list[str]) -> list[tuple[float, np.ndarray]]:
        """(score, neighbours) of each text."""
        return [(logistic(float(self.curve @ (share, nearest * (2 * share - 1), 1.0))) if len(near) else self.blank, near) for share, nearest, near in self.votes(texts)]

    def explain(self, text: str, near: np.ndarray) -> tuple[list[int], list[str]]:
        """The ids of the neighbours and the terms that weigh most."""
        bag = bag_of(text)
        names = {self.vocabulary[w]: w for w in bag if w in self.vocabulary}
        terms, values = self.vector(bag)
        return [self.ids[i] for i in near.tolist()], [names[t] for t in terms[np.argsort(-values, kind="stable")][:10].tolist()]


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in texts_of(batches, 1):
        bags = [bag_of(t) for t in texts]
        columns = [batch.column(0), batch.column(2), pa.array([list(b) for b in bags], pa.list_(pa.string())), pa.array([list(b.values()) for b in bags], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "terms", "counts"])


def document_frequencies(docs: DataFrame, vocabulary: dict[str, int]) -> tuple[int, np.ndarray]:
    """How many rows ``docs`` has, and how many of them hold each known term; each task sends one row a term."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, df = 0, np.zeros(len(sent.value), np.int64)
        for _, texts in texts_of(batches, 0):
            rows += len(texts)
            df += np.bincount(term_counts(texts, sent.value)[1], minlength=len(df))
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, found], pa.int32()), pa.array(np.r_[rows, df[found]], pa.int64())], ["term", "n"])

    counted = map_batches(docs.select(F.col("text").cast("string")), count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    sent.destroy()
    term, n = counted.column("term").to_numpy(), counted.column("n").to_numpy()
    df = np.zeros(len(vocabulary))
    df[term[term >= 0]] = n[term >= 0]
    return int(n[term < 0].sum()), df


def relevance(in_0: np.ndarray, in_1: np.ndarray, n_0: int, n_1: int) -> np.ndarray:
    """The standardised difference of the shares of two classes' rows that hold each term; 1 where a class is empty."""
    if not n_0 or not n_1:
        return np.ones(len(in_0))
    pooled = (in_0 + in_1) / (n_0 + n_1)
    return np.abs(in_1 / n_1 - in_0 / n_0) / np.sqrt(pooled * (1 - pooled) * (1 / n_0 + 1 / n_1) + 1e-12)


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = SAMPLE_PER_CLASS) -> ToxicityModel:
    """Learn from the labelled rows; document frequencies count every row of ``docs``.

    Examples without a word have no vector. Texts without a known word get the
    share of label 1 among such examples, as if there were half a toxic row and
    one and a half others more: without labels it is a quarter, so that nothing
    is rejected. ``docs`` needs doc_id and text; repeated rows count as often as
    they stand, a null text as ''. Either table may be empty.
    """
    sample, totals = labelled_sample(docs, labels, label, per_class, SAMPLE_CHARS)
    sample = materialize(sample, "examples")
    bags = map_batches(sample.select("doc_id", "text", "label"), _bags, "doc_id long, label int, terms array<string>, counts array<int>").orderBy("doc_id").toArrow()
    classes = np.array(bags.column("label").to_pylist(), np.int64)
    doc_ids = np.array(bags.column("doc_id").to_pylist(), np.int64)
    lists = bags.column("terms").combine_chunks() if bags.num_rows else pa.array([], pa.list_(pa.string()))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    counts = bags.column("counts").combine_chunks().flatten().to_numpy(zero_copy_only=False) if bags.num_rows else np.zeros(0, np.int32)
    encoded = pc.dictionary_encode(lists.flatten())
    vocabulary = {w: i for i, w in enumerate(encoded.dictionary.to_pylist())}
    term = encoded.indices.to_numpy(zero_copy_only=False)
    del bags, lists, encoded  # the driver keeps numbers only
    give_back(docs.sparkSession)
    of_1 = np.repeat(classes, sizes) == 1
    n, df = document_frequencies(docs, vocabulary)
    idf = np.log((1 + n) / (1 + df)) + 1
    in_1, in_0 = np.bincount(term[of_1], minlength=len(idf)), np.bincount(term[~of_1], minlength=len(idf))
    sampled = [int((classes == c).sum()) for c in (0, 1)]
    vote = np.array([totals[c] / max(sampled[c], 1) for c in (0, 1)])
    starts = np.cumsum(sizes) - sizes
    full = np.flatnonzero(sizes > 0)
    empty = classes[sizes == 0]
    blank = ((empty == 1).sum() * vote[1] + 0.5) / ((empty == 1).sum() * vote[1] + (empty == 0).sum() * vote[0] + 2)
    model = ToxicityModel(vocabulary, idf * relevance(in_0, in_1, *sampled), None, doc_ids[full].tolist(), classes[full], vote, float(blank))
    vectors, alike, in_any = [], [], in_0 + in_1
    for i in full.tolist():
        own = slice(starts[i], starts[i] + sizes[i])
        vectors.append(model.unit(term[own], counts[own]))
        usual = term[own][np.argmax(counts[own] * in_any[term[own]])]  # the word that marks its language best
        alike.append((int(usual), int(sizes[i])))
    model.index = BlockMaxIndex(vectors, len(vocabulary), alike)
    del vectors, alike, term, counts
    give_back(docs.sparkSession)
    model.curve = _calibrated(sample, model)
    return model


def _calibrated(sample: DataFrame, model: ToxicityModel) -> np.ndarray:
    """The logistic curve over the votes that each example gets from the others."""
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {d: i for i, d in enumerate(sent.value.ids)}
        for batch, texts in texts_of(batches, 1):
            own = [number.get(d, -1) for d in batch.column(0).to_pylist()]
            votes = sent.value.votes(texts, own)
            near = [len(v[2]) > 0 for v in votes]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([v[0] for v in votes], pa.float64()), pa.array([v[1] for v in votes], pa.float64()), pa.array(near, pa.bool_())], ["doc_id", "label", "share", "nearest", "near"])

    spread = sample.select("doc_id", "text", "label").repartition(4 * sample.sparkSession.sparkContext.defaultParallelism, "doc_id")
    rows = map_batches(spread, left_out, "doc_id long, label int, share double, nearest double, near boolean").filter("near").orderBy("doc_id").collect()
    sent.destroy()
    if not rows:
        return np.zeros(3)
    y = np.array([r.label for r in rows])
    return logistic_fit(np.array([(r.share, r.nearest * (2 * r.share - 1)) for r in rows]), y.astype(float), model.vote[y])


def score_toxicity(docs: DataFrame, model: ToxicityModel, column: str = "score") -> DataFrame:
    """``docs`` with the probability that each row's whole text is toxic.

    A null text counts as ''. Repeated rows get equal scores, ties between
    examples go to the smaller doc_id, other columns stay as they are and an
    empty table gives an empty result; ``column`` must be a new name. Very long
    texts are read in parts, none is cut.
    """
    return _scored(docs, model, {column: "double"}, lambda model, text, score, near: (score,))


def toxicity_evidence(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with score, evidence_ids and evidence_terms (comma-joined) of each row."""

    def evidence(model: ToxicityModel, text: str, score: float, near: np.ndarray) -> tuple:
        ids, terms = model.explain(text, near)
        return score, ",".join(map(str, ids)), ",".join(terms)

    return _scored(docs, model, {"score": "double", "evidence_ids": "string", "evidence_terms": "string"}, evidence)


def _scored(docs: DataFrame, model: ToxicityModel, columns: dict[str, str], value) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def values(texts: list[str]) -> list[tuple]:
        return [value(sent.value, text, *scored) for text, scored in zip(texts, sent.value.scores(texts), strict=True)]

    return with_columns_at_once(docs, "text", columns, lambda: values)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels.filter(crc_bucket("doc_id", 5) != 0))
    scored = score_toxicity(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), model)
    return scored.select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
