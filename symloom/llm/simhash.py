"""SimHash near-duplicate detection by multi-index hashing.

A fingerprint is split into two 32-bit segments. If two fingerprints differ in
at most four bits, one of the segments differs in at most two, so that some
segment value lies within one bit of both. Each fingerprint therefore looks up
the Hamming ball of radius one around each of its segments (66 table keys) and
every meeting is verified over all 64 bits.

Only distinct fingerprints enter the tables, so exact copies cost one row.
A table bucket of up to ``PAIR_LIMIT`` fingerprints is verified pair by pair.
Fuller buckets (one large group of near copies) go an exact way that never
forms pairs: fingerprints x and y link within four bits if and only if some
64-bit point lies within two bits of both, so the members are grouped by the
2081 points of their balls of radius two. A point has at most 2081 fingerprints
within two bits of it, which bounds every group by geometry.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symloom.llm.common import map_batches, materialize, scratch, slices, spread, table, texts_of, with_columns
from symloom.llm.components import connected_components

RADIUS = 4
PAIR_LIMIT = 64
#: Bits that mark the ids whose rows need a join: 4 MB in 1024 buckets, which may be broadcast; the driver holds them several times over.
MARK_BITS = 1 << 25
#: Words of a shingle of ``shingle_links``.
SHINGLE_WORDS = 5
#: About how many texts are sampled for the order of shingles, and how many repeated shingles it tells apart.
ORDER_SAMPLE = 5_000
ORDER_ENTRIES = 65_536
#: Bits per shingle, at least, of the bitmap of a text's shingles that bounds how many two texts share.
SKETCH_BITS = 4
#: How many of a text's first buckets go with it where pairs are compared: enough up to about 280 shingles.
LEAD = 32
#: Texts of so many shingles carry a bitmap of their buckets, and each of their rows so many buckets before its own. Both only save rows.
LONG, BEFORE = 256, 16
#: A text's buckets that are compared with their first and last text, and how many of them must be shared. Both only save work.
STAR_BUCKETS, STAR_SHARED = 16, 3
_SHINGLES_AT_ONCE = 1 << 16
_HALF = 0xFFFFFFFF


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def simhash64(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles (no words: 0).

    A-Z are lower-cased and words end at ASCII white space. Fewer words than
    ``width`` make one shingle. A bit is set where over half the shingle hashes set it.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], gaps[: len(words) - width] + 1)).tolist()
    ends = np.concatenate((gaps[width - 1 :], [len(joined)])).tolist()
    total, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, len(starts), _SHINGLES_AT_ONCE):
        part = slice(k, k + _SHINGLES_AT_ONCE)
        hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts[part], ends[part], strict=True)], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * total > len(starts), bitorder="little").tobytes(), "little")


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in texts_of(batches, 1):
        prints = np.fromiter((simhash64(t) for t in texts), np.uint64, len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) for each row of ``docs``; a null text counts as empty (fingerprint zero)."""
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _fingerprint, "doc_id long, fp long")


def _ball_keys(fp: Column) -> Column:
    """Table keys: each 32-bit segment and its one-bit neighbours, the segment's number in bit 32."""
    masks = [0, *(1 << i for i in range(32))]
    low, high = fp.bitwiseAND(F.lit(_HALF)), F.shiftrightunsigned(fp, 32).bitwiseOR(F.lit(1 << 32))
    return F.array(*(half.bitwiseXOR(F.lit(m).cast("long")) for half in (low, high) for m in masks))


def _points(fp: Column) -> Column:
    """All 64-bit points within two bits."""
    masks = [0, *(1 << i for i in range(64)), *((1 << i) | (1 << j) for i, j in combinations(range(64), 2))]
    literal = F.from_json(F.lit(str([_signed(m) for m in masks])), "array<bigint>")
    return F.transform(literal, lambda m: fp.bitwiseXOR(m))


def _near(x: str, y: str) -> Column:
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= RADIUS


def links(prints: DataFrame, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints in column ``fp`` that connect all within four bits.

    Every edge differs in at most four bits. Inside buckets of more than
    ``pair_limit`` members a star of edges stands for all pairs of a ball, so
    that the components are exact while the edges stay linear.
    """
    keyed = prints.select("fp", F.explode(_ball_keys(F.col("fp"))).alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = materialize(keyed.join(buckets.hint("merge"), "key"), "members")  # both sides grow with the corpus
    few = members.filter(F.col("n") <= pair_limit)
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").filter((F.col("a") < F.col("b")) & _near("a", "b")).select("a", "b")
    crowd = materialize(members.filter(F.col("n") > pair_limit).select("fp").distinct(), "crowd")
    balls = spread(crowd, crowd.count(), 200, "fp").select("fp", F.explode(_points(F.col("fp"))).alias("point"))
    at_point = balls.groupBy("point").agg(F.collect_list("fp").alias("near")).filter(F.size("near") > 1)
    stars = at_point.select(F.array_min("near").alias("a"), F.explode("near").alias("b")).filter("a <> b")
    return pairs.unionByName(stars).distinct()


def _shingle_hashes(text: str) -> np.ndarray:
    """The distinct hashes of a text's shingles of ``SHINGLE_WORDS`` words, words as in ``simhash64``."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    last = max(1, len(words) - SHINGLE_WORDS + 1)
    hashes = {xxhash.xxh64_intdigest(b" ".join(words[i : i + SHINGLE_WORDS]), 5) for i in range(last)}
    return np.fromiter(hashes, np.uint64, len(hashes)).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in texts_of(batches, 1):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_shingle_hashes(t) for t in texts], pa.list_(pa.int64()))], ["doc_id", "shingles"])


def _lead(first: np.ndarray) -> np.ndarray:
    """The first ``LEAD`` buckets of a text; none if two of them are one."""
    lead = first[:LEAD]
    return lead if len(np.unique(lead)) == len(lead) else lead[:0]


def _usual_shingles(texts: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of the texts repeats, sorted, and how often."""
    sample = texts.filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(max(1, rows // ORDER_SAMPLE))) == 0)
    counts = map_batches(sample, _sets, "doc_id long, shingles array<bigint>").select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"))
    often = sorted((r.shingle, r.n) for r in counts.filter("n > 2").orderBy(F.desc("n"), "shingle").limit(ORDER_ENTRIES).collect())
    return np.array([x for x, _ in often], np.int64), np.array([n for _, n in often], np.int64)


def _sketch(hashes: np.ndarray) -> np.ndarray:
    """A bitmap of a set's hashes: a power of two of bits, 64 and ``SKETCH_BITS`` for each hash at least."""
    width = max(64, 1 << (SKETCH_BITS * len(hashes) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[hashes & (width - 1)] = True
    return np.packbits(bits).view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a hash of the text as doc_id, so that copies are one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.xxhash64(text).alias("doc_id"), text.alias("text"))


def shingle_members(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, fp, sketch, lead, bits, first) of each text, once for each task that met it, and (shingle, x, low, high): the texts x in each bucket of two or more, with its first and last.

    A bucket is 32 bits of a shingle's hash; where two shingles meet in one, it only holds more texts.

    Texts of a Jaccard similarity of 0.8 or more share a bucket: in one order of
    all shingles, two such sets share one of the first n - ceil(0.8 n) + 1 of
    each. The order puts shingles that a sample repeats last, which keeps
    buckets small; any order gives the same links. x, low and high are structs of
    key, size and ``at``, how many of the text's shingles come before the bucket's.
    """
    texts = _keyed(docs)
    sent = docs.sparkSession.sparkContext.broadcast(_usual_shingles(texts, docs.count()))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usual, often = sent.value
        seen: set[int] = set()  # a task's copies of a text count once
        for batch, values in texts_of(batches, 1):
            keys = batch.column(0).to_pylist()
            fresh = [i for i, k in enumerate(keys) if not (k in seen or seen.add(k))]
            values, first, sizes, sketch, bits = [values[i] for i in fresh], [], [], [], []
            for value in values:
                own = _shingle_hashes(value)
                at = np.minimum(np.searchsorted(usual, own), max(len(usual) - 1, 0))
                rank = np.where(usual[at] == own, often[at], 0) if len(usual) else np.zeros(len(own), np.int64)
                first.append((own[np.lexsort((own, rank))][: len(own) - (4 * len(own) + 4) // 5 + 1] >> 32).astype(np.int32))
                sizes.append(len(own))
                sketch.append(_sketch(own))
                bits.append(_sketch(first[-1].astype(np.int64)) if len(own) >= LONG else sketch[-1][:0])
            prints = np.fromiter((simhash64(t) for t in values), np.uint64, len(values)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(fresh, pa.int64())), pa.array(prints), pa.array(sizes, pa.int32()), pa.array(first, pa.list_(pa.int32())), pa.array([_lead(f) for f in first], pa.list_(pa.int32())), pa.array(sketch, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], ["key", "fp", "size", "first", "lead", "sketch", "bits"])

    heads = materialize(map_batches(texts, prefixes, "key long, fp long, size int, first array<int>, lead array<int>, sketch array<bigint>, bits array<bigint>"), "heads")
    flat = heads.select("key", "size", F.posexplode("first").alias("at", "shingle")).repartition("shingle")  # structs make wider rows
    rows = flat.select("shingle", F.struct("key", "size", "at").alias("x"))
    buckets = rows.groupBy("shingle").agg(F.min("x").alias("low"), F.max("x").alias("high")).filter("low.key <> high.key")
    return heads.select("key", "fp", "sketch", "lead", "bits", F.when(F.col("size") >= LONG, F.col("first")).otherwise(F.array().cast("array<int>")).alias("first")), materialize(rows.join(buckets.hint("merge"), "shingle").distinct(), "shingle-members")


def _prefix(n: Column) -> Column:
    """How many of a text's n shingles have buckets."""
    return n - F.floor((4 * n + 4) / 5) + 1


def _lacks(x: str | Column, y: str | Column) -> Column:
    """How many shingles of x are not in y, at least: the bits of x's sketch that y's lacks."""
    missing = F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q))))
    return F.aggregate(missing, F.lit(0), lambda total, n: total + n)


def _folded(x: str, y: str) -> Column:
    """The sketch in column x, its halves laid over each other if it is twice as wide as y's."""
    half = F.size(y)
    return F.when(F.size(x) > half, F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseOR(q))).otherwise(F.col(x))


def _of_keys(rows: DataFrame, pairs: DataFrame, label: str) -> DataFrame:
    """The rows whose ``doc_id`` is a key of the pairs, and few others, one for each; other rows are not shuffled."""
    keys = pairs.select(F.col("key_a").alias("doc_id")).union(pairs.select("key_b")).distinct()
    with scratch(rows.sparkSession):
        marks = materialize(_marks(keys), f"{label}-marks")
        known = rows.withColumn("__symloom_bucket", F.bitmap_bucket_number(_mark_place() + 1)).join(F.broadcast(marks), "__symloom_bucket", "left")
        return materialize(known.filter(_is_marked()).select(rows.columns).dropDuplicates(["doc_id"]), label)


def _candidates(texts: DataFrame, pairs: DataFrame, least: Column) -> DataFrame:
    """Distinct (key_a, key_b, a, b) of the pairs (x, y), given once a bucket, that come ``least`` times and whose sizes and sketches allow a link that their fingerprints don't show already.

    Sizes differ by a quarter at most, and so the sketches by one doubling.
    """
    allowed = pairs.filter("x.key <> y.key and 5 * least(x.size, y.size) >= 4 * greatest(x.size, y.size)")
    low, high = F.least("x", "y"), F.greatest("x", "y")
    ordered = allowed.select(*(side[field].alias(f"{field}_{n}") for n, side in (("a", low), ("b", high)) for field in ("key", "size")))
    with scratch(texts.sparkSession):
        shared = materialize(ordered.groupBy(ordered.columns).agg(F.count("*").alias("n")).filter(F.col("n") >= least).drop("n"), "sharing")
        few = _of_keys(texts.select(F.col("key").alias("doc_id"), "fp", "sketch"), shared, "sketches")
        of = [few.select(F.col("doc_id").alias(f"key_{n}"), F.col("fp").alias(n), F.col("sketch").alias(f"sketch_{n}")) for n in ("a", "b")]
        known = shared.join(of[0], "key_a").join(of[1], "key_b").filter("a <> b").withColumns({"of_a": _folded("sketch_a", "sketch_b"), "of_b": _folded("sketch_b", "sketch_a")})
        most = F.least(F.col("size_a") - _lacks("of_a", "of_b"), F.col("size_b") - _lacks("of_b", "of_a"))
        return materialize(known.filter(9 * most >= 4 * (F.col("size_a") + F.col("size_b"))).select("key_a", "key_b", "a", "b"), "candidates")


def shingle_stars(texts: DataFrame, members: DataFrame) -> DataFrame:
    """Texts with the first and the last of some of their buckets, which link most groups of near copies without their pairs."""
    some = members.filter(F.col("x.at") < STAR_BUCKETS)
    least = F.least(F.lit(STAR_SHARED), _prefix(F.col("size_a")), _prefix(F.col("size_b")))
    return _candidates(texts, some.select("x", F.explode(F.array("low", "high")).alias("y")), least)


def _both(p: Column, q: Column) -> Column:
    """How many shingles sets of p and q share at least at a similarity of 0.8."""
    return F.call_function("div", 4 * (p + q) + 8, F.lit(9)).cast("int")


def _led(p: Column, q: Column) -> Column:
    """Whether the leads of texts of p and q shingles hold the places of their first common bucket."""
    return F.greatest(p, q) - _both(p, q) < LEAD


def _margin(size: Column, lead: Column) -> Column:
    """How much is added to two texts' sizes for the parts of their leads that are compared: the lesser of both texts'. Without a lead, too little for any."""
    return F.when(F.size(lead) > 0, F.least(LEAD - size, _prefix(size).cast("int") - size)).otherwise(-(1 << 30))


def _may_share_enough(m: Column) -> Column:
    """Whether the bitmaps of the buckets of texts x and y allow as many common buckets as a similarity of 0.8 takes. Always, if one has none.

    Two such sets of sizes p and q share m = ceil(4 (p + q) / 9) shingles or
    more. The first f of the p lack at most p - m of the q, and so the other
    way, so that of the buckets of both at least the lesser f - (p - m) meet.
    """
    p, q = F.col("x.size"), F.col("y.size")
    most = F.least(_prefix(p) - _lacks(_folded("x_bits", "y_bits"), _folded("y_bits", "x_bits")), _prefix(q) - _lacks(_folded("y_bits", "x_bits"), _folded("x_bits", "y_bits")))
    return F.when((F.size("x_bits") > 0) & (F.size("y_bits") > 0), most >= F.least(_prefix(p) - p, _prefix(q) - q) + m).otherwise(True)


def _first_meeting() -> Column:
    """Whether texts x and y, which meet in a bucket, meet in none before it and in as many as they must.

    Where x and y of sizes p and q share m, the first p - m + k of x's and q - m + k
    of y's have k in common, for any k up to m; the first of all is met there for k = 1.
    If their leads can't tell, each bucket counts where the first may be and that has no bucket of both among the few before it:
    the first of all has none. Their bitmaps then tell whether they may meet in enough.
    The condition is kept short, as Java compiles no long methods.
    """
    p, q, margin = F.col("x.size"), F.col("y.size"), F.least("x_margin", "y_margin")
    m = _both(p, q)
    common = F.array_intersect(F.slice("x_lead", F.lit(1), p + margin), F.slice("y_lead", F.lit(1), q + margin))
    led = (F.size(common) >= m + margin) & (common[0] == F.col("shingle"))
    return (F.col("x.at") <= p - m) & (F.col("y.at") <= q - m) & F.when(m + margin < 1, ~F.arrays_overlap("x_before", "y_before") & _may_share_enough(m)).otherwise(led)


def shingle_rest(texts: DataFrame, members: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs whose fingerprints are in different components so far and that share as many buckets as a similarity of 0.8 takes.

    Texts short enough for their leads are a row in their first bucket only,
    others in few more.
    """
    roots = texts.select("key", "fp").distinct().join(groups, F.col("fp") == groups["node"], "left").select("key", F.coalesce("root", "fp").alias("root"))
    leads = texts.select(F.col("key").alias("of"), "lead", "bits", "first").dropDuplicates(["of"])
    at, window = F.col("x.at"), F.lit(BEFORE)
    before = F.slice("first", F.greatest(at - window, F.lit(0)) + 1, F.least(at, window))
    with scratch(texts.sparkSession):
        with scratch(texts.sparkSession):
            placed = materialize(members.join(roots, members["x.key"] == roots["key"]).select("shingle", "x", "root"), "placed")
            mixed = placed.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("shingle")
            apart = placed.join(mixed.hint("merge"), "shingle", "left_semi").join(leads.hint("merge"), F.col("x.key") == F.col("of"))
            led = apart.withColumn("lead", F.when(_led(F.col("x.size"), F.col("x.size")), F.col("lead"))).withColumns({"margin": _margin(F.col("x.size"), F.col("lead")), "before": before})
            open_ = materialize(led.select("shingle", F.col("x").alias("text"), "root", "lead", "margin", "bits", "before"), "open")
        sides = [open_.select("shingle", F.col("text").alias(n), *(F.col(c).alias(f"{n}_{c}") for c in open_.columns[2:])) for n in ("x", "y")]  # alike, so that Spark shuffles them once
        near = (F.col("x_root") != F.col("y_root")) & (F.col("x.key") < F.col("y.key")) & (5 * F.least("x.size", "y.size") >= 4 * F.greatest("x.size", "y.size"))
        met = sides[0].join(sides[1].hint("merge"), "shingle").filter(near & _first_meeting())
        return _candidates(texts, met.select("x", "y"), F.lit(1))


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (a, b, text_a, text_b) whose texts' whole shingle sets have a similarity of 0.8 or more, as (a, b)."""
    last, of_last = None, np.zeros(0, np.int64)
    for batch in slices(batches):
        keep = []
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            if (y := y.as_py()) != last:
                last, of_last = y, _shingle_hashes(y)
            own = _shingle_hashes(x.as_py())
            if 9 * len(np.intersect1d(own, of_last, assume_unique=True)) >= 4 * (len(own) + len(of_last)):
                keep.append(i)
        yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def alike(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges (a, b) between the fingerprints of the candidate texts whose whole shingle sets have a similarity of 0.8 or more.

    Texts are shuffled rather than their shingles' hashes, which don't compress.
    """
    texts = _of_keys(_keyed(docs), pairs, "candidate-texts")
    both = pairs.join(texts.select(F.col("doc_id").alias("key_a"), F.col("text").alias("text_a")).hint("merge"), "key_a").join(texts.select(F.col("doc_id").alias("key_b"), F.col("text").alias("text_b")).hint("merge"), "key_b")
    found = map_batches(both.select("a", "b", "text_a", "text_b"), _similar, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _with_shingles(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """The components of ``edges`` and of all pairs of texts with a similarity of 0.8 or more, exactly.

    Every such pair shares a bucket. The buckets' stars link most groups; only
    pairs that are still in different components are looked at one by one.
    """
    spark = docs.sparkSession
    texts, members = shingle_members(docs)
    with scratch(spark):
        edges = materialize(edges.unionByName(alike(docs, shingle_stars(texts, members))).distinct(), "star-edges")
    with scratch(spark):
        groups = materialize(connected_components(edges), "star-groups")
    with scratch(spark):
        more = materialize(alike(docs, shingle_rest(texts, members, groups)), "rest-edges")
    return groups if more.isEmpty() else connected_components(edges.unionByName(more).distinct())


def near_duplicates(docs: DataFrame, pair_limit: int = PAIR_LIMIT, shingles: bool = False) -> DataFrame:
    """One row (doc_id, fingerprint, component_id) per row of ``docs`` (doc_id, text; other columns are ignored).

    Documents link if their fingerprints differ in at most four bits and, with
    ``shingles``, if their sets of five-word shingles have a similarity of 0.8;
    component_id is the smallest doc_id reachable. Null and empty texts share
    fingerprint zero and link like any other. Repeated rows stay repeated. A
    null doc_id keeps its row and never becomes a component's id unless the
    component has no other. An empty table gives an empty result.
    """
    marked = materialize(fingerprints(docs), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "distinct")
    with scratch(docs.sparkSession):
        with scratch(docs.sparkSession):
            prints = materialize(spread(distinct.select("fp"), distinct.count(), 5_000, "fp"), "prints")
            edges = materialize(links(prints, pair_limit), "links")
        groups = materialize(_with_shingles(docs, edges) if shingles else connected_components(edges), "groups")
    root = distinct.join(groups, distinct["fp"] == groups["node"], "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    smallest = root.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    by_print = root.join(smallest, "root").select("fp", "component_id")
    return marked.join(by_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _mark_place() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(MARK_BITS))


def _marks(ids: DataFrame) -> DataFrame:
    """(bucket, bits): the hashed ids as a bitmap of at most MARK_BITS / 32768 rows, whatever their number."""
    place = ids.select((_mark_place() + 1).alias("place"))  # buckets and bits count places from one
    return place.groupBy(F.bitmap_bucket_number("place").alias("__symloom_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("__symloom_bits"))


def _is_marked() -> Column:
    """Whether the row's place is set in its bucket's bits."""
    at = F.bitmap_bit_position(_mark_place() + 1)
    byte = F.conv(F.hex(F.substring("__symloom_bits", F.floor(at / 8) + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False))


def representatives(docs: DataFrame, pair_limit: int = PAIR_LIMIT, shingles: bool = False) -> DataFrame:
    """The rows of ``docs`` whose doc_id is their group's smallest, one row for each such id; all columns stay.

    Of rows of the group that share that id, one with the smallest text stays. Rows without a doc_id always stay.

    Ids that go, or that repeat, are marked in a bitmap of fixed size. Rows
    without a mark stay without being shuffled; the few others are joined with
    the ids that stay. However full the bitmap, the result is the same.
    """
    with scratch(docs.sparkSession):
        found = materialize(near_duplicates(docs, pair_limit, shingles).filter("doc_id is not null"), "found")
    ids = materialize(found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("component_id").alias("component_id")), "ids")
    marks = materialize(_marks(ids.filter("n > 1 or doc_id <> component_id")), "marks")
    known = docs.filter("doc_id is not null").withColumn("__symloom_bucket", F.bitmap_bucket_number(_mark_place() + 1))
    known = known.join(F.broadcast(marks), "__symloom_bucket", "left").withColumn("__symloom_marked", _is_marked())
    rest = known.filter("__symloom_marked").select(docs.columns)
    kept = found.filter("doc_id = component_id")
    once = rest.join(kept.join(ids.filter("n = 1"), "doc_id", "left_semi").select("doc_id").hint("merge"), "doc_id", "left_semi")
    repeated = rest.join(ids.filter("n > 1").select("doc_id").hint("merge"), "doc_id", "left_semi")
    printed = with_columns(repeated, "text", {"__symloom_print": "string"}, lambda: lambda t: (f"{simhash64(t):016x}",))
    order = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_first())
    again = printed.join(kept.select("doc_id", F.col("fingerprint").alias("__symloom_print")).hint("merge"), ["doc_id", "__symloom_print"], "left_semi").withColumn("__symloom_rank", F.row_number().over(order)).filter("__symloom_rank = 1")
    parts = [known.filter("not __symloom_marked"), once, again, docs.filter("doc_id is null")]
    return reduce(DataFrame.unionByName, [p.select(docs.columns) for p in parts])


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
