"""Secrets by patterns and sliding-window entropy, in SQL functions alone.

Besides the base patterns, every long run of token characters that mixes
letters and digits is a candidate. A window slides over it; the counts of the
characters that leave and enter change the sum of c log2 c step by step, and the
highest entropy of any window is compared with the threshold of the run's
character class. Runs on the allow-list (placeholders, counting sequences, addresses) are
suppressed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm.common import table
from symloom.llm.spans import clear_of, count_of, in_order, joined, let, matches, spans_if

#: Base kinds in the order that reports list them, then the method's own.
BASE_KINDS = ["assign", "access", "hex"]
KINDS = [*BASE_KINDS, "entropy"]
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++"""
ASSIGNED = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"[0-9a-f]{16,}+"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
WINDOW = 20
#: Least entropy in bits of the best window, by character class; the first class that fits counts.
CLASSES = [("hex", "^[0-9a-fA-F]+$", 3.0), ("single-case", "^(?:[a-z0-9]+|[A-Z0-9]+)$", 3.5), ("mixed", ".", 3.7)]
ALLOWED = [
    r"(?i)example|placeholder|changeme|dummy|sample",
    r"(?i)0123456789|123456789|abcdefgh|qwerty",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)^/*(home|usr|var|etc|www|https?)/",
    r"^[A-Za-z]+[0-9]{0,4}([/_-][A-Za-z]*[0-9]{0,4})*$",
]
#: The same with possessive quantifiers, which match alike here but never recurse.
_ALLOWED = [*ALLOWED[:-1], r"^[A-Za-z]++[0-9]{0,4}+(?:[/_-][A-Za-z]*+[0-9]{0,4}+)*+$"]
_UNIT = 1 << 40


def window_entropy(run: Column, window: int = WINDOW) -> Column:
    """Highest Shannon entropy, in bits, of any ``window`` characters of an ASCII string at least that long.

    A step of the window lets one character out and one in, which changes the
    sum of c log2 c by what their counts among the characters that stay tell.
    The sum is kept in whole units of 2^-40 bits, so that no error adds up. Time
    is in proportion to the run's length.
    """
    weights = [round(c * math.log2(c) * _UNIT) if c else 0 for c in range(window + 1)]
    gain = F.from_json(F.lit(str([b - a for a, b in zip(weights, weights[1:], strict=False)])), "array<bigint>")

    def change(codes: Column, x: Column, i: Column) -> Column:
        stay = F.slice(codes, F.greatest(i - (window - 2), F.lit(1)), F.least(i, F.lit(window - 1)))

        def step(char: Column) -> Column:
            return F.get(gain, F.size(F.filter(stay, lambda y: y == char)))

        return step(x) - F.when(i >= window, step(F.get(codes, i - window))).otherwise(F.lit(0).cast("long"))

    def taken(state: Column, d: Column) -> Column:
        total, n = state["sum"] + d, state["n"] + 1
        return F.struct(total.alias("sum"), n.alias("n"), F.when(n >= window, F.least(state["least"], total)).otherwise(state["least"]).alias("least"))

    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"), F.lit(1 << 62).alias("least"))
    codes = F.transform(F.split(run, ""), F.ascii)
    least = F.aggregate(let(codes, lambda cs: F.transform(cs, lambda x, i: change(cs, x, i))), start, taken, lambda state: state["least"].cast("double"))
    return F.lit(math.log2(window)) - least / float(_UNIT * window)


def _is_random(s: Column) -> Column:
    value = s["value"]
    candidate = value.rlike("[A-Za-z]") & value.rlike("[0-9]")
    for pattern in _ALLOWED:
        candidate &= ~value.rlike(pattern)
    least = F.coalesce(*(F.when(value.rlike(pattern), F.lit(bits)) for _, pattern, bits in CLASSES))
    return F.when(candidate, window_entropy(value) >= least).otherwise(F.lit(False))


def base_spans(text: Column) -> Column:
    """The spans of the base kinds by kind and start; ``text`` must not be null."""
    assign = F.filter(matches(text, "assign", ASSIGN), lambda s: F.length(F.regexp_extract(s["value"], ASSIGNED, 1)) >= 12)
    access = F.filter(matches(text, "access", ACCESS), lambda s: F.length(s["value"]) >= 18)
    return F.concat(
        spans_if(text.contains("=") | text.contains(":"), assign),
        spans_if(text.contains("AKIA"), access),
        spans_if(text.rlike(HEX), matches(text, "hex", HEX)),
    )


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, base, entropy) per row of ``docs`` (doc_id, text): arrays of spans.

    Candidates that touch a base span are left to it. Spans of different kinds
    may overlap; of those that start at one place the kind listed first comes
    first. A null text counts as empty. Repeated rows stay repeated; an empty
    table gives an empty result. Other columns are ignored. Very long texts and
    runs are read whole, in time proportional to their length.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("base", base_spans(F.col("text")))
    rows = rows.withColumn("runs", spans_if(F.col("text").rlike(CANDIDATE), matches(F.col("text"), "entropy", CANDIDATE))).withColumn("free", clear_of("runs", "base"))
    return rows.select("doc_id", "base", F.filter("free", _is_random).alias("entropy"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    counts = [count_of(F.col("base"), k).alias(f"n_{k}") for k in BASE_KINDS]
    every = in_order(F.concat("base", "entropy"), KINDS, start_first=True)
    return found.select("doc_id", *counts, F.sha2(joined(in_order(F.col("base"), KINDS, start_first=True)), 256).alias("base_sha256"), joined(every).alias("spans"))
