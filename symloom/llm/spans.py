"""Places of regular expression matches, by SQL functions alone.

A span is struct<kind string, start int, end int, value string>; places count
code points from 0, the end is exclusive. All functions take time in proportion
to a text's length and its number of spans (sorting aside).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<kind:string,start:int,end:int,value:string>"
NO_SPANS = f"cast(array() as array<{SPAN}>)"
#: Size of the pieces that running totals are made in.
PIECE = 64
#: Products of two arrays' sizes up to which all their pairs are looked at.
FEW_PAIRS = 4096
_FAR = 1 << 40


def span(kind: Column, start: Column, end: Column, value: Column) -> Column:
    return F.struct(kind.alias("kind"), start.cast("int").alias("start"), end.cast("int").alias("end"), value.alias("value"))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column], neutral: int) -> Column:
    """The inclusive running totals of an array of long under an associative operation.

    An array grows by copying, so that totals are made one by one in pieces of
    ``PIECE`` only, then in pieces of those pieces' ends, then of theirs.
    """
    zero = F.lit(neutral).cast("long")

    def one_by_one(xs: Column) -> Column:
        return F.aggregate(xs, F.expr("cast(array() as array<bigint>)"), lambda out, x: F.concat(out, F.array(combine(F.coalesce(F.get(out, F.size(out) - 1), zero), x))))

    def in_pieces(xs: Column) -> Column:
        last = F.greatest(F.floor((F.size(xs) - 1).cast("double") / float(PIECE)).cast("int"), F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: one_by_one(F.slice(xs, i * PIECE + 1, F.lit(PIECE))))

    def joined(parts: Column, totals: Callable[[Column], Column]) -> Column:
        ends = totals(F.transform(parts, lambda p: F.get(p, F.size(p) - 1)))
        return let(ends, lambda before: F.flatten(F.transform(parts, lambda p, i: F.transform(p, lambda x: combine(F.coalesce(F.get(before, i - 1), zero), x)))))

    def of_pieces(ends: Column) -> Column:
        return let(let(ends, in_pieces), lambda parts: joined(parts, one_by_one))

    return let(let(values, in_pieces), lambda parts: joined(parts, of_pieces))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def running_sums(values: Column) -> Column:
    return running(values, _sum, 0)


def matches(text: Column, kind: str, pattern: str, measure: Callable[[Column], Column] = F.length) -> Column:
    """Spans of the leftmost non-overlapping matches of a pattern that matches no empty string.

    The stretches between the matches and the matches themselves are laid end
    to end, which gives their places, in units of ``measure`` (code points, or
    bytes with ``F.octet_length``). Give patterns possessive quantifiers, so
    that matching neither recurses nor goes back over long runs.
    """

    def placed(found: Column) -> Column:
        sizes = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda b, v: (measure(b) + measure(v)).cast("long"))
        return let(running_sums(sizes), lambda ends: F.transform(found, lambda v, i: span(F.lit(kind), F.get(ends, i) - measure(v), F.get(ends, i), v)))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, F.expr(NO_SPANS)).otherwise(placed(found)))


def spans_if(condition: Column, spans: Column) -> Column:
    return F.when(condition, spans).otherwise(F.expr(NO_SPANS))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def clear_of(own: str, others: str) -> Column:
    """The spans in column ``own`` that touch none of those in column ``others``, by start."""

    def marked(name: str, is_own: bool) -> Column:
        return F.transform(name, lambda s: F.struct(s["start"].alias("at"), F.lit(is_own).alias("own"), s.alias("s")))

    def clear(m: Column) -> Column:
        ends = running(F.transform(m, lambda x: F.when(x["own"], F.lit(-1).cast("long")).otherwise(x["s"]["end"].cast("long"))), F.greatest, -1)
        starts = F.reverse(running(F.transform(F.reverse(m), lambda x: F.when(x["own"], F.lit(_FAR)).otherwise(x["s"]["start"].cast("long"))), F.least, _FAR))
        before, after = F.lit(-1).cast("long"), F.lit(_FAR)
        reach = F.arrays_zip(m.alias("m"), F.concat(F.array(before), ends).alias("e"), F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(m) - 1, F.lit(0))), F.array(after)).alias("n"))
        free = F.filter(reach, lambda x: x["m"].isNotNull() & x["m"]["own"] & (x["e"] <= x["m"]["s"]["start"]) & (x["n"] >= x["m"]["s"]["end"]))
        return F.transform(free, lambda x: x["m"]["s"])

    few = F.size(own).cast("long") * F.size(others).cast("long") <= FEW_PAIRS
    by_pairs = F.filter(own, lambda s: ~F.exists(others, lambda o: overlaps(o, s)))
    return F.when(few, by_pairs).otherwise(let(F.array_sort(F.concat(marked(own, True), marked(others, False))), clear))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def in_order(spans: Column, kinds: list[str], start_first: bool) -> Column:
    """By kind as listed and then start, or by start and then kind."""
    place = F.create_map(*(F.lit(x) for i, k in enumerate(kinds) for x in (k, i)))

    def key(s: Column) -> Column:
        parts = (s["start"], place[s["kind"]]) if start_first else (place[s["kind"]], s["start"])
        return F.struct(parts[0].alias("a"), parts[1].alias("b"), s.alias("s"))

    return F.transform(F.array_sort(F.transform(spans, key)), lambda x: x["s"])


def replaced(text: Column, spans: Column) -> Column:
    """``text`` with each span, or each run of overlapping spans, as <KIND> of its first one; the spans' places count bytes."""

    def built(data: Column, sorted_: Column, reach: Column) -> Column:
        def cut(start: Column, end: Column) -> Column:
            return F.substring(data, start + 1, end - start).cast("string")

        def part(s: Column, i: Column) -> Column:
            at = F.coalesce(F.get(reach, i - 1), F.lit(0).cast("long")).cast("int")
            return F.when(s["start"] >= at, F.concat(cut(at, s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(F.lit(""))

        last = F.get(reach, F.size(reach) - 1).cast("int")
        return F.concat(F.array_join(F.transform(sorted_, part), ""), cut(last, F.octet_length(text)))

    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    whole = let(by_start, lambda s: let(running(F.transform(s, lambda x: x["end"].cast("long")), F.greatest, 0), lambda reach: let(F.encode(text, "UTF-8"), lambda data: built(data, s, reach))))
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
