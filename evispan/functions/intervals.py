"""Algebra on arrays of half-open intervals struct<start, stop>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KIND = "array<struct<start:int,stop:int>>"


def span(start: Column, stop: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["stop"]) & (b["start"] < a["stop"])


def any_overlap(left: Column, right: Column) -> Column:
    return F.exists(left, lambda a: F.exists(right, lambda b: overlaps(a, b)))


def union_length(spans: Column) -> Column:
    """Covered length; touching and overlapping intervals count once."""
    zero = F.struct(F.lit(0).alias("total"), F.lit(-1).alias("end"))
    return F.aggregate(
        F.array_sort(spans),
        zero,
        lambda acc, s: F.struct((acc["total"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], acc["end"]))).alias("total"), F.greatest(acc["end"], s["stop"]).alias("end")),
        lambda acc: acc["total"],
    )


def merged(spans: Column) -> Column:
    """Disjoint intervals in order, touching ones joined."""
    zero = F.struct(F.array().cast(KIND).alias("done"), F.lit(None).cast("struct<start:int,stop:int>").alias("now"))

    def step(acc: Column, s: Column) -> Column:
        joins = acc["now"].isNotNull() & (s["start"] <= acc["now"]["stop"])
        grown = span(acc["now"]["start"], F.greatest(acc["now"]["stop"], s["stop"]))
        pushed = F.when(acc["now"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"])))
        return F.struct(F.when(joins, acc["done"]).otherwise(pushed).alias("done"), F.when(joins, grown).otherwise(span(s["start"], s["stop"])).alias("now"))

    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: F.when(acc["now"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))))


def pairwise(left: Column, right: Column) -> Column:
    """All non-empty intersections of the two sides."""
    cut = F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: span(F.greatest(a["start"], b["start"]), F.least(a["stop"], b["stop"])))))
    return F.filter(cut, lambda s: s["start"] < s["stop"])


def overlap_sum(left: Column, right: Column) -> Column:
    """Pairwise overlap, which counts doubly covered text twice."""
    return F.aggregate(pairwise(left, right), F.lit(0), lambda a, s: a + s["stop"] - s["start"])


def overlap_union(left: Column, right: Column) -> Column:
    return union_length(pairwise(left, right))


def match_scores(gold: Column, pred: Column, union: bool = True) -> Column:
    """(f1, recall, precision) by covered characters; by plain overlap sums where union is false."""
    both = overlap_union(gold, pred) if union else overlap_sum(gold, pred)
    g, p = union_length(gold), union_length(pred)
    recall, precision = F.when(g > 0, both / g).otherwise(0.0), F.when(p > 0, both / p).otherwise(0.0)
    f1 = F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(0.0)
    return F.struct(f1.alias("f1"), recall.alias("recall"), precision.alias("precision"))


def best_gold(golds: Column, pred: Column) -> Column:
    """The best of several gold alternatives, never their union."""
    return F.array_max(F.transform(golds, lambda g: match_scores(g, pred)))


def covered_by(gold: Column, spans: Column) -> Column:
    """The gold interval lies in one merged interval."""
    return F.exists(merged(spans), lambda s: (s["start"] <= gold["start"]) & (gold["stop"] <= s["stop"]))


def noncontiguous(spans: Column) -> Column:
    return F.size(merged(spans)) > 1


def sliced_text(text: Column, spans: Column, separator: str = "\n[...]\n") -> Column:
    return F.array_join(F.transform(spans, lambda s: F.regexp_replace(F.substring(text, s["start"] + 1, s["stop"] - s["start"]), r"(?U)^\s+|\s+$", "")), separator)
