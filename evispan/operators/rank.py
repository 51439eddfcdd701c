"""Rank fusion, ranking and footprint metrics, budget controls, frontiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEPTHS = (1, 2, 4, 8)


def fuse(left: DataFrame, right: DataFrame, keys: list[str], item: str = "item", k: int = 60) -> DataFrame:
    """(keys, item, score, rank): reciprocal-rank sums over two rankings (rank from 1), ids of either; ties by id."""
    both = left.select(*keys, item, "rank").unionByName(right.select(*keys, item, "rank"))
    summed = both.groupBy(*keys, item).agg(F.round(F.sum(1 / (k + F.col("rank"))), 12).alias("score"))
    return summed.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), item)).cast("long"))


def fuse_complete(first: DataFrame, second: DataFrame, keys: list[str], label: str = "label", k: int = 60) -> DataFrame:
    """Two complete rankings of the same labels: ties by the better first rank, then the larger label."""
    both = first.select(*keys, label, F.col("rank").alias("_a")).join(second.select(*keys, label, F.col("rank").alias("_b")), [*keys, label], "full_outer")
    bad = F.col("_a").isNull() | F.col("_b").isNull()
    score = F.when(bad, F.raise_error(F.lit("the rankings' labels differ")).cast("double")).otherwise(F.round(1 / (k + F.col("_a")) + 1 / (k + F.col("_b")), 12))
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "_a", F.col(label).desc())
    return both.withColumn("score", score).withColumn("rank", F.row_number().over(order).cast("long")).drop("_a", "_b")


def is_permutation(labels: Column, ranked: Column) -> Column:
    return (F.array_sort(labels) == F.array_sort(ranked)) & (F.size(F.array_distinct(ranked)) == F.size(ranked))


def ranking_metrics(ranked: DataFrame, keys: list[str], depths: tuple[int, ...] = DEPTHS, relevant: float = 0.5) -> DataFrame:
    """(keys, ndcg_k, mrr_k, best_k) of rows (keys, rank from 1, rel): gains 2^rel - 1, the ideal from the same relevances."""
    w = Window.partitionBy(*keys)
    rows = ranked.withColumn("_ideal", F.row_number().over(w.orderBy(F.col("rel").desc(), "rank")))
    gain = F.pow(F.lit(2.0), F.col("rel")) - 1
    aggs = []
    for k in depths:
        top, ideal = F.col("rank") <= k, F.col("_ideal") <= k
        dcg = F.sum(F.when(top, gain / F.log2(F.col("rank") + 1)).otherwise(0.0))
        best = F.sum(F.when(ideal, gain / F.log2(F.col("_ideal") + 1)).otherwise(0.0))
        aggs += [
            F.when(best > 0, dcg / best).otherwise(0.0).alias(f"ndcg_{k}"),
            F.coalesce(1 / F.min(F.when(top & (F.col("rel") >= relevant), F.col("rank"))), F.lit(0.0)).alias(f"mrr_{k}"),
            F.max(F.when(top, F.col("rel"))).alias(f"best_{k}"),
        ]
    return rows.groupBy(*keys).agg(*aggs)


def touch_metrics(segs: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, touched, amplification): segments that an edit touches, and their length over the edit's."""
    e = edits.select("doc_id", F.col("start").alias("_s"), F.col("stop").alias("_e"))
    met = segs.join(e, "doc_id").where((F.col("start") < F.col("_e")) & (F.col("_s") < F.col("stop")))
    return met.groupBy("doc_id").agg(F.count("*").alias("touched"), (F.sum(F.col("stop") - F.col("start")) / F.greatest(F.lit(1), F.max(F.col("_e") - F.col("_s")))).alias("amplification"))


def inventory_cost(items: DataFrame, group: str, identity: str, size: str) -> DataFrame:
    """(group, documents, different, mean_atoms, atoms_once): costs by document and by different text; a text of two sizes raises."""
    per = items.groupBy(group, identity).agg(F.count("*").alias("c"), F.min(size).alias("low"), F.max(size).alias("high"), F.sum(size).alias("s"))
    once = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.raise_error(F.lit("a text has inventories of two sizes")).cast("int"))
    return per.groupBy(group).agg(F.sum("c").alias("documents"), F.count("*").alias("different"), F.round(F.sum("s") / F.sum("c"), 9).alias("mean_atoms"), F.sum(once).alias("atoms_once"))


def reuse_rate(old: DataFrame, new: DataFrame, key: str, piece: str) -> DataFrame:
    """(key, reuse): the share of old pieces, with repeats, that the new version still has."""
    count = lambda df, n: df.groupBy(key, F.md5(piece).alias("sig")).agg(F.count("*").alias(n))
    both = count(old, "a").join(count(new, "b"), [key, "sig"], "left")
    return both.groupBy(key).agg((F.sum(F.least("a", F.coalesce("b", F.lit(0)))) / F.sum("a")).alias("reuse"))


def greedy_cover(gold_len: int, overlaps: list[list[tuple[int, int]]], k: int) -> list[int]:
    """Up to k tiles (their overlaps with the gold as disjoint intervals) that cover most of it, one after the other; ties to the earlier."""
    left, out = [], []
    covered: list[tuple[int, int]] = []

    def length(spans: list[tuple[int, int]]) -> int:
        total, end = 0, -1
        for a, b in sorted(spans):
            total += max(0, b - max(a, end))
            end = max(end, b)
        return total

    left = list(range(len(overlaps)))
    while left and len(out) < k:
        base = length(covered)
        gains = [(length(covered + overlaps[i]) - base, -i) for i in left]
        gain, neg = max(gains)
        if gain <= 0:
            break
        out.append(-neg)
        left.remove(-neg)
        covered += overlaps[-neg]
    return out


def budget_control(ranked: DataFrame, cap: Column, order: list[Column], base: int = 2) -> DataFrame:
    """(doc_id, selected, spent, feasible): the first `base` ranks always, then others whole, in `order`, where they still fit.

    ranked is (doc_id, rank from 1, item, cost, cap): what comes after the base is skipped where
    it doesn't fit and the next is tried, a fold over the ordered array.
    """
    line = F.array_sort(F.collect_list(F.struct((F.col("rank") > base).alias("late"), *[c.alias(f"o{i}") for i, c in enumerate(order)], "rank", "item", "cost")))
    per = ranked.groupBy("doc_id").agg(line.alias("line"), F.max(cap).alias("cap"))
    zero = F.struct(F.lit(0).cast("long").alias("spent"), F.array().cast("array<string>").alias("got"))
    step = lambda s, x: F.when(~x["late"] | (s["spent"] + x["cost"] <= F.col("cap")), F.struct((s["spent"] + x["cost"]).alias("spent"), F.concat(s["got"], F.array(x["item"].cast("string"))).alias("got"))).otherwise(s)
    done = per.withColumn("s", F.aggregate("line", zero, step))
    return done.select("doc_id", F.array_join("s.got", ",").alias("selected"), F.col("s.spent").alias("spent"), (F.col("s.spent") <= F.col("cap")).alias("feasible"))


def pareto(rows: DataFrame, cost: str, gain: str) -> DataFrame:
    """Rows that none beats: no other has as low a cost and as high a gain with either strictly better.

    Rows are compared with the best gain of lower costs, kept by range partitions: first the best
    of each of many cost buckets, then a window within a bucket, so no task holds all rows.
    """
    bounds = rows.agg(F.min(cost).alias("lo"), F.max(cost).alias("hi"))
    bucket = F.when(F.col("hi") > F.col("lo"), F.floor(255 * (F.col(cost) - F.col("lo")) / (F.col("hi") - F.col("lo")))).otherwise(0)
    placed = rows.join(F.broadcast(bounds)).withColumn("_b", bucket)  # one row of bounds
    best = placed.groupBy("_b").agg(F.max(gain).alias("_g"))
    before = best.withColumn("_before", F.max("_g").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select("_b", "_before")
    levels = placed.groupBy("_b", cost).agg(F.max(gain).alias("_top"))  # only a cost's best can stay
    cheaper = F.max("_top").over(Window.partitionBy("_b").orderBy(cost).rowsBetween(Window.unboundedPreceding, -1))
    kept = levels.withColumn("_cheaper", cheaper).join(F.broadcast(before), "_b")  # 256 buckets at most
    kept = kept.where((F.col("_cheaper").isNull() | (F.col("_top") > F.col("_cheaper"))) & (F.col("_before").isNull() | (F.col("_top") > F.col("_before"))))
    return placed.join(kept.select("_b", cost, F.col("_top").alias(gain)), ["_b", cost, gain], "left_semi").select(*rows.columns)


def knee(frontier: DataFrame, cost: str, gain: str) -> DataFrame:
    """The frontier row nearest to the best of both after scaling each to 0..1; ties to the lower cost."""
    b = frontier.agg(*[f(c).alias(f"_{n}{c}") for c in (cost, gain) for n, f in (("lo", F.min), ("hi", F.max))])
    unit = lambda c: F.when(F.col(f"_hi{c}") > F.col(f"_lo{c}"), (F.col(c) - F.col(f"_lo{c}")) / (F.col(f"_hi{c}") - F.col(f"_lo{c}"))).otherwise(0.0)
    d = F.round(F.sqrt(F.pow(unit(cost), 2) + F.pow(1 - unit(gain), 2)), 9)
    return frontier.join(F.broadcast(b)).withColumn("distance", d).orderBy("distance", cost).limit(1).select(*frontier.columns, "distance")


def retained_gain(rows: DataFrame, base_gain: float, full_gain: float, base_objects: float, least: float = 0.9, most: float = 2.0) -> DataFrame:
    """The row with the fewest objects that keeps `least` of the full gain within `most` times the objects; none raises."""
    ok = (F.col("gain") - base_gain >= least * (full_gain - base_gain)) & (F.col("objects") <= most * base_objects)
    best = rows.where(ok).agg(F.min_by(F.struct(*rows.columns), F.struct("objects", -F.col("gain"))).alias("r"))
    return best.select(F.when(F.col("r").isNull(), F.raise_error(F.lit("no row keeps enough")).cast(best.schema["r"].dataType)).otherwise(F.col("r")).alias("r")).select("r.*")


def best_threshold(rows: DataFrame) -> DataFrame:
    """The threshold of the largest f1 + .2 complete - .0005 objects; ties to fewer objects, then the lower threshold."""
    value = F.round(F.col("f1") + 0.20 * F.col("complete") - 0.0005 * F.col("objects"), 9)
    return rows.withColumn("objective", value).orderBy(F.col("objective").desc(), "objects", "threshold").limit(1)
