"""Answer scoring, composition of first and fallback answers, and usage of replayed responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispan.functions.text import date_key, normal_answer


def _counted(words: Column) -> Column:
    return F.filter(F.split(words, " "), lambda w: w != "")


def score_pairs(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, em, f1): the best over a key's golds of exact match and token-multiset F1 of normal forms.

    Where one side has no token, F1 is exact equality; both empty match.
    """
    p, g = _counted(normal_answer(F.col("answer"))), _counted(normal_answer(F.col("gold")))
    rows = pairs.select(*keys, p.alias("p"), g.alias("g"))
    # a multiset's overlap is what is left of p after what g cannot match: sizes of sorted arrays' counts
    shared = F.aggregate(F.array_distinct("p"), F.lit(0), lambda s, w: s + F.least(F.size(F.filter("p", lambda x: x == w)), F.size(F.filter("g", lambda x: x == w))))
    em = F.col("p") == F.col("g")
    f1 = F.when((F.size("p") == 0) | (F.size("g") == 0), em.cast("double")).otherwise(2 * shared / (F.size("p") + F.size("g")))
    return rows.select(*keys, em.alias("em"), f1.alias("f1")).groupBy(*keys).agg(F.max("em").alias("em"), F.max("f1").alias("f1"))


def audited_match(answer: Column, golds: Column) -> Column:
    """Exact match of normal forms, or the same full date in any of its written forms."""
    same = F.exists(golds, lambda g: normal_answer(g) == normal_answer(answer))
    day = date_key(answer)
    return same | (day.isNotNull() & F.exists(golds, lambda g: F.coalesce(date_key(g) == day, F.lit(False))))


def compose_selective(first: DataFrame, fallback: DataFrame, keys: list[str], selective: bool = True) -> DataFrame:
    """First answers, replaced by fallbacks only where the answer's normal form is `unknown`.

    A parser failure doesn't trigger. Selection and support stay the first stage's; request ids of
    both stages are listed, repeats included; a triggered row without a fallback is an error.
    """
    f = fallback.select(*keys, F.col("answer").alias("_answer"), F.col("request_ids").alias("_ids"), F.lit(True).alias("_there"))
    rows = first.join(f, keys, "left").withColumn("trigger", (normal_answer(F.col("answer")) == "unknown") & F.lit(selective))
    lost = F.col("trigger") & F.col("_there").isNull()
    answer = F.when(lost, F.raise_error(F.lit("a triggered answer has no fallback")).cast("string")).when(F.col("trigger"), F.col("_answer")).otherwise(F.col("answer"))
    ids = F.when(F.col("trigger"), F.concat("request_ids", "_ids")).otherwise(F.col("request_ids"))
    return rows.withColumn("answer", answer).withColumn("request_ids", ids).drop("_answer", "_ids", "_there")


def usage(rows: DataFrame, responses: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, calls, tokens) over each row's request ids; a repeated request counts each time, a missing response raises."""
    flat = rows.select(*keys, F.explode("request_ids").alias("request_id"))
    met = flat.join(responses.select("request_id", "tokens"), "request_id", "left")
    cost = F.when(F.col("tokens").isNull(), F.raise_error(F.concat(F.lit("no response for "), "request_id")).cast("long")).otherwise(F.col("tokens"))
    return met.groupBy(*keys).agg(F.count("*").alias("calls"), F.sum(cost).alias("tokens"))


def experiment_summary(rows: DataFrame) -> DataFrame:
    """By (policy, budget, selective), a null budget being a group: counts, fallbacks and means."""
    return rows.groupBy("policy", "budget", "selective").agg(
        F.count("*").alias("n"),
        F.sum(F.col("trigger").cast("long")).alias("fallbacks"),
        *[F.round(F.avg(F.col(c).cast("double")), 9).alias(c) for c in ("em", "f1", "complete", "calls", "tokens")],
    )
