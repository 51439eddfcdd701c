"""Policy cases whose rules are revised: the newest rule of a scope decides, and what a change must refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["invoice", "allocation", "refund", "routing"]


def outcome(kind: Column, rule: Column, request: Column) -> Column:
    """(decision, value) of a request under a rule, both structs of whole numbers.

    invoice: quantity x unit + fee commits. allocation: used + requested within the limit commits
    the request, else 0 is denied. refund: within the window commits the smaller of paid and cap,
    else 0 is denied. routing: severity at the threshold goes to urgent, else to normal.
    """
    fits, fresh = request["used"] + request["requested"] <= rule["limit"], request["age"] <= rule["window"]
    decision = F.when(kind == "invoice", "commit").when(kind == "allocation", F.when(fits, "commit").otherwise("deny")).when(kind == "refund", F.when(fresh, "commit").otherwise("deny")).otherwise(F.when(request["severity"] >= rule["threshold"], "urgent").otherwise("normal"))
    value = (
        F.when(kind == "invoice", request["quantity"] * rule["unit"] + rule["fee"])
        .when(kind == "allocation", F.when(fits, request["requested"]).otherwise(0))
        .when(kind == "refund", F.when(fresh, F.least(request["paid"], rule["cap"])).otherwise(0))
        .otherwise(0)
    )
    return F.struct(decision.alias("decision"), value.cast("long").alias("value"))


def newest(rules: DataFrame) -> DataFrame:
    """(scope, rule): the rule with the greatest revision of each scope."""
    return rules.groupBy("scope").agg(F.max_by("rule", "revision").alias("rule"), F.max("revision").alias("revision"))


def generated(spark, cases: int = 32, revisions: int = 5) -> tuple[DataFrame, DataFrame]:
    """(requests, rules): a case a scope, its kinds in turn, numbers from its index."""
    ids = spark.range(cases).withColumnRenamed("id", "scope")
    i = F.col("scope")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (i % 4 + 1).cast("int"))
    request = F.struct(*[(i * a % b + 1).alias(n) for n, a, b in (("quantity", 7, 11), ("used", 5, 40), ("requested", 3, 30), ("age", 11, 60), ("paid", 13, 200), ("severity", 17, 10))])
    requests = ids.select("scope", kind.alias("kind"), request.alias("request"))
    grown = ids.withColumn("revision", F.explode(F.sequence(F.lit(1), F.lit(revisions))))
    r = F.col("revision")
    rule = F.struct(*[((i + r) * a % b + c).alias(n) for n, a, b, c in (("unit", 3, 20, 1), ("fee", 5, 9, 0), ("limit", 7, 50, 10), ("window", 11, 45, 10), ("cap", 13, 150, 20), ("threshold", 17, 8, 2))])
    return requests, grown.select("scope", "revision", rule.alias("rule"))


def decide(requests: DataFrame, rules: DataFrame) -> DataFrame:
    met = requests.join(newest(rules), "scope")
    return met.select("scope", "kind", "revision", outcome(F.col("kind"), F.col("rule"), F.col("request")).alias("o")).select("scope", "kind", "revision", "o.decision", "o.value")


def refresh_flags(shown: DataFrame, before: DataFrame, after: DataFrame, shown_after: DataFrame, same_epoch: bool) -> DataFrame:
    """One row: content_only, a shown document vanished or changed; epoch, the snapshot or plan did; query, the shown list did."""
    a, b = before.select("id", F.col("hash").alias("_a")), after.select("id", F.col("hash").alias("_b"))
    content = shown.join(a, "id", "left").join(b, "id", "left").agg(F.coalesce(F.bool_or(~F.col("_a").eqNullSafe(F.col("_b"))), F.lit(False)).alias("content_only"))
    listed = lambda df, n: df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string")), ",").alias(n))
    return content.join(listed(shown, "_x")).join(listed(shown_after, "_y")).select("content_only", F.lit(not same_epoch).alias("epoch"), (F.col("_x") != F.col("_y")).alias("query"))
