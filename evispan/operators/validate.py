"""Input contracts, and decisions over versioned reads, writes and obligations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispan.functions.intervals import any_overlap

#: The nine policies of the decision matrix.
POLICIES = ["execution_evidence", "projection_evidence", "model_evidence", "without_read_check", "read_set_occ", "selectors_only", "target_version_occ", "review_all", "append_only"]
FAMILIES = ["freshness", "commitment", "authority", "operation", "view", "witness_gap"]


def job_problems(jobs: DataFrame, docs: DataFrame, support: DataFrame) -> DataFrame:
    """(job_id, problem, n): repeated bodies, blank titles, jobs without support; also bodies that don't have their digest and costs that aren't positive."""
    repeated = docs.groupBy("job_id", "sha256").agg(F.count("*").alias("c")).where("c > 1").groupBy("job_id").agg(F.count("*").alias("n")).withColumn("problem", F.lit("repeated_body"))
    flags = docs.select("job_id", F.explode(F.array_compact(F.array(
        F.when(F.col("title") == "", "blank_title"),
        F.when(F.sha2("text", 256) != F.col("sha256"), "wrong_digest"),
        F.when(F.col("tokens") <= 0, "bad_cost"),
    ))).alias("problem"))
    flagged = flags.groupBy("job_id", "problem").agg(F.count("*").alias("n"))
    bare = jobs.select("job_id").join(support.select("job_id").distinct(), "job_id", "left_anti").select("job_id", F.lit("no_support").alias("problem"), F.lit(1).cast("long").alias("n"))
    return repeated.select("job_id", "problem", "n").unionByName(flagged).unionByName(bare)


def same_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that stand on one side only; empty where the sides agree."""
    a, b = left.select(key).distinct().withColumn("_a", F.lit(True)), right.select(key).distinct().withColumn("_b", F.lit(True))
    return a.join(b, key, "full_outer").where("_a is null or _b is null").select(key, F.when(F.col("_a").isNull(), "right").otherwise("left").alias("side"))


def conflict(writes1: Column, deps1: Column, foot1: Column, writes2: Column, deps2: Column, foot2: Column) -> Column:
    """REBASE for a shared write, REVALIDATE for a write into the other's dependencies, REBASE for overlapping text, else COMMUTE."""
    return (
        F.when(F.arrays_overlap(writes1, writes2), "REBASE")
        .when(F.arrays_overlap(writes1, deps2) | F.arrays_overlap(writes2, deps1), "REVALIDATE")
        .when(any_overlap(foot1, foot2), "REBASE")
        .otherwise("COMMUTE")
    )


def current(reads: Column, versions: Column) -> Column:
    """All reads (array of struct<object, version>) are at the current version; an object that is gone is stale."""
    return F.forall(reads, lambda r: F.coalesce(F.element_at(versions, r["object"]) == r["version"], F.lit(False)))


def freshness(reads: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """(key, decision) from reads (key, object, version) and current (object, version)."""
    met = reads.join(now.select("object", F.col("version").alias("_now")), "object", "left")
    return met.groupBy(key).agg(F.bool_and(F.coalesce(F.col("version") == F.col("_now"), F.lit(False))).alias("fresh")).select(key, F.when(F.col("fresh"), "FRESH").otherwise("REVALIDATE").alias("decision"))


def selectors() -> list[Column]:
    """The obligations that need no versions."""
    return [
        F.when(~F.col("target_unique"), "TARGET"),
        F.when(F.col("declared_operation") != F.col("actual_operation"), "OP"),
        F.when(F.col("actor_authority") < F.col("required_authority"), "AUTH"),
    ]


def obligations(evidence: str, check_reads: bool = True) -> Column:
    """Failed obligations of an update row by one kind of evidence, as an array of names.

    Columns: target_unique, declared_operation, actual_operation, actor_authority,
    required_authority, requires_witness, versions, and by evidence reads_<e> and views_<e>,
    arrays of struct<object, version>. A missing witness isn't held against the model's evidence.
    """
    versions, reads = F.col("versions"), F.col(f"reads_{evidence}")
    checks = selectors()
    if check_reads:
        if evidence != "model":
            checks.append(F.when(F.col("requires_witness") & (F.size(reads) == 0), "READ"))
        checks.append(F.when(~current(reads, versions), "FRESH"))
    checks.append(F.when(~current(F.col(f"views_{evidence}"), versions), "VIEW"))
    return F.array_compact(F.array(*checks))


def decision(policy: str) -> Column:
    """What one of the POLICIES says of an update row: AUTO_COMMIT, REVALIDATE or REVIEW."""

    def judged(failed: Column) -> Column:
        stale = F.arrays_overlap(failed, F.array(*[F.lit(x) for x in ("READ", "FRESH", "VIEW")]))
        return F.when(stale, "REVALIDATE").when(F.size(failed) > 0, "REVIEW").otherwise("AUTO_COMMIT")

    if policy.endswith("_evidence"):
        return judged(obligations(policy.removesuffix("_evidence")))
    if policy == "without_read_check":
        return judged(obligations("execution", check_reads=False))
    if policy == "read_set_occ":
        return F.when(current(F.col("reads_execution"), F.col("versions")), "AUTO_COMMIT").otherwise("REVALIDATE")
    if policy == "target_version_occ":
        same = F.coalesce(F.element_at("versions", F.col("target")) == F.col("target_version"), F.lit(False))
        return F.when(same, "AUTO_COMMIT").otherwise("REVALIDATE")
    if policy == "selectors_only":
        return judged(F.array_compact(F.array(*selectors())))
    return F.lit({"append_only": "AUTO_COMMIT", "review_all": "REVIEW"}[policy])


def decisions(updates: DataFrame, policies: list[str] = POLICIES) -> DataFrame:
    """updates once for each policy, with `policy` and `decision`; one pass, no join."""
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), decision(p).alias("decision")) for p in policies]))
    return updates.withColumn("_d", each).select(*updates.columns, "_d.policy", "_d.decision")


def matrix(judged: DataFrame) -> DataFrame:
    """By policy and family: cases, automatic commits, unsafe ones and their rate; denominators are at least 1."""
    auto = F.col("decision") == "AUTO_COMMIT"
    return judged.groupBy("policy", "family").agg(
        F.count("*").alias("cases"),
        F.count_if(auto).alias("committed"),
        F.count_if(auto & F.col("unsafe")).alias("unsafe_commits"),
        F.round(F.count_if(auto & F.col("unsafe")) / F.greatest(F.count_if(F.col("unsafe")), F.lit(1)), 9).alias("unsafe_rate"),
    )


def generated_updates(spark, per_family: int = 60, safe: int = 300) -> DataFrame:
    """Diagnostic updates: `per_family` of each issue and `safe` without one, from a range and column expressions.

    freshness: a dependency moved on; commitment: a peer's object did; authority: too little;
    operation: not the declared one; view: a source moved on that the model's evidence lacks;
    witness_gap: a hidden read moved on that only the execution saw.
    """
    n = per_family * len(FAMILIES)
    ids = spark.range(n + safe).withColumnRenamed("id", "case_id")
    family = F.when(F.col("case_id") < n, F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), (F.floor(F.col("case_id") / per_family) + 1).cast("int"))).otherwise("safe")
    rows = ids.withColumn("family", family)
    name = lambda what: F.concat(F.lit(f"{what}-"), F.col("case_id").cast("string"))
    is_ = lambda f: F.col("family") == f
    read = lambda what: F.struct(name(what).alias("object"), F.lit(1).alias("version"))
    at = lambda what, bad: F.struct(name(what), F.when(is_(bad), 2).otherwise(1))
    none = F.array().cast("array<struct<object:string,version:int>>")
    versions = F.map_from_entries(F.array(F.struct(name("target"), F.lit(1)), at("dependency", "freshness"), at("peer", "commitment"), at("source", "view"), at("hidden", "witness_gap")))
    base = F.array(read("dependency"), read("peer"))
    seen = F.when(is_("witness_gap"), F.array(read("hidden"))).otherwise(base)
    return rows.select(
        "case_id",
        "family",
        (F.col("family") != "safe").alias("unsafe"),
        name("target").alias("target"),
        F.lit(1).alias("target_version"),
        F.lit(True).alias("target_unique"),
        F.lit("replace").alias("declared_operation"),
        F.when(is_("operation"), "append").otherwise("replace").alias("actual_operation"),
        F.when(is_("authority"), 0).otherwise(2).alias("actor_authority"),
        F.lit(2).alias("required_authority"),
        seen.alias("reads_execution"),
        F.when(is_("witness_gap"), none).otherwise(base).alias("reads_projection"),
        F.when(is_("witness_gap"), none).otherwise(base).alias("reads_model"),
        F.when(is_("view"), F.array(read("source"))).otherwise(none).alias("views_execution"),
        F.when(is_("view"), F.array(read("source"))).otherwise(none).alias("views_projection"),
        none.alias("views_model"),
        is_("witness_gap").alias("requires_witness"),
        versions.alias("versions"),
    )


def stale_updates(scenarios: DataFrame) -> DataFrame:
    """Updates of scenarios (event_id, stale): each read its peer's commitment at version 1, which is at 2 where stale."""
    name = lambda what: F.concat(F.lit(f"{what}-"), F.col("event_id").cast("string"))
    none = F.array().cast("array<struct<object:string,version:int>>")
    read = F.array(F.struct(name("peer").alias("object"), F.lit(1).alias("version")))
    versions = F.map_from_entries(F.array(F.struct(name("target"), F.lit(1)), F.struct(name("peer"), F.when(F.col("stale"), 2).otherwise(1))))
    return scenarios.select(
        "event_id", "stale", name("target").alias("target"), F.lit(1).alias("target_version"), F.lit(True).alias("target_unique"),
        F.lit("replace").alias("declared_operation"), F.lit("replace").alias("actual_operation"), F.lit(1).alias("actor_authority"), F.lit(1).alias("required_authority"),
        *[read.alias(f"reads_{e}") for e in ("execution", "projection", "model")], *[none.alias(f"views_{e}") for e in ("execution", "projection", "model")],
        F.lit(False).alias("requires_witness"), versions.alias("versions"),
    )


def stale_summary(judged: DataFrame) -> DataFrame:
    """By policy: scenarios, stale ones, stale ones that were committed, and those not committed."""
    commits = F.col("decision") == "AUTO_COMMIT"
    return judged.groupBy("policy").agg(F.count("*").alias("scenarios"), F.count_if("stale").alias("stale"), F.count_if(F.col("stale") & commits).alias("stale_commits"), F.count_if(~commits).alias("not_committed"))
