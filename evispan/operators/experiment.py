"""The experiment: every job by every policy and cap, read in one shot, with a stepwise fallback, scored against labels.

Jobs, policies and caps are columns of one table of cases, so a stage is one plan for all of them.
Labels meet finished answers only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispan.operators import answers, reader, select
from evispan.operators.components import settled

KEYS = ["job_id", "policy", "budget"]


def check(policies: tuple[str, ...], caps: tuple[int, ...], fallback: int) -> None:
    if not policies or set(policies) - set(select.POLICIES):
        raise ValueError("known policies are needed")
    if len(set(policies)) < len(policies) or len(set(caps)) < len(caps):
        raise ValueError("a policy or cap repeats")
    if any(type(c) is not int or c < 0 for c in (*caps, fallback)):
        raise ValueError("caps are whole numbers of 0 or more")


def sound_labels(labels: DataFrame, docs: DataFrame) -> DataFrame:
    """labels (job_id, answers, support) of the jobs of docs; no answer, or a support that is no candidate's place, raises."""
    sizes = docs.groupBy("job_id").agg(F.count("*").alias("_n"))
    met = sizes.join(labels, "job_id", "left")
    none = F.coalesce(F.size("answers") < 1, F.lit(True)) | F.exists("answers", lambda a: a.isNull())
    outside = F.coalesce(F.exists("support", lambda i: i.isNull() | (i < 0) | (i >= F.col("_n"))), F.lit(True))
    problem = F.when(none, "no answers").when(outside, "a support is no candidate")
    return met.where(F.when(problem.isNotNull(), F.raise_error(F.concat_ws(": ", F.col("job_id").cast("string"), problem)).cast("boolean")).otherwise(True)).drop("_n")


def selections(jobs: DataFrame, docs: DataFrame, policies: tuple[str, ...], caps: tuple[int, ...]) -> DataFrame:
    """(job_id, policy, budget, selected, spent); full has one row a job, with a null budget."""
    scored = docs.join(select.relevance(jobs, docs), ["job_id", "pos"])
    greedy = tuple(p for p in policies if p not in ("rank", "full"))
    feats = settled(select.features(jobs, docs, greedy)) if greedy else None
    parts = []
    for p in policies:
        for c in (None,) if p == "full" else caps:
            got = select.select_full(docs) if p == "full" else select.select_rank(scored, c) if p == "rank" else select.select_greedy(feats, p, c)
            parts.append(got.select("job_id", F.lit(p).alias("policy"), F.lit(c).cast("int").alias("budget"), "selected", F.col("spent").cast("long").alias("spent")))
    return reduce(DataFrame.unionByName, parts)


def evaluate(
    jobs: DataFrame, docs: DataFrame, labels: DataFrame, model: reader.Model, usage: DataFrame, *, policies: tuple[str, ...] = ("rank", "singleton", "bundle", "full"), caps: tuple[int, ...] = (512, 1024, 2048),
    demos: str = "", fallback: int = 1024, include_reference: bool = True,
) -> DataFrame:
    """A row a job, policy, cap and mode: answer, em, f1, complete, first_em, source tokens, calls, tokens.

    jobs (job_id, question, stratum), docs (job_id, pos, …), labels (job_id, answers, support), usage
    (request_id, tokens). selective rows take the stepwise answer where the first is "unknown"; with
    the reference, every job also has a row of policy always_dynamic.
    """
    check(policies, caps, fallback)
    gold = settled(sound_labels(labels, docs))
    cases = settled(selections(jobs, docs, policies, caps).withColumn("case", F.concat_ws("|", F.col("job_id").cast("string"), "policy", F.coalesce(F.col("budget").cast("string"), F.lit("")))))
    chosen = cases.where("selected <> ''").select("case", "job_id", F.explode(F.split("selected", ",")).alias("pos")).withColumn("pos", F.col("pos").cast("int"))
    own = docs.join(chosen, ["job_id", "pos"]).drop("job_id").withColumnRenamed("case", "job_id")
    asked = cases.select("case", "job_id").join(jobs.select("job_id", "question"), "job_id").select(F.col("case").alias("job_id"), "question")
    read = reader.one_shot(asked, own, own.select("job_id", "pos"), model, demos).withColumnRenamed("job_id", "case")
    first = settled(cases.join(read, "case").withColumn("source_tokens", F.col("spent")))
    unsure = first.where(answers.normal_answer(F.col("answer")) == "unknown").select("job_id").distinct()
    wanted = jobs if include_reference else jobs.join(unsure, "job_id", "left_semi")
    back = settled(reader.stepwise(wanted, docs, model, demos=demos))
    keyed = first.select("case").join(first.select("case", "job_id"), "case").join(back, "job_id").select("case", "answer", "request_ids")
    both = [answers.compose_selective(first, keyed, ["case"], on).withColumn("selective", F.lit(on)) for on in (False, True)]
    rows = both[0].unionByName(both[1])
    columns = ["job_id", "policy", "budget", "selective", "trigger", "answer", "ok", "request_ids", "selected", "source_tokens"]
    rows = rows.select(*columns)
    if include_reference:
        rows = rows.unionByName(
            back.select("job_id", F.lit("always_dynamic").alias("policy"), F.lit(fallback).alias("budget"), F.lit(False).alias("selective"), F.lit(True).alias("trigger"), "answer", F.lit(True).alias("ok"), "request_ids", F.lit("").alias("selected"), F.lit(None).cast("long").alias("source_tokens"))
        )
    rows = settled(rows.withColumn("row", F.sha2(F.concat_ws("|", F.col("job_id").cast("string"), "policy", F.coalesce(F.col("budget").cast("string"), F.lit("")), "selective"), 256)))
    golds = gold.select("job_id", F.explode("answers").alias("gold"))
    scored = answers.score_pairs(rows.select("row", "job_id", "answer").join(golds, "job_id"), ["row"])
    start = answers.score_pairs(first.select("case", "job_id", "answer").join(golds, "job_id"), ["case"]).select("case", F.col("em").alias("first_em"))
    start = first.select("case", "job_id", "policy", "budget").join(start, "case").drop("case")
    cost = answers.usage(rows, usage, ["row"])
    support = F.transform("support", lambda i: i.cast("string"))
    out = rows.join(scored, "row").join(cost, "row", "left").join(gold.select("job_id", "support"), "job_id").join(jobs.select("job_id", "stratum"), "job_id")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in KEYS]
    out = out.alias("r").join(start.alias("s"), reduce(lambda a, b: a & b, same), "left")
    return out.select(
        "r.job_id", "stratum", "r.policy", "r.budget", "selective", "trigger", "answer", "ok", "request_ids", F.col("em").cast("double").alias("em"), "f1",
        F.when(F.col("r.policy") != "always_dynamic", (F.size(F.array_except(support, F.split("selected", ","))) == 0).cast("double")).alias("complete"),
        F.col("first_em").cast("double").alias("first_em"), "source_tokens", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
    )
