"""Command line: prepare, select, run, summarize, compare, query.

python -m evispan.cli select JOBS.json OUT --policy bundle --budget 1024
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def session(name: str = "evispan") -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def select(spark: SparkSession, args) -> None:
    from evispan.operators.select import select_records
    from evispan.sources import readers

    questions, docs = readers.job_tables(readers.read_records(spark, args.jobs, readers.JOB))
    readers.write_new(select_records(questions, docs, args.policy, args.budget), args.output)


def summarize(spark: SparkSession, args) -> None:
    from evispan.operators.answers import experiment_summary
    from evispan.sources import readers

    readers.write_new(experiment_summary(spark.read.parquet(args.rows)), args.output)


def compare(spark: SparkSession, args) -> None:
    from evispan.operators.stats import paired_bootstrap

    sides = [{r["id"]: {"stratum": r["stratum"], args.metric: r[args.metric]} for r in spark.read.parquet(p).select("id", "stratum", args.metric).collect()} for p in (args.left, args.right)]
    spark.createDataFrame([paired_bootstrap(*sides, args.metric, args.ratio, args.seed, args.replicates)]).select(*[F.col(c) for c in ("estimate", "low", "high")]).write.mode("errorifexists").json(args.output)


def prepare(spark: SparkSession, args) -> None:
    from evispan.sources import prepare as p
    from evispan.sources import readers

    jobs, labels, audit = p.jobs_and_labels(readers.read_records(spark, args.records, StructType.fromDDL(p.RECORD)))
    for name, df in (("jobs", jobs), ("labels", labels), ("audit", audit)):
        readers.write_new(df, f"{args.output}/{name}")


def run(spark: SparkSession, args) -> None:
    """Replay stored responses over all jobs, policies and caps; what isn't stored raises."""
    from evispan.operators.experiment import evaluate
    from evispan.sources import readers

    questions, docs = readers.job_tables(readers.read_records(spark, args.jobs, readers.JOB))
    labels = readers.read_records(spark, args.labels, StructType.fromDDL("id string, answers array<string>, support_indices array<int>"))
    cache = spark.read.schema("request_id string, payload string, response string, model string, usage_tokens long").option("mode", "FAILFAST").json(args.cache).where(F.col("model") == args.model)
    model = lambda sent: readers.replay(sent, cache).withColumnRenamed("response", "raw")
    demos = spark.read.text(args.demos, wholetext=True).first()["value"] if args.demos else ""
    usage = cache.select("request_id", F.col("usage_tokens").alias("tokens"))
    rows = evaluate(questions, docs, labels.select(F.col("id").alias("job_id"), "answers", F.col("support_indices").alias("support")), model, usage, policies=tuple(args.policies), caps=tuple(args.caps), demos=demos)
    readers.write_new(rows, args.output, "parquet")


def query(spark: SparkSession, args) -> None:
    from evispan.plans import registry
    from evispan.sources import readers

    readers.write_new(registry.QUERIES[args.name](spark, args.tables), args.output, "parquet")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="evispan")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("select")
    s.add_argument("jobs"), s.add_argument("output"), s.add_argument("--policy", default="bundle"), s.add_argument("--budget", type=int, default=1024)
    s = sub.add_parser("summarize")
    s.add_argument("rows"), s.add_argument("output")
    s = sub.add_parser("compare")
    s.add_argument("left"), s.add_argument("right"), s.add_argument("output"), s.add_argument("--metric", default="em"), s.add_argument("--ratio", action="store_true")
    s.add_argument("--seed", type=int, default=20260921), s.add_argument("--replicates", type=int, default=20_000)
    s = sub.add_parser("prepare")
    s.add_argument("records"), s.add_argument("output")
    s = sub.add_parser("run")
    s.add_argument("jobs"), s.add_argument("labels"), s.add_argument("cache"), s.add_argument("output"), s.add_argument("--model", required=True), s.add_argument("--demos")
    s.add_argument("--caps", type=int, nargs="+", default=[512, 1024, 2048]), s.add_argument("--policies", nargs="+", default=["rank", "singleton", "bundle", "full"])
    s = sub.add_parser("query")
    s.add_argument("name"), s.add_argument("tables"), s.add_argument("output")
    args = p.parse_args(argv)
    try:
        {"prepare": prepare, "select": select, "run": run, "summarize": summarize, "compare": compare, "query": query}[args.command](session(), args)
    except Exception as e:  # what the user can mend is said in a line
        print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
