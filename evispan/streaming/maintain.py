"""Top-k kept up to date over a stream of document changes, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evispan.operators import snapshot

CHANGES = "id long, text string, op string, seq long"


def apply_changes(corpus: DataFrame, changes: DataFrame) -> DataFrame:
    """corpus (id, text) after changes (id, text, op, seq): of several for an id the last counts; op delete removes."""
    last = changes.groupBy("id").agg(F.max_by(F.struct("text", "op"), "seq").alias("c")).select("id", "c.text", "c.op")
    return corpus.join(last.select("id"), "id", "left_anti").unionByName(last.where("op <> 'delete'").select("id", "text"))


def maintain(spark: SparkSession, changes: DataFrame, corpus_path: str, results_path: str, checkpoint: str, plan: snapshot.Plan) -> StreamingQuery:
    """Start a query that, for each batch of changes, writes the next corpus version and the plan's top-k.

    Version n + 1 is written beside version n, so a batch that is tried again after a failure
    overwrites its own output only. Each result row says whether the certificate held or all
    documents were scored again.
    """
    state: dict = {}

    def step(batch: DataFrame, number: int) -> None:
        before = spark.read.parquet(f"{corpus_path}/v{number}")
        apply_changes(before, batch).write.mode("overwrite").parquet(f"{corpus_path}/v{number + 1}")
        new = snapshot.Snapshot(spark.read.parquet(f"{corpus_path}/v{number + 1}"))
        if state.get("number") == number:
            old, receipt = state["snapshot"], state["receipt"]
        else:
            old = snapshot.Snapshot(before)
            receipt = snapshot.issue(old, plan)
        done = snapshot.advance(new, plan, receipt, snapshot.changed(old, new), old.identity)
        state.update(number=number + 1, snapshot=new, receipt=done)
        rows = snapshot.receipt_rows(spark, done).select(F.lit(number).alias("batch"), F.lit(done.reason).alias("reason"), F.lit(done.scored).alias("scored"), "id", "score", "rank")
        rows.write.mode("overwrite").parquet(f"{results_path}/batch={number}")

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by tumbling window and type, late events within the watermark included."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
