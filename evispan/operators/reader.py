"""Reading policies over a batch of jobs: one-shot answers, and retrieval in steps.

The model is a function from requests (request_id, payload, job_id) to answers with the column
`raw`; a stored-response table is the usual one. Every step is one plan over all open jobs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispan.functions.text import answer_is, first_sentence, next_query, record_frame, terminal_answer
from evispan.operators import lexical
from evispan.operators.components import settled

Model = Callable[[DataFrame], DataFrame]
STEPS, TOP = 10, 6
#: Output limits of the static reader, of a step and of the one-shot reader.
LIMITS = {"static": 96, "step": 128, "one_shot": 1280}


def sources(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(job_id, sources): framed records of chosen (job_id, pos), in position order."""
    framed = docs.join(chosen, ["job_id", "pos"], "left_semi").select("job_id", "pos", record_frame(F.col("doc_id").cast("string"), F.col("title"), F.col("text"), F.col("sha256")).alias("f"))
    return framed.groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "f"))), lambda x: x["f"]), "").alias("sources"))


def payload(question: Column, found: Column, sentences: Column, limit: int, demos: str = "") -> Column:
    return F.to_json(F.struct(F.lit(limit).alias("max_output"), F.concat(F.lit(demos + "Question: "), question, F.lit("\nSources:\n"), found, F.lit("\nA: "), F.array_join(sentences, " ")).alias("user")))


def ask(rows: DataFrame, model: Model) -> DataFrame:
    """rows (job_id, payload, …) with request_id and the model's raw."""
    sent = rows.withColumn("request_id", F.sha2("payload", 256))
    return sent.join(model(sent.select("job_id", "request_id", "payload")).select("job_id", "request_id", "raw"), ["job_id", "request_id"])


def one_shot(jobs: DataFrame, docs: DataFrame, chosen: DataFrame, model: Model, demos: str = "") -> DataFrame:
    """(job_id, answer, ok, request_ids) from one call a job."""
    rows = jobs.join(sources(docs, chosen), "job_id", "left").withColumn("sources", F.coalesce("sources", F.lit("")))
    asked = ask(rows.withColumn("payload", payload(F.col("question"), F.col("sources"), F.array().cast("array<string>"), LIMITS["static"], demos)), model)
    return asked.withColumn("t", terminal_answer(F.col("raw"))).select("job_id", "t.answer", "t.ok", F.array("request_id").alias("request_ids"))


def stepwise(jobs: DataFrame, docs: DataFrame, model: Model, steps: int = STEPS, top: int = TOP, demos: str = "") -> DataFrame:
    """(job_id, answer, steps, request_ids): retrieve for the last sentence, read the growing pool, keep the first sentence; ends at "answer is" or after `steps`."""
    none = F.array().cast("array<string>")
    state = settled(jobs.select("job_id", "question", none.alias("sentences"), none.alias("request_ids"), F.lit(None).cast("string").alias("answer")))
    pool = None
    for _ in range(steps):
        live = state.where("answer is null")
        if not live.limit(1).count():
            break
        asked_for = live.select("job_id", next_query(F.col("question"), F.col("sentences")).alias("question"))
        hits = lexical.top_k(lexical.bm25(docs.join(live.select("job_id"), "job_id", "left_semi"), lexical.query_terms(asked_for)), top).select("job_id", "pos")
        pool = settled((hits if pool is None else pool.unionByName(hits)).distinct())
        rows = live.join(sources(docs, pool), "job_id", "left").withColumn("payload", payload(F.col("question"), F.coalesce("sources", F.lit("")), F.col("sentences"), LIMITS["step"], demos))
        got = ask(rows, model).select("job_id", "request_id", first_sentence(F.trim("raw")).alias("s"))
        joined = state.join(got, "job_id", "left")
        fresh = F.col("s").isNotNull()
        state = settled(
            joined.select(
                "job_id",
                "question",
                F.when(fresh, F.concat("sentences", F.array("s"))).otherwise(F.col("sentences")).alias("sentences"),
                F.when(fresh, F.concat("request_ids", F.array("request_id"))).otherwise(F.col("request_ids")).alias("request_ids"),
                F.when(fresh, answer_is(F.concat(F.lit(" "), "s"))).otherwise(F.col("answer")).alias("answer"),
            )
        )
    return state.select("job_id", F.coalesce("answer", F.lit("UNKNOWN")).alias("answer"), F.size("sentences").alias("steps"), "request_ids")
