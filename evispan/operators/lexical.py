"""Lexical scoring of candidates within their jobs: term tables joined and summed, no per-job Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispan.functions.text import STOP_WORDS, word_tokens

JOB = ["job_id"]
UNIT = ["job_id", "pos"]


def stop_words(spark) -> DataFrame:
    return spark.createDataFrame([(w,) for w in STOP_WORDS], "term string")


def body(docs: DataFrame) -> DataFrame:
    """docs with the text that is scored: title, line end, body."""
    return docs.select(*UNIT, F.concat_ws("\n", "title", "text").alias("body"))


def doc_terms(docs: DataFrame) -> DataFrame:
    """(job_id, pos, term, tf)."""
    return body(docs).select(*UNIT, F.explode(word_tokens(F.col("body"))).alias("term")).groupBy(*UNIT, "term").agg(F.count("*").alias("tf"))


def query_terms(jobs: DataFrame) -> DataFrame:
    """(job_id, term): a question's different words without stop words."""
    words = jobs.select("job_id", F.explode(F.array_distinct(word_tokens(F.col("question")))).alias("term"))
    return words.join(F.broadcast(stop_words(jobs.sparkSession)), "term", "left_anti").select("job_id", "term")


def _lengths(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(job_id, pos, len, avg_len, n): token counts by summing the term table, so texts aren't tokenised again."""
    w = Window.partitionBy("job_id")
    counted = terms.groupBy(*UNIT).agg(F.sum("tf").alias("len"))
    sized = docs.select(*UNIT).join(counted, UNIT, "left").select(*UNIT, F.coalesce("len", F.lit(0)).alias("len"))
    return sized.withColumn("avg_len", F.avg("len").over(w)).withColumn("n", F.count("*").over(w))


def asked_tokens(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(job_id, pos, asked, tokens): a candidate's tokens beside its job's wanted terms, null where the job wants none."""
    asked = wanted.groupBy("job_id").agg(F.collect_set("term").alias("asked"))
    return body(docs).select(*UNIT, word_tokens(F.col("body")).alias("tokens")).join(asked, "job_id", "left")


def bm25(docs: DataFrame, wanted: DataFrame, keys: list[str] = JOB, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """(keys, pos, score) for every candidate; wanted has (keys, term), keys starting with job_id. No match scores 0.

    A question's few terms are counted in the candidate's own row and only hits become rows; longer
    lists of terms (keys beyond the job) meet the whole term table.
    """
    if keys == JOB:
        rows = asked_tokens(docs, wanted)
        met = rows.select(*UNIT, F.explode(F.filter("tokens", lambda t: F.array_contains("asked", t))).alias("term"))
        hits = met.groupBy(*UNIT, "term").agg(F.count("*").alias("tf")).withColumn("df", F.count("*").over(Window.partitionBy("job_id", "term")))
        w = Window.partitionBy("job_id")
        size = rows.select(*UNIT, F.size("tokens").alias("len")).withColumn("avg_len", F.avg("len").over(w)).withColumn("n", F.count("*").over(w))
    else:
        terms = doc_terms(docs)
        df = terms.groupBy("job_id", "term").agg(F.count("*").alias("df"))
        size = _lengths(docs, terms)
        hits = wanted.join(terms, ["job_id", "term"]).join(df, ["job_id", "term"])
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    summed = hits.join(size, UNIT).groupBy(*keys, "pos").agg(F.sum(part).alias("score"))
    every = docs.select(*UNIT) if keys == JOB else wanted.select(*keys).distinct().join(docs.select(*UNIT), "job_id")
    return every.join(summed, [*keys, "pos"], "left").select(*keys, "pos", F.coalesce("score", F.lit(0.0)).alias("score"))


def scaled(scores: DataFrame, keys: list[str] = JOB, value: str = "score") -> DataFrame:
    """Min-max to 0..1 within the keys; a constant vector becomes zeros."""
    w = Window.partitionBy(*keys)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return scores.withColumn("_low", low).withColumn("_high", high).withColumn(value, F.when(F.col("_high") > F.col("_low"), (F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(0.0)).drop("_low", "_high")


def tfidf(docs: DataFrame) -> DataFrame:
    """(job_id, pos, term, w): raw tf times smooth idf, unit rows, stop words removed; a candidate of stop words only has no row.

    Document frequencies and norms are windows: rows that lie by job stay where they are.
    """
    terms = doc_terms(docs).join(F.broadcast(stop_words(docs.sparkSession)), "term", "left_anti")
    terms = terms.withColumn("df", F.count("*").over(Window.partitionBy("job_id", "term")))
    n = docs.groupBy("job_id").agg(F.count("*").alias("n"))
    w = terms.join(n, "job_id").withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*UNIT)))
    return w.withColumn("w", F.col("w") / norm).select(*UNIT, "term", "w")


def coverage(docs: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_id, pos, term): the question's terms that each candidate has."""
    return asked_tokens(docs, query_terms(jobs)).select(*UNIT, F.explode(F.array_intersect("asked", "tokens")).alias("term"))


def expansion_terms(docs: DataFrame, k: int = 8) -> DataFrame:
    """(job_id, pos, term, rank): each candidate's heaviest TF-IDF terms, by weight and then term."""
    order = Window.partitionBy(*UNIT).orderBy(F.round("w", 9).desc(), "term")
    return tfidf(docs).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*UNIT, "term", "rank")


def query_overlap(jobs: DataFrame, docs: DataFrame) -> DataFrame:
    """(job_id, pos, score): shared idf mass over the question's, divided by the square root of the relative length."""
    terms = doc_terms(docs).join(F.broadcast(stop_words(docs.sparkSession)), "term", "left_anti").where(F.length("term") > 2).select(*UNIT, "term")
    q = query_terms(jobs).where(F.length("term") > 2)
    df = terms.groupBy("job_id", "term").agg(F.count("*").alias("df"))
    n = docs.groupBy("job_id").agg(F.count("*").alias("n"))
    weighed = q.join(n, "job_id").join(df, ["job_id", "term"], "left").withColumn("idf", F.log((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1)
    mass = weighed.groupBy("job_id").agg(F.sum("idf").alias("mass"), F.count("*").alias("nq"))
    shared = terms.join(weighed.select("job_id", "term", "idf"), ["job_id", "term"]).groupBy(*UNIT).agg(F.sum("idf").alias("got"))
    size = terms.groupBy(*UNIT).agg(F.count("*").alias("nt"))
    out = docs.select(*UNIT).join(shared, UNIT, "left").join(size, UNIT, "left").join(mass, "job_id", "left")
    longer = F.sqrt(F.greatest(F.lit(1.0), F.coalesce("nt", F.lit(0)) / F.greatest(F.coalesce("nq", F.lit(0)), F.lit(1))))
    return out.select(*UNIT, F.coalesce(F.col("got") / F.col("mass") / longer, F.lit(0.0)).alias("score"))


def hybrid(left: DataFrame, right: DataFrame, weight: float = 0.5) -> DataFrame:
    """weight x min-max of left plus the rest of right's, per candidate."""
    a, b = scaled(left).withColumnRenamed("score", "_a"), scaled(right).withColumnRenamed("score", "_b")
    return a.join(b, UNIT).select(*UNIT, (weight * F.col("_a") + (1 - weight) * F.col("_b")).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def top_k(scores: DataFrame, k: int, keys: list[str] = JOB, places: int = 9) -> DataFrame:
    """The k best of each key by (score, then position), ties always broken."""
    order = Window.partitionBy(*keys).orderBy(F.round("score", places).desc(), "pos")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
