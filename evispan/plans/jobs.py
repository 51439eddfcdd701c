"""Evidence-selection jobs derived from the test tables, and the SQL that checks them.

Every benchmark item is a question and every document a candidate of the question that its
doc_id falls to, in doc_id order; a title is the text's first two words, a token cost is a quarter
of its characters, and a candidate supports its question where labels.quality is 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("job_id"), F.col("text").alias("question"), (F.col("item_id") % 2).cast("string").alias("stratum"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, pos, doc_id, title, text, sha256, tokens)."""
    n = table(spark, sf_dir, "benchmark").agg(F.count("*").alias("n"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(n))  # one row: the number of questions
    docs = docs.withColumn("job_id", F.col("doc_id") % F.col("n"))
    words = F.slice(F.filter(F.split("text", r"[ \t\n\r\x0b\x0c]+"), lambda w: w != ""), 1, 2)
    return docs.select(
        "job_id",
        (F.row_number().over(Window.partitionBy("job_id").orderBy("doc_id")) - 1).alias("pos"),
        "doc_id",
        F.array_join(words, " ").alias("title"),
        "text",
        F.sha2("text", 256).alias("sha256"),
        F.greatest(F.lit(1), F.ceil(F.length("text") / 4)).cast("long").alias("tokens"),
    )


def support(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    return candidates(spark, sf_dir).join(good, "doc_id", "left_semi").select("job_id", "pos")


#: Common table expressions for DuckDB: jobs, docs, support.
SQL = r"""
nq AS (SELECT count(*) AS n FROM benchmark),
jobs AS (SELECT item_id AS job_id, text AS question, CAST(item_id % 2 AS VARCHAR) AS stratum FROM benchmark),
docs AS (SELECT doc_id % n AS job_id, CAST(row_number() OVER (PARTITION BY doc_id % n ORDER BY doc_id) - 1 AS INTEGER) AS pos, doc_id,
                array_to_string(list_slice(list_filter(regexp_split_to_array(text, '[ \t\n\r\x0b\x0c]+'), lambda w: w <> ''), 1, 2), ' ') AS title,
                text, sha256(text) AS sha256, CAST(greatest(1, ceil(length(text) / 4)) AS BIGINT) AS tokens
         FROM documents, nq),
support AS (SELECT job_id, pos FROM docs WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))
"""
