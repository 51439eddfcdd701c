"""The corpus pipeline: five stages over documents, each written and read again before the next.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept. All but the
last return the columns of documents, extra ones included whatever their names; the last returns
the mix. Null and empty texts are scored as such by the classifier and are near duplicates of each
other; rows without a doc_id are judged like any, but stay only where no copy has an id; repeated
rows are copies, of which one stays; empty tables pass through as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evispan.llm import classifier, decontaminate, mixing, secrets, simhash
from evispan.llm.common import delete_path, fresh_path, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the byte network predicts as bad."""
    return classifier.keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies: five-word shingles, similarity of about 0.8 and more."""
    return simhash.keep_one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that share a window with a benchmark item."""
    return decontaminate.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret in the text by its kind; all documents stay."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every document that is left."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scan", secret_scan),
    ("source mixture", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of documents after all stages; a stage's table is deleted once the next one is written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete_path(spark, before)
        before = path
    return docs


#: A trained network and 64-bit fingerprints aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
