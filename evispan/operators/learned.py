"""Latent text vectors and balanced logistic models over pairs and tiles, by Spark's own learners.

Feature hashing and the optimiser differ from other libraries' in their details; results agree in
meaning, not bit by bit.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evispan.functions.text import content_tokens

HASHES, RANK, MOST_ROWS = 4096, 48, 80_000


def grams(text: DataFrame) -> DataFrame:
    """text with `grams`: terms and neighbouring pairs of terms."""
    t = text.withColumn("_t", content_tokens(F.col("text")))
    pairs = F.transform(F.slice("_t", 1, F.greatest(F.size("_t") - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get("_t", i + 1)))
    return t.withColumn("grams", F.concat("_t", pairs)).drop("_t")


class LatentModel:
    """Hashed sublinear TF-IDF rows, turned by the leading right singular vectors of a bounded sample."""

    def __init__(self, weights: PipelineModel, basis: list[list[float]]):
        self.weights, self.basis = weights, basis

    @staticmethod
    def _sublinear(df: DataFrame) -> DataFrame:
        return df.withColumn("tf", array_to_vector(F.transform(vector_to_array("tf"), lambda x: F.when(x > 0, 1 + F.log(x)).otherwise(0.0))))

    @classmethod
    def fit(cls, atoms: DataFrame, rank: int = RANK, most_rows: int = MOST_ROWS) -> LatentModel:
        sample = grams(atoms.orderBy(F.xxhash64("text"), "text").limit(most_rows))
        counted = HashingTF(inputCol="grams", outputCol="tf", numFeatures=HASHES).transform(sample)
        weights = Pipeline(stages=[IDF(inputCol="tf", outputCol="w"), Normalizer(inputCol="w", outputCol="v")]).fit(cls._sublinear(counted))
        rows = weights.transform(cls._sublinear(counted)).select(vector_to_array("v").alias("v"))
        svd = RowMatrix(rows.rdd.map(lambda r: r["v"])).computeSVD(min(rank, HASHES))
        return cls(weights, svd.V.toArray().T.tolist())

    def encode(self, atoms: DataFrame) -> DataFrame:
        """atoms with `vector`, unit rows; an atom without terms has zeros."""
        counted = HashingTF(inputCol="grams", outputCol="tf", numFeatures=HASHES).transform(grams(atoms))
        rows = self.weights.transform(self._sublinear(counted)).withColumn("_v", vector_to_array("v"))
        basis = atoms.sparkSession.sparkContext.broadcast(self.basis)

        @F.pandas_udf("array<double>")
        def turned(vs):
            import numpy as np
            import pandas as pd

            out = np.stack(vs.to_numpy()) @ np.array(basis.value).T
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            return pd.Series(list(out / np.where(norm > 0, norm, 1)))

        return rows.withColumn("vector", turned("_v")).select(*atoms.columns, "vector")


def balanced_logistic(rows: DataFrame, features: list[str], label: str = "label") -> LogisticRegressionModel:
    """A logistic model in which both classes weigh the same."""
    share = rows.agg(F.avg(F.col(label).cast("double"))).first()[0]
    if share is None or not 0 < share < 1:
        raise ValueError("both classes are needed")
    weighed = rows.withColumn("_w", F.when(F.col(label) == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
    return LogisticRegression(featuresCol="_f", labelCol=label, weightCol="_w", maxIter=100).fit(VectorAssembler(inputCols=features, outputCol="_f").transform(weighed))


def probabilities(model: LogisticRegressionModel, rows: DataFrame, features: list[str]) -> DataFrame:
    """rows with `p`, the probability of label 1."""
    scored = model.transform(VectorAssembler(inputCols=features, outputCol="_f").transform(rows))
    return scored.select(*rows.columns, vector_to_array("probability")[1].alias("p"))


def pair_features(edges: DataFrame, atoms: DataFrame) -> DataFrame:
    """edges (doc_id, i, j, lexical, dense, bridge) with distance, jaccard and length ratio of their atoms; a bounded document's terms a side."""
    t = atoms.select("doc_id", "atom", F.array_distinct(content_tokens(F.col("text"))).alias("t"), F.count("*").over(Window.partitionBy("doc_id")).alias("n"))
    a, b = t.toDF("doc_id", "i", "ta", "n"), t.select("doc_id", F.col("atom").alias("j"), F.col("t").alias("tb"))
    met = edges.join(a, ["doc_id", "i"]).join(b, ["doc_id", "j"])
    union = F.size(F.array_union("ta", "tb"))
    return met.withColumn("distance", (F.col("j") - F.col("i")) / F.greatest(F.lit(1), F.col("n") - 1)).withColumn("jaccard", F.when(union > 0, F.size(F.array_intersect("ta", "tb")) / union).otherwise(0.0)).withColumn(
        "length_ratio", F.least(F.size("ta"), F.size("tb")) / F.greatest(F.lit(1), F.greatest(F.size("ta"), F.size("tb")))
    ).drop("ta", "tb", "n")
