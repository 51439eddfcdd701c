"""Connected components over shared keys."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in spark.checkpoint.dir; a session on one machine may go without and gets a folder of its own."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='evispan-')}")
    return df.checkpoint(eager=True)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable over edges (a, b).

    Every round each node takes the smallest label among its neighbours' and then its label's own
    label, so chains shorten by half and more. Labels move as grouped minima, summed before they
    are shuffled.
    """
    both = settled(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = settled(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).withColumnRenamed("a", "node"))
    for _ in range(most_rounds):
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("heard"))
        closer = labels.join(heard, "node").select("node", "root", F.least("root", "heard").alias("next"))
        jumps = labels.select(F.col("node").alias("next"), F.col("root").alias("far"))
        new = settled(closer.join(jumps, "next", "left").select("node", "root", F.least("next", F.coalesce("far", "next")).alias("new")))
        done = not new.where("new <> root").limit(1).count()
        labels = new.select("node", F.col("new").alias("root"))
        if done:
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def shared_key_components(keyed: DataFrame, node: str = "doc_id", key: str = "k") -> DataFrame:
    """(node, component): nodes that share a key, directly or through others. A key joins its nodes to its smallest one, never all to all."""
    first = keyed.groupBy(key).agg(F.min(node).alias("a"))
    edges = keyed.select(F.col(node).alias("b"), key).join(first, key).where("a <> b").select("a", "b").distinct()
    found = components(edges)
    every = keyed.select(node).distinct()
    return every.join(found.withColumnRenamed("node", node), node, "left").select(node, F.coalesce("root", node).alias("component"))


def eligible(found: DataFrame, banned: DataFrame, node: str = "doc_id", salt: str = "rep:") -> DataFrame:
    """(component, members, representative) of the components without a banned member; the representative has the lowest hash."""
    bad = found.join(banned, node, "left_semi").select("component").distinct()
    kept = found.join(bad, "component", "left_anti")
    key = F.sha2(F.concat(F.lit(salt), F.col(node).cast("string")), 256)
    return kept.groupBy("component").agg(F.count("*").alias("members"), F.min_by(node, key).alias("representative"))
