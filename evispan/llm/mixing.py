"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

A source's words, in seeded order, are cut into shards of bounded size and each shard into blocks
of `block_words` words. The whole budget's blocks go to sources by the highest quotients
target / (2k - 1); each source's quota goes to its shards in the same way by their sizes. A shard
with n blocks and quota q then takes block j floor(((j+1)q + r)/n) - floor((jq + r)/n) times,
where r is a seeded phase: exactly q in all, spread evenly, never above ceil(q / n). That has a
closed form over a document's words, so no block is ever a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispan.llm.common import WORD, read_table, seeded, settle

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2
BLOCK = 32
SHARD = 1 << 21
SEED = "mix-1"


def _quotas(parties: DataFrame, group: list[str], votes: str, seats: str, most: str, order: str) -> DataFrame:
    """parties with `quota`: their group's seats by highest quotients votes / (2k - 1), none above `most`.

    A divisor that gives too few seats and one that gives too many bound each party's result, so
    only about three quotients a party are ranked instead of one per seat.
    """
    g = Window.partitionBy(*(group or [F.lit(0)]))
    sized = parties.withColumn("_v", F.sum(votes).over(g)).withColumn("_n", F.count("*").over(g))

    def rounded(by: Column) -> Column:
        return F.when(F.col("_v") > 0, F.floor(F.col(votes) * by / F.col("_v") + 0.5)).otherwise(0).cast("long")

    bound = sized.withColumn("_high", F.least(rounded(F.col(seats) + F.col("_n")), F.col(most))).withColumn(
        "_low", F.least(F.col("_high"), rounded(F.greatest(F.col(seats) - F.col("_n"), F.lit(0))))
    )
    bound = bound.withColumn("_open", F.greatest(F.col(seats) - F.sum("_low").over(g), F.lit(0)))
    more = bound.where("_high > _low").withColumn("_k", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))))
    ranked = more.withColumn("_rank", F.row_number().over(g.orderBy((F.col(votes) / (2 * F.col("_k") - 1)).desc(), F.col(order), F.col("_k"))))
    won = ranked.where("_rank <= _open").groupBy(*group, order).agg(F.count("*").alias("_won"))
    keys = [*group, order]
    return (
        bound.join(won, keys, "left")
        .withColumn("quota", F.col("_low") + F.coalesce("_won", F.lit(0)))
        .drop("_v", "_n", "_high", "_low", "_open", "_won")
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, idx, target) from (source, source_size): weights by code point order, null last; excess over limit x size reshared."""
    one = Window.partitionBy(F.lit(0))
    by_name = one.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("idx", F.row_number().over(by_name) - 1).withColumn("w", F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("idx") % len(weights) + 1).cast("int")).cast("double"))
    w = w.withColumn("cap", (limit * F.col("source_size")).cast("double")).withColumn("total", (share * F.sum("source_size").over(one)).cast("double"))
    before = one.orderBy(F.col("cap") / F.col("w"), "idx").rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("_c", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("_w", F.sum("w").over(one) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    w = w.withColumn("full", F.col("cap") * F.col("_w") <= F.col("w") * (F.col("total") - F.col("_c")))
    w = w.withColumn("_cc", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(one)).withColumn("_ww", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(one))
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * (F.col("total") - F.col("_cc")) / F.when(F.col("full"), 1.0).otherwise(F.col("_ww")))
    return w.select("source", "source_size", "idx", "total", target.alias("target"))


def mix(docs: DataFrame, *, block: int = BLOCK, shard: int = SHARD, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken), a row per row of docs.

    Null and empty texts have size 0 and take nothing; rows without a source form the last source;
    repeated rows each count; rows that differ in nothing are interchangeable.
    """
    sized = settle(
        docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"), seeded(seed, F.col("doc_id")).alias("h"))
    )
    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources = settle(sources.withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard)).cast("long")))
    placed = sized.join(sources.select(F.col("source").alias("s"), "idx", "n_shards"), F.col("source").eqNullSafe(F.col("s"))).withColumn("shard", F.col("h") % F.col("n_shards"))
    shards = placed.groupBy("idx", "shard").agg(F.sum("size").alias("shard_size")).withColumn("blocks", F.ceil(F.col("shard_size") / block).cast("long"))
    shards = settle(shards)
    held = shards.groupBy("idx").agg((2 * F.sum("blocks")).alias("most"))
    quotas = _quotas(sources.join(held, "idx").withColumn("seats", F.floor(F.col("total") / block + 0.5).cast("long")), [], "target", "seats", "most", "idx")
    quotas = quotas.select("source", "idx", "source_size", "target", "n_shards", F.col("quota").alias("seats"))
    dealt = _quotas(shards.join(quotas.select("idx", "seats"), "idx").withColumn("most", 2 * F.col("blocks")), ["idx"], "shard_size", "seats", "most", "shard")
    dealt = settle(dealt.withColumn("phase", F.when(F.col("blocks") > 0, seeded(seed, F.col("idx"), F.col("shard")) % F.greatest(F.col("blocks"), F.lit(1))).otherwise(0)).select("idx", "shard", "blocks", "quota", "phase"))
    line = Window.partitionBy("idx", "shard").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = placed.withColumn("stop", F.sum("size").over(line))
    laid = laid.join(dealt, ["idx", "shard"]).join(quotas.select("idx", "source_size", "target"), "idx")

    def times(j: Column) -> Column:
        return F.when(F.col("blocks") > 0, F.floor((j * F.col("quota") + F.col("phase")) / F.greatest(F.col("blocks"), F.lit(1)))).otherwise(0).cast("long")

    def up_to(x: Column) -> Column:
        j = F.floor(x / block).cast("long")
        return block * times(j) + (x % block) * (times(j + 1) - times(j))

    stop = F.col("stop")
    return laid.select("doc_id", "source", "size", "source_size", "target", (up_to(stop) - up_to(stop - F.col("size"))).cast("long").alias("taken"))


def op3_sainte_lague(spark, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) AS h FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS idx FROM s0),
s2 AS (SELECT *, CAST([3, 1, 2][CAST(idx % 3 + 1 AS INTEGER)] AS DOUBLE) AS w, CAST(2 * source_size AS DOUBLE) AS cap, CAST(1.5 * sum(source_size) OVER () AS DOUBLE) AS total FROM s1),
s3 AS (SELECT *, coalesce(sum(cap) OVER b, 0.0) AS c, sum(w) OVER () - coalesce(sum(w) OVER b, 0.0) AS ww FROM s2
       WINDOW b AS (ORDER BY cap / w, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, cap * ww <= w * (total - c) AS is_full FROM s3),
s5 AS (SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0.0 END) OVER () AS cc, sum(CASE WHEN is_full THEN 0.0 ELSE w END) OVER () AS wo FROM s4),
src AS (SELECT source, source_size, idx, total, CASE WHEN is_full THEN cap ELSE w * (total - cc) / wo END AS target,
               greatest(1, CAST(ceil(source_size / {SHARD}.0) AS BIGINT)) AS n_shards FROM s5),
pl AS (SELECT d.*, idx, n_shards, h % n_shards AS shard FROM d JOIN src ON d.source IS NOT DISTINCT FROM src.source),
sh AS (SELECT idx, shard, CAST(sum(size) AS BIGINT) AS z, CAST(ceil(sum(size) / {BLOCK}.0) AS BIGINT) AS blocks FROM pl GROUP BY idx, shard),
q0 AS (SELECT src.*, 2 * m.b AS most, CAST(floor(total / {BLOCK} + 0.5) AS BIGINT) AS seats, sum(target) OVER () AS v, count(*) OVER () AS n
       FROM src JOIN (SELECT idx, CAST(sum(blocks) AS BIGINT) AS b FROM sh GROUP BY idx) m USING (idx)),
q1 AS (SELECT *, least(CASE WHEN v > 0 THEN CAST(floor(target * (seats + n) / v + 0.5) AS BIGINT) ELSE 0 END, most) AS hi FROM q0),
q2 AS (SELECT *, least(hi, CASE WHEN v > 0 THEN CAST(floor(target * greatest(seats - n, 0) / v + 0.5) AS BIGINT) ELSE 0 END) AS lo FROM q1),
q3 AS (SELECT *, greatest(seats - sum(lo) OVER (), 0) AS spare FROM q2),
q4 AS (SELECT idx, spare, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, idx, k) AS rk FROM (SELECT *, unnest(range(lo + 1, hi + 1)) AS k FROM q3)),
q5 AS (SELECT q3.idx, source_size, target, lo + coalesce(c, 0) AS quota FROM q3 LEFT JOIN (SELECT idx, count(*) AS c FROM q4 WHERE rk <= spare GROUP BY idx) x USING (idx)),
r0 AS (SELECT sh.*, q5.quota AS seats, 2 * blocks AS most, sum(z) OVER (PARTITION BY idx) AS v, count(*) OVER (PARTITION BY idx) AS n FROM sh JOIN q5 USING (idx)),
r1 AS (SELECT *, least(CASE WHEN v > 0 THEN CAST(floor(z * (seats + n) / v + 0.5) AS BIGINT) ELSE 0 END, most) AS hi FROM r0),
r2 AS (SELECT *, least(hi, CASE WHEN v > 0 THEN CAST(floor(z * greatest(seats - n, 0) / v + 0.5) AS BIGINT) ELSE 0 END) AS lo FROM r1),
r3 AS (SELECT *, greatest(seats - sum(lo) OVER (PARTITION BY idx), 0) AS spare FROM r2),
r4 AS (SELECT idx, shard, spare, row_number() OVER (PARTITION BY idx ORDER BY z / (2 * k - 1) DESC, shard, k) AS rk FROM (SELECT *, unnest(range(lo + 1, hi + 1)) AS k FROM r3)),
r5 AS (SELECT r3.idx, r3.shard, blocks, lo + coalesce(c, 0) AS quota,
              CASE WHEN blocks > 0 THEN CAST(('0x' || substr(md5('{SEED}:' || r3.idx || ':' || r3.shard), 1, 15)) AS BIGINT) % greatest(blocks, 1) ELSE 0 END AS phase
       FROM r3 LEFT JOIN (SELECT idx, shard, count(*) AS c FROM r4 WHERE rk <= spare GROUP BY idx, shard) x ON x.idx = r3.idx AND x.shard = r3.shard),
l0 AS (SELECT *, CAST(sum(size) OVER (PARTITION BY idx, shard ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM pl),
l1 AS (SELECT l0.*, e - size AS b, blocks, quota, phase FROM l0 JOIN r5 USING (idx, shard)),
l2 AS (SELECT *, CASE WHEN blocks > 0 THEN {BLOCK} * (((e // {BLOCK}) * quota + phase) // blocks) + (e % {BLOCK}) * ((((e // {BLOCK}) + 1) * quota + phase) // blocks - ((e // {BLOCK}) * quota + phase) // blocks) ELSE 0 END AS fe,
              CASE WHEN blocks > 0 THEN {BLOCK} * (((b // {BLOCK}) * quota + phase) // blocks) + (b % {BLOCK}) * ((((b // {BLOCK}) + 1) * quota + phase) // blocks - ((b // {BLOCK}) * quota + phase) // blocks) ELSE 0 END AS fb FROM l1)
SELECT doc_id, size, q5.source_size, q5.target, CAST(fe - fb AS BIGINT) AS taken FROM l2 JOIN q5 USING (idx)
"""
