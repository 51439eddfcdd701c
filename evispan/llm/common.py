"""Pieces that several corpus operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: What separates words in most contracts: space and the controls 9 to 13.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Only a session on one machine may go without, as in tests."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='evispan-')}")
    return sc.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Whether Spark, from 4.1 on, deletes a plan's shuffle files as soon as it has run; a plan takes it when it is made.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, freed: bool = False) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives lost executors; `freed`: what it shuffled goes at once, not when the driver collects its garbage."""
    shared_dir(df.sparkSession)
    if not freed:
        return df.checkpoint(eager=True)
    conf = df.sparkSession.conf
    was = conf.get(FREED, "false")
    conf.set(FREED, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        conf.set(FREED, was)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: Column, spaces: str = SPACES) -> Column:
    """Words of a text without the empty pieces that split() leaves at its ends; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), spaces, -1), lambda w: w != "")


def seeded(seed: str, *cols: Column) -> Column:
    """A hash in 0 .. 2^60 that other SQL engines compute alike: the first 15 hex digits of an MD5."""
    joined = F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


_BASE = 0x9E3779B97F4A7C15 | 5
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A value for each byte, A-Z having those of a-z.
_VALUE = np.random.default_rng(42).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]
_powers: list[np.ndarray] = []
BLOCK_BYTES = 1 << 19


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of values times powers of an odd base, up to each place."""
    if not _powers or len(_powers[0]) < len(values):
        n = max(1 << 16, 2 * len(values))
        _powers[:] = [np.cumprod(np.append(np.uint64(1), np.full(n - 1, b, np.uint64)), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers[0][: len(values)], dtype=np.uint64)])


def stretch_hashes(total: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hashes of the stretches from each start to its stop, as differences of prefix sums brought to one power."""
    h = (total[stops] - total[starts]) * _powers[1][starts]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """64-bit hashes of the words of each text of a string column, A-Z lower-cased; null has none.

    The column's bytes are hashed in blocks of whole texts; a text longer than a block in pieces
    cut at white space, so memory doesn't grow with a text's length but for its words.
    """
    large = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1)
        low, high = int(offsets[at]), int(offsets[end])
        if end == at + 1 and high - low > BLOCK_BYTES:
            yield _long_text(data[low:high])
        else:
            starts, found = _hashed(data[low:high], offsets[at:end] - low)
            cuts = np.searchsorted(starts, offsets[at + 1 : end] - low)
            yield from np.split(found, cuts)
        at = end


def _hashed(data: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words of some bytes; a word ends before the places in `fresh` as well."""
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    fresh = fresh[fresh < len(data)]
    begins[fresh] = inside[fresh]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = fresh[fresh > 0] - 1
    ends[last] = inside[last]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stretch_hashes(prefix_sums(_VALUE[data]), starts, stops)


def _long_text(data: np.ndarray) -> np.ndarray:
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(data):
        end = min(len(data), at + BLOCK_BYTES)
        while end < len(data) and not (space := np.flatnonzero(_SPACE[data[at:end]])).size:
            end = min(len(data), end + BLOCK_BYTES)  # a word longer than a block
        if end < len(data):
            end = at + int(space[-1]) + 1
        out.append(_hashed(data[at:end], np.zeros(0, np.int64))[1])
        at = end
    return np.concatenate(out)


#: Numbers that a task gathers before it deals them out, and buckets for each shuffle partition.
GATHERED, FINE = 1 << 21, 4
PACKED = "bucket int, data binary"


def dealt(blocks: Iterator[tuple[np.ndarray, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of PACKED from (hash, rows) blocks of unsigned numbers and of equally many rows of 64-bit numbers.

    A row of PACKED has all rows of one bucket that were gathered together, so what moves between
    the JVM and Python is a few long values and not a row for each.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> pa.RecordBatch:
        where = np.concatenate([h for h, _ in held]) % np.uint64(buckets)
        order = np.argsort(where.astype(np.int32), kind="stable")
        where, rows = where[order], np.concatenate([r for _, r in held])[order]
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(where) else np.zeros(0, np.int64)
        data = [rows[a:b].tobytes() for a, b in zip(first.tolist(), [*first[1:].tolist(), len(where)], strict=True)] if len(where) else []
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(where[first].astype(np.int32)), pa.array(data, pa.binary())], names=["bucket", "data"])

    size = 0
    for block in blocks:
        held.append(block)
        size += block[1].size
        if size >= GATHERED:
            yield out()
            size = 0
    if held:
        yield out()


def gathered(packed: DataFrame) -> DataFrame:
    """PACKED rows dealt by their bucket, a bucket's rows side by side."""
    return packed.repartition(partitions(packed.sparkSession), "bucket").sortWithinPartitions("bucket")


def unpacked(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    """The rows of `width` numbers of each bucket, from gathered() rows; memory holds one bucket."""
    now, held = None, []
    for batch in batches:
        for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if bucket != now and held:
                yield np.concatenate(held)
                held = []
            now = bucket
            held.append(np.frombuffer(data.as_buffer(), np.int64).reshape(-1, width))
    if held:
        yield np.concatenate(held)


def lowest(rows: DataFrame, count: int, most: int, by: str = "_h") -> list[Row]:
    """The `most` rows lowest in a seeded() column, of `count` in all; the driver gets about that many, not as many from each task."""
    if count <= most:
        found = rows.collect()
    else:
        bound, found = (most + 4 * int(most**0.5) + 4) / count, []
        while len(found) < most:
            found = rows.where(F.col(by) < int(min(1.0, bound) * (1 << 60))).collect()
            if bound >= 1:
                break
            bound *= 2
    return sorted(found, key=lambda r: (r[by], *map(str, r)))[:most]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node of an undirected edge list (a, b), as (node, root), roots themselves included.

    Large-star and small-star passes alternate until the edges stay as they are. Each pass is a
    grouped minimum, summed before the shuffle, and a join that Spark may split where a hub is
    hot, so neither the driver nor one task ever holds a component.
    """

    def pairs(df: DataFrame) -> DataFrame:
        return df.where("a <> b").distinct()

    def star(directed: DataFrame, keep: Column, own: bool) -> DataFrame:
        low = directed.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = directed.join(low, "a")
        hung = out.where(keep).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return hung.unionByName(low.select("a", F.col("m").alias("b"))) if own else hung

    now = settle(pairs(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))
    seen = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = pairs(star(both, F.col("b") > F.col("a"), False))
        now = settle(pairs(star(large, F.lit(True), True)))
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.unionByName(now.select(F.col("b").alias("a"), "b").distinct()).select(F.col("a").alias("node"), F.col("b").alias("root"))


def set_aside(docs: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns of these names renamed, so that an operator's own can't meet them, and what brings each back."""
    taken = set(docs.columns)
    aside = {}
    for name in names:
        if name in taken:
            new = f"_own_{name}"
            while new in taken:
                new += "_"
            taken.add(new)
            aside[name] = new
            docs = docs.withColumnRenamed(name, new)
    return docs, aside


def brought_back(df: DataFrame, columns: list[str], aside: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(aside.get(c, c)).alias(c) for c in columns])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
