"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Every byte has a
learned vector; learned filters of 8 bytes at steps of 4 run over a chunk, and each filter's
largest response in the chunk is kept. A text's mean and largest chunk responses are weighed into
one probability. Trained by Adam on a bounded, balanced sample of labelled rows; the bias is then
moved to the labels' own share of good texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from evispan.llm.common import brought_back, lowest, read_table, seeded, set_aside, settle

CHUNK, OVERLAP, HALF, WIDTH, FILTERS = 512, 64, 4, 6, 32
STEP = CHUNK - OVERLAP
#: Labelled rows of each class that are fitted on, the lowest by a seeded hash; their whole texts are.
MOST_ROWS = 800
STEPS, BATCH, RATE = 600, 32, 4e-3
SEED = "cnn-1"
#: Chunks in one matrix product.
BLOCK = 256


@dataclass
class Net:
    bytes_: np.ndarray  # 256 x WIDTH
    filters: np.ndarray  # 2, HALF * WIDTH, FILTERS: the two halves of each filter
    shift: np.ndarray  # FILTERS
    mean: np.ndarray  # FILTERS
    top: np.ndarray  # FILTERS
    bias: np.ndarray  # 1

    @staticmethod
    def fresh() -> Net:
        rng = np.random.default_rng(7)
        f = lambda *s: rng.normal(0, 1, s).astype(np.float32)
        return Net(f(256, WIDTH) * 0.5, f(2, HALF * WIDTH, FILTERS) * (2 / (2 * HALF * WIDTH)) ** 0.5, np.zeros(FILTERS, np.float32), f(FILTERS) * 0.1, f(FILTERS) * 0.1, np.zeros(1, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.bytes_, self.filters, self.shift, self.mean, self.top, self.bias]

    def responses(self, chunks: np.ndarray) -> np.ndarray:
        """(chunks, positions, FILTERS) before the shift and the rectifier."""
        n = len(chunks)
        x = self.bytes_[chunks.reshape(-1)].reshape(n * (CHUNK // HALF), HALF * WIDTH)
        left = (x @ self.filters[0]).reshape(n, CHUNK // HALF, FILTERS)
        right = (x @ self.filters[1]).reshape(n, CHUNK // HALF, FILTERS)
        return left[:, :-1] + right[:, 1:]

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        return np.maximum(self.responses(chunks).max(axis=1) + self.shift, 0)

    def logits(self, pooled: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One number per text; starts are the places of the texts' first chunks."""
        sizes = np.diff(np.append(starts, len(pooled)))[:, None]
        return (np.add.reduceat(pooled, starts) / sizes) @ self.mean + np.maximum.reduceat(pooled, starts) @ self.top + self.bias[0]


def chunks_of(text: str | None) -> np.ndarray:
    """Overlapping chunks that cover the whole text, the last filled up with zero bytes; an empty text has one of zeros."""
    data = b"" if text is None else text.encode("utf-8", "surrogatepass")
    n = max(1, -(-(len(data) - OVERLAP) // STEP))
    flat = np.zeros(n * STEP + OVERLAP, np.uint8)
    flat[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(flat, CHUNK)[::STEP]


def fit(texts: list[str | None], labels: list[int], share: float) -> Net:
    """A net fitted to the texts; share is the labels' own part of 1s. One class only gives a constant."""
    net = Net.fresh()
    odds = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
    if len(set(labels)) < 2:
        net.mean[:], net.top[:], net.bias[0] = 0, 0, odds
        return net
    y = np.array(labels, np.float32)
    rng = np.random.default_rng(11)
    m, v = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()]
    of = [np.flatnonzero(y == q) for q in (0, 1)]
    for t in range(1, STEPS + 1):
        rows = np.concatenate([rng.choice(own, BATCH // 2) for own in of])
        grads = _gradients(net, [chunks_of(texts[i]) for i in rows], y[rows])
        for p, g, a, b in zip(net.parts(), grads, m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= RATE * (1 - 0.9 * t / STEPS) * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-7)
    net.bias[0] += odds  # batches have as many of either class
    return net


def _gradients(net: Net, texts: list[np.ndarray], y: np.ndarray) -> list[np.ndarray]:
    """The mean loss's gradient over all chunks of the texts, BLOCK of them at a time, forth and back."""
    chunks = np.concatenate(texts)
    sizes = np.array([len(c) for c in texts])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    where, best = np.empty((len(chunks), FILTERS), np.int64), np.empty((len(chunks), FILTERS), np.float32)
    for at in range(0, len(chunks), BLOCK):
        raw = net.responses(chunks[at : at + BLOCK])
        where[at : at + BLOCK] = raw.argmax(axis=1)  # a filter's gradient reaches only the place of its largest response
        best[at : at + BLOCK] = np.take_along_axis(raw, where[at : at + BLOCK, None], 1)[:, 0] + net.shift
    pooled = np.maximum(best, 0)
    z = net.logits(pooled, starts)
    d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
    means = np.add.reduceat(pooled, starts) / sizes[:, None]
    tops = np.maximum.reduceat(pooled, starts)
    g_pool = np.repeat(d / sizes, sizes)[:, None] * net.mean
    own = np.repeat(np.arange(len(sizes)), sizes)
    largest = pooled == tops[own]  # chunks that tie share the gradient
    g_pool = g_pool + largest / np.add.reduceat(largest.astype(np.float32), starts)[own] * (d[own][:, None] * net.top)
    g = (g_pool * (best > 0)).astype(np.float32)
    weights = net.filters.reshape(2 * HALF, WIDTH, FILTERS).transpose(2, 0, 1)
    g_filters, g_bytes = np.zeros_like(net.filters), np.zeros((256, WIDTH), np.float32)
    for at in range(0, len(chunks), BLOCK):
        part = slice(at, at + BLOCK)
        places = where[part][:, :, None] * HALF + np.arange(2 * HALF)  # chunks, FILTERS, 2 * HALF
        seen = np.take_along_axis(chunks[part][:, None, :], places.reshape(len(places), 1, -1), 2).reshape(places.shape)
        flat = seen.reshape(-1)
        back = g[part][:, :, None, None] * weights
        g_filters += np.einsum("cf,cfkw->kwf", g[part], net.bytes_[seen], optimize=True).reshape(net.filters.shape)
        g_bytes += np.stack([np.bincount(flat, back[..., w].reshape(-1), 256) for w in range(WIDTH)], 1).astype(np.float32)
    return [g_bytes, g_filters, g.sum(0), means.T @ d + 1e-4 * net.mean, tops.T @ d + 1e-4 * net.top, np.array([d.sum()], np.float32)]


def scores(net: Net, texts: list[str | None]) -> np.ndarray:
    """Probabilities of label 1; texts are gathered into products of about BLOCK chunks, long ones cut into several."""
    out, sums, tops, counts = np.zeros(len(texts)), np.zeros((len(texts), FILTERS)), np.zeros((len(texts), FILTERS)), np.zeros(len(texts))
    group: list[np.ndarray] = []
    owners: list[int] = []

    def flush() -> None:
        if group:
            pooled = net.pooled(np.concatenate(group))
            starts = np.concatenate([[0], np.cumsum([len(c) for c in group])[:-1]])
            who = np.array(owners)
            np.add.at(sums, who, np.add.reduceat(pooled, starts))
            np.maximum.at(tops, who, np.maximum.reduceat(pooled, starts))
            group.clear()
            owners.clear()

    held = 0
    for i, t in enumerate(texts):
        c = chunks_of(t)
        counts[i] = len(c)
        for at in range(0, len(c), BLOCK):
            part = c[at : at + BLOCK]
            group.append(part)
            owners.append(i)
            held += len(part)
            if held >= BLOCK:
                flush()
                held = 0
    flush()
    z = (sums / counts[:, None]) @ net.mean.astype(np.float64) + tops @ net.top.astype(np.float64) + float(net.bias[0])
    out[:] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return out


def _held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(3)) == 1


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Net:
    """Fit on at most `most_rows` rows of each class that aren't held out; of several labels or texts for an id the lowest counts."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality")).where(~_held_out())
    there = known.join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("_h", seeded(SEED, F.col("doc_id")))
    there = settle(there.select("doc_id", F.col("quality").cast("int").alias("quality"), "_h"))
    total = {r["quality"]: r["n"] for r in there.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    ids = [r for q in (0, 1) for r in lowest(there.where(F.col("quality") == q), total.get(q, 0), most_rows)]
    chosen = docs.sparkSession.createDataFrame([(r["doc_id"], r["quality"]) for r in ids], StructType([docs.schema["doc_id"], StructField("quality", IntegerType())]))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    good = total.get(1, 0)
    return fit([r["text"] for r in rows], [r["quality"] for r in rows], (good + 1) / (sum(total.values()) + 2))


def score(docs: DataFrame, net: Net, *, text: str = "text") -> DataFrame:
    """docs with `score`, from the text alone; null and empty texts are scored as one chunk of zeros."""
    docs = docs.drop("score")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            found = [scores(net, column.slice(at, 256).to_pylist()) for at in range(0, len(column), 256)]
            kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())], names=[*names, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that the classifier predicts as good, in their own columns."""
    rows, aside = set_aside(docs, ["score"])
    return brought_back(score(rows, train(docs, labels)).where("score >= 0.5"), docs.columns, aside)


def op7_byte_cnn(spark, sf_dir: str) -> DataFrame:
    """A row per document with its score; null and empty texts as in score(), repeated rows repeated, without labels of both classes one constant."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    net = train(docs, read_table(spark, sf_dir, "labels"))
    found = score(docs, net).select("doc_id", "score")
    return found.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
