"""Benchmark decontamination with suffix arrays over the training text.

A task gathers training documents into shards of bounded size. All suffixes of a shard's words are
sorted by prefix doubling, from three words (one where numbers are large) on, until a window's length is reached: the shard's
suffix array. Every benchmark suffix of a window's length is binary-searched in it, which gives the
places of all its occurrences; occurrences that follow each other on one diagonal of document and
item are one longest match.

The benchmark is shipped in blocks of bounded bytes. With several blocks the documents are read
once for each, only (text's key, matches) of what matched is kept, and one join brings all back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from evispan.llm.common import brought_back, read_table, set_aside, settle, union_all

#: A-Z become a-z; bytes 0x00-0x2F, 0x3A-0x60 and 0x7B-0x7F separate words.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 32 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256)
)

HIT_FIELDS = "n_words long, matches array<struct<start:int,length:int,item:string,item_start:int>>, hit_words long, items array<string>"


def words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Benchmark:
    """One block of benchmark items as word numbers, and where its windows begin."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        vocab: dict[bytes, int] = {}
        self.items: list[str] = []
        self.window = window
        seqs, owner, offset, starts, sizes = [], [], [], [], []
        for item, text in items:
            ids = [vocab.setdefault(w, len(vocab)) for w in words(text)]
            if not ids:
                continue
            size = min(window, len(ids))
            starts.append(len(seqs) + np.arange(len(ids) - size + 1))
            sizes.append(np.full(len(ids) - size + 1, size))
            owner += [len(self.items)] * len(ids)
            offset += range(len(ids))
            self.items.append(item)
            seqs += ids
        none = [np.zeros(0, np.int64)]
        self.vocab = list(vocab)
        self.seq, self.owner, self.offset = (np.array(x, np.int64) for x in (seqs, owner, offset))
        self.starts, self.sizes = np.concatenate(starts or none), np.concatenate(sizes or none)


def suffix_array(train: np.ndarray, depth: int) -> np.ndarray:
    """The places of train sorted by the words that follow, to `depth` words at least; places beyond the end count as 0."""
    n = len(train)

    def shifted(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(x)
        out[: max(0, n - by)] = x[by:]
        return out

    few = n == 0 or int(train.max()) < 1 << 21
    key, known = ((train << 42) | (shifted(train, 1) << 21) | shifted(train, 2), 3) if few else (train, 1)
    while True:
        order = np.argsort(key, kind="stable")
        if known >= depth:
            return order
        ranked = key[order]
        new = np.concatenate([[1], (ranked[1:] != ranked[:-1]).astype(np.int64)])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if rank[order[-1]] == n:
            return order  # all suffixes differ already
        key, known = (rank << 32) | shifted(rank, known), 2 * known


def occurrences(train: np.ndarray, array: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low, high): the part of the suffix array whose suffixes begin with each row of queries, by binary search of all rows at once."""
    n, size = len(array), queries.shape[1]
    padded = np.concatenate([train, np.zeros(size, np.int64)])
    step = np.arange(size)

    def bound(after: bool) -> np.ndarray:
        low, high = np.zeros(len(queries), np.int64), np.full(len(queries), n)
        while (live := np.flatnonzero(low < high)).size:
            mid = (low[live] + high[live]) // 2
            diff = padded[array[mid][:, None] + step] - queries[live]
            at = (diff != 0).argmax(axis=1)
            sign = diff[np.arange(len(live)), at]
            right = (sign < 0) | ((sign == 0) & after)
            low[live], high[live] = np.where(right, mid + 1, low[live]), np.where(right, high[live], mid)
        return low

    return bound(False), bound(True)


#: Benchmark suffixes that are searched, and occurrences that are merged, at once.
QUERIES = 50_000


class _Numbers(dict):
    """Words numbered from 1 as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        return n


def shard_matches(bench: Benchmark, texts: list[str | None]) -> tuple[list[int], list[list[tuple[int, int, str, int]]]]:
    """Words of each text, and its longest matches (start, length, item, start in the item)."""
    vocab = _Numbers()
    ids, bounds, counts = [], [0], []
    for t in texts:
        w = words(t)
        counts.append(len(w))
        ids += map(vocab.__getitem__, w)
        ids.append(0)
        bounds.append(len(ids))
    found: list[list[tuple[int, int, str, int]]] = [[] for _ in texts]
    train, edges = np.array(ids, dtype=np.int64), np.array(bounds)
    mine = np.array([vocab.get(w, -1) for w in bench.vocab], np.int64)[bench.seq] if len(bench.seq) else bench.seq
    array = suffix_array(train, bench.window) if len(bench.seq) and len(train) else train
    places, tests, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in np.unique(bench.sizes).tolist():
        starts = bench.starts[bench.sizes == size]
        for at in range(0, len(starts), QUERIES):
            part = starts[at : at + QUERIES]
            queries = mine[part[:, None] + np.arange(size)]
            here = (queries > 0).all(axis=1)  # a word that the shard lacks ends the search before it starts
            low, high = occurrences(train, array, queries[here])
            many = high - low
            places.append(array[np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)])
            tests.append(np.repeat(part[here], many))
            sizes.append(np.repeat(size, many.sum()))
    p, t, z = np.concatenate(places), np.concatenate(tests), np.concatenate(sizes)
    if not len(p):
        return counts, found
    own = bench.owner[t]
    order = np.lexsort((p, p - t, own))
    p, t, z, own = p[order], t[order], z[order], own[order]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | ((p - t)[1:] != (p - t)[:-1]) | (p[1:] != p[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    doc = np.searchsorted(edges, p[first], "right") - 1
    for d, start, length, item, off in zip(doc.tolist(), (p[first] - edges[doc]).tolist(), (p[last] - p[first] + z[first]).tolist(), own[first].tolist(), bench.offset[t[first]].tolist(), strict=True):
        found[d].append((start, length, bench.items[item], off))
    return counts, found


def covered(matches: list[tuple[int, int, str, int]]) -> int:
    total, end = 0, 0
    for start, length, *_ in sorted(matches):
        total += max(0, start + length - max(start, end))
        end = max(end, start + length)
    return total


_MATCHES = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("item", pa.string()), ("item_start", pa.int32())]))
_FIELDS = ("start", "length", "item", "item_start")


def _shards(batches: Iterator[pa.RecordBatch], text: str, shard_words: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Rows of a batch and their texts, cut so that a shard has about shard_words words; one text is never cut."""
    for batch in batches:
        column, at = batch.column(batch.schema.get_field_index(text)), 0
        while at < len(column):
            end, chars, shard = at, 0, []
            while end < len(column) and chars < 6 * shard_words:
                shard.append(column[end].as_py())
                chars += len(shard[-1] or "")
                end += 1
            yield batch.slice(at, end - at), shard
            at = end


def _listed(found: list[list[tuple[int, int, str, int]]]) -> pa.Array:
    return pa.array([[dict(zip(_FIELDS, m, strict=True)) for m in sorted(f)] for f in found], _MATCHES)


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10,
    block_bytes: int = 32_000_000, shard_words: int = 1_000_000,
) -> DataFrame:
    """docs with n_words, matches, hit_words and items (ids as strings, sorted).

    A window is `window` consecutive words of an item, or a whole shorter item. Null and empty
    texts have no words and no matches; a null item id is the empty string; columns of docs that
    have one of the new names are replaced; repeated rows stay repeated.
    """
    docs = docs.drop("n_words", "matches", "hit_words", "items")
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(item_text).alias("t")).where("t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))  # an item is shipped whole
    ship = lambda b: docs.sparkSession.sparkContext.broadcast(sorted((r.i, r.t) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()))
    if blocks == 1:
        schema = StructType([*docs.schema.fields, *StructType.fromDDL(HIT_FIELDS).fields])
        return docs.mapInArrow(_searcher(ship(0), docs.columns, text, window, shard_words), schema)
    key = F.md5(F.coalesce(F.concat(F.lit("="), F.col(text)), F.lit("")))
    narrow = docs.select(key.alias("_key"), F.col(text).alias("_text")).where("_text is not null")
    kind = StructType([StructField("_key", StringType()), StructType.fromDDL(HIT_FIELDS)["matches"]])
    parts = [settle(narrow.mapInArrow(_matcher(ship(b), window, shard_words), kind).dropDuplicates(["_key"])) for b in range(blocks)]
    met = union_all(parts).groupBy("_key").agg(F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches"))
    none = F.array().cast(kind["matches"].dataType)
    names = docs.columns
    rows = docs.withColumn("_key", key).join(met, "_key", "left").withColumn("matches", F.coalesce("matches", none))
    folded = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    step = lambda acc, m: F.struct((acc["n"] + F.greatest(F.lit(0), m["start"] + m["length"] - F.greatest(m["start"], acc["end"]))).alias("n"), F.greatest(acc["end"], m["start"] + m["length"]).alias("end"))
    hit = F.aggregate("matches", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda acc: acc["n"].cast("long"))
    return rows.select(*names, F.regexp_count(folded, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")).cast("long").alias("n_words"), "matches", hit.alias("hit_words"), F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item"]))).alias("items"))


def _searcher(shipped, names: list[str], text: str, window: int, shard_words: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = Benchmark(shipped.value, window)
        for rows, shard in _shards(batches, text, shard_words):
            counts, found = shard_matches(bench, shard)
            made = [pa.array(counts, pa.int64()), _listed(found), pa.array([covered(f) for f in found], pa.int64()), pa.array([sorted({m[2] for m in f}) for f in found], pa.list_(pa.string()))]
            kept = [rows.column(rows.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays(kept + made, names=[*names, "n_words", "matches", "hit_words", "items"])

    return search


def _matcher(shipped, window: int, shard_words: int):
    """(key, matches) of the texts that have any."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = Benchmark(shipped.value, window)
        for rows, shard in _shards(batches, "_text", shard_words):
            _, found = shard_matches(bench, shard)
            at = [i for i, f in enumerate(found) if f]
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(at, pa.int64())), _listed([found[i] for i in at])], names=["_key", "matches"])

    return search


def contaminated(min_hit_words: int = 1) -> Column:
    return F.col("hit_words") >= min_hit_words


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without those that share a window with the benchmark, in their own columns; null and empty texts stay, as do repeated rows."""
    rows, aside = set_aside(docs, ["n_words", "matches", "hit_words", "items"])
    return brought_back(find_overlaps(rows, benchmark, **options).where(~contaminated()), docs.columns, aside)


def digest_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document's words, hit words and items; nulls, empty texts and repeated rows as in find_overlaps()."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_overlaps(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.col("hit_words").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


#: DuckDB: every window of an item looked up among the documents' windows of the same length.
OP8_SQL = r"""
WITH iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
dw AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
ks AS (SELECT DISTINCT k FROM win),
pos AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k),
occ AS (SELECT p.doc_id, p.i, p.k, win.item_id FROM pos p JOIN win ON win.k = p.k AND win.g = array_to_string(list_slice(p.w, p.i, p.i + p.k - 1), ' ')),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
