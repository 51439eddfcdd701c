"""SimHash near-duplicates through anchor points of a covering code.

The anchors are the words of the perfect Hamming code of length 63, whose covering radius is 1,
on the fingerprint's low 63 bits. Two fingerprints at 2 or fewer differing bits have a midpoint
at most 1 bit from each, and that midpoint lies within 1 bit of an anchor; a fingerprint is
therefore replicated to every anchor within the radius plus the threshold's half, 2 bits, which
are 32 anchors (1 if it is an anchor itself), and no link is lost. At most 2 * (1 + 63 + 1953) =
4034 different fingerprints can meet at an anchor, whatever the corpus, so each comparison group
is bounded by construction. Equal fingerprints are gathered before the replication.

near_copies() finds texts alike in their shingles, where whole fingerprints differ in many bits:
a text gets a longer fingerprint, of which twelve blocks of 31 bits are covered by the Hamming code
of that length in the same way, and 128 further bits measure the distance of what meets there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from evispan.llm.common import FINE, PACKED, brought_back, connected_components, dealt, gathered, partitions, read_table, set_aside, settle, unpacked, word_hashes

BITS = 63
LIMIT = 2
SEED = 42
#: Runs at an anchor up to this size are compared pair by pair, longer ones through their 1-bit neighbours.
PAIRWISE = 48

_INDEX = np.arange(1, BITS + 1, dtype=np.uint64)
#: Parity masks: mask k has the positions whose number has bit k.
_MASKS = [np.uint64(sum(1 << (i - 1) for i in range(1, BITS + 1) if i >> k & 1)) for k in range(6)]
#: For each syndrome s the 31 pairs i < j with i xor j = s, as bit masks; row 0 is unused.
_PAIRS = np.array(
    [[(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, BITS + 1) if i != s and i < i ^ s] if s else [0] * 31 for s in range(64)],
    dtype=np.uint64,
)
_NEIGHBOURS = np.array([0, *(1 << k for k in range(64))], dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a text's word shingles, with repeats; no words: 0."""
    words = [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], ends[:-shingle]]).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), 65536):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at : at + 65536], stops[at : at + 65536], strict=True)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << k for k in np.flatnonzero(2 * ones > len(starts)).tolist()))


def with_fingerprint(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int = 3) -> DataFrame:
    """The kept columns and fp, the fingerprint as a signed long."""
    kept = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(len(kept))), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(found.view(np.int64))], names=[*kept, "fp"])

    schema = StructType([docs.schema[c] for c in kept] + [StructField("fp", LongType())])
    return docs.select(*kept, F.col(text).alias("_text")).mapInArrow(run, schema)


def anchors_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, anchor) for every anchor within 2 bits of each fingerprint."""
    low = fp & np.uint64((1 << BITS) - 1)
    syndrome = np.zeros(len(fp), dtype=np.int64)
    for k, mask in enumerate(_MASKS):
        syndrome |= (np.bitwise_count(low & mask).astype(np.int64) & 1) << k
    own, off = syndrome == 0, np.flatnonzero(syndrome)
    s = syndrome[off]
    near = low[off] ^ (np.uint64(1) << (s - 1).astype(np.uint64))
    far = low[off, None] ^ _PAIRS[s]
    return (
        np.concatenate([fp[own], fp[off], np.repeat(fp[off], far.shape[1])]),
        np.concatenate([low[own], near, far.ravel()]),
    )


def _links(run: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among the different fingerprints that meet at one anchor."""
    parent = list(range(len(run)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    if len(run) <= PAIRWISE:
        near = np.bitwise_count(run[:, None] ^ run[None, :]) <= LIMIT
        left, right = np.nonzero(np.triu(near, 1))
    else:  # two fingerprints are within 2 bits just when they share one at 1 bit or less
        who = np.repeat(np.arange(len(run)), len(_NEIGHBOURS))
        mid = (run[:, None] ^ _NEIGHBOURS).ravel()
        order = np.argsort(mid, kind="stable")
        mid, who = mid[order], who[order]
        same = mid[1:] == mid[:-1]
        left, right = who[:-1][same], who[1:][same]
    out = []
    for i, j in zip(left.tolist(), right.tolist(), strict=True):
        a, b = root(i), root(j)
        if a != b:
            parent[b] = a
            out.append((i, j))
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among fingerprints sorted by anchor; a run may go on in the next batch."""
    rest = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)

    def linked(anchor: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(0, dtype=np.int64)
        size = np.diff(np.concatenate([first, [len(anchor)]]))
        twos = first[size == 2]
        close = twos[np.bitwise_count(fp[twos] ^ fp[twos + 1]) <= LIMIT]
        a, b = [fp[close]], [fp[close + 1]]
        for at, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            run = fp[at : at + n]
            if got := _links(run):
                i, j = np.array(got).T
                a.append(run[i])
                b.append(run[j])
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0]).view(np.int64)), pa.array(np.ascontiguousarray(pairs[:, 1]).view(np.int64))], names=["a", "b"])

    for batch in batches:
        anchor = np.concatenate([rest[0], batch.column(0).to_numpy().view(np.uint64)])
        fp = np.concatenate([rest[1], batch.column(1).to_numpy().view(np.uint64)])
        cut = int(np.searchsorted(anchor.view(np.int64), anchor.view(np.int64)[-1])) if len(anchor) else 0
        yield linked(anchor[:cut], fp[:cut])
        rest = anchor[cut:], fp[cut:]
    yield linked(*rest)


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints within 2 bits of each other; fps has different values of fp."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, anchor = anchors_of(batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(fp.view(np.int64))], names=["anchor", "fp"])

    spread = fps.select("fp").mapInArrow(replicate, "anchor long, fp long")
    return spread.repartition(partitions(fps.sparkSession), "anchor").sortWithinPartitions("anchor").mapInArrow(_compare, "a long, b long")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of docs, the component named by its smallest doc_id.

    Null and empty texts have fingerprint 0 and link as any other; a null doc_id never names a
    component unless all are null; repeated rows and other columns change nothing.
    """
    marked = settle(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), shingle=shingle))
    fps = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected_components(fingerprint_links(fps))
    named = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = settle(named)
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.join(lowest, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


# Near copies: word shingles of any size at a similarity, through the same kind of anchors on several short blocks.

#: Lanes of 64 bits from each shingle hash: SKETCH of them name a text and measure its distance, the others give two blocks each.
LANES, SKETCH = 8, 2
BLOCK_BITS = 31
#: Differing bits of the 128 that still link. Shingle sets with a Jaccard similarity of 0.8 differ in 19.4 on average (standard deviation 4.1).
NEAR_LIMIT = 26
#: An anchor with this many texts is dealt over SALTS tasks, which together compare all its pairs; they are looked for in one text of SAMPLE.
HOT, SALTS, SAMPLE = 20_000, 32, 16

_MIX = np.uint64(0x9E3779B97F4A7C15)
_LANE = np.array([pow(0xD1342543DE82EF95, k + 1, 1 << 64) for k in range(LANES)], dtype=np.uint64)
_SHORT_MASKS = [np.uint64(sum(1 << (i - 1) for i in range(1, BLOCK_BITS + 1) if i >> k & 1)) for k in range(5)]
_SHORT_PAIRS = np.array(
    [[(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, BLOCK_BITS + 1) if i != s and i < i ^ s] if s else [0] * 15 for s in range(32)],
    dtype=np.uint64,
)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def wide_fingerprint(one: np.ndarray, shingle: int) -> np.ndarray:
    """LANES numbers of 64 bits, each bit the majority of that bit among the hashes of the different shingles of a text's word_hashes(); no words: zeros."""
    if not len(one):
        return np.zeros(LANES, np.uint64)
    size = min(shingle, len(one))
    h = np.zeros(len(one) - size + 1, np.uint64)
    for i in range(size):
        h = _mixed(h * _MIX + one[i : i + len(h)])
    h = np.unique(h)
    ones = np.zeros(64 * LANES, np.int64)
    for at in range(0, len(h), 255 * 64):  # sums of 255 rows fit in a byte
        bits = np.unpackbits(_mixed(h[at : at + 255 * 64, None] ^ _LANE).view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):
            ones += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)


_WIDE = [f"l{k}" for k in range(LANES)]


def _with_wide(docs: DataFrame, shingle: int) -> DataFrame:
    """rk, the kept columns and the lanes of docs (rk, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([wide_fingerprint(words, shingle) for words in word_hashes(batch.column(2))], np.uint64).reshape(-1, LANES)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(np.ascontiguousarray(found[:, k]).view(np.int64)) for k in range(LANES))], names=["rk", "doc_id", *_WIDE])

    return docs.mapInArrow(run, StructType([docs.schema["rk"], docs.schema["doc_id"], *(StructField(n, LongType()) for n in _WIDE)]))


def block_anchors(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor): for every 31-bit block the words of the perfect Hamming code within 2 bits, 16 or, for a word itself, 1."""
    syndrome = np.zeros(len(block), dtype=np.int64)
    for k, mask in enumerate(_SHORT_MASKS):
        syndrome |= (np.bitwise_count(block & mask).astype(np.int64) & 1) << k
    own, off = np.flatnonzero(syndrome == 0), np.flatnonzero(syndrome)
    s = syndrome[off]
    near = block[off] ^ (np.uint64(1) << (s - 1).astype(np.uint64))
    far = block[off, None] ^ _SHORT_PAIRS[s]
    return np.concatenate([own, off, np.repeat(off, far.shape[1])]), np.concatenate([block[own], near, far.ravel()])


def _salts(s0: np.ndarray, s1: np.ndarray) -> np.ndarray:
    return _mixed(s0 ^ s1) % np.uint64(SALTS) + np.uint64(1)


def _anchor_blocks(batches: Iterator[pa.RecordBatch], hot: np.ndarray, led: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, s0, s1) from (l0 .. l7); an anchor has its block's number above its 31 bits and, at hot anchors, a salt above that.

    Of the sorted hot anchors `led` has the pivots. What is near the pivot goes to its own salt, what
    isn't to every salt: so a pair meets somewhere, or both of it are near the pivot.
    """
    for batch in batches:
        lanes = [c.to_numpy().view(np.uint64) for c in batch.columns]
        for k in range(2 * (LANES - SKETCH)):
            block = (lanes[SKETCH + k // 2] >> np.uint64(32 * (k % 2))) & np.uint64((1 << BLOCK_BITS) - 1)
            row, anchor = block_anchors(block)
            anchor = anchor | np.uint64(k << 32)
            s0, s1 = lanes[0][row], lanes[1][row]
            if len(hot):
                at = np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)
                met = hot[at] == anchor
                far = met & (np.bitwise_count(np.stack([s0, s1], axis=1) ^ led[at]).sum(axis=1) > limit)
                own = np.where(met, anchor | (_salts(s0, s1) << np.uint64(40)), anchor)
                every = np.arange(1, SALTS + 1, dtype=np.uint64) << np.uint64(40)
                anchor = np.concatenate([own[~far], (anchor[far, None] | every).ravel()])
                s0, s1 = (np.concatenate([s[~far], np.repeat(s[far], SALTS)]) for s in (s0, s1))
            yield anchor, s0, s1


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _anchor_blocks(batches, np.zeros(0, np.uint64), np.zeros((0, SKETCH), np.uint64), 0):
        yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in block], names=["anchor", "s0", "s1"])


def _dealt_anchors(pivots: dict[int, tuple[int, int]], limit: int, buckets: int):
    hot = np.array(sorted(pivots), np.int64)
    led = np.array([pivots[a] for a in hot.tolist()], np.int64).reshape(-1, SKETCH).view(np.uint64)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for anchor, s0, s1 in _anchor_blocks(batches, hot.view(np.uint64), led, limit):
            yield _mixed(anchor) >> np.uint64(20), np.stack([anchor, s0, s1], axis=1).view(np.int64)

    return lambda batches: dealt(blocks(batches), buckets)


def sketch_links(run: np.ndarray, limit: int, own: int | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that connect just the rows of run (n, SKETCH) that chains of distances of at most `limit` connect.

    With `own`, of the pairs those count that have one of the first `own` rows; the very first leads first.

    The smallest row not yet taken becomes a leader and takes what is near it; only rows of different
    leaders are then compared, a square of rows at a time, so a group of near copies costs its size
    and not its square, and has mostly the same leaders wherever it meets.
    """
    many = len(run) if own is None else own
    group = np.arange(len(run))
    out: list[tuple[int, int]] = []
    rest = np.arange(len(run))
    while len(left := rest[: np.searchsorted(rest, many)]):
        lead = left[run[left, 0].argmin()] if own is None or out or left[0] else left[0]
        near = np.bitwise_count(run[rest] ^ run[lead]).sum(axis=1) <= limit
        group[rest[near]] = lead
        out += [(int(lead), int(j)) for j in rest[near] if j != lead]
        rest = rest[~near]
    parent = {int(k): int(k) for k in np.unique(group)}

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    if len(parent) > 1:
        for a in range(0, many, 512):
            for b in range(a, len(run), 512):
                if len(parent) == 1:
                    break
                z = min(many, a + 512)
                left, right = run[a:z], run[b : b + 512]
                i, j = np.nonzero((np.bitwise_count(left[:, None] ^ right[None]).sum(axis=2) <= limit) & (group[a:z, None] != group[None, b : b + 512]))
                for x, y in zip((i + a).tolist(), (j + b).tolist(), strict=True):
                    p, q = root(int(group[x])), root(int(group[y]))
                    if p != q:
                        parent[q] = p
                        out.append((x, y))
    return out


def _sketch_compare(pivots: dict[int, tuple[int, int]], limit: int):
    """Links (a, b) of 16 bytes each from buckets of (anchor, s0, s1); a hot anchor's salts compare their own texts with all that came."""

    def linked(rows: np.ndarray) -> np.ndarray:
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        anchor, s = rows[:, 0], rows[:, 1:].view(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        size = np.diff(np.append(first, len(anchor)))
        twos = first[size == 2]
        close = twos[np.bitwise_count(s[twos] ^ s[twos + 1]).sum(axis=1) <= limit]
        out = [np.concatenate([s[close], s[close + 1]], axis=1)]
        for at, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            run, pivot = s[at : at + n], pivots.get(int(anchor[at]) & ((1 << 40) - 1))
            own = None
            if pivot:
                mine = _salts(*run.T) == np.uint64(anchor[at] >> 40)
                run, own = np.concatenate([np.array([pivot], np.int64).view(np.uint64), run[mine], run[~mine]]), 1 + int(mine.sum())
            if got := sketch_links(run, limit, own):
                i, j = np.array(got).T
                out.append(np.concatenate([run[i], run[j]], axis=1))
        return np.unique(np.concatenate(out), axis=0)

    def star(links: list[np.ndarray]) -> pa.RecordBatch:
        """The links' components as stars around their smallest member, which is mostly the same one in every task."""
        nodes, at = np.unique(np.concatenate(links).reshape(-1, SKETCH), axis=0, return_inverse=True)
        label = smallest_labels(len(nodes), *at.reshape(-1, 2).T)
        far = np.flatnonzero(label != np.arange(len(nodes)))
        sides = [pa.array([x.tobytes() for x in np.ascontiguousarray(nodes[i])], pa.binary()) for i in (label[far], far)]
        return pa.RecordBatch.from_arrays(sides, names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros((0, 2 * SKETCH), np.uint64)]
        for rows in unpacked(batches, 1 + SKETCH):
            held.append(linked(rows))
            if sum(map(len, held)) >= 1 << 20:
                yield star(held)
                held = held[:1]
        yield star(held)

    return run


def smallest_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of 0 .. n - 1 that links (a, b) reach from each; roots hook to smaller ones and paths halve, so few rounds are needed."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (label[a], label[b], a, b):
            np.minimum.at(new, end, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def near_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, limit: int = NEAR_LIMIT, hot: int = HOT) -> DataFrame:
    """(rk, doc_id, root): one row per row of docs; rk names the row's id and text, root its group of near copies.

    Two texts are linked where they share an anchor of one of twelve 31-bit blocks and their
    128-bit sketches differ in at most `limit` bits. At a hot anchor the texts near its pivot are
    linked to it and dealt over salts; each other text meets all of them in every salt.
    Null and empty texts are copies of each other; repeated rows and a null doc_id count as any.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(row_key(F.col(doc_id), F.col(text)).alias("rk"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = settle(_with_wide(rows, shingle))
    node = lambda: F.concat(*[_bytes(F.col(c)) for c in _WIDE[:SKETCH]])
    fps = settle(marked.groupBy(*_WIDE[:SKETCH]).agg(*[F.min(c).alias(c) for c in _WIDE[SKETCH:]]))
    some = fps.where(F.pmod(F.xxhash64("l0", "l1"), F.lit(SAMPLE)) == 0).select(*_WIDE).mapInArrow(_anchor_rows, "anchor long, s0 long, s1 long")
    busy = some.groupBy("anchor").agg(F.count("*").alias("c"), F.min(F.struct("s0", "s1")).alias("p")).where(F.col("c") >= max(2, hot // SAMPLE))
    pivots = {r["anchor"]: (r["p"]["s0"], r["p"]["s1"]) for r in busy.collect()}  # each has hot / SAMPLE rows of the sample
    spread = fps.select(*_WIDE).mapInArrow(_dealt_anchors(pivots, limit, FINE * n), PACKED)
    links = gathered(spread).mapInArrow(_sketch_compare(pivots, limit), "a binary, b binary")
    roots = connected_components(links.distinct())
    named = marked.select("rk", "doc_id", node().alias("node"))
    return named.join(roots, "node", "left").select("rk", "doc_id", F.coalesce("root", "node").alias("root"))


def _bytes(c: Column) -> Column:
    """A long's eight bytes, the lowest first, as numpy lays them out."""
    return F.unhex(F.concat(*[F.substring(F.lpad(F.hex(c), 16, "0"), 15 - 2 * k, 2) for k in range(8)]))


def row_key(doc_id: Column, text: Column) -> Column:
    """A 128-bit name of a row's id and text; nulls have their own."""
    return F.md5(F.concat(F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("")), F.lit("\n"), F.coalesce(F.concat(F.lit("="), text), F.lit(""))))


def keep_one_per_group(docs: DataFrame, *, shingle: int = 5, limit: int = NEAR_LIMIT) -> DataFrame:
    """One row of each group of near copies: of those with the smallest doc_id (null last) the one with the smallest row_key().

    Rows that repeat, in id and text, are one; a group whose rows have no id keeps one of them;
    rows that share an id but not a group are judged apart. Null and empty texts form one group.
    """
    groups = near_copies(docs, shingle=shingle, limit=limit)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("rk").alias("rk")))
    kept = groups.groupBy("root").agg(first["rk"].alias("_rk")).select("_rk")
    rows, aside = set_aside(docs, ["_rk"])
    text, doc_id = (F.col(aside.get(c, c)) for c in ("text", "doc_id"))
    # repeats fall together before the shuffle, and the semi-join finds the rows dealt as it needs them
    single = rows.withColumn("_rk", row_key(doc_id, text)).dropDuplicates(["_rk"])
    return brought_back(single.join(kept, "_rk", "left_semi"), docs.columns, aside)


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component; null and empty texts, repeated rows and null ids as in near_duplicates()."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
