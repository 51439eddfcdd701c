"""Substring dedup by collinear chaining of shared k-mer seeds.

1. Words of each different text are hashed; of every WINDOW consecutive k-mers the smallest is a
   seed (a run of K + WINDOW - 1 equal words always shares one). A task drops the copies of a text
   that it has seen, so a hot group of copies sends at most one text's seeds from each task.
2. Verbatim passages have an exact way: a seed carries the hash of the LONG words that begin there;
   where two texts share it, all windows of LEAST_WORDS words anchored at the seed are hashed, and
   all texts with an equal window are joined to the first of them.
   Edited passages are found by seeds that meet by their hash. In each run of equal seeds a text is
   joined to the run's first text and to its NEAR predecessors: linear in the run, and the texts of
   a run stay connected. Places where both texts have the same LONG words after the seed, or up to
   it, are left to the windows. A seed of one word repeated counts only where such runs make up
   half of the LEAST_WORDS around it; else every text with a stammer would meet every other.
   What NEAR leaves out has an exact way: of the texts of longer runs, all that share two seeds
   within REACH words, which every chain has, meet by both, unless a class holds both texts and
   passages cover both places already. The stretches there are compared if they share three words
   in a row that few of the group have, or if what many have would do for a passage alone.
3. A pair's seeds are chained in order, with gaps costing GAP a word; the best predecessor of each
   seed comes from a Fenwick tree of prefix maxima.
4. The two stretches of words around each chain are fetched and aligned from their common k-mers;
   what is long and alike enough is a passage.

Texts are named by the smallest doc_id that has them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispan.llm.common import FINE, PACKED, connected_components, dealt, gathered, partitions, prefix_sums, read_table, settle, stretch_hashes, unpacked, word_hashes

K, WINDOW = 5, 10
NEAR = 4
GAP = 0.1
#: A chain is aligned from this many seeds and words; a passage is this long and this alike.
LEAST_SEEDS, LEAST_SPAN = 2, 10
LEAST_WORDS, LEAST_SHARE = 50, 0.8
#: Of LEAST_WORDS equal words the first seed lies in the first WINDOW places, so this many from it are equal too.
LONG = LEAST_WORDS - WINDOW + 1
#: Window rows that are merged, and pairs that are made, at once.
FLUSH = 200_000
#: Words of texts whose seeds are looked for together.
SEEDED = 1 << 17
#: From this many pairs of a seed's places in two texts, repeats at one stride are tiled.
TILED = 64
#: Seed pairs of two texts beyond this many times their places are chained along diagonals.
REPEATED = 4
#: Two seeds of a chain's first step are fewer words apart: GAP a word of both gaps is less than the K that a seed adds.
REACH = int(K / GAP)
BAND = 16  # diagonals beside a chain's own where an alignment may go
MARGIN = LEAST_WORDS  # a chain may have lost its outer seeds to edits
#: Hot seeds are looked for in one of SAMPLE texts; that only spreads work, every seed is joined either way.
SAMPLE, SALTS, LEAST_HOT = 64, 64, 32

#: Words in runs of one word, around a place, from which a seed of one word repeated is joined.
LEAST_RUNS = LEAST_WORDS // 2

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _kmers(words: np.ndarray) -> np.ndarray:
    h = np.zeros(len(words) - K + 1, np.uint64)
    for i in range(K):
        h = (h ^ words[i : i + len(h)]) * _MIX
        h ^= h >> np.uint64(29)
    return h


def seeds_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the minimizers of a text's k-mers; a text of fewer than K words has none."""
    n = len(words) - K + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    h = _kmers(words)
    if n <= WINDOW:
        at = np.array([int(h.argmin())])
    else:
        windows = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
        at = np.arange(len(windows)) + windows.argmin(axis=1)
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    return h[at], at.astype(np.int32)


def _seeds_at(words: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """seeds_of() of many texts that lie side by side in `words`, each from its start to its stop; places are those in `words`."""
    if len(words) < K + WINDOW:
        found = [(h, at + s) for s, e in zip(start.tolist(), stop.tolist(), strict=True) for h, at in [seeds_of(words[s:e])]]
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else seeds_of(words)
    h = _kmers(words)
    windows = np.lib.stride_tricks.sliding_window_view(h, WINDOW).argmin(axis=1)
    whole = np.repeat(stop, stop - start)[: len(windows)] - np.arange(len(windows)) >= K + WINDOW - 1
    at = np.flatnonzero(whole)
    at = at + windows[at]
    short = np.flatnonzero((stop - start >= K) & (stop - start < K + WINDOW - 1))
    own = [s + int(h[s : e - K + 1].argmin()) for s, e in zip(start[short].tolist(), stop[short].tolist(), strict=True)]
    at = np.unique(np.concatenate([at, np.array(own, np.int64)]))
    return h[at], at


def anchors_of_windows(words: np.ndarray) -> np.ndarray:
    """For each start of LEAST_WORDS words the place of its first seed, which equal words share."""
    n = len(words) - LEAST_WORDS + 1
    if n < 1:
        return np.zeros(0, np.int64)
    h = _kmers(words)
    return np.arange(n) + np.lib.stride_tricks.sliding_window_view(h, WINDOW)[:n].argmin(axis=1)


def thinned(words: np.ndarray, at: np.ndarray, first: np.ndarray | int = 0, last: np.ndarray | None = None) -> np.ndarray:
    """Whether each seed is joined as such: one of a single word repeated only where runs abound, and then at every K-th place of its run.

    Of texts side by side, `first` and `last` are where each seed's text starts and stops.
    """
    last = len(words) if last is None else last
    same = np.concatenate([[False], words[1:] == words[:-1]])
    same[first] = False
    if not same.any():
        return np.ones(len(at), bool)
    start = np.flatnonzero(~same)
    size = np.diff(np.append(start, len(words)))
    of = np.cumsum(~same) - 1
    total = np.concatenate([[0], np.cumsum((size >= K)[of])])
    around = total[np.minimum(last, at + LEAST_WORDS)] - total[np.maximum(first, at + K - LEAST_WORDS)]
    alone = of[at] == of[at + K - 1]
    return ~alone | ((around >= LEAST_RUNS) & ((at - start[of[at]]) % K == 0))


def _seed_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(seed, key, at, long, back) of texts (key, text), each key once a task.

    `long` is a 32-bit hash of the LONG words from the place, `back` one of those up to the seed's
    end, 0 where there are fewer; a place that only windows are anchored at is given as ~at.
    """
    seen: set[int] = set()

    def block(held: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, ...]:
        words, sizes = np.concatenate([w for _, w in held]), np.array([len(w) for _, w in held])
        stop = np.cumsum(sizes)
        start = stop - sizes
        h, at = _seeds_at(words, start, stop)
        of = np.searchsorted(stop, at, "right")
        first, last = start[of], stop[of]
        long, back = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        fits, behind = at <= last - LONG, at >= first + LONG - K
        total = prefix_sums(words)
        long[fits] = stretch_hashes(total, at[fits], at[fits] + LONG) >> np.uint64(32)
        back[behind] = stretch_hashes(total, at[behind] + K - LONG, at[behind] + K) >> np.uint64(32)
        joined = thinned(words, at, first, last)
        use = joined | fits
        keys, place = np.array([key for key, _ in held], np.int64)[of], at - first
        return tuple(c[use] for c in (h.view(np.int64), keys, np.where(joined, place, ~place).astype(np.int64), long, back))

    held: list[tuple[int, np.ndarray]] = []
    size = 0
    for batch in batches:
        keys = batch.column(0).to_pylist()
        fresh = [i for i, key in enumerate(keys) if key not in seen and not seen.add(key)]
        texts = batch.column(1).take(pa.array(fresh, pa.int64()))
        for i, words in zip(fresh, word_hashes(texts), strict=True):
            if len(words) < K:
                continue
            held.append((keys[i], words))
            size += len(words)
            if size >= SEEDED:
                yield block(held)
                held, size = [], 0
    if held:
        yield block(held)


SEEDS = "seed long, key long, at long, long long, back long"


def _seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _seed_blocks(batches):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in block], names=["seed", "key", "at", "long", "back"])


def _dealt_seeds(hot: np.ndarray, buckets: int):
    """Four numbers a seed: seed, key, salt and place, long and back; the salt is 0 but for hot seeds."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for seed, key, at, long, back in _seed_blocks(batches):
            salt = np.where(np.isin(seed, hot), key % SALTS, 0)
            by = (seed.view(np.uint64) ^ salt.astype(np.uint64)) * _MIX
            yield by >> np.uint64(20), np.stack([seed, key, salt << 32 | (at & 0xFFFFFFFF), long << 32 | back], axis=1)

    return lambda batches: dealt(blocks(batches), buckets)


#: A text's places of one seed, with the hashes of the words after and before each.
Places = tuple[np.ndarray, np.ndarray, np.ndarray]


def hot_seeds(texts: DataFrame, n: int) -> dict[int, tuple[int, Places]]:
    """{seed: (pivot's key, its places)} of seeds with more than a fair task's share of a sample; 4 n of them at most, as their rows add up to the sample's."""
    some = settle(texts.where(F.pmod("key", F.lit(SAMPLE)) == 0).mapInArrow(_seed_rows, SEEDS).where("at >= 0").distinct(), freed=True)
    total = some.count()
    hot = some.groupBy("seed").agg(F.count("*").alias("c"), F.min("key").alias("key")).where(F.col("c") >= max(LEAST_HOT, total // (4 * n)))
    places = some.join(F.broadcast(hot.select("seed", "key")), ["seed", "key"]).groupBy("seed", "key").agg(F.sort_array(F.collect_list(F.struct("at", "long", "back"))).alias("p")).collect()
    return {r["seed"]: (r["key"], tuple(np.array(c, np.int64) for c in zip(*r["p"], strict=True))) for r in places}


def _joined(seed: np.ndarray, salt: np.ndarray, key: np.ndarray, place: Places, pivots: dict) -> Iterator[np.ndarray]:
    """Pairs (a, b, place in a, place in b) of sorted seed rows, whole runs of them."""
    new_run = np.concatenate([[True], (seed[1:] != seed[:-1]) | (salt[1:] != salt[:-1])])
    new_text = new_run | np.concatenate([[True], key[1:] != key[:-1]])
    text_at = np.flatnonzero(new_text)
    sizes = np.diff(np.append(text_at, len(seed)))
    run_no = np.cumsum(new_run)[text_at] - 1
    run_text = (np.cumsum(new_text) - 1)[np.flatnonzero(new_run)]
    texts = np.arange(len(text_at))
    left, right = [], []
    for step in range(NEAR + 1):
        other = texts - step if step else run_text[run_no]
        ok = other > run_text[run_no] if step else other < texts  # the first text is joined at step 0
        left.append(other[ok])
        right.append(texts[ok])
    keys, places, counts = [key[text_at]], [place], [sizes]
    text_seed, text_key = seed[text_at], key[text_at]
    for s in np.unique(seed[np.isin(seed, pivots["seeds"])]).tolist() if len(pivots["seeds"]) else ():
        own, where = pivots["of"][s]
        partners = np.flatnonzero((text_seed == s) & (text_key != own))
        left.append(np.full(len(partners), sum(map(len, counts))))
        right.append(partners)
        keys.append(np.array([own], np.int64))
        places.append(where)
        counts.append(np.array([len(where[0])]))
    count = np.concatenate(counts)
    yield from _crossed(np.concatenate(left), np.concatenate(right), np.concatenate(keys), tuple(np.concatenate(c) for c in zip(*places, strict=True)), np.cumsum(count) - count, count)


def _strides(place: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The step between a text's places where it is one step throughout, else 0."""
    step = np.diff(place, append=0)
    here = step[start]
    same = np.append(step[1:] == step[:-1], False)
    breaks = np.concatenate([[0], np.cumsum(~same)])
    inner = np.maximum(start + count - 2, start)
    return np.where((count > 2) & (breaks[inner] == breaks[start]), here, 0)


def _crossed(left: np.ndarray, right: np.ndarray, key: np.ndarray, places: Places, start: np.ndarray, count: np.ndarray) -> Iterator[np.ndarray]:
    """Every place of one text with every place of the other but those that windows will find.

    Of two runs at one and the same stride, a line repeated, all diagonals are alike: those that
    tile the longer run from its start and from its end stand for the others.
    """
    place, long, back = places
    n, m = count[left], count[right]
    stride = _strides(place, start, count)
    tiled = (n * m > TILED) & (stride[left] > 0) & (stride[left] == stride[right])
    rows = np.where(tiled, 2 * np.maximum(n, m), n * m)
    cuts = np.flatnonzero(np.diff(np.cumsum(rows) // FLUSH, prepend=0)) + 1
    for part in np.split(np.arange(len(left)), cuts):
        if not len(part):
            continue
        i = np.repeat(part, rows[part])
        k = np.arange(len(i)) - np.repeat(np.cumsum(rows[part]) - rows[part], rows[part])
        x, y = k // m[i], k % m[i]
        if tiled[part].any():
            most, least = np.maximum(n, m)[i], np.minimum(n, m)[i]
            j = k % most
            far = np.where(k < most, j % least, least - 1 - (most - 1 - j) % least)
            x, y = np.where(tiled[i], np.where(n[i] >= m[i], j, far), x), np.where(tiled[i], np.where(n[i] >= m[i], far, j), y)
        a, b = left[i], right[i]
        x, y = start[a] + x, start[b] + y
        use = ((long[x] != long[y]) | (long[x] == 0)) & ((back[x] != back[y]) | (back[x] == 0))
        yield np.stack([key[a], key[b], place[x], place[y]])[:, use]


def _shared(seed: np.ndarray, key: np.ndarray, long: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Rows, in whole runs, whose LONG words another text has; of salted runs, of which other tasks hold parts, all."""
    order = np.lexsort((key, long, seed))
    s, g, k = seed[order], long[order], key[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (g[1:] != g[:-1])])
    first = np.flatnonzero(new)
    texts = np.add.reduceat(np.concatenate([[True], k[1:] != k[:-1]]) | new, first, dtype=np.int64)
    many = np.zeros(len(seed), bool)
    many[order] = (texts > 1)[np.cumsum(new) - 1]
    return (many | np.isin(seed, hot)) & (long != 0)


def _pair_rows(hot: dict[int, tuple[int, Places]]):
    """Pairs from buckets of seeds, and (key, key, at, at) of places whose LONG words another text may have; rows that repeat are copies of a text from other tasks."""
    pivots = {"seeds": np.array(sorted(hot), np.int64), "of": hot}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in unpacked(batches, 4):
            rows = rows[np.argsort(rows[:, 0], kind="stable")]
            new = np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])
            rows = rows[~(new & np.append(new[1:], True))]  # most seeds stand in one text only
            seed, key, salt, at = rows[:, 0], rows[:, 1], rows[:, 2] >> 32, rows[:, 2].astype(np.int32).astype(np.int64)
            order = np.lexsort((at, key, salt, seed))
            seed, key, salt, at, both = seed[order], key[order], salt[order], at[order], rows[order, 3]
            long, back = both >> 32, both & 0xFFFFFFFF
            if not len(seed):
                continue
            fresh = np.concatenate([[True], (seed[1:] != seed[:-1]) | (key[1:] != key[:-1]) | (at[1:] != at[:-1])])
            seed, salt, key, at, long, back = (c[fresh] for c in (seed, salt, key, at, long, back))
            i = np.flatnonzero(_shared(seed, key, long, pivots["seeds"]))
            where = np.where(at < 0, ~at, at)[i]
            yield _pair_batch(np.stack([key[i], key[i], where, where]))
            i = np.flatnonzero(at >= 0)
            if len(i):
                yield _member_batch(seed[i], key[i], at[i], pivots["seeds"])
                yield from map(_pair_batch, _joined(seed[i], salt[i], key[i], (at[i], long[i], back[i]), pivots))

    return run


def _pair_batch(found: np.ndarray) -> pa.RecordBatch:
    a, b, x, y = found
    flip = a > b
    a, b, x, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, y, x), np.where(flip, x, y)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32))], names=["a", "b", "x", "y"])


def _member_batch(seed: np.ndarray, key: np.ndarray, at: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
    """(key, seed, at, -1) of seeds that two texts share, -2 where _joined() leaves out pairs of the run; a hot seed's run may go on elsewhere."""
    order = np.lexsort((key, seed))
    s, k = seed[order], key[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    first = np.flatnonzero(new)
    texts = np.empty(len(s), np.int64)
    texts[order] = np.add.reduceat(np.concatenate([[True], k[1:] != k[:-1]]) | new, first, dtype=np.int64)[np.cumsum(new) - 1]
    texts[np.isin(seed, hot)] = NEAR + 3
    i = np.flatnonzero(texts > 1)
    return pa.RecordBatch.from_arrays([pa.array(key[i]), pa.array(seed[i]), pa.array(at[i].astype(np.int32)), pa.array(np.where(texts[i] > NEAR + 2, -2, -1).astype(np.int32))], names=["a", "b", "x", "y"])


def _ended(batches):
    yield from batches
    yield None


def chains(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Disjoint chains (seeds, first x, last x, first y, last y) of seeds sorted by (x, y), the best first.

    Each seed adds K, less what it overlaps its predecessor, less GAP a word of both gaps. With the
    gap cost linear, the best predecessor maximises score + GAP * (x + y) among smaller y, a prefix
    maximum that a Fenwick tree keeps; seeds of equal x wait until that x is done.
    """
    n = len(x)
    ranks = np.unique(y, return_inverse=True)[1] + 1
    size = int(ranks.max())
    tree_v, tree_i = [float("-inf")] * (size + 1), [-1] * (size + 1)
    score, back = [0.0] * n, [-1] * n
    xs, ys, rs = x.tolist(), y.tolist(), ranks.tolist()
    i = 0
    while i < n:
        j = i
        while j < n and xs[j] == xs[i]:
            r, best, who = rs[j] - 1, float("-inf"), -1
            while r:
                if tree_v[r] > best:
                    best, who = tree_v[r], tree_i[r]
                r &= r - 1
            score[j] = float(K)
            if who >= 0:
                step = min(xs[j] - xs[who], ys[j] - ys[who], K)
                linked = best - GAP * (xs[j] + ys[j]) + step
                if linked > score[j]:
                    score[j], back[j] = linked, who
            j += 1
        for k in range(i, j):
            r, v = rs[k], score[k] + GAP * (xs[k] + ys[k])
            while r <= size:
                if v > tree_v[r]:
                    tree_v[r], tree_i[r] = v, k
                r += r & -r
        i = j
    used, out = [False] * n, []
    for end in sorted(range(n), key=lambda k: -score[k]):
        k, count, start = end, 0, end
        while k >= 0 and not used[k]:
            used[k] = True
            count, start, k = count + 1, k, back[k]
        if count >= LEAST_SEEDS and xs[end] - xs[start] + K >= LEAST_SPAN and ys[end] - ys[start] + K >= LEAST_SPAN:
            out.append((count, xs[start], xs[end] + K, ys[start], ys[end] + K))
    return out


def diagonals(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """As chains(), of seeds that repeat on both sides: runs along one diagonal, those that bring most words of either side not in the ones before first.

    A run ends where a gap costs more than a seed adds. Every seed whose run is long enough lies in a
    kept run's words on both sides; the alignment goes on beside a run's diagonal.
    """
    order = np.lexsort((x, x - y))
    x, y = x[order].astype(np.int64), y[order].astype(np.int64)
    d = x - y
    first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (2 * GAP * (x[1:] - x[:-1]) > K)]))
    last = np.append(first[1:], len(x)) - 1
    count, span = last - first + 1, x[last] - x[first] + K
    ok = np.flatnonzero((count >= LEAST_SEEDS) & (span >= LEAST_SPAN))
    in_x, in_y, out = np.zeros(int(x.max()) + K, bool), np.zeros(int(y.max()) + K, bool), []
    heap = [(-2 * int(span[k]), int(k)) for k in ok]
    heapify(heap)
    while heap:
        gain, k = heap[0]
        a, b, n = int(x[first[k]]), int(y[first[k]]), int(span[k])
        now = int(in_x[a : a + n].sum()) + int(in_y[b : b + n].sum()) - 2 * n
        if now == 0:
            heappop(heap)
        elif now > gain:
            heapreplace(heap, (now, k))
        else:
            heappop(heap)
            in_x[a : a + n] = in_y[b : b + n] = True
            out.append((int(count[k]), a, a + n, b, b + n))
    return out


def _runs(batches: Iterator[pa.RecordBatch], keys: int, least: int) -> Iterator[list[np.ndarray]]:
    """Whole groups of equal leading `keys` columns from sorted batches."""
    held: list[list[np.ndarray]] = []  # batches of a group that goes on, put together when it ends
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(cols[0]):
            continue
        edge = np.zeros(len(cols[0]), bool)
        for k, c in enumerate(cols[:keys]):
            edge[1:] |= c[1:] != c[:-1]
            edge[0] |= bool(held) and c[0] != held[-1][k][-1]
        cuts = np.flatnonzero(edge)
        if not len(cuts):
            held.append(cols)
            continue
        held.append([c[: cuts[0]] for c in cols])
        cols_held = [np.concatenate(c) for c in zip(*held, strict=True)]
        if len(cols_held[0]) >= least:
            yield cols_held
        whole = np.flatnonzero(np.diff(cuts) >= least)
        for s, e in zip(cuts[whole].tolist(), cuts[whole + 1].tolist(), strict=True):
            yield [c[s:e] for c in cols]
        held = [[c[cuts[-1] :] for c in cols]]
    if held:
        cols_held = [np.concatenate(c) for c in zip(*held, strict=True)]
        if len(cols_held[0]) >= least:
            yield cols_held


def _chain_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of the seed pairs (a, b, x, y), sorted; places for windows, which have a = b, go through as (a, a, place, -1, -1, -1), shared seeds, which have a negative y, as (key, seed, at, y, -2, -2)."""
    places: list[pa.RecordBatch] = []

    def pairs() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (c.to_numpy() for c in batch.columns)
            seed = y < 0
            own = (a == b) & ~seed
            for some, what in ((own, -1), (seed, -2)):
                if some.any():
                    none = pa.array(np.full(some.sum(), what, np.int32))
                    places.append(pa.RecordBatch.from_arrays([pa.array(a[some]), pa.array(b[some]), pa.array(x[some]), pa.array(y[some]) if what == -2 else none, none, none], names=["a", "b", "ax", "az", "bx", "bz"]))
            if (own | seed).any():
                batch = batch.filter(pa.array(~(own | seed)))
            yield batch

    rows: list[tuple] = []
    for a, b, x, y in _runs(pairs(), 2, LEAST_SEEDS):
        both = np.stack([x, y], 1)[np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))]
        if len(both) >= LEAST_SEEDS and both[-1, 0] - both[0, 0] + K >= LEAST_SPAN:
            find = diagonals if len(both) > REPEATED * (len(np.unique(both[:, 0])) + len(np.unique(both[:, 1]))) else chains
            rows += [(int(a[0]), int(b[0]), *c[1:]) for c in find(both[:, 0], both[:, 1])]
        while places:
            yield places.pop()
        if len(rows) >= 10_000:
            yield _chain_batch(rows)
            rows = []
    yield from places
    yield _chain_batch(rows)


def _chain_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64()] + [pa.int32()] * 4
    cols = list(zip(*rows, strict=True)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["a", "b", "ax", "az", "bx", "bz"])


def _grams(p: np.ndarray, k: int) -> np.ndarray:
    h = np.zeros(max(0, len(p) - k + 1), np.uint64)
    for i in range(k):
        h = (h ^ p[i : i + len(h)].astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
    return h


def _same_run(p: np.ndarray, q: np.ndarray) -> int:
    """Equal words at the start of both."""
    n, at, step = min(len(p), len(q)), 0, 32
    while at < n:
        equal = p[at : min(n, at + step)] == q[at : min(n, at + step)]
        if not equal.all():
            return at + int(equal.argmin())
        at, step = at + len(equal), step * 2
    return n


def _heaviest(i: np.ndarray, j: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """The starts of the runs, sorted by i, that are in order on both sides and have the most places together; few runs only."""
    starts, ends, sizes = j.tolist(), (j + size).tolist(), size.tolist()
    best, back = list(sizes), [-1] * len(sizes)
    for n in range(len(sizes)):
        for m in range(n):
            if ends[m] <= starts[n] and best[m] + sizes[n] > best[n]:
                best[n], back[n] = best[m] + sizes[n], m
    n, line = (max(range(len(best)), key=best.__getitem__) if best else -1), []
    while n >= 0:
        line.append((int(i[n]), starts[n]))
        n = back[n]
    return line[::-1]


def _longest(i: list[int], j: list[int]) -> list[tuple[int, int]]:
    """A longest set of places in order on both sides, of places sorted by i."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(j)
    for n, v in enumerate(j):
        at = bisect_left(tails, v)
        back[n] = ends[at - 1] if at else -1
        tails[at : at + 1] = [v]
        ends[at : at + 1] = [n]
    line, n = [], ends[-1] if ends else -1
    while n >= 0:
        line.append((i[n], j[n]))
        n = back[n]
    return line[::-1]


def matching_blocks(p: np.ndarray, q: np.ndarray, k: int = 3, chain: tuple[int, int, int, int] | None = None, band: int = 0) -> list[tuple[int, int, int]]:
    """Equal runs (place in p, place in q, words) in order on both sides.

    They grow from the k-mers that stand once on either side, of which the longest ordered set is
    taken; a stretch without any is compared place by place from its start. n log n at most. With a
    chain (its start and stop in p, in q), all equal k-mers near its diagonals count, repeated or not.
    """
    if len(p) == len(q) and np.array_equal(p, q):
        return [(0, 0, len(p))]
    (up, ip, np_), (uq, iq, nq) = (np.unique(_grams(s, k), return_index=True, return_counts=True) for s in (p, q))
    _, a, b = np.intersect1d(up[np_ == 1], uq[nq == 1], assume_unique=True, return_indices=True)
    i, j = ip[np_ == 1][a], iq[nq == 1][b]
    if chain is not None:
        first, last = sorted((chain[2] - chain[0], chain[3] - chain[1]))
        gp, gq = _grams(p, k), _grams(q, k)
        beside = [_beside(gp, gq, np.arange(first - band, last + band + 1) if band else np.array([first, last]))]
        i, j = (np.concatenate(c) for c in zip((i, j), *beside, strict=True))
    order = np.lexsort((-j, i))  # of one place's partners the last first, so that an ordered set has one of them
    i, j = i[order], j[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 1) | (np.diff(j) != 1)])) if len(i) else np.zeros(0, np.int64)
    line = _heaviest(i[first], j[first], np.diff(np.append(first, len(i)))) if chain is None and len(first) <= 64 else _longest(i.tolist(), j.tolist())
    out, x, y = [], 0, 0
    for a, b in line or [(0, 0)]:
        if a < x or b < y:
            continue  # inside the run before, or across it
        left = _same_run(p[x:a][::-1], q[y:b][::-1])
        size = left + _same_run(p[a:], q[b:])
        if size:
            out.append((a - left, b - left, size))
            x, y = a - left + size, b - left + size
    return out


def _beside(gp: np.ndarray, gq: np.ndarray, diagonals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of equal k-mers on some diagonals."""
    if not (len(gp) and len(gq)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    j = np.arange(len(gp)) + diagonals[:, None]
    d, i = np.nonzero((gq[j.clip(0, len(gq) - 1)] == gp) & (j >= 0) & (j < len(gq)))
    return i, i + diagonals[d]


def _may_lead(p: np.ndarray, q: np.ndarray, chain: tuple[int, int, int, int], k: int = 3) -> bool:
    """Whether matching_blocks(), with the chain or without, can make a passage: from the diagonals beside the chain's and those of k-mers that stand once on either side."""
    gp, gq = _grams(p, k), _grams(q, k)
    (up, ip, np_), (uq, iq, nq) = (np.unique(g, return_index=True, return_counts=True) for g in (gp, gq))
    _, a, b = np.intersect1d(up[np_ == 1], uq[nq == 1], assume_unique=True, return_indices=True)
    first, last = sorted((chain[2] - chain[0], chain[3] - chain[1]))
    diagonals = np.unique(np.concatenate([iq[nq == 1][b] - ip[np_ == 1][a], [0], np.arange(first - BAND, last + BAND + 1)]))
    if len(diagonals) * len(gp) > FLUSH * 5:
        return True
    i, j = _beside(gp, gq, diagonals)
    for side, at in ((p, i), (q, j)):
        covered = np.zeros(len(side), bool)
        for m in range(k):
            covered[at + m] = True
        if not _long_enough(covered, np.array([len(side)]))[0]:
            return False
    return True


def align(p: np.ndarray, q: np.ndarray, chain: tuple[int, int, int, int] | None = None) -> list[tuple[int, int, int, int, int]]:
    """Passages (start, stop in p, start, stop in q, equal words) of two stretches of words.

    Equal runs in order are joined while the words that differ between them keep the whole at
    LEAST_SHARE; a passage has LEAST_WORDS words on both sides. Where that leaves out some of the
    chain (its start and stop in p, in q), as where all words repeat, its diagonals lead the alignment.
    """
    if _common_words(p, q) < LEAST_SHARE * LEAST_WORDS:
        return []
    covers = lambda rows: chain is None or any(r[0] <= chain[0] and chain[1] <= r[1] and r[2] <= chain[2] and chain[3] <= r[3] for r in rows)
    if chain is not None and chain[2] - chain[0] == chain[3] - chain[1] and (blocks := _on_diagonal(p, q, chain[2] - chain[0])):
        gp, gq = _grams(p, 3), _grams(q, 3)
        free_p, free_q = np.ones(len(gp), bool), np.ones(len(gq), bool)
        for i, j, n in blocks:
            free_p[i : i + n - 2] = free_q[j : j + n - 2] = False
        if set(gp[free_p].tolist()).isdisjoint(gq[free_q].tolist()):
            return _joined_blocks(blocks)  # what is left can't align anywhere
        (s, t, _), (e, f, n) = blocks[0], blocks[-1]
        e, f = e + n, f + n
        left = matching_blocks(p[:s], q[:t]) if _meet(p[:s], q[:t]) else []
        right = [(e + i, f + j, m) for i, j, m in matching_blocks(p[e:], q[f:])] if _meet(p[e:], q[f:]) else []
        found = _joined_blocks(left + blocks + right)
        if covers(found) or not _repeats(p, q):
            return found
    if chain is not None and not _may_lead(p, q, chain):
        return []
    found = _joined_blocks(matching_blocks(p, q))
    for band in (0, BAND):
        if covers(found):
            break
        if not band and not _repeats(p, q):
            break
        led = _joined_blocks(matching_blocks(p, q, chain=chain, band=band))
        found = max(found, led, key=lambda rows: sum(r[4] for r in rows))
    return found


def _common_words(p: np.ndarray, q: np.ndarray) -> int:
    """Words of p that q has: no alignment has more equal ones."""
    return sum(map(set(q.tolist()).__contains__, p.tolist()))


def _on_diagonal(p: np.ndarray, q: np.ndarray, d: int, k: int = 3) -> list[tuple[int, int, int]]:
    """Equal runs of k words and more on one diagonal."""
    lo, hi = max(0, -d), min(len(p), len(q) - d)
    edge = np.diff(np.concatenate([[0], (p[lo:hi] == q[lo + d : hi + d]).astype(np.int8), [0]]))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = stop - start >= k
    return [(lo + i, lo + i + d, j - i) for i, j in zip(start[keep].tolist(), stop[keep].tolist(), strict=True)]


def _meet(p: np.ndarray, q: np.ndarray, k: int = 3) -> bool:
    """Whether two stretches have k words in a row in common."""
    return min(len(p), len(q)) >= k and not set(_grams(p, k).tolist()).isdisjoint(_grams(q, k).tolist())


def _repeats(p: np.ndarray, q: np.ndarray, k: int = 3) -> bool:
    """Whether a k-mer of both stands twice in one of them; else those that stand once are all there is."""
    gp, gq = _grams(p, k), _grams(q, k)
    (up, np_), (uq, nq) = (np.unique(g, return_counts=True) for g in (gp, gq))
    return bool(np.isin(up[np_ > 1], uq).any() or np.isin(uq[nq > 1], up).any())


def _joined_blocks(blocks: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    out, now = [], None
    for i, j, n in blocks:
        if now is not None:
            same = now[4] + n
            if same >= LEAST_SHARE * max(i + n - now[0], j + n - now[2]):
                now = (now[0], i + n, now[2], j + n, same)
                continue
            out.append(now)
        now = (i, i + n, j, j + n, n)
    if now is not None:
        out.append(now)
    return [r for r in out if min(r[1] - r[0], r[3] - r[2]) >= LEAST_WORDS]


def find_passages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(classes, passages): (doc_id, copy_of, n_words) a row per row of docs, and (a, b, a_start, a_stop, b_start, b_stop, same).

    a < b are the smallest doc_ids with their texts; starts and stops are word places. Null and
    empty texts have no passages and are copies of each other; a null doc_id stands in no passage
    unless a copy has an id; repeated rows are copies.
    """
    return _found(docs, doc_id, text)[:2]


CHAINS = "a long, b long, ax int, az int, bx int, bz int"


def _found(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """find_passages(), the components of its passages, and their SPANS."""
    spark = docs.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), t.alias("text")).withColumn("key", F.xxhash64("text", F.md5("text")))
    narrow = settle(rows.select("doc_id", "key", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words")))
    firsts = narrow.groupBy("key").agg(F.min("doc_id").alias("copy_of"))
    classes = narrow.join(firsts, "key").select("doc_id", "copy_of", "n_words", "key")
    n = partitions(spark)
    hot = hot_seeds(rows.select("key", "text"), n)
    seeds = rows.select("key", "text").mapInArrow(_dealt_seeds(np.array(sorted(hot), np.int64), FINE * n), PACKED)
    pairs = gathered(seeds).mapInArrow(_pair_rows(hot), "a long, b long, x int, y int")
    found = settle(_chained(pairs, n), freed=True)
    named, texts = firsts.where("copy_of is not null"), rows.withColumnRenamed("doc_id", "copy_of")
    places = found.where("bx = -1").groupBy(F.col("a").alias("key")).agg(F.collect_set("ax").alias("places"))
    held = places.join(named, "key").join(texts, ["copy_of", "key"])
    within = held.select("copy_of", "places", "text").mapInArrow(_window_stars, STARS)
    aligned = _aligned(found.where("bx >= 0"), named, texts, {key for key, _ in hot.values()}, n)
    passages = settle(aligned.unionByName(_merged_stars(within, n)), freed=True)
    roots = connected_components(passages.select("a", "b"))
    spans = settle(_spans(passages))
    unmet = settle(_unmet(found.where("bx = -2"), named, spans, roots, n), freed=True)
    if unmet.isEmpty():
        return classes, passages, roots, spans
    more = settle(_met(unmet, named, texts, spans, n), freed=True)
    # classes that the rest connects
    of = roots.select(F.col("node"), "root")
    ends = more.select("a", "b").distinct()
    for c in ("a", "b"):
        ends = ends.join(of.withColumnsRenamed({"node": c, "root": f"r{c}"}), c, "left")
    over = connected_components(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    both = roots.select("node", "root").unionByName(ends.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(roots, "node", "left_anti").withColumn("root", F.col("node")))
    both = both.join(over.select(F.col("node").alias("root"), F.col("root").alias("over")), "root", "left").select("node", F.coalesce("over", "root").alias("root"))
    own = spans.unionByName(_spans(more)).groupBy("copy_of").agg(F.min("partner").alias("partner"), F.flatten(F.collect_list("spans")).alias("spans"))
    return classes, passages.unionByName(more), settle(both), own.mapInArrow(_merged_spans, SPANS)


def _chained(pairs: DataFrame, n: int) -> DataFrame:
    found = pairs.repartition(n, "a", "b").sortWithinPartitions("a", "b", "x", "y").mapInArrow(_chain_rows, CHAINS)
    return found.withColumn("chain", F.xxhash64(*found.columns))


def _aligned(found: DataFrame, named: DataFrame, texts: DataFrame, pivots: set[int], n: int) -> DataFrame:
    """Passages around chains of the texts `named` by their keys."""
    sides = found.select(F.col("a").alias("key"), "chain", F.lit(0).alias("side"), F.col("ax").alias("x"), F.col("az").alias("z")).unionByName(
        found.select(F.col("b").alias("key"), "chain", F.lit(1).alias("side"), F.col("bx").alias("x"), F.col("bz").alias("z"))
    )
    # a text goes out once for all its chains; only the pivots of hot seeds may have very many, which are dealt apart
    part = F.when(F.col("key").isin(sorted(pivots)), F.pmod("chain", F.lit(SALTS))).otherwise(0) if pivots else F.lit(0)
    wanted = sides.groupBy("key", part.alias("part")).agg(F.collect_list(F.struct("chain", "side", "x", "z")).alias("chains")).join(named, "key")
    wide = wanted.join(texts, ["copy_of", "key"]).select("copy_of", "chains", "text")
    cut = wide.mapInArrow(_stretch_rows, "chain long, side int, doc long, start int, x int, z int, words binary")
    return cut.repartition(n, "chain").sortWithinPartitions("chain", "side").mapInArrow(_align_rows, "a long, b long, a_start int, a_stop int, b_start int, b_stop int, same int")


UNMET = "key long, step long, root long, x int, z int, covered boolean"


SPANS = "copy_of long, partner long, spans array<struct<s:int,e:int>>"


def _spans(passages: DataFrame) -> DataFrame:
    """SPANS of texts with passages: the smallest other text of one, and the words in passages as spans apart."""
    ends = passages.select(F.col("a").alias("copy_of"), F.col("b").alias("other"), F.col("a_start").alias("s"), F.col("a_stop").alias("e")).unionByName(
        passages.select(F.col("b").alias("copy_of"), F.col("a").alias("other"), F.col("b_start").alias("s"), F.col("b_stop").alias("e"))
    )
    # distinct starts and stops are at most a text's words each, however many partners there are
    starts = ends.groupBy("copy_of", "s").agg(F.max("e").alias("e"), F.min(F.when(F.col("copy_of") != F.col("other"), F.col("other"))).alias("partner"))
    return starts.groupBy("copy_of").agg(F.min("partner").alias("partner"), F.collect_list(F.struct("s", "e")).alias("spans")).mapInArrow(_merged_spans, SPANS)


def _merged_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2)
        sizes = np.diff(lists.offsets.to_numpy())
        s, e = (lists.flatten().field(k).to_numpy().astype(np.int64) for k in range(2))
        of = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((s, of))
        s, e = s[order], e[order]
        lift = of * (int(e.max(initial=0)) + 1)  # spans are sorted by text
        new = np.flatnonzero(np.append(True, (s + lift)[1:] > np.maximum.accumulate(e + lift)[:-1]) if len(s) else np.zeros(0, bool))
        stop = np.maximum.reduceat(e, new) if len(new) else e
        both = pa.StructArray.from_arrays([pa.array(s[new], pa.int32()), pa.array(stop, pa.int32())], names=["s", "e"])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(np.searchsorted(of[new], np.arange(len(sizes) + 1)), pa.int32()), both)], names=["copy_of", "partner", "spans"])


def _covered(spans: pa.Scalar, n: int) -> np.ndarray:
    """Whether passages have each of n places."""
    edge = np.zeros(n + 1, np.int64)
    if spans.is_valid:
        s, e = (np.minimum(spans.values.field(k).to_numpy(), n) for k in range(2))
        np.add.at(edge, s, 1)
        np.add.at(edge, e, -1)
    return np.cumsum(edge)[:n] > 0


def _unmet(seeds: DataFrame, named: DataFrame, spans: DataFrame, roots: DataFrame, n: int) -> DataFrame:
    """UNMET places of texts that share two seeds within REACH words, one of a run that _joined() doesn't pair in full, but where all are of one class and passages cover all places."""
    own = seeds.groupBy(F.col("a").alias("key")).agg(F.collect_list(F.struct(F.col("b").alias("seed"), F.col("ax").alias("at"), (F.col("az") == -2).alias("long"))).alias("seeds"), F.max(F.col("az") == -2).alias("any")).where("any")
    texts = own.join(named, "key").join(spans.drop("partner"), "copy_of", "left").join(roots.withColumnRenamed("node", "copy_of"), "copy_of", "left")
    near = texts.select("key", F.coalesce("root", "copy_of").alias("root"), "seeds", "spans").mapInArrow(_seed_steps(FINE * n), PACKED)
    return gathered(near).mapInArrow(_unmet_rows, UNMET)


def _met(unmet: DataFrame, named: DataFrame, texts: DataFrame, spans: DataFrame, n: int) -> DataFrame:
    """Passages of the stretches around UNMET places of one step."""
    wanted = unmet.groupBy("key").agg(F.collect_list(F.struct("step", "root", "x", "z", "covered")).alias("places")).join(named, "key").join(spans.drop("partner"), "copy_of", "left")
    wide = wanted.join(texts, ["copy_of", "key"]).select("copy_of", "places", "text", "spans")
    cut = wide.mapInArrow(_place_stretches, "step long, doc long, root long, covered boolean, start int, x int, z int, words binary, had binary")
    return cut.repartition(n, "step").sortWithinPartitions("step", "doc", "start").mapInArrow(_met_rows, "a long, b long, a_start int, a_stop int, b_start int, b_stop int, same int")


def _seed_steps(buckets: int):
    """Four numbers a step from a seed to another within REACH words: a hash of both, key, root, and place, step and whether passages cover it, from (key, root, seeds, spans)."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for key, root, seeds, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                seed, at, long = (seeds.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                order = np.argsort(at, kind="stable")
                seed, at, long = seed[order].view(np.uint64), at[order].astype(np.int64), long[order]
                covered = _covered(spans, int(at[-1]) + 1)[at]
                many = np.searchsorted(at, at + REACH) - np.arange(len(at)) - 1
                i = np.repeat(np.arange(len(at)), many)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
                use = (long[i] | long[j]) & (at[i] < at[j])
                i, j = i[use], j[use]
                if len(i):
                    both = (seed[i] * _MIX ^ seed[j]) * _MIX
                    both ^= both >> np.uint64(29)
                    both, x, z, had = _near_made_one(both, at[i], at[j], covered[i] & covered[j])
                    where = x << 32 | (z - x) << 1 | had
                    yield both >> np.uint64(20), np.stack([both.view(np.int64), np.full(len(x), key, np.int64), np.full(len(x), root, np.int64), where], axis=1)

    return lambda batches: dealt(blocks(batches), buckets)


def _near_made_one(step: np.ndarray, x: np.ndarray, z: np.ndarray, covered: np.ndarray) -> tuple[np.ndarray, ...]:
    """A text's places of steps, those of one step made one whose stretches _place_stretches() would: a run of one word or line has very many."""
    order = np.lexsort((x, step))
    step, x, z, covered = step[order], x[order], z[order], covered[order]
    lift = np.cumsum(np.concatenate([[False], step[1:] != step[:-1]])) * (int(z.max()) + K + 2 * MARGIN + 1)
    new = np.flatnonzero(np.concatenate([[True], (x + lift)[1:] > np.maximum.accumulate(z + lift)[:-1] + K + 2 * MARGIN]))
    return step[new], x[new], np.maximum.reduceat(z, new), np.minimum.reduceat(covered, new)


def _unmet_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All places of a step that two texts share, unless all are covered and of one root."""
    for rows in unpacked(batches, 4):
        rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
        step, key, root, where = rows.T
        new = np.concatenate([[True], step[1:] != step[:-1]])
        first, run = np.flatnonzero(new), np.cumsum(new) - 1
        covered = where & 1
        last = np.append(first[1:], len(rows)) - 1
        apart = np.minimum.reduceat(covered, first) == 0
        apart |= np.minimum.reduceat(root, first) != np.maximum.reduceat(root, first)
        i = np.flatnonzero((apart & (key[first] != key[last]))[run])
        x = where[i] >> 32
        cols = [key[i], step[i], root[i], x.astype(np.int32), (x + (where[i] >> 1 & 0x7FFFFFFF) + K).astype(np.int32), covered[i] == 1]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "step", "root", "x", "z", "covered"])


def _place_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(step, doc, root, covered, start, x, z, words, had) of each place, with a margin, those of a step that meet made one, from (copy_of, places, text, spans); `had` has a bit for each word, whether passages have it."""
    names = ["step", "doc", "root", "covered", "start", "x", "z", "words", "had"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    rows: list[tuple] = []
    size = 0

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        rows.clear()
        return made

    for batch in batches:
        for doc, places, words, spans in zip(batch.column(0).to_pylist(), batch.column(1), word_hashes(batch.column(2)), batch.column(3), strict=True):
            words, had = words.astype(np.uint32), _covered(spans, len(words))
            now = None
            for step, root, x, z, covered in [*sorted(tuple(p.values()) for p in places.as_py()), (None,) * 5]:
                if now is not None and step == now[0] and x - MARGIN <= now[5] + MARGIN:
                    now[3], now[5] = now[3] and covered, max(now[5], z)
                    continue
                if now is not None:
                    at = max(0, now[2] - MARGIN)
                    rows.append((now[0], doc, now[1], now[3], at, now[2], now[4], words[at : now[5] + MARGIN].tobytes(), np.packbits(had[at : now[5] + MARGIN]).tobytes()))
                    size += len(rows[-1][-2])
                now = [step, root, x, covered, z, z]
            if size > 1 << 22:
                yield out()
                size = 0
    if rows:
        yield out()


#: Stretches of one step that may share a k-mer and be compared for that; what more have counts as if all had it.
FEW = 32


def _compared(words: list[np.ndarray], k: int = 3, done: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j) of stretches, all that may_align() can hold for: they share a k-mer that FEW have, or those that more have would do on both sides.

    `done` numbers stretches of which those of one number need no comparison; below 0 they do.
    """
    n, sizes = len(words), np.array([len(w) for w in words])
    done = np.full(n, -1) if done is None else done
    if n <= FEW:
        i, j = np.triu_indices(n, 1)
        use = (done[i] != done[j]) | (done[i] < 0)
        yield i[use], j[use]
        return
    stop = np.cumsum(sizes)
    of = np.repeat(np.arange(n), sizes)
    grams = _grams(np.concatenate(words), k)
    at = np.flatnonzero(np.arange(len(grams)) + k <= stop[of[: len(grams)]])
    order = np.lexsort((of[at], grams[at]))
    gram, who, at = grams[at][order], of[at][order], at[order]
    new = np.concatenate([[True], gram[1:] != gram[:-1]])
    fresh = new | np.concatenate([[True], who[1:] != who[:-1]])
    run = np.cumsum(new) - 1
    have = np.bincount(run, fresh)
    common = (have > FEW)[run]
    covered = np.zeros(len(of), bool)
    for i in range(k):
        covered[at[common] + i] = True
    some = np.flatnonzero(fresh & ~common)
    few, few_run = who[some], run[some]
    many = np.searchsorted(few_run, few_run, side="right") - np.arange(len(few)) - 1
    codes = [np.zeros(0, np.int64)]
    for part in np.split(np.arange(len(few)), np.flatnonzero(np.diff(np.cumsum(many) // FLUSH)) + 1):
        left = np.repeat(part, many[part])
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(many[part]) - many[part], many[part])
        left, right = few[left], few[right]
        use = (done[left] != done[right]) | (done[left] < 0)
        codes.append(np.unique(left[use] * n + right[use]))
    code = np.unique(np.concatenate(codes))
    yield code // n, code % n
    heavy = np.flatnonzero(_long_enough(covered, sizes))
    if len(heavy) < 2:
        return
    # places in k-mers that many have, one at least in three of which one stretch must have of the other
    number = np.full(len(of), -1)
    number[at[common]] = np.unique(run[common], return_inverse=True)[1]
    least = LEAST_SHARE * LEAST_WORDS
    wide = max(1, (FLUSH * 100) // (int(number.max()) + 2))
    for s in range(1, len(heavy), wide):
        block = heavy[s : s + wide]
        has = np.zeros((len(block), int(number.max()) + 2), bool)
        for row, j in enumerate(block.tolist()):
            has[row, number[stop[j] - sizes[j] : stop[j]]] = True
        has[:, -1] = False  # of places in no such k-mer
        out, held = [], 0
        for i in heavy[: s + len(block) - 1].tolist():
            rows = np.flatnonzero((block > i) & ((done[block] != done[i]) | (done[i] < 0)))
            if not len(rows):
                continue
            own = number[stop[i] - sizes[i] : stop[i]]
            inside = has[rows[:, None], own]
            places = inside.copy()
            for m in range(1, k):
                places[:, m:] |= inside[:, :-m]
            j = block[rows[places.sum(axis=1) >= least]]
            out.append(np.stack([np.full(len(j), i), j]))
            held += len(j)
            if held >= FLUSH:
                yield tuple(np.concatenate(out, axis=1))
                out, held = [], 0
        if out:
            yield tuple(np.concatenate(out, axis=1))


def _met_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, doc, root, covered, start, x, z, data, had in _runs(batches, 1, 2):
        words = [np.frombuffer(w, np.uint32) for w in data]
        yield from _met_step(doc, root, covered, start, x, z, words, [np.unpackbits(np.frombuffer(h, np.uint8), count=len(w)).view(bool) for w, h in zip(words, had, strict=True)])


def _met_step(doc, root, covered, start, x, z, words, had) -> Iterator[pa.RecordBatch]:
    """Passages of the stretches of one step; two that passages have joined by now are left out if passages have all words from the first to the last that they share, `had` to begin with."""
    names, class_of = np.unique(root, return_inverse=True)
    top = list(range(len(names)))

    def find(a: int) -> int:
        while top[a] != a:
            top[a] = a = top[top[a]]
        return a

    ends = np.stack([x - start, z - start], axis=1)
    for i, j in _compared(words, done=np.where(covered, class_of, -1)):
        meet = doc[i] != doc[j]
        i, j = i[meet], j[meet]
        if not len(i):
            continue
        flip = doc[i] > doc[j]
        i, j = np.where(flip, j, i), np.where(flip, i, j)
        lengths = np.array([len(w) for w in words])
        for some in np.split(np.arange(len(i)), np.flatnonzero(np.diff(np.cumsum(lengths[i] + lengths[j]) // LOOKED_AT)) + 1):
            pairs = np.stack([i[some], j[some]], axis=1)
            looked = Looked([words[m] for m in pairs.ravel().tolist()], np.concatenate([ends[pairs[:, 0]], ends[pairs[:, 1]]], axis=1))
            rows = []
            for n in np.flatnonzero(looked.ok).tolist():
                a, b = pairs[n].tolist()
                if find(class_of[a]) == find(class_of[b]) and had[a][looked.reach(2 * n)].all() and had[b][looked.reach(2 * n + 1)].all():
                    continue
                for s, e, t, f, same in looked.passages(n):
                    rows.append((doc[a], doc[b], start[a] + s, start[a] + e, start[b] + t, start[b] + f, same))
                    top[find(class_of[a])] = find(class_of[b])
                    for m, low, high in ((a, s, e), (b, t, f)):
                        had[m][low:high] = True
            if rows:
                yield _passage_batch(rows)


def _passage_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64()] + [pa.int32()] * 5
    cols = list(zip(*rows, strict=True)) or [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["a", "b", "a_start", "a_stop", "b_start", "b_stop", "same"])


def _stretch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each chain's stretch, with a margin, as 32-bit hashes, a few megabytes at a time, from (copy_of, chains, text)."""
    names = ["chain", "side", "doc", "start", "x", "z", "words"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    for batch in batches:
        rows, size = [], 0
        for doc, chains_, words in zip(batch.column(0).to_pylist(), batch.column(1), word_hashes(batch.column(2)), strict=True):
            words = words.astype(np.uint32)
            for chain, side, x, z in zip(*(chains_.values.field(k).to_pylist() for k in range(4)), strict=True):
                s = max(0, x - MARGIN)
                rows.append((chain, side, doc, s, x, z, words[s : z + MARGIN].tobytes()))
                size += len(rows[-1][-1])
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def may_align(words: list[np.ndarray], k: int = 3) -> np.ndarray:
    """Of stretches, two a pair, whether each pair can have a passage; all at once.

    Equal runs grow from k words in a row, so both stretches need LEAST_WORDS places of which
    LEAST_SHARE are in k-mers of the other: a sum over a stretch that long, of what each place adds.
    """
    return Looked(words, k=k).ok


class Looked:
    """Stretches, two a pair, looked at together: `ok` is may_align(), `met` are the places in k-mers of the other.

    With chains (start and stop in either stretch) `plain` are pairs that only meet on their
    chain's diagonal, whose passages need no further alignment.
    """

    def __init__(self, words: list[np.ndarray], chains: np.ndarray | None = None, k: int = 3):
        self.words, self.chains, self.k = words, chains, k
        sizes = np.array([len(w) for w in words])
        stop, n = np.cumsum(sizes), int(sizes.sum())
        self.start, self.sizes = stop - sizes, sizes
        of = np.repeat(np.arange(len(sizes)), sizes)
        grams = _grams(np.concatenate(words), k)
        at = np.flatnonzero(np.arange(len(grams)) + k <= stop[of[: len(grams)]])
        pair = of[at] // 2
        code = grams[at] ^ pair.astype(np.uint64) * _MIX
        order = np.argsort(code)
        new = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) != 0])) if len(at) else np.zeros(0, np.int64)
        side = (of[at] & 1)[order]
        both = np.minimum.reduceat(side, new) != np.maximum.reduceat(side, new) if len(new) else np.zeros(0, bool)
        met = at[order[np.repeat(both, np.diff(np.append(new, len(at))))]]
        self.met = np.zeros(n, bool)
        for i in range(k):
            self.met[met + i] = True
        self.ok = _long_enough(self.met, sizes).reshape(-1, 2).all(axis=1)
        if chains is None or not len(at):
            self.plain = np.zeros(len(sizes) // 2, bool)
            return
        shift = chains[:, 2] - chains[:, 0]
        one = shift == chains[:, 3] - chains[:, 1]
        left = at[(of[at] & 1 == 0) & one[pair]]
        mate = left - self.start[of[left]] + shift[of[left] // 2]
        inside = (mate >= 0) & (mate <= sizes[of[left] + 1] - k)
        left, mate = left[inside], (mate + self.start[of[left] + 1])[inside]
        same = grams[left] == grams[mate]
        left, mate = left[same], mate[same]
        self.on = np.zeros(len(grams), bool)
        self.on[left] = self.on[mate] = True
        free = ~self.on[at][order]
        clash = np.logical_or.reduceat(free & (side == 0), new) & np.logical_or.reduceat(free & (side == 1), new)
        self.plain = np.zeros(len(sizes) // 2, bool)
        self.plain[of[left] // 2] = True
        self.plain[pair[order[new[clash]]]] = False
        line = np.zeros(n, bool)
        for i in range(k):
            line[left + i] = line[mate + i] = True
        self.ok &= ~self.plain | _long_enough(line, sizes).reshape(-1, 2).all(axis=1)

    def reach(self, m: int) -> slice:
        """From the first to the last place that is met, which no passage goes beyond."""
        met = np.flatnonzero(self.met[self.start[m] : self.start[m] + self.sizes[m]])
        return slice(int(met[0]), int(met[-1]) + 1) if len(met) else slice(0, 0)

    def passages(self, pair: int) -> list[tuple[int, int, int, int, int]]:
        """align() of a pair that is ok."""
        chain = self.chains[pair].tolist()
        if not self.plain[pair]:
            return align(self.words[2 * pair], self.words[2 * pair + 1], tuple(chain))
        at = self.start[2 * pair]
        edge = np.diff(np.concatenate([[0], self.on[at : at + self.sizes[2 * pair] - self.k + 1].view(np.int8), [0]]))
        start, stop = np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()
        return _joined_blocks([(i, i + chain[2] - chain[0], j - i + self.k - 1) for i, j in zip(start, stop, strict=True)])


def _long_enough(covered: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether LEAST_WORDS places and more in a row of each stretch, the first and the last among them, are covered to LEAST_SHARE."""
    stop = np.cumsum(sizes)
    start, n = stop - sizes, len(covered)
    of = np.repeat(np.arange(len(sizes)), sizes)
    add = round(1 / (1 - LEAST_SHARE)) - 1  # a place that differs takes what so many equal ones bring
    total = np.concatenate([[0], np.cumsum(np.where(covered, 1, -add))])
    lift = (total[start] + np.arange(len(sizes)) * 2 * (add + 1) * (int(sizes.max()) + 1))[of]  # a stretch's sums lie below those before it
    before, after = total[:-1] - lift, total[1:] - lift
    least = np.minimum.accumulate(np.where(covered, before, np.iinfo(np.int64).max))
    at = np.flatnonzero((np.arange(n) - start[of] >= LEAST_WORDS - 1) & covered)
    out = np.zeros(len(sizes), bool)
    out[of[at[after[at] >= least[at - (LEAST_WORDS - 1)]]]] = True
    return out


#: Words that are looked at together.
LOOKED_AT = 1 << 18


def _align_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    left = None
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        rows = []
        if held:
            looked = Looked([side[3] for pair in held for side in pair], np.array([(*a[4], *b[4]) for a, b in held]))
            for n in np.flatnonzero(looked.ok).tolist():
                a, b = held[n]
                rows += [(a[1], b[1], a[2] + i, a[2] + j, b[2] + k, b[2] + m, same) for i, j, k, m, same in looked.passages(n)]
        held.clear()
        return _passage_batch(rows)

    size = 0
    for batch in batches:
        for chain, side, doc, start, x, z, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            got = (chain, doc, start, np.frombuffer(words, np.uint32), (x - start, z - start))
            if side == 0:
                left = got
            elif left is not None and left[0] == chain and left[1] != doc:
                held.append((left, got) if left[1] < doc else (got, left))
                left = None  # repeated rows bring a stretch again
                size += len(held[-1][0][3]) + len(held[-1][1][3])
                if size >= LOOKED_AT:
                    yield out()
                    size = 0
    yield out()


STARS = "window long, a long, b long, a_start int, b_start int, n int"


def _window_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_stars() of the windows of LEAST_WORDS words that are anchored at given places of texts, FLUSH and more of them at a time."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def out() -> Iterator[pa.RecordBatch]:
        window, doc, start = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((start, doc, window))
        yield from _stars(window[order], doc[order], start[order])

    size = 0
    for batch in batches:
        for doc, places, words in zip(batch.column(0).to_pylist(), batch.column(1), word_hashes(batch.column(2)), strict=True):
            at = np.flatnonzero(np.isin(anchors_of_windows(words), places.values.to_numpy()))
            if len(at):
                held.append((stretch_hashes(prefix_sums(words), at, at + LEAST_WORDS).view(np.int64), np.full(len(at), doc, np.int64), at.astype(np.int32)))
                size += len(at)
            if size >= FLUSH:
                yield from out()
                size = 0
    if held:
        yield from out()


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns cut so that no run of equal first values is split."""
    held: list[list[np.ndarray]] = []
    for batch in _ended(batches):
        if batch is not None:
            cols = [c.to_numpy() for c in batch.columns]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            if not cut and held and held[-1][0][-1] == cols[0][0]:
                held.append(cols)
                continue
            done, held = [*held, [c[:cut] for c in cols]], [[c[cut:] for c in cols]]
        else:
            done, held = held, []
        if sum(len(d[0]) for d in done):
            yield [np.concatenate(c) for c in zip(*done, strict=True)]


def _star_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for columns in _whole_runs(batches):
        yield from _stars(*columns)


def _stars(window: np.ndarray, doc: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Windows, sorted, joined to the first of each run: rows of STARS of three kinds.

    Links have no window. A run's first text, which that of other runs elsewhere must meet, has no
    b, and n = 1 where another text here has the window. Further places in a text that alone has
    the window here keep the window, until it shows that a text elsewhere has it.
    """
    new = np.concatenate([[True], window[1:] != window[:-1]])
    first, run = np.flatnonzero(new), np.cumsum(new) - 1
    last = np.append(first[1:], len(window)) - 1
    many = doc[first] != doc[last]
    yield _star_batch(window[first], doc[first], None, start[first], None, many)
    link, more = ~new & many[run], ~new & ~many[run]
    at = first[run]
    yield _star_batch(None, *merge_windows(doc[at][link], doc[link], start[at][link].astype(np.int64), start[link].astype(np.int64)))
    yield _star_batch(window[more], doc[more], doc[more], start[at][more], start[more], np.full(more.sum(), LEAST_WORDS))


def merge_windows(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """(a, b, x, y, words) of equal windows, those that touch on one diagonal made one; a <= b."""
    flip = a > b
    a, b, x, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, y, x), np.where(flip, x, y)
    order = np.lexsort((x, x - y, b, a))
    a, b, x, y = a[order], b[order], x[order], y[order]
    if not len(a):
        return a, b, x, y, a
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | ((x - y)[1:] != (x - y)[:-1]) | (x[1:] > x[:-1] + LEAST_WORDS)])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(a)) - 1
    return a[at], b[at], x[at], y[at], x[last] - x[at] + LEAST_WORDS


def _star_batch(window, a, b, x, y, n) -> pa.RecordBatch:
    rows = len(a)
    cols = [(window, pa.int64()), (a, pa.int64()), (b, pa.int64()), (x, pa.int32()), (y, pa.int32()), (n, pa.int32())]
    return pa.RecordBatch.from_arrays([pa.nulls(rows, t) if c is None else pa.array(c.astype(t.to_pandas_dtype())) for c, t in cols], names=["window", "a", "b", "a_start", "b_start", "n"])


def _merged_stars(within: DataFrame, n: int) -> DataFrame:
    """Passages of equal windows: the tasks' own, and those of the tasks' firsts, of which a task sends one a window; a may be b, for further places."""
    within = settle(within, freed=True)
    firsts = within.where("b is null").select("window", F.col("a").alias("doc"), F.col("a_start").alias("start"))
    across = settle(firsts.repartition(n, "window").sortWithinPartitions("window", "doc", "start").mapInArrow(_star_rows, STARS), freed=True)
    shared = across.where("b is null and n = 1").select("window")
    again = within.where("b is not null and window is not null").join(shared, "window", "left_semi")
    linked = "window is null and b is not null"
    own = within.where(linked).unionByName(across.where(linked)).unionByName(again.select(*within.columns))
    end = lambda c: (F.col(c) + F.col("n")).cast("int")
    return own.select("a", "b", "a_start", end("a_start").alias("a_stop"), "b_start", end("b_start").alias("b_stop"), F.col("n").alias("same"))


def op10_collinear_chains(spark, sf_dir: str) -> DataFrame:
    """A row per document: its class (documents that passages or copies connect), its links, and its passages as merged word spans."""
    return summarise(*_found(read_table(spark, sf_dir, "documents")))


def summarise(classes: DataFrame, passages: DataFrame, roots: DataFrame | None = None, spans: DataFrame | None = None) -> DataFrame:
    """(doc_id, class_id, copy_of, n_links, partner_id, n_words, passage_words, passages) from find_passages().

    n_links is the number of other texts in the class; partner_id the smallest that a passage was found with.
    """
    roots = connected_components(passages.select("a", "b")) if roots is None else roots
    spans = _spans(passages) if spans is None else spans
    sizes = roots.groupBy("root").agg((F.count("*") - 1).alias("n_links"))
    info = spans.where("partner is not null").join(roots.select(F.col("node").alias("copy_of"), F.col("root")).join(sizes, "root"), "copy_of")
    info = info.select(
        "copy_of", "root", "n_links", F.col("partner").alias("partner_id"),
        F.aggregate("spans", F.lit(0), lambda a, x: a + x["e"] - x["s"]).cast("long").alias("passage_words"),
        F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["s"], x["e"])), ",").alias("passages"),
    )
    return classes.join(info, "copy_of", "left").select(
        "doc_id",
        F.coalesce("root", "copy_of").alias("class_id"),
        "copy_of",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "partner_id",
        "n_words",
        F.coalesce("passage_words", F.lit(0)).cast("long").alias("passage_words"),
        F.coalesce("passages", F.lit("")).alias("passages"),
    )
