"""One job's candidates as arrays: a job's rows meet once, by their job, and every policy, pair list and score is made from that.

Tokens are made by the column expressions; a term's code is its rank among the job's terms, so codes sort as terms do.
Rows of similarity, growth and links are made when a candidate is taken, not for all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evispan.functions.text import STOP_WORDS, word_tokens
from evispan.operators import lexical

PLACES = 9
K1, B = 0.9, 0.4
#: Cells of a dense block, rows of a batch that is handed on, triples that are kept between rounds.
CELLS, ROWS, KEPT = 4_000_000, 1_000_000, 500_000
SLACK = 1e-8


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def scaled(x: np.ndarray, places: int = PLACES) -> np.ndarray:
    low, high = x.min(), x.max()
    return np.round((x - low) / (high - low), places) if high > low else np.zeros(len(x))


class Job:
    """rows: (pos, words and, if they are needed, title_words, tokens, sha256); asked: the question's different terms."""

    def __init__(self, rows: pa.Table, asked: list[str] = ()):
        rows = rows.sort_by("pos")
        self.n, self.pos = len(rows), rows["pos"].to_numpy()
        if "tokens" in rows.column_names:
            self.cost = rows["tokens"].to_numpy().astype(np.int64)
            self.body = np.unique(np.array(rows["sha256"].to_pylist(), dtype=object).astype(str), return_inverse=True)[1]
        words = [rows[c] for c in ("words", "title_words") if c in rows.column_names]
        flat = pa.concat_arrays([pa.concat_arrays([x.flatten() for x in w.chunks]) for w in words])
        made = flat.dictionary_encode()
        order = pc.sort_indices(made.dictionary)
        self.terms = made.dictionary.take(order)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        codes = rank[made.indices.to_numpy()]
        sizes = [pc.fill_null(pc.list_value_length(w), 0).to_numpy().astype(np.int64) for w in words]
        self.size = sizes[0]
        self.codes, self.title_codes = codes[: self.size.sum()], codes[self.size.sum() :]
        self.title_size = sizes[1] if len(sizes) > 1 else None
        v = max(1, len(self.terms))
        key, self.tf = np.unique(np.repeat(np.arange(self.n), self.size) * v + self.codes, return_counts=True)
        self.doc, self.term = key // v, key % v
        self.df = np.bincount(self.term, minlength=v)
        by = np.argsort(self.term, kind="stable")
        self.post, self.post_at = by, np.append(0, np.cumsum(self.df))
        at = pc.index_in(pa.array(list(asked), pa.string()), self.terms).to_pylist()
        self.asked, self.n_terms = [t for t in at if t is not None], max(1, len(at))
        self.row_at = np.searchsorted(self.doc, np.arange(self.n + 1))

    def bm25(self, terms) -> np.ndarray:
        out, mean = np.zeros(self.n), self.size.mean()
        for t in terms:
            e = self.post[self.post_at[t] : self.post_at[t + 1]]
            tf, d = self.tf[e], self.doc[e]
            out[d] += np.log(1 + (self.n - self.df[t] + 0.5) / (self.df[t] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * self.size[d] / mean))
        return out

    def relevance(self) -> np.ndarray:
        return scaled(self.bm25(self.asked))

    def covers(self) -> np.ndarray:
        """A row of bits for each candidate: the question's terms that it has."""
        out = np.zeros((self.n, max(1, -(-len(self.asked) // 64))), np.uint64)
        for k, t in enumerate(self.asked):
            out[self.doc[self.post[self.post_at[t] : self.post_at[t + 1]]], k // 64] |= np.uint64(1 << k % 64)
        return out

    def weigh(self) -> None:
        """TF-IDF entries of unit rows without stop words: w_doc, w_term, w, and where rows begin."""
        keep = ~pc.is_in(self.terms, pa.array(STOP_WORDS)).to_numpy(zero_copy_only=False)
        keep = keep[self.term] if len(self.terms) else np.zeros(0, bool)
        self.w_doc, self.w_term = self.doc[keep], self.term[keep]
        w = self.tf[keep] * (np.log((1 + self.n) / (1 + self.df[self.w_term])) + 1)
        self.w = w / np.sqrt(np.bincount(self.w_doc, w * w, self.n))[self.w_doc]
        self.w_at = np.searchsorted(self.w_doc, np.arange(self.n + 1))

    def similar(self, i: int) -> np.ndarray:
        """Cosines of candidate i with all, itself 0."""
        own = slice(self.w_at[i], self.w_at[i + 1])
        line = np.zeros(len(self.df))
        line[self.w_term[own]] = self.w[own]
        out = np.round(np.bincount(self.w_doc, self.w * line[self.w_term], self.n), PLACES)
        out[i] = 0
        return out

    def heavy(self, i: int, k: int = 8) -> np.ndarray:
        """The k heaviest terms of candidate i, by weight and then term."""
        own = slice(self.w_at[i], self.w_at[i + 1])
        return self.w_term[own][np.lexsort((self.w_term[own], -np.round(self.w[own], PLACES)))[:k]]

    def grown(self, i: int, places: int = PLACES) -> np.ndarray | None:
        """Scaled BM25 of candidate i's heavy terms for all candidates; None without terms."""
        terms = self.heavy(i)
        return scaled(self.bm25(terms), places) if len(terms) else None

    def cosines(self, members: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, columns, block of cosines) with rows before columns or on the diagonal; members (all) are places in a chosen order.

        Terms of many postings are multiplied as dense blocks, the others by their pairs of postings.
        """
        members = np.arange(self.n) if members is None else members
        m = len(members)
        place = np.full(self.n, -1)
        place[members] = np.arange(m)
        keep = place[self.w_doc] >= 0
        doc, term, w = place[self.w_doc[keep]], self.w_term[keep], self.w[keep]
        df = np.bincount(term, minlength=len(self.df))
        often = df > max(8, m // 48)  # a dense column costs m * m / 2 products, some 50 times cheaper each
        column = np.cumsum(often) - 1
        dense, rare = often[term], ~often[term] & (df[term] > 1)
        step = max(1, min(m, CELLS // max(1, m)))
        by = np.argsort(doc[dense], kind="stable")
        dd, dt, dw = doc[dense][by], column[term[dense][by]], w[dense][by]
        width = int(often.sum())

        def block(lo: int, hi: int) -> np.ndarray:
            a, b = np.searchsorted(dd, (lo, hi))
            out = np.zeros((hi - lo, width))
            out[dd[a:b] - lo, dt[a:b]] = dw[a:b]
            return out

        # rare terms: each posting with the later ones of its term
        by = np.lexsort((doc[rare], term[rare]))
        rd, rt, rw = doc[rare][by], term[rare][by], w[rare][by]
        last = np.searchsorted(rt, rt, side="right")
        first = np.argsort(rd, kind="stable")
        for lo in range(0, m, step):
            hi = min(m, lo + step)
            out = np.zeros((hi - lo, m))
            if width:
                mine = block(lo, hi)
                for c in range(lo, m, step):
                    out[:, c : min(m, c + step)] = mine @ block(c, min(m, c + step)).T
            a, b = np.searchsorted(rd[first], (lo, hi))
            mine = first[a:b]
            for k in range(0, len(mine), 50_000):
                some = mine[k : k + 50_000]
                later = ranges(some + 1, last[some] - some - 1)
                left = np.repeat(some, last[some] - some - 1)
                out += np.bincount((rd[left] - lo) * m + rd[later], rw[left] * rw[later], (hi - lo) * m).reshape(hi - lo, m)
            yield np.arange(lo, hi), np.arange(m), out

    def mentions(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs i < j of which one's title, of four characters or more, is in the other's words."""
        chars = pc.utf8_length(self.terms).to_numpy() if len(self.terms) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(self.n), self.title_size)
        long_ = np.bincount(owner, chars[self.title_codes], self.n) >= 4
        starts, t_starts = np.cumsum(self.size) - self.size, np.cumsum(self.title_size) - self.title_size
        found = [np.zeros(0, np.int64)]
        v = max(1, len(self.terms))
        for m in np.unique(self.title_size[long_ & (self.title_size > 0)]):
            named = np.flatnonzero(long_ & (self.title_size == m))
            room = np.maximum(0, self.size - m + 1)
            at, d = ranges(starts, room), np.repeat(np.arange(self.n), room)
            grams, phrases = self.codes[at], self.title_codes[t_starts[named]]
            for k in range(1, m):
                if k > 1:  # else keys outgrow 64 bits
                    both = np.unique(np.append(grams, phrases), return_inverse=True)[1]
                    grams, phrases = both[: len(grams)], both[len(grams) :]
                grams, phrases = grams * v + self.codes[at + k], phrases * v + self.title_codes[t_starts[named] + k]
            order = np.argsort(phrases, kind="stable")
            named, phrases = named[order], phrases[order]
            keys, begin, many = np.unique(phrases, return_index=True, return_counts=True)
            slot = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            met = np.unique(d[keys[slot] == grams] * len(keys) + slot[keys[slot] == grams])
            q, slot = met // len(keys), met % len(keys)
            p, q = named[ranges(begin[slot], many[slot])], np.repeat(q, many[slot])
            found.append(np.unique(np.minimum(p, q)[p != q] * self.n + np.maximum(p, q)[p != q]))
        pairs = np.unique(np.concatenate(found))
        return pairs // self.n, pairs % self.n


class Links:
    """Undirected pairs as sorted neighbour lists."""

    def __init__(self, n: int, i: np.ndarray, j: np.ndarray):
        self.i, self.j = i, j
        a, b = np.append(i, j), np.append(j, i)
        order = np.lexsort((b, a))
        self.near, self.at = b[order], np.searchsorted(a[order], np.arange(n + 1))

    def of(self, i: int) -> np.ndarray:
        return self.near[self.at[i] : self.at[i + 1]]


def rank(job: Job, rel: np.ndarray, budget: int, open_: np.ndarray) -> tuple[list[int], int, int]:
    spent, seen, out = 0, set(), []
    for i in np.lexsort((np.arange(job.n), job.cost, -rel)):
        if open_[i] and spent + job.cost[i] <= budget and job.body[i] not in seen:
            spent += int(job.cost[i])
            seen.add(job.body[i])
            out.append(int(i))
    return sorted(out), spent, len(out)


class Search:
    """A job's candidates under one policy and budget. Bundles are single candidates, linked pairs, and triples with two links.

    What a unit's price or bodies bar stays barred, and a triple's value only falls, as its links count in full from the start:
    so triples are listed down to a bound, and listed again only when no unit reaches that bound.
    """

    def __init__(self, job: Job, policy: str, budget: int, rel: np.ndarray, covers: np.ndarray | None, links: Links | None, near: Callable[[int], np.ndarray] | None, open_: np.ndarray):
        self.job, self.policy, self.rel, self.covers, self.links, self.near = job, policy, rel, covers, links, near
        self.left, self.open = budget, open_.copy()
        n = job.n
        self.close, self.grown, self.touched = np.zeros(n), np.zeros(n), np.zeros(n, bool)
        self.met = np.zeros(1 if covers is None else covers.shape[1], np.uint64)
        self.bundles = policy.endswith("bundle")
        if self.bundles:
            self.pairs = np.stack([links.i, links.j], axis=1)
            self.triples, self.bound = np.zeros((0, 3), np.int64), np.inf

    def gain(self, *members: np.ndarray) -> np.ndarray:
        held = self.covers[members[0]]
        for x in members[1:]:
            held = held | self.covers[x]
        return np.bitwise_count(held & ~self.met).sum(axis=1, dtype=np.int64) / self.job.n_terms

    def value(self, units: np.ndarray) -> np.ndarray:
        """Of units of one size each."""
        price, size = self.job.cost[units].sum(axis=1).astype(float), units.shape[1]
        if not self.bundles:
            one = units[:, 0]
            if self.policy == "iterative":
                return 0.6 * self.rel[one] + 0.4 * self.grown[one]
            if self.policy.startswith("mmr"):
                plain = 0.7 * self.rel[one] - 0.3 * self.close[one]
                return plain / np.sqrt(price) if self.policy == "mmr_per_cost" else plain
            return (self.rel[one] + 0.35 * self.gain(one) + 0.3 * self.touched[one]) / price**0.25
        rel = self.rel[units]
        best = rel.max(axis=1)
        rest = (rel.sum(axis=1) - best) / max(1, size - 1)
        linked = self.touched[units[:, 0]] if size == 1 else np.ones(len(units))
        return (best + 0.25 * rest + 0.35 * self.gain(*units.T) + 0.3 * linked) / price**0.25

    def allowed(self, units: np.ndarray) -> np.ndarray:
        units = units[self.open[units].all(axis=1) & (self.job.cost[units].sum(axis=1) <= self.left)]
        bodies = np.sort(self.job.body[units], axis=1)
        return units[(bodies[:, 1:] != bodies[:, :-1]).all(axis=1)]

    def first(self, units: np.ndarray) -> tuple | None:
        """The best of units as a key that sorts before all worse ones."""
        if not len(units):
            return None
        value, price = np.round(self.value(units), PLACES), self.job.cost[units].sum(axis=1)
        units, price = units[top := np.flatnonzero(value == value.max())], price[top]
        k = np.lexsort((*units.T[::-1], *(() if self.policy == "mmr" else (price,))))[0]
        return (-value.max(), 0 if self.policy == "mmr" else int(price[k]), tuple(units[k].tolist()) + (self.job.n,) * (3 - units.shape[1]))

    def list_triples(self, bound: float) -> None:
        """Triples with two links of value `bound` or more, center by center; neighbours go first that can't reach it."""
        cost, rel, n = self.job.cost, self.rel, self.job.n
        edges = self.edges
        v, a = np.append(edges[:, 0], edges[:, 1]), np.append(edges[:, 1], edges[:, 0])
        part = self.gain(np.arange(n))
        for _ in range(3):
            high, more, low = np.zeros(n), np.zeros(n), np.full(n, np.iinfo(np.int64).max // 4)
            np.maximum.at(high, v, rel[a])
            np.maximum.at(more, v, part[a])
            np.minimum.at(low, v, cost[a])
            price = cost[v] + cost[a] + low[v]
            best = np.maximum(np.maximum(rel[v], rel[a]), high[v])
            most = best * 0.875 + 0.125 * (rel[v] + rel[a] + high[v]) + 0.35 * np.minimum(1, part[v] + part[a] + more[v]) + 0.3
            keep = (price <= self.left) & (most / price.astype(float) ** 0.25 >= bound - SLACK)
            v, a = v[keep], a[keep]
        order = np.argsort(v, kind="stable")
        v, a = v[order], a[order]
        found, count = [], 0
        begin = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else []
        for s, e in zip(begin, np.append(begin[1:], len(v)) if len(v) else [], strict=True):
            own, c = a[s:e], v[s]
            step = max(1, CELLS // len(own))
            for k in range(0, len(own), step):
                x, y = np.nonzero(np.arange(k, min(len(own), k + step))[:, None] < np.arange(len(own))[None])
                x, y = own[x + k], own[y]
                keep = cost[x] + cost[y] + cost[c] <= self.left
                units = self.allowed(np.sort(np.stack([np.full(keep.sum(), c), x[keep], y[keep]], axis=1), axis=1))
                value = self.value(units)
                found.append((units[value >= bound], value[value >= bound]))
                count += len(found[-1][0])
            if count > 2 * KEPT:
                units, value = np.concatenate([u for u, _ in found]), np.concatenate([x for _, x in found])
                bound = max(bound, np.partition(value, len(value) - KEPT)[len(value) - KEPT])
                found = [(units[value >= bound], value[value >= bound])]
                count = len(found[0][0])
        self.triples = np.concatenate([u for u, _ in found]) if found else np.zeros((0, 3), np.int64)
        self.bound = bound

    def best(self) -> tuple | None:
        keys = [self.first(self.allowed(np.flatnonzero(self.open)[:, None]))]
        if self.bundles and keys[0] is not None:
            self.pairs = self.allowed(self.pairs)
            keys.append(self.first(self.pairs))
            if keys[1] is not None:
                self.triples = self.allowed(self.triples)
                keys.append(self.first(self.triples))
                if -min(k for k in keys if k)[0] < self.bound + SLACK and self.bound > -np.inf:
                    top = -min(k for k in keys[:2] if k)[0]
                    self.edges = self.allowed(np.stack([self.links.i, self.links.j], axis=1))
                    self.list_triples(0.8 * top if self.bound > 0.8 * top + SLACK else -np.inf)
                    keys[2] = self.first(self.triples)
        return min((k for k in keys if k), default=None)

    def take(self, members: list[int]) -> None:
        self.left -= int(self.job.cost[members].sum())
        self.open &= ~np.isin(self.job.body, self.job.body[members])
        for i in members:
            if self.policy in ("singleton", "bundle", "similarity_bundle"):
                self.met |= self.covers[i]
                near = self.near(i)
                self.touched[near] = True
                if self.bundles:  # what a triple with i leaves
                    near = near[self.open[near]]
                    x, y = np.nonzero(np.arange(len(near))[:, None] < np.arange(len(near))[None])
                    self.pairs = np.concatenate([self.pairs, self.allowed(np.sort(np.stack([near[x], near[y]], axis=1), axis=1))])
            elif self.policy == "iterative":
                if (line := self.job.grown(i)) is not None:
                    self.grown = np.maximum(self.grown, line)
            else:
                self.close = np.maximum(self.close, self.job.similar(i))

    def run(self) -> tuple[list[int], int, int]:
        budget, chosen, steps = self.left, [], 0
        while (key := self.best()) is not None:
            members = [i for i in key[2] if i < self.job.n]
            self.take(members)
            chosen += members
            steps += 1
        return sorted(chosen), budget - self.left, steps


def alike(job: Job, budget: int, least: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of candidates that fit the budget together, with a similarity of `least` or more."""
    members = np.argsort(job.cost, kind="stable")
    members = members[job.cost[members] <= budget]
    found = [np.zeros((2, 0), np.int64)]
    for rows, columns, block in job.cosines(members):
        x, y = np.nonzero((np.round(block, PLACES) >= least) & (rows[:, None] < columns[None]))
        i, j = members[rows[x]], members[columns[y]]
        keep = job.cost[i] + job.cost[j] <= budget
        found.append(np.sort(np.stack([i[keep], j[keep]]), axis=0))
    return tuple(np.concatenate(found, axis=1))


def choose(job: Job, plans: list[tuple[str, int]], pool: set[int] | None = None) -> list[tuple[str, int, list[int], int, int]]:
    """(policy, budget, chosen places, spent, steps) for each policy and budget, what they share made once."""
    rel, kinds = job.relevance(), {p for p, _ in plans}
    open_ = np.ones(job.n, bool) if pool is None else np.isin(job.pos, list(pool))
    covers = job.covers() if kinds & {"singleton", "bundle", "similarity_bundle"} else None
    named = Links(job.n, *job.mentions()) if kinds & {"singleton", "bundle"} else None
    if kinds & {"mmr", "mmr_per_cost", "iterative", "similarity_bundle"}:
        job.weigh()
    out = []
    for policy, budget in plans:
        if policy == "rank":
            out.append((policy, budget, *rank(job, rel, budget, open_)))
            continue
        links, near = named, named.of if named else None
        if policy == "similarity_bundle":
            links, near = Links(job.n, *alike(job, budget)), lambda i: np.flatnonzero(job.similar(i) >= 0.2)
        out.append((policy, budget, *Search(job, policy, budget, rel, covers, links, near, open_).run()))
    return out


def rows_of(docs: DataFrame, titles: bool = True, costs: bool = True) -> DataFrame:
    """(job_id, pos, words and title_words, tokens, sha256 if asked for)."""
    more = [word_tokens(F.col("title")).alias("title_words")] * titles + [F.col("tokens").cast("long").alias("tokens"), F.col("sha256")] * costs
    return docs.select("job_id", "pos", word_tokens(F.concat_ws("\n", "title", "text")).alias("words"), *more)


def select_jobs(jobs: DataFrame, docs: DataFrame, plans: list[tuple[str, int]], pool: DataFrame | None = None) -> DataFrame:
    """(job_id, policy, cap, selected, spent, steps): every job by every policy and budget, from one shuffle of the texts."""
    rows = rows_of(docs)
    if pool is not None:
        rows = rows.join(pool.select("job_id", "pos").distinct().withColumn("pooled", F.lit(True)), ["job_id", "pos"], "left")
    kind = T.StructType([docs.schema["job_id"], *T.StructType.fromDDL("policy string, cap int, selected string, spent long, steps int").fields])
    pooled = pool is not None

    def run(key, own: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(own):
            return pa.Table.from_pylist([], schema=SCHEMA.insert(0, own.schema.field("job_id")))
        job = Job(own, sorted(asked["term"].to_pylist()))
        allowed = set(own.filter(pc.fill_null(own["pooled"], False))["pos"].to_pylist()) if pooled else None
        found = [{"job_id": key[0].as_py(), "policy": p, "cap": cap, "selected": ",".join(map(str, job.pos[got].tolist())), "spent": spent, "steps": steps} for p, cap, got, spent, steps in choose(job, plans, allowed)]
        return pa.Table.from_pylist(found, schema=SCHEMA.insert(0, own.schema.field("job_id")))

    asked = lexical.query_terms(jobs).groupBy("job_id")
    return rows.groupBy("job_id").cogroup(asked).applyInArrow(run, kind)


SCHEMA = pa.schema([("policy", pa.string()), ("cap", pa.int32()), ("selected", pa.string()), ("spent", pa.int64()), ("steps", pa.int32())])


def _each(docs: DataFrame, fields: str, make: Callable[[Job], Iterator[tuple[np.ndarray, ...]]], titles: bool = False) -> DataFrame:
    """(job_id, fields): what make() yields for each job, in batches."""
    kind = T.StructType([docs.schema["job_id"], *T.StructType.fromDDL(fields).fields])
    names = kind.names

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job = Job(pa.Table.from_batches(list(batches)))
        for columns in make(job):
            for k in range(0, len(columns[0]), ROWS):
                some = [pa.array(c[k : k + ROWS]) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.repeat(key[0], len(some[0])), *some], names)

    return rows_of(docs, titles, costs=False).groupBy("job_id").applyInArrow(run, kind)


def cosine_pairs(docs: DataFrame, places: int = PLACES) -> DataFrame:
    """(job_id, i, j, sim) with i < j for pairs that share a term."""

    def make(job: Job):
        job.weigh()
        pos = job.pos.astype(np.int32)
        for rows, columns, block in job.cosines():
            x, y = np.nonzero((block > 0) & (rows[:, None] < columns[None]))
            yield pos[rows[x]], pos[columns[y]], np.round(block[x, y], places)

    return _each(docs, "i int, j int, sim double", make)


def mention_graph(docs: DataFrame) -> DataFrame:
    """(job_id, i, j) with i < j where either's title, of four characters or more, is mentioned in the other's body."""

    def make(job: Job):
        pos = job.pos.astype(np.int32)
        i, j = job.mentions()
        yield pos[i], pos[j]

    return _each(docs, "i int, j int", make, titles=True)


def expansion(docs: DataFrame, places: int = PLACES) -> DataFrame:
    """(job_id, source, pos, score): BM25 of each candidate's heavy terms over its job, scaled by source; no rows without terms."""

    def make(job: Job):
        job.weigh()
        pos, step = job.pos.astype(np.int32), max(1, ROWS // job.n)
        for lo in range(0, job.n, step):
            lines = [(i, line) for i in range(lo, min(job.n, lo + step)) if (line := job.grown(i, places)) is not None]
            if lines:
                yield pos[np.repeat([i for i, _ in lines], job.n)], np.tile(pos, len(lines)), np.concatenate([x for _, x in lines])

    return _each(docs, "source int, pos int, score double", make)
