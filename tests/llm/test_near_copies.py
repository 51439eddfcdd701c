"""Near copies at five words, and the pipeline's stages on odd tables."""

import random
from collections import Counter

import numpy as np

import corpus_pipeline
from evispan.llm import simhash


def shingles(t):
    w = (t or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def alike(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"e{rng.randrange(10**6)}"
    return out


def corpus(seed=31):
    rng = random.Random(seed)
    rows = []
    for g in range(60):
        own = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((80, 150, 400)))]
        for e in range(rng.choice((1, 2, 4))):
            rows.append((len(rows), " ".join(edited(rng, own, e and rng.randrange(1, 1 + len(own) // 60)))))
    return rows


def test_block_anchors_lose_no_pair_at_two_bits():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 31, 400, dtype=np.uint64)
    for flips in ((), (0,), (30,), (3, 17), (0, 30)):
        y = x.copy()
        for k in flips:
            y ^= np.uint64(1 << k)
        sides = []
        for v in (x, y):
            where = {}
            for row, a in zip(*(c.tolist() for c in simhash.block_anchors(v)), strict=True):
                where.setdefault(row, set()).add(a)
            sides.append(where)
        assert all(sides[0][i] & sides[1][i] for i in range(400))
        assert {len(v) for v in sides[0].values()} <= {1, 16}


def test_sketch_links_connect_what_chains_of_near_rows_do():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, (40, 2), dtype=np.uint64)
    run = np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 63, (40, 2)).astype(np.uint64)) for _ in range(20)]])
    for limit in (2, 3, 40):
        want, got = list(range(len(run))), list(range(len(run)))

        def union(r, i, j):
            while r[i] != i:
                i = r[i]
            while r[j] != j:
                j = r[j]
            r[max(i, j)] = min(i, j)

        near = np.bitwise_count(run[:, None] ^ run[None]).sum(axis=2) <= limit
        for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
            union(want, int(i), int(j))
        links = simhash.sketch_links(run, limit)
        for i, j in links:
            assert near[i, j]
            union(got, i, j)
        top = lambda r, i: i if r[i] == i else top(r, r[i])
        assert [top(want, i) for i in range(len(run))] == [top(got, i) for i in range(len(run))] and len(links) < len(run)


def test_near_copies_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for hot in (simhash.HOT, 2):  # with every anchor hot, a text still meets its copies
        root = {r["doc_id"]: r["root"] for r in simhash.near_copies(docs, hot=hot).collect()}
        pairs = [(i, j, alike(a, b)) for i, a in rows for j, b in rows if i < j]
        close = [(i, j) for i, j, s in pairs if s >= 0.8]
        assert len(close) > 50 and sum(root[i] == root[j] for i, j in close) >= 0.95 * len(close)
        assert not any(root[i] == root[j] for i, j, s in pairs if s < 0.3)


def test_a_hot_anchor_loses_no_pair(spark, monkeypatch):
    rng = np.random.default_rng(3)
    lanes = rng.integers(0, 1 << 63, (300, simhash.LANES), dtype=np.uint64)
    lanes[:, simhash.SKETCH] &= np.uint64(((1 << 31) - 1) << 32)  # all meet at one anchor of the first block, and hardly elsewhere
    for i in range(0, 240, 2):
        lanes[i + 1, :2] = lanes[i, :2] ^ np.uint64(0b1011 << int(rng.integers(0, 60)))
    lanes[240:, :2] = lanes[240, :2] ^ (np.uint64(1) << rng.integers(0, 64, (60, 2)).astype(np.uint64))
    rows = [(f"{i}", i, *map(int, r)) for i, r in enumerate(lanes.view(np.int64))]
    wide = spark.createDataFrame(rows, "rk string, doc_id long, " + ", ".join(f"l{k} long" for k in range(simhash.LANES)))
    monkeypatch.setattr(simhash, "_with_wide", lambda docs, shingle: wide)
    docs = spark.createDataFrame([(1, "")], "doc_id long, text string")
    for hot in (simhash.HOT, 2):
        root = {r["doc_id"]: r["root"] for r in simhash.near_copies(docs, hot=hot).collect()}
        assert len(root) == 300 and len(set(root.values())) == 121
        assert all(root[i] == root[i + 1] for i in range(0, 240, 2)) and len({root[i] for i in range(240, 300)}) == 1


def test_one_row_of_each_group_stays(spark):
    x, y, z = (" ".join(f"{c}{k}" for k in range(60)) for c in "xyz")
    rows = [(1, x, "p"), (5, x, "q"), (5, y, "r"), (7, z, "s"), (7, z, "s"), (None, x, "t"), (None, "lone word here", "u"), (9, None, "v"), (8, "", "w"), (8, " \n", "w2")]
    docs = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "doc_id long, text string, _rk string, root string, score double")
    kept = simhash.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    none = [k for k in got if not (k[1] or "").strip()]
    assert got[1, x] == got[5, y] == got[7, z] == got[None, "lone word here"] == 1 and len(none) == 1 and none[0][0] == 8
    assert sum(got.values()) == 5
    assert simhash.keep_one_per_group(docs.where("false")).count() == 0


def test_pipeline_on_odd_tables(spark, tmp_path):
    rng = random.Random(5)
    good = [" ".join(rng.choice(["the", "river", "of", "stone", "moon", "light"]) + str(rng.randrange(50)) for _ in range(90)) for _ in range(40)]
    bad = [" ".join(rng.choice(["BUY!!", "NOW!!", "$$$"]) for _ in range(90)) for _ in range(40)]
    rows = [(i, t, "en", "a" if i % 3 else None, len(t), "x", "y", 0.5) for i, t in enumerate(good + bad)]
    rows += [rows[0], (100, good[1], "en", "a", None, "x", "y", 0.5), (None, None, None, None, None, None, None, None), (101, "", "en", "b", 0, "x", "y", 0.1), (102, good[2] + " token=abcdef123456", "en", "b", 1, "x", "y", 0.1)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, spans string, fp string, score double"
    labels = [(i, int(i < 40), 0) for i in range(80)]
    bench = [(1, " ".join(good[3].split()[20:40]))]

    def tables(name, docs, labels, bench):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame(docs, kinds).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        return d

    d = tables("full", rows, labels, bench)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    left = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, d).write.parquet(f"{d}/stage{k}")
        docs = spark.read.parquet(f"{d}/stage{k}")
        if k < 4:
            assert sorted(docs.columns) == sorted(spark.read.parquet(f"{d}/documents.parquet").columns)
            left.append(Counter((r["doc_id"], r["text"]) for r in docs.collect()))
    assert all(i < 40 or i is None or i >= 100 for i, _ in left[0]) and left[0][0, good[0]] == 2
    assert left[1][0, good[0]] == 1 and (100, good[1]) not in left[1] and (1, good[1]) in left[1]
    assert (3, good[3]) in left[1] and (3, good[3]) not in left[2]
    assert not any("abcdef123456" in (t or "") for _, t in left[3]) and len(left[3]) == len(left[2])
    assert docs.count() == sum(left[3].values())
    assert corpus_pipeline.run(spark, tables("empty", [], [], [])).count() == 0
    assert corpus_pipeline.run(spark, tables("unlabelled", rows, [], bench)).count() > 30


def test_smallest_labels():
    rng = np.random.default_rng(5)
    for n, m in ((1, 0), (50, 30), (300, 400), (300, 299)):
        a, b = (np.arange(m), np.arange(m) + 1) if m == n - 1 else rng.integers(0, n, (2, m))
        want = list(range(n))
        for _ in range(n):
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                want[i] = want[j] = min(want[i], want[j])
        assert simhash.smallest_labels(n, a, b).tolist() == want
