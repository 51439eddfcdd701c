"""A job's candidates as arrays against the plain policies, pair lists and scores."""

import random

import numpy as np
import pyarrow as pa
import pytest

from evispan.operators import jobwise
from evispan.operators.select import greedy

WORDS = [w + x for w in ("amber", "birch", "cedar") for x in "abcde"] + ["the", "of"]


def made(rng: random.Random, n: int):
    texts = [rng.choices(WORDS, k=rng.randint(0, 14)) for _ in range(n)]
    titles = [t[: rng.choice([0, 1, 2, 2, 3])] for t in texts]
    rows = {"pos": list(range(n)), "words": [a + b for a, b in zip(titles, texts, strict=True)], "title_words": titles, "tokens": [rng.randint(1, 9) for _ in range(n)], "sha256": [str(rng.randint(0, n + 2)) for _ in range(n)]}
    return jobwise.Job(pa.table(rows, schema=pa.schema([("pos", pa.int32()), ("words", pa.list_(pa.string())), ("title_words", pa.list_(pa.string())), ("tokens", pa.int64()), ("sha256", pa.string())])), sorted(set(rng.choices(WORDS[:15], k=4)))), rows


def plain_links(rows, n):
    out = np.zeros((n, n), bool)
    for i, t in enumerate(rows["title_words"]):
        for j, b in enumerate(rows["words"]):
            if i != j and len("".join(t)) >= 4 and f" {' '.join(t)} " in f" {' '.join(b)} ":
                out[i, j] = out[j, i] = True
    return out


@pytest.mark.parametrize("kept", [jobwise.KEPT, 2])
@pytest.mark.parametrize("policy", ["iterative", "mmr", "mmr_per_cost", "singleton", "bundle", "similarity_bundle"])
def test_policies_agree_with_the_plain_loop(policy, kept, monkeypatch):
    monkeypatch.setattr(jobwise, "KEPT", kept)
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 14)
        job, rows = made(rng, n)
        job.weigh()
        sim, grow = np.array([job.similar(i) for i in range(n)]), np.zeros((n, n))
        for i in range(n):
            if (line := job.grown(i)) is not None:
                grow[i] = np.where(np.arange(n) == i, 0, line)
        asked = [job.terms[t].as_py() for t in job.asked]
        covers = [set(asked) & set(w) for w in rows["words"]]
        budget = rng.randint(0, 40)
        pool = set(rng.sample(range(n), rng.randint(0, n))) if rng.random() < 0.3 else None
        want = greedy(policy, budget, np.array(rows["tokens"]), job.relevance(), rows["sha256"], sim, plain_links(rows, n), covers, grow, job.n_terms, pool)
        assert jobwise.choose(job, [(policy, budget)], pool)[0][2:] == want


@pytest.mark.parametrize("cells", [jobwise.CELLS, 30])
def test_cosines_and_mentions_of_all_pairs(cells, monkeypatch):
    monkeypatch.setattr(jobwise, "CELLS", cells)
    rng = random.Random(9)
    for _ in range(20):
        n = rng.randint(1, 60)
        job, rows = made(rng, n)
        job.weigh()
        links = plain_links(rows, n)
        assert list(zip(*map(list, job.mentions()), strict=True)) == [(i, j) for i in range(n) for j in range(i + 1, n) if links[i, j]]
        got = np.concatenate([block for _, _, block in job.cosines()])
        for i in range(n):
            assert np.allclose(got[i, i + 1 :], job.similar(i)[i + 1 :], atol=1e-8)
