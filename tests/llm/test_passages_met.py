"""Passages between texts that meet only at seeds of long runs, and what comes before an alignment."""

import random

import numpy as np
import pytest

from evispan.llm import passages


def corpus(rng: random.Random, n: int, pairs: int):
    """Texts with one common line; texts 2 k and 2 k + 1, k < pairs, also share three of four words on both sides of it, and so no further seed."""
    word = lambda: f"w{rng.randrange(10**9)}"
    line = [word() for _ in range(25)]
    texts = []
    for k in range(n):
        if k % 2 and k < 2 * pairs:
            sides = [[word() if i % 4 == 3 else w for i, w in enumerate(side)] for side in sides]
        else:
            sides = [[word() for _ in range(16)] for _ in range(2)]
        texts.append(" ".join([word() for _ in range(60)] + sides[0] + line + sides[1] + [word() for _ in range(60)]))
    return texts


def test_edited_passages_at_a_common_line_are_found(spark):
    rng = random.Random(11)
    n, pairs = 120, 12
    texts = corpus(rng, n, pairs)
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    out = passages.summarise(*passages.find_passages(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in out} == {k: (k - k % 2, 1) if k < 2 * pairs else (k, 0) for k in range(n)}
    assert all(r["passage_words"] >= 50 for r in out if r["doc_id"] < 2 * pairs)


def stretches(rng: random.Random, n: int, vocabulary: int):
    out = []
    for _ in range(n):
        p = [rng.randrange(vocabulary) for _ in range(rng.randint(0, 160))]
        q = [rng.randrange(vocabulary) if rng.random() < rng.choice([0.02, 0.1, 0.2]) else w for w in p[rng.randint(0, 30) :]]
        out += [np.array(p, np.uint32), np.array(q + [rng.randrange(vocabulary) for _ in range(rng.randint(0, 40))], np.uint32)]
    return out


@pytest.mark.parametrize("vocabulary", [3, 30, 10**6])
def test_nothing_that_aligns_is_left_out_before(vocabulary):
    words = stretches(random.Random(3), 300, vocabulary)
    ok = passages.may_align(words)
    found = np.array([bool(passages.align(p, q)) for p, q in zip(words[::2], words[1::2], strict=True)])
    assert found.any() and not (found & ~ok).any()


@pytest.mark.parametrize("vocabulary", [3, 60, 10**6])
def test_stretches_of_a_step_are_compared_if_they_can_align(vocabulary, monkeypatch):
    monkeypatch.setattr(passages, "FEW", 3)
    rng = random.Random(4)
    words = [w for w in stretches(rng, 20, vocabulary) for _ in range(rng.randint(1, 2))]
    met = {(int(a), int(b)) for i, j in passages._compared(words) for a, b in zip(i, j, strict=True)}
    pairs = [(i, j) for i in range(len(words)) for j in range(i + 1, len(words))]
    ok = passages.may_align([words[k] for pair in pairs for k in pair])
    assert {pair for pair, may in zip(pairs, ok, strict=True) if may} <= met and all(i < j for i, j in met)


def runs_of_one_word(rng: random.Random, n: int):
    """Stretches of a few one-word runs of 20 to 90 words."""
    return [np.array([w for _ in range(rng.randint(1, 3)) for w in [rng.randrange(4)] * rng.randint(20, 90)], np.uint32) for _ in range(n)]


def test_runs_shorter_than_a_passage_are_left_out_before():
    """48 words and 80 of one kind in a row make no passage of 50, though with two words about they are 96 % of one."""
    p, q = np.array([1] * 40 + [7] * 48 + [2] * 40, np.uint32), np.array([3] * 40 + [7] * 80 + [4] * 40, np.uint32)
    assert passages.align(p, q, (50, 70, 50, 70)) == [] and not passages.may_align([p, q])[0]
    assert passages.may_align([np.append(p, [7] * 2), np.append(q, [7] * 2)]).tolist() == [False]
    assert passages.may_align([np.array([7] * 50, np.uint32), q])[0]


@pytest.mark.parametrize("vocabulary", [1, 3, 30, 10**6])
def test_stretches_looked_at_together_align_as_one_by_one(vocabulary):
    rng = random.Random(5)
    words = runs_of_one_word(rng, 400) if vocabulary == 1 else stretches(rng, 300, vocabulary)
    chains = []
    for p, q in zip(words[::2], words[1::2], strict=True):
        a, b = rng.randint(0, max(0, len(p) - 10)), rng.randint(0, max(0, len(q) - 10))
        i, j = rng.choice([(i, j) for i in range(len(p)) for j in range(len(q)) if p[i] == q[j]] or [(a, b)])
        chains.append((i, i + 10, j, j + 10 + rng.choice([0, 0, 0, 3])))
    looked = passages.Looked(words, np.array(chains))
    for k, chain in enumerate(chains):
        found = passages.align(words[2 * k], words[2 * k + 1], chain)
        assert (looked.passages(k) if looked.ok[k] else []) == found
    assert looked.ok.any() and not looked.ok.all()


def test_a_step_of_many_near_copies_is_aligned_about_once_a_text(monkeypatch):
    """All of n near copies of a line meet at one step; all pairs would be n * n / 2 alignments."""
    rng = random.Random(6)
    n, line = 90, [rng.randrange(10**6) for _ in range(100)]
    words = [np.array([rng.randrange(10**6, 10**7) if k in (10 + i % 9, 88 - i % 7) else w for k, w in enumerate(line)], np.uint32) for i in range(n)]
    calls = []
    monkeypatch.setattr(passages.Looked, "passages", lambda self, pair, real=passages.Looked.passages: calls.append(pair) or real(self, pair))
    one = np.ones(n, np.int32)
    rows = [r for b in passages._met_step(np.arange(n), np.arange(n), np.zeros(n, bool), 0 * one, 45 * one, 60 * one, words, [np.zeros(100, bool) for _ in range(n)]) for r in b.to_pylist()]
    root = list(range(n))
    for r in rows:
        low, high = sorted((root[r["a"]], root[r["b"]]))
        root = [low if x == high else x for x in root]
    had = [{w for r in rows for k in ("a", "b") if r[k] == i for w in range(r[f"{k}_start"], r[f"{k}_stop"])} for i in range(n)]
    assert set(root) == {0} and all(h == set(range(100)) for h in had)
    assert len(calls) <= 10 * n


def test_a_step_of_a_run_of_one_word_is_one_place():
    """Seeds of one word at every fifth place make nine steps each, all of one hash; what is far apart stays so."""
    i, j = (a.ravel() for a in np.meshgrid(np.arange(0, 5000, 5), np.arange(5, 50, 5), indexing="ij"))
    x, step = np.append(i, [9000, 3]), np.append(np.full(len(i), 7), [7, 8]).astype(np.uint64)
    got = passages._near_made_one(step, x, np.append(i + j, [9010, 20]), np.arange(len(x)) != 17)
    assert [c.tolist() for c in got] == [[7, 7, 8], [0, 9000, 3], [5040, 9010, 20], [False, True, True]]
