"""What the operators' methods add, against plain versions of the same definitions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evispan.llm import classifier, pii, rules, secrets, urlfilter
from evispan.llm.common import FREED, settle


def plain_templates(rows):
    """{path: template} of one host's (path, label) rows, a node at a time."""
    import math
    import re

    paths: dict = {}
    for p, label in rows:
        n, bad, known = paths.get(p, (0, 0, 0))
        paths[p] = (n + 1, bad + (label or 0), known + (label is not None))
    out: dict = {}

    def walk(items, k, prefix, alone):
        groups: dict = {}
        for p in items:
            segs = [s for s in p.split("/") if s]
            if len(segs) <= k:
                out[p] = prefix
            else:
                groups.setdefault(segs[k], []).append(p)
        total = [sum(paths[p][i] for own in groups.values() for p in own) for i in range(3)]
        under: dict = {}
        for seg, own in groups.items():
            n, bad, known = (sum(paths[p][i] for p in own) for i in range(3))
            differs = None
            if known and total[2] > known:
                a, b = (bad + 1) / (known + 2), (total[1] - bad + 1) / (total[2] - known + 2)
                differs = abs(a - b) / math.sqrt(a * (1 - a) / (known + 2) + b * (1 - b) / (total[2] - known + 2)) >= urlfilter.LEAST_SCORE
            rare = len(groups) > urlfilter.MOST_CHILDREN and n < urlfilter.LEAST_SHARE * total[0]
            value = re.search(urlfilter.VALUE, seg)
            name = "*" if value else seg if differs else "*" if rare else urlfilter.MERGED if differs is False else seg
            under.setdefault(name, []).extend(own)
        for name, own in under.items():
            walk(own, k + 1, f"{prefix}/{name}", alone)

    walk(list(paths), 0, "", False)
    return out


def test_template_tree_against_a_plain_one(spark):
    rng = random.Random(1)
    hosts = {}
    for h in range(5):
        rows = []
        for _ in range(250):
            depth = rng.randrange(0, 9)
            segs = [rng.choice(["de", "fr", "en", "x", str(rng.randrange(40)), f"w{rng.randrange(80 if h % 2 else 3)}"]) for _ in range(depth)]
            label = rng.choice([None, int(segs[0] == "de"), int("fr" not in segs)]) if segs else None
            rows.append(("/" + "/".join(segs) + rng.choice(["", "/"]), label))
        hosts[f"h{h}"] = rows
    df = spark.createDataFrame([(h, p, x) for h, rows in hosts.items() for p, x in rows], "host string, path string, label int")
    got = {(r["host"], r["path"]): r["template"] for r in urlfilter.templates(df).collect()}
    assert got == {(h, p): t for h, rows in hosts.items() for p, t in plain_templates(rows).items()}
    assert len(set(got.values())) > 20


def test_unlabelled_branches_are_never_rejected(spark):
    rows = [("a.com", f"/de/{i}", 1) for i in range(60)] + [("a.com", p, None) for p in ("/news/today", "/about", "/de", "//de/999", "/en/1", "")]
    rows += [("b.com", f"/s{i}/p", 0) for i in range(60)] + [("b.com", f"/bad/x{i}", 1) for i in range(2)] + [("b.com", f"/worse/x{i}", 1) for i in range(12)]
    got = {(r["host"], r["path"]): r for r in urlfilter.templates(spark.createDataFrame(rows, "host string, path string, label int")).collect()}
    assert got["a.com", "/de/3"]["rejected"] and got["a.com", "//de/999"]["rejected"] and got["a.com", "//de/999"]["template"] == "/de/*"
    assert not any(got["a.com", p]["rejected"] for p in ("/news/today", "/about", "/de", "/en/1", ""))
    assert got["b.com", "/worse/x1"]["template"].startswith("/worse/") and not got["b.com", "/s5/p"]["rejected"]
    assert urlfilter.templates(spark.createDataFrame([], "host string, path string, label int")).count() == 0
    odd = urlfilter.templates(spark.createDataFrame([(None, None, None), (None, None, 1), ("h", "/" + "/".join("ab" * 40), 0)], "host string, path string, label int")).collect()
    assert {(r["host"], r["n"]) for r in odd} == {("", 2), ("h", 1)}


def test_further_personal_data_is_found(spark):
    rng = random.Random(2)
    fill = lambda: " ".join(rng.choice(["river", "stone", "moon", "light", "over", "under"]) for _ in range(12))
    digits = lambda n: str(rng.randrange(3, 7)) + "".join(str(rng.randrange(10)) for _ in range(n - 1))
    planted = [lambda: digits(16), lambda: "DE89 3704 0044 0532 0130 00", lambda: "Dr. Anna Keller", lambda: "221 Baker Street", lambda: f"{rng.randrange(200, 999)}-{rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}", lambda: f"call {digits(4)} {digits(4)} {digits(4)} {digits(4)}"]
    base = [lambda: f"u{rng.randrange(99)}@mail.com", lambda: f"{rng.randrange(1, 223)}.1.2.3", lambda: "+1 (555) 010-9999"]
    clean = [lambda: f"version {rng.randrange(9)}.{rng.randrange(9)}.{rng.randrange(1000, 9999)}", lambda: "2020-11-12", lambda: f"1 {rng.randrange(100, 999)} {rng.randrange(100, 999)}", lambda: f"page {rng.randrange(99)}"]
    rows, want = [], set()
    for i in range(600):
        what = rng.choice([planted, planted, base, clean])
        if what is planted:
            want.add(i)
        rows.append((i, f"{fill()} {rng.choice(what)()} {fill()}", what is clean))
    found = pii.detect(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()
    caught = {r["doc_id"] for r in found if r["spans"]}
    assert len(want & caught) >= 0.9 * len(want)
    assert len({r["doc_id"] for r in found if r["spans"] and rows[r["doc_id"]][2]}) <= 0.02 * len(rows)
    assert {s["kind"] for r in found for s in r["spans"]} > set(range(len(pii.BASE_KINDS) - 2))
    ok = spark.createDataFrame([("DE89 3704 0044 0532 0130 00",), ("DE88370400440532013000",), ("GB82WEST12345698765432",)], "h string").select(pii.account_ok(pii.F.col("h")).alias("ok")).collect()
    assert [r["ok"] for r in ok] == [True, False, True]


@pytest.mark.parametrize(
    ("kind", "text"),
    [
        ("github", "ghp_" + "aB3" * 12), ("slack", "xoxb-12345-abcdefgh"), ("google", "AIza" + "x" * 35), ("stripe", "sk_live_" + "Z" * 20),
        ("jwt", "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl"), ("pem", "-----BEGIN RSA PRIVATE KEY-----"),
    ],
)
def test_further_rules(spark, kind, text):
    at = [r.kind for r in secrets.RULES].index(kind)
    docs = spark.createDataFrame([(1, f"see {text} there"), (2, f"see {text[: len(text) // 2]} there"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secrets.scan(docs).collect()}
    assert got == {1: [(4, at, 4 + len(text))], 2: [], 3: []}


def test_pooled_responses_against_plain_convolution():
    rng = np.random.default_rng(3)
    net = classifier.Net.fresh()
    net.shift[:] = rng.normal(0, 0.2, len(net.shift))
    net.mean[:], net.top[:], net.bias[0] = rng.normal(0, 1, len(net.mean)), rng.normal(0, 1, len(net.top)), 0.3
    texts = ["", None, "short", "Ünïcode 🙂 " * 90, "x" * 5000]

    def plain(text):
        data = (text or "").encode()
        n = max(1, -(-(len(data) - classifier.OVERLAP) // classifier.STEP))
        pooled = []
        for c in range(n):
            chunk = (data[c * classifier.STEP : c * classifier.STEP + classifier.CHUNK] + bytes(classifier.CHUNK))[: classifier.CHUNK]
            best = np.full(classifier.FILTERS, -np.inf)
            for at in range(0, classifier.CHUNK - classifier.HALF, classifier.HALF):
                window = net.bytes_[list(chunk[at : at + 2 * classifier.HALF])].reshape(2, -1)
                best = np.maximum(best, window[0] @ net.filters[0] + window[1] @ net.filters[1])
            pooled.append(np.maximum(best + net.shift, 0))
        pooled = np.array(pooled)
        return 1 / (1 + np.exp(-(pooled.mean(axis=0) @ net.mean + pooled.max(axis=0) @ net.top + net.bias[0])))

    assert classifier.scores(net, texts) == pytest.approx([plain(t) for t in texts], abs=1e-4)


def test_rule_verdicts_and_odd_labels(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["river", "stone", "moon", "light", "over"]) + str(rng.randrange(300))
    good = [" ".join(word() for _ in range(120)) for _ in range(60)]
    bad = [" ".join(word().upper() + "!!" for _ in range(120)) for _ in range(60)]
    rows = [(i, t, "c") for i, t in enumerate([*good, *bad, None, "", "few words", "same three words " * 40])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rule string")
    labels = lambda x: spark.createDataFrame(x, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in rules.apply_rules(docs, labels([(i, int(i < 60), 0) for i in range(120)])).collect()}
    assert all(got[i]["kept"] for i in range(60)) and not any(got[i]["kept"] for i in range(60, 124))
    assert all(got[i]["base_failed"] == (got[i]["n_words"] < 50 or 100 * got[i]["n_repeat_words"] > 50 * got[i]["n_words"]) for i in got)
    assert [got[i]["base_failed"] for i in (120, 121, 122, 123, 70)] == [True, True, True, True, False]
    for odd in ([], [(0, 1, 0)], [(1, None, None), (None, 0, 0)]):
        kept = rules.apply_rules(docs, labels(odd)).collect()
        assert sum(r["kept"] for r in kept) == 120
    assert rules.apply_rules(docs.where("false"), labels([(0, 1, 0)])).count() == 0


def test_training_on_odd_tables(spark):
    labels = lambda x: spark.createDataFrame(x, "doc_id string, quality int")
    docs = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", None), (None, "z")], "doc_id string, text string")
    for x in ([], [("a", 1)], [("a", 1), ("b", 0), ("q", 1), (None, 0), ("b", None)]):
        s = [r["score"] for r in classifier.score(docs, classifier.train(docs, labels(x))).collect()]
        assert len(s) == 4 and all(0 <= v <= 1 for v in s)
    assert classifier.score(docs.where("false"), classifier.train(docs.where("false"), labels([("a", 1)]))).count() == 0


def test_settle_frees_what_it_shuffled(spark):
    def shuffles():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}

    before = shuffles()
    rows = settle(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), freed=True)
    assert not shuffles() - before
    assert sorted((r["k"], r["count"]) for r in rows.collect()) == [(k, 143 if k < 6 else 142) for k in range(7)]
    assert spark.conf.get(FREED) == "false"
