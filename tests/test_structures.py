"""Intervals, segments, graphs, snapshots, statistics and decisions on authored rows."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evispan.functions import intervals as iv
from evispan.operators import components, graph, rank, revisions, segment, snapshot, stats, validate


def spans(*pairs):
    return F.array(*[iv.span(F.lit(a), F.lit(b)) for a, b in pairs])


def test_intervals(spark):
    a, b = spans((0, 5), (5, 8), (10, 12), (3, 6)), spans((4, 11))
    r = spark.range(1).select(iv.union_length(a).alias("u"), iv.merged(a).alias("m"), iv.overlap_sum(a, b).alias("s"), iv.overlap_union(a, b).alias("o"), iv.noncontiguous(a).alias("n"), iv.covered_by(iv.span(F.lit(1), F.lit(7)), a).alias("c")).first()
    assert (r["u"], [tuple(x) for x in r["m"]], r["s"], r["o"], r["n"], r["c"]) == (10, [(0, 8), (10, 12)], 7, 5, True, True)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n!é🙂", max_size=300), st.sampled_from(sorted(segment.POLICIES)))
def test_segments_cover(text, policy):
    cut = segment.POLICIES[policy](text)
    assert "".join(text[a:b] for a, b in cut) == text
    assert all(a < b for a, b in cut)


def test_expression_segments_cover(spark):
    docs = spark.createDataFrame([(1, "One. Two!\n\nThree"), (2, ""), (3, None), (4, "x" * 200)], "doc_id long, text string")
    for policy in segment.EXPRESSIONS:
        assert segment.uncovered(segment.segments(docs, policy), docs).count() == 0


def test_gear_is_bounded():
    sizes = [b - a for a, b in segment.cdc_gear("lorem ipsum dolor " * 60)]
    assert max(sizes) <= 128 and min(sizes[:-1]) >= 32


def test_history_without_edits_is_plain():
    text = "Alpha beta gamma. " * 12
    assert segment.history_dp(text, []) == segment.boundary_dp(text, 48, 8, 120, 1.0, 0.3, 0.55)


def test_turn_blocks():
    blocks = segment.turn_blocks(["red fox"] * 10 + ["blue sea"] * 10)
    assert blocks[0][0] == 0 and blocks[-1][1] == 20 and any(b == 10 for _, b in blocks)


def test_capped_clusters():
    edges = [(0.9, 0, 1), (0.8, 1, 2), (0.7, 2, 3), (0.1, 3, 4)]
    got = {tuple(m): s for m, s in graph.capped_clusters(5, edges, 0.2, 3)}
    assert set(got) == {(0, 1, 2), (3,), (4,)}
    assert got[0, 1, 2] == pytest.approx(0.85)


def test_overlays_stop_without_gain():
    assert graph.choose_overlays(4, [(0.5, [0, 2]), (0.5, [0, 2]), (0.9, [1, 3])]) == [2, 0]


def test_components_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert set(got.values()) == {0, 100} and got[40] == 0 and got[101] == 100


def test_budget_control_skips_and_goes_on(spark):
    rows = spark.createDataFrame([(1, r, r, c, 20) for r, c in ((1, 5), (2, 5), (3, 50), (4, 8))], "doc_id long, rank int, item int, cost long, cap long")
    assert tuple(rank.budget_control(rows, F.col("cap"), [F.col("rank")]).first()) == (1, "1,2,4", 18, True)
    assert not rank.budget_control(rows.withColumn("cap", F.lit(3).cast("long")), F.col("cap"), [F.col("rank")]).first()["feasible"]


def test_fusion_ties(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "job long, item string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "x", 2)], "job long, item string, rank int")
    assert [r["item"] for r in rank.fuse(a, b, ["job"]).orderBy("rank").collect()] == ["x", "y"]
    first, second = a.withColumnRenamed("item", "label"), b.withColumnRenamed("item", "label")
    assert [r["label"] for r in rank.fuse_complete(first, second, ["job"]).orderBy("rank").collect()] == ["x", "y"]


def test_pareto_and_choices(spark):
    rows = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 3.0), (3, 2.0, 2.0), (4, 3.0, 3.0), (5, 2.0, 3.0)], "id int, cost double, gain double")
    assert sorted(r["id"] for r in rank.pareto(rows, "cost", "gain").collect()) == [1, 2, 5]
    many = spark.createDataFrame([(1, 0.95, 12.0), (2, 0.96, 15.0), (3, 0.5, 2.0)], "id int, gain double, objects double")
    assert rank.retained_gain(many, 0.0, 1.0, 10.0).first()["id"] == 1
    assert rank.greedy_cover(10, [[(0, 4)], [(3, 9)], [(0, 2)]], 2) == [1, 0]


def test_snapshot_advance(spark):
    old = snapshot.Snapshot(spark.createDataFrame([(i, f"alpha {'beta ' * (i % 5)}gamma{i}") for i in range(60)], "id long, text string"))
    new = snapshot.Snapshot(spark.createDataFrame([(i, f"alpha {'beta ' * (i % 5)}gamma{i}") for i in range(60) if i != 4] + [(99, "beta beta beta beta beta beta")], "id long, text string"))
    plan = snapshot.Plan("beta beta nothing", 3)
    exact = [r["id"] for r in snapshot.top(new.scores(plan), 3).orderBy("rank").collect()]
    moved = snapshot.changed(old, new)
    assert {(r["id"], r["change"]) for r in moved.collect()} == {(4, "removed"), (99, "added")}
    done = snapshot.advance(new, plan, snapshot.issue(old, plan), moved, old.identity)
    assert [i for i, _ in done.selected] == exact
    assert snapshot.advance(new, plan, snapshot.issue(old, plan), moved, old.identity, complete=False).reason == "not_comparable"
    kept = snapshot.issue(new, plan)
    assert snapshot.advance(new, plan, kept, moved, new.identity) is kept
    assert [r["id"] for r in snapshot.block_max_top(new, plan, 8).orderBy("rank").collect()] == exact
    assert snapshot.issue(new, snapshot.Plan(" ", 3)).selected == ()
    with pytest.raises(ValueError, match="repeat"):
        snapshot.Snapshot(spark.createDataFrame([(1, "a"), (1, "b")], "id long, text string"))


def test_bootstrap_is_repeatable():
    x, strata = np.array([0.0, 1, 1, 0, 1, 1]), ["a", "a", "b", "b", "b", "a"]
    first = stats.stratified_bootstrap(x, strata, replicates=500)
    assert first == stats.stratified_bootstrap(x, strata, replicates=500)
    assert first[1] <= first[0] <= first[2]
    a = {str(i): {"stratum": s, "em": v} for i, (v, s) in enumerate(zip(x, strata, strict=True))}
    assert stats.paired_bootstrap(a, dict(reversed(a.items())), "em", replicates=200)["estimate"] == 0
    with pytest.raises(ValueError, match="differ"):
        stats.paired_bootstrap(a, {k: v for k, v in a.items() if k != "0"}, "em")
    low, high = stats.order_statistic_interval(list(x), 20260902, 200)
    assert 0 <= low <= high <= 1


def test_alignment_fails_closed(spark):
    a = spark.createDataFrame([(1, "s", 1.0), (2, "s", 0.0)], "id int, stratum string, v double")
    assert stats.align_pairs(a, a, ["id"], ["stratum"]).count() == 2
    with pytest.raises(Exception, match="do not align"):
        stats.align_pairs(a, a.where("id = 1"), ["id"], ["stratum"]).collect()


def test_conflicts(spark):
    arr = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    case = lambda w1, d1, f1, w2, d2, f2: spark.range(1).select(validate.conflict(arr(*w1), arr(*d1), spans(f1), arr(*w2), arr(*d2), spans(f2)).alias("c")).first()["c"]
    assert case("a", "", (0, 1), "a", "", (5, 6)) == "REBASE"
    assert case("a", "", (0, 1), "b", "a", (5, 6)) == "REVALIDATE"
    assert case("a", "", (0, 6), "b", "", (5, 6)) == "REBASE"
    assert case("a", "", (0, 5), "b", "", (5, 6)) == "COMMUTE"


def test_revision_decisions(spark):
    requests, rules = revisions.generated(spark)
    got = revisions.decide(requests, rules).collect()
    assert len(got) == 32 and all(r["revision"] == 5 for r in got)
    assert all(r["value"] == 0 for r in got if r["decision"] in ("deny", "urgent", "normal"))


def test_drift_bounds_every_unchanged_document():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 5))
        old, new = (snapshot.Stats(10, float(rng.uniform(1, 300)), tuple(rng.normal(0, 3, n))) for _ in range(2))
        if rng.random() < 0.3:
            new = snapshot.Stats(10, old.avg_len * float(rng.uniform(0.99, 1.01)), old.idf)
        bound = snapshot.drift(old, new)
        for _ in range(20):
            f, length = rng.integers(0, 9, n), float(rng.uniform(1, 500))
            score = lambda s: sum(w * x * (snapshot.K1 + 1) / (x + snapshot.K1 * (1 - snapshot.B + snapshot.B * length / s.avg_len)) for w, x in zip(s.idf, f, strict=True) if x)
            assert abs(score(new) - score(old)) <= bound
    same = snapshot.Stats(3, 5.0, (1.0, -0.5))
    assert snapshot.drift(same, same) == 0 and snapshot.drift(same, snapshot.Stats(3, 5.0, (1.0,))) == math.inf
    assert snapshot.drift(same, snapshot.Stats(3, 0.0, (1.0, -0.5))) == math.inf == snapshot.drift(same, snapshot.Stats(3, 5.0, (math.nan, 0.0)))


def test_gear_chunks_against_the_rolling_sum():
    rng = random.Random(4)
    for low, average, high in ((32, 64, 128), (8, 16, 40), (2, 64, 100), (1, 2, 3), (64, 64, 64)):
        table, bits = segment.gear_table("gear-"), max(1, round(math.log2(average)))
        for n in (0, 1, 5, 63, 400, 900):
            text = "".join(rng.choice("ab cdéü日🙂") for _ in range(n))
            want, start, h = [], 0, 0
            for i, c in enumerate(text, 1):
                for b in c.encode():
                    h = (2 * h + table[b]) % 2**64
                if i - start >= low and (h % 2**bits == 0 or i - start >= high):
                    want.append((start, i))
                    start, h = i, 0
            want += [(start, n)] if start < n else []
            assert segment.cdc_gear(text, low, average, high) == want


def test_boundary_strengths_and_cuts():
    far = "alpha beta" * 3
    for before, after, want in (("One.", " two", 0.85), ("One. ", "two", 0.85), ('One."', " two", 0.0), ("One:", " two", 0.2), ("a\n", "\nb", 1.0), ("One.    ", "two", 0.0), ("x", "y", 0.0)):
        text = far + before + after + " gamma delta"
        at = len(far + before)
        change = 1 - segment.bag_cosine(text[max(0, at - 90) : at], text[at : at + 90])
        assert segment.boundary_strength(text, at) == pytest.approx(min(1.5, 0.72 * change + 0.55 * want))
    assert segment.boundary_strength("abc", 0) == segment.boundary_strength("abc", 3) == 1.0
    text = "aaaa bbbb. cccc dddd eeee ffff gggg"
    assert segment.candidate_cuts(text, 48) == [11, 16]
