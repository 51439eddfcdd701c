"""The experiment and its commands, evaluators and contracts on authored rows."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from evispan import cli
from evispan.functions import intervals as iv
from evispan.operators import contracts, evaluate, experiment
from evispan.sources import prepare, readers

HOP = [
    {"id": "a", "question": "who met river stone?", "answer": "Ann", "type": "bridge", "context": [{"title": "River", "sentences": ["Ann met river stone. ", "More."]}, {"title": "Moon", "sentences": ["moon light river"]}], "supporting_facts": [{"title": "River", "sent": 0}]},
    {"id": "b", "question": "what is the moon?", "answer": "light", "type": "other", "context": [{"title": "Moon", "sentences": ["the moon is light"]}, {"title": "Sea", "sentences": ["sea"]}], "supporting_facts": [{"title": "Moon", "sent": 0}, {"title": "Sea", "sent": 0}]},
    {"id": "c", "question": "?", "answer": "x", "type": "other", "context": [{"title": "T", "sentences": ["s"]}], "supporting_facts": [{"title": "T", "sent": 4}]},
    {"id": "d", "question": "?", "answer": "x", "type": "other", "context": [{"title": "T", "sentences": ["s"]}], "supporting_facts": [{"title": "U", "sent": 0}]},
    {"id": "e", "question": "?", "answer": "", "type": "other", "context": [], "supporting_facts": []},
]


def spans(*pairs):
    return F.array(*[iv.span(F.lit(a), F.lit(b)) for a, b in pairs])


def test_prepare_and_run(spark, tmp_path):
    (tmp_path / "records.json").write_text(json.dumps(HOP))
    made = str(tmp_path / "made")
    assert cli.main(["prepare", str(tmp_path / "records.json"), made]) == 0
    jobs = {r["id"]: r for r in spark.read.json(f"{made}/jobs").collect()}
    assert set(jobs) == {"a", "b"} and jobs["a"]["docs"][0]["sha256"] == hashlib.sha256(b"Ann met river stone. More.").hexdigest() and not {"answers", "support_indices"} & set(spark.read.json(f"{made}/jobs").columns)
    assert {r["id"]: r["support_indices"] for r in spark.read.json(f"{made}/labels").collect()} == {"a": [0], "b": [0, 1]}
    assert {(r["id"], r["reason"]) for r in spark.read.json(f"{made}/audit").collect()} == {("c", "sentence_id_out_of_range"), ("d", "missing_title"), ("e", "no_answer")}
    assert cli.main(["prepare", str(tmp_path / "records.json"), made]) == 2

    said = {"who": "So the answer is: Ann.", "what": "So the answer is: UNKNOWN."}
    sent = []

    def model(requests):
        sent.append(requests.select("request_id", "payload").distinct())
        step = F.col("payload").contains('"max_output":128')
        return requests.withColumn("raw", F.when(step, "So the answer is: light.").when(F.col("payload").contains("who met"), said["who"]).otherwise(said["what"]))

    questions, docs = readers.job_tables(readers.read_records(spark, f"{made}/jobs", readers.JOB))
    labels = spark.read.json(f"{made}/labels").select(F.col("id").alias("job_id"), "answers", F.col("support_indices").alias("support"))
    stored = {}

    def remembered(requests):
        out = model(requests)
        stored.update({r["request_id"]: (r["payload"], r["raw"]) for r in out.select("request_id", "payload", "raw").collect()})
        return out

    options = {"policies": ("rank", "bundle", "full"), "caps": (6, 100)}
    # the usage table is read after all requests are known, so a first pass collects them
    usage = spark.createDataFrame([("", 0)], "request_id string, tokens long")
    with pytest.raises(Exception, match="no response"):
        experiment.evaluate(questions, docs, labels, remembered, usage, demos="D\n", **options).collect()
    cache = tmp_path / "cache.json"
    cache.write_text("\n".join(json.dumps({"request_id": i, "payload": p, "response": r, "model": "m", "usage_tokens": 7}) for i, (p, r) in stored.items()))
    (tmp_path / "demos").write_text("D\n")
    out = str(tmp_path / "rows")
    args = ["run", f"{made}/jobs", f"{made}/labels", str(cache), out, "--model", "m", "--demos", str(tmp_path / "demos"), "--caps", "6", "100", "--policies", "rank", "bundle", "full"]
    assert cli.main(args) == 0
    rows = spark.read.parquet(out).collect()
    by = {(r["job_id"], r["policy"], r["budget"], r["selective"]): r for r in rows}
    assert len(rows) == len(by) == 2 * (5 * 2 + 1)
    assert by["a", "rank", 100, True]["em"] == 1 and by["a", "rank", 100, True]["calls"] == 1 and by["a", "rank", 100, True]["tokens"] == 7
    plain, selective = by["b", "rank", 100, False], by["b", "rank", 100, True]
    assert (plain["em"], plain["trigger"], plain["answer"]) == (0, False, "UNKNOWN") and selective["em"] == 1 and selective["trigger"] and selective["calls"] > 1 and selective["first_em"] == 0
    assert by["b", "full", None, False]["complete"] == 1 and by["b", "rank", 6, False]["complete"] == 0 and by["b", "always_dynamic", 1024, False]["em"] == 1
    assert cli.main(args) == 2
    assert cli.main([*args[:4], out + "2", "--model", "other"]) == 2


@pytest.mark.parametrize("options", [{"policies": ()}, {"policies": ("best",)}, {"policies": ("rank", "rank")}, {"caps": (1, 1)}, {"caps": (-1,)}, {"caps": (True,)}])
def test_experiment_refuses(options):
    with pytest.raises(ValueError, match="polic|cap"):
        experiment.check(options.get("policies", ("rank",)), options.get("caps", (5,)), 10)


def test_labels_must_fit(spark):
    docs = spark.createDataFrame([("a", 0), ("a", 1)], "job_id string, pos int")
    row = lambda a, s: spark.createDataFrame([("a", a, s)], "job_id string, answers array<string>, support array<int>")
    assert experiment.sound_labels(row(["x"], [1]), docs).count() == 1
    for bad in (row([], [0]), row(None, [0]), row(["x"], [2]), row(["x"], [-1]), row(["x"], None)):
        with pytest.raises(Exception, match="answers|support"):
            experiment.sound_labels(bad, docs).collect()


def test_path_connectivity(spark):
    sentences = spark.createDataFrame([(1, "Ada Lovelace", 0, 10), (1, "Ada Lovelace", 10, 20), (1, "London", 20, 30), (1, "Analytical Engine", 30, 40)], "doc_id int, title string, start int, stop int")
    triples = spark.createDataFrame([(1, "ada lovelace", "born", "London"), (1, "Lovelace", "made", "engine"), (1, "Ada", "in", "London"), (1, "", "in", "London"), (2, "x", "in", "y")], "doc_id int, subject string, relation string, object string")
    tiles = spark.range(1).select(F.lit(1).alias("doc_id"), spans((12, 15), (22, 25)).alias("ranges"))
    got = {(r["subject"], r["relation"]): (r["mappable"], r["covered"]) for r in evaluate.path_connectivity(triples, sentences, tiles).collect()}
    assert got == {("ada lovelace", "born"): (True, True), ("Lovelace", "made"): (True, False), ("Ada", "in"): (False, False), ("", "in"): (False, False), ("x", "in"): (False, False)}
    total = evaluate.connectivity_summary(evaluate.path_connectivity(triples, sentences, tiles)).first()
    assert (total["triples"], total["mappable"], total["covered"], total["coverage"]) == (5, 2, 1, 0.5)


def test_rankings_fail_closed(spark):
    c = spark.createDataFrame([(1, "A", 1, "t1", [(0, 5)]), (1, "B", 2, "t2", [(5, 9)])], "case_id int, label string, rrf_rank int, tile_id string, ranges array<struct<start:int,stop:int>>")
    ranked = lambda r: spark.createDataFrame([(1, r, "SCORED")], "case_id int, ranked array<string>, status string")
    assert [r["tile_id"][-2:] for r in evaluate.ranked_tiles(c, ranked(["B", "A"])).orderBy("place").collect()] == ["t2", "t1"]
    for bad in (["A"], ["A", "A"], ["A", "C"]):
        with pytest.raises(Exception, match="ranking"):
            evaluate.ranked_tiles(c, ranked(bad)).collect()
        assert evaluate.fused_footprints(c, ranked(bad)).count() == 0
    trace = spark.createDataFrame([(1, 1, "t", [(0, 5)]), (1, 3, "u", [(5, 9)])], "case_id int, rank int, tile_id string, ranges array<struct<start:int,stop:int>>")
    atoms = spark.createDataFrame([(1, "p1", 0, 5), (1, "p2", 5, 9)], "case_id int, paragraph_id string, start int, stop int")
    with pytest.raises(Exception, match="rank is missing"):
        evaluate.trace_candidates(trace, atoms, ["A", "B"]).collect()
    with pytest.raises(Exception, match="no paragraph"):
        evaluate.trace_candidates(trace.where("rank = 1"), atoms.where("start > 0"), ["A", "B"]).collect()
    with pytest.raises(Exception, match="not enough"):
        evaluate.trace_candidates(trace, atoms, ["A"]).collect()


def test_bridge_needs_gold(spark):
    q = spark.createDataFrame([(1, "m", "some text", [], [])], "doc_id int, method string, text string, golds array<array<struct<start:int,stop:int>>>, footprints array<struct<tile_id:string,ranges:array<struct<start:int,stop:int>>>>")
    with pytest.raises(Exception, match="no gold"):
        evaluate.bridge_rows(q).collect()


def test_external_contracts(spark):
    body = lambda d: json.dumps({"output": [{"type": "reasoning", "content": None}, {"type": "message", "content": [{"type": "output_text", "text": json.dumps(d)}]}]})
    rows = [(body({"rank_1": "B", "rank_2": "A"}),), (body({"rank_1": "B", "rank_2": "B"}),), (body({"rank_1": "B"}),), ("no json",), (json.dumps({"output": []}),)]
    got = spark.createDataFrame(rows, "b string").select(contracts.parsed_ranking(F.col("b"), F.array(F.lit("A"), F.lit("B"))).alias("r")).collect()
    assert [r["r"] for r in got] == [["B", "A"], None, None, None, None]
    assert contracts.ranking_schema(["A", "B"])["required"] == ["rank_1", "rank_2"]
    cases = spark.createDataFrame([(1, "one two one", [("a", ["two"], [], 0.5)]), (2, "one two one", [("a", ["one"], None, None)])], f"doc_id int, text string, tiles {contracts.TILE}")
    assert contracts.valid_external_tiles(cases.where("doc_id = 1")).first()["tile_id"] == "a"
    with pytest.raises(Exception, match="quote_count"):
        contracts.valid_external_tiles(cases).collect()
    keys = spark.range(1).select(contracts.query_text(F.lit(1), {"question": F.lit(""), "claim": F.lit("c")}, F.lit(None)).alias("q"), contracts.cluster_id(F.lit("d"), F.lit(9), {"paper_id": F.lit(None)}).alias("c")).first()
    assert (keys["q"], keys["c"]) == ("c", "d:document:9")
    with pytest.raises(Exception, match="no visible query"):
        spark.range(1).select(contracts.query_text(F.lit(1), {"question": F.lit("")}, F.lit(None))).collect()


def test_sample_fingerprint_and_export(spark):
    rows = [("b", "text é", 0), ("a", "", 1)]
    h = hashlib.sha256()
    for i, t, _ in rows:
        h.update(i.encode() + b"\0" + hashlib.sha256(t.encode()).digest() + b"\n")
    df = spark.createDataFrame(rows, "doc_id string, text string, pos int").repartition(2)
    assert contracts.sample_fingerprint(df, "pos").first()["sha"] == h.hexdigest()
    paragraphs = spark.createDataFrame([("b", 1, "p2", "y"), ("b", 0, "p1", "x")], "doc_id string, pos int, id string, text string")
    out = contracts.exported_cases(df.select("doc_id", F.lit("q").alias("query")), paragraphs, "do")
    by = {r["case_id"]: [p["id"] for p in r["paragraphs"]] for r in out.collect()}
    assert by == {"b": ["p1", "p2"], "a": []} and "gold" not in out.columns
    assert tuple(contracts.export_stats(out).first()) == (2, 1.0, 2)


def test_costs_are_a_parameter(spark):
    records = spark.read.json(spark.sparkContext.parallelize([json.dumps(HOP[0])]), schema=prepare.RECORD)
    jobs, _, _ = prepare.jobs_and_labels(records, lambda frame: F.lit(3))
    assert {d["tokens"] for d in jobs.first()["docs"]} == {3}
