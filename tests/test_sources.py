"""Readers, adapters, replay, the command line and the stream."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evispan import cli
from evispan.operators import learned, reader, snapshot
from evispan.sources import adapters, readers
from evispan.streaming import maintain

ROW = T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.IntegerType())])


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_records_of_either_shape(spark, tmp_path):
    for name, text in (("a.json", '[{"id":"x","v":1},{"id":"y","v":2}]'), ("b.json", '{"id":"x","v":1}\n{"id":"y","v":2}\n')):
        got = readers.read_records(spark, put(tmp_path / name, text), ROW).orderBy("id").collect()
        assert [tuple(r) for r in got] == [("x", 1), ("y", 2)]


def test_strict_lines_name_the_bad_one(spark, tmp_path):
    good = put(tmp_path / "g.jsonl", '{"id":"x","v":1}\n\n{"id":"y","v":2}\n')
    assert readers.read_jsonl_strict(spark, good, ROW).count() == 2
    with pytest.raises(Exception, match=r"bad\.jsonl:2"):
        readers.read_jsonl_strict(spark, put(tmp_path / "bad.jsonl", '{"id":"x","v":1}\nnope\n'), ROW).collect()


def test_unique_keeps_the_first(spark, tmp_path):
    rows, audit = readers.read_jsonl_unique(spark, put(tmp_path / "u.jsonl", '{"id":"x","v":1}\nbad\n{"id":"x","v":2}\n{"id":"y","v":3}'), ROW, "id")
    assert sorted(map(tuple, rows.collect())) == [("x", 1), ("y", 3)]
    assert tuple(audit.first()) == (4, 2, 1, 1)


def test_envelope(spark, tmp_path):
    path = put(tmp_path / "e.json", '{"rows": [{"row": {"id": "x", "v": 1}}, {"row": {"id": "y", "v": 2}}]}')
    assert readers.read_enveloped(spark, path, ROW).count() == 2


def test_csv_mark_and_locate(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    path = put(tmp_path / "deep" / "t.csv", "﻿a,b\n1,x\n")
    assert readers.read_table(spark, path).columns == ["a", "b"]
    assert readers.locate_once(spark, str(tmp_path), ["t.csv"])["t.csv"].endswith("deep/t.csv")
    with pytest.raises(ValueError, match="0 times"):
        readers.locate_once(spark, str(tmp_path), ["no.csv"])


def test_feature_pairs(spark, tmp_path):
    for n, files in ((1, "a b"), (2, "b c"), (3, "d")):
        folder = tmp_path / "demo_task" / "task7" / f"feature{n}"
        folder.mkdir(parents=True)
        (folder / "feature.patch").write_text("".join(f"diff --git a/{f} b/{f}\n" for f in files.split()))
    got = {(r["a"], r["b"]): r["shared"] for r in readers.feature_pairs(spark, str(tmp_path)).collect()}
    assert got == {(1, 2): ["b"], (1, 3): [], (2, 3): []}


def job(i):
    docs = [{"id": f"{i}{k}", "title": f"Title{k} Alpha", "text": f"body {k} of alpha words", "sha256": hashlib.sha256(f"body {k} of alpha words".encode()).hexdigest(), "tokens": 10} for k in range(4)]
    return {"id": i, "question": "alpha words?", "stratum": "s", "docs": docs}


def test_cli_selects_and_refuses_to_overwrite(spark, tmp_path):
    path = put(tmp_path / "jobs.json", json.dumps([job("p"), job("q")]))
    out = str(tmp_path / "out")
    questions, docs = readers.job_tables(readers.read_records(spark, path, readers.JOB))
    assert docs.count() == 8
    assert readers.nested_jobs(questions, docs).count() == 2
    assert cli.main(["select", path, out, "--policy", "rank", "--budget", "25"]) == 0
    assert {r["spent"] for r in spark.read.json(out).collect()} == {20}
    assert cli.main(["select", path, out]) == 2


def test_wrong_digest(spark, tmp_path):
    bad = job("p")
    bad["docs"][0]["sha256"] = "0"
    with pytest.raises(Exception, match="digest"):
        readers.job_tables(readers.read_records(spark, put(tmp_path / "b.json", json.dumps([bad])), readers.JOB))[1].collect()


def test_replay_checks_payloads(spark):
    cache = spark.createDataFrame([("1", "p", "r", "m", 5)], "request_id string, payload string, response string, model string, usage_tokens int")
    ask = lambda i, p: readers.replay(spark.createDataFrame([(i, p)], "request_id string, payload string"), cache).collect()
    assert ask("1", "p")[0]["response"] == "r"
    with pytest.raises(Exception, match="another payload"):
        ask("1", "q")
    with pytest.raises(Exception, match="no stored response"):
        ask("2", "p")


HOP = "id string, question string, context array<struct<title:string,sentences:array<string>>>, supporting_facts array<struct<title:string,sent:int>>"


def test_multi_hop_adapter(spark):
    rows = [("a", "q", [("T", ["One.", "Two."]), ("U", ["Three."])], [("T", 1), ("U", 0)]), ("b", "q", [("T", ["One."])], [("V", 0)]), ("c", "q", [("T", ["One."])], [("T", 4)])]
    docs, gold, audit = adapters.multi_hop(spark.createDataFrame(rows, HOP))
    d, g = docs.first(), gold.first()
    assert d["text"] == "[T]\nOne.\nTwo.\n[U]\nThree.\n"
    assert [d["text"][s["start"] : s["stop"]] for s in g["ranges"]] == ["Two.\n", "Three.\n"]
    assert {tuple(r) for r in audit.collect()} == {("b", "missing_title"), ("c", "sentence_id_out_of_range")}


def test_paragraph_adapters(spark):
    rows = [("a", "q", True, [("T", "one ", True), ("U", "two", False)]), ("b", "q", False, [("T", "x", True)])]
    docs, gold, audit = adapters.titled_paragraphs(spark.createDataFrame(rows, "id string, question string, answerable boolean, paragraphs array<struct<title:string,text:string,is_supporting:boolean>>"))
    text = docs.first()["text"]
    assert [text[s["start"] : s["stop"]] for s in gold.first()["ranges"]] == ["one\n"]
    assert audit.first()["reason"] == "unanswerable"
    assert [r["id"] for r in adapters.indexed_paragraphs(docs).orderBy("paragraph").collect()] == ["p0001", "p0002"]
    said = spark.createDataFrame([("a", [["p0001", "p0002"]]), ("z", [["p0001"]])], "doc_id string, tiles array<array<string>>")
    assert adapters.checked_predictions(docs, said).first()["failure"] is None
    assert adapters.checked_predictions(docs, said.unionAll(said)).first()["failure"] == "repeated"


def test_paper_and_meeting_adapters(spark):
    papers = [("p", ["First  para.", "Second.", "Second."], [("q?", [(["First para."],), (["Second."],), (["FLOAT SELECTED: x"],)])])]
    docs, gold, audit = adapters.annotated_papers(spark.createDataFrame(papers, "id string, paragraphs array<string>, qas array<struct<question:string,answers:array<struct<evidence:array<string>>>>>"))
    assert docs.count() == 1 and [r["alternative"] for r in gold.collect()] == [0]
    assert sorted(r["reason"] for r in audit.collect()) == ["ambiguous", "float_evidence"]
    m = [("m", [("A", "hi"), ("B", "yo")], [("q", [[0, 1]])])]
    schema = "id string, turns array<struct<speaker:string,content:string>>, queries array<struct<query:string,spans:array<array<int>>>>"
    docs, gold, _ = adapters.meetings(spark.createDataFrame(m, schema))
    assert docs.first()["text"] == "A: hi\nB: yo\n" and tuple(gold.first()["ranges"][0]) == (0, 12)
    with pytest.raises(Exception, match="out of range"):
        adapters.meetings(spark.createDataFrame([("m", [("A", "hi")], [("q", [[0, 3]])])], schema))[1].collect()


def test_contract_clinical_and_judged_adapters(spark):
    c = spark.createDataFrame([("c", "abcdef", [[0, 3], [3, 6]], {"h": ("Entailment", [1, 1]), "n": ("NotMentioned", [])})], "id string, text string, spans array<array<int>>, annotations map<string,struct<choice:string,spans:array<int>>>")
    docs, gold, audit = adapters.span_contracts(c, spark.createDataFrame([("h", "H?"), ("n", "N?")], "key string, hypothesis string"))
    assert [tuple(x) for x in gold.first()["ranges"]] == [(3, 6)] and audit.first()["reason"] == "not_mentioned" and docs.first()["query"] == "H?"
    p = spark.createDataFrame([(1, "x", "i", "c", "o"), (2, "x", "i", "c", "o")], "prompt long, article string, intervention string, comparator string, outcome string")
    a = spark.createDataFrame([(1, "x", 0, 4), (1, "x", 0, 4), (2, "x", 3, 99)], "prompt long, article string, start int, stop int")
    docs, gold, audit = adapters.clinical_prompts(p, a, spark.createDataFrame([("x",)], "article string"), spark.createDataFrame([("x", "line\n\nmore\n")], "article string, text string"))
    assert gold.count() == 1 and audit.first()["reason"] == "no_valid_span" and [tuple(s) for s in docs.first()["atoms"]] == [(0, 5), (6, 11)]
    q = spark.createDataFrame([("q", "p", "?")], "id string, paper string, question string")
    rows = spark.createDataFrame([("p", 1, 7, 0, "B"), ("p", 0, 3, 0, "A"), ("p", 2, 7, 1, "C")], "paper string, idx int, pidx int, sidx int, content string")
    docs, gold, _ = adapters.judged_passages(q, rows, spark.createDataFrame([("q", 7)], "id string, pidx int"))
    assert docs.first()["text"] == "A\nBC\n" and tuple(gold.first()["ranges"][0]) == (2, 5)


def test_reader_steps(spark):
    rows = spark.createDataFrame([json.loads(json.dumps(job("p")))], readers.JOB)
    questions, docs = readers.job_tables(rows)
    model = lambda sent: sent.withColumn("raw", F.when(F.col("payload").contains("Found"), "so the answer is: alpha.").otherwise("Found it. Next"))
    got = reader.stepwise(questions, docs, model).first()
    assert (got["answer"], got["steps"], len(got["request_ids"])) == ("alpha", 2, 2)
    once = reader.one_shot(questions, docs, docs.select("job_id", "pos"), lambda s: s.withColumn("raw", F.lit("So the answer is: beta."))).first()
    assert (once["answer"], once["ok"]) == ("beta", True)


def test_learned(spark):
    atoms = spark.createDataFrame([(1, i, "red fox jumps" if i % 2 else "blue sea waves") for i in range(12)], "doc_id long, atom int, text string")
    model = learned.LatentModel.fit(atoms, rank=2)
    v = {r["atom"]: r["vector"] for r in model.encode(atoms).collect()}
    near, far = sum(a * b for a, b in zip(v[1], v[3], strict=True)), sum(a * b for a, b in zip(v[0], v[1], strict=True))
    assert near > 0.99 and abs(far) < 0.1
    rows = spark.createDataFrame([(float(i), i % 3 == 0) for i in range(30)], "x double, y boolean").withColumn("label", (F.col("x") > 14).cast("int"))
    fitted = learned.balanced_logistic(rows, ["x"])
    assert learned.probabilities(fitted, rows, ["x"]).where("x = 29").first()["p"] > 0.9


def test_stream_maintains_top_k(spark, tmp_path):
    corpus, changes, results = str(tmp_path / "corpus"), str(tmp_path / "changes"), str(tmp_path / "results")
    spark.createDataFrame([(i, f"alpha {'beta ' * (i % 4)}x{i}") for i in range(30)], "id long, text string").write.parquet(f"{corpus}/v0")
    spark.createDataFrame([(90, "beta beta beta beta beta", "upsert", 1), (3, None, "delete", 2)], maintain.CHANGES).coalesce(1).write.parquet(changes)
    plan = snapshot.Plan("beta", 3)
    maintain.maintain(spark, spark.readStream.schema(maintain.CHANGES).parquet(changes), corpus, results, str(tmp_path / "cp"), plan).awaitTermination(120)
    got = spark.read.parquet(results).orderBy("rank").collect()
    want = snapshot.top(snapshot.Snapshot(spark.read.parquet(f"{corpus}/v1")).scores(plan), 3).orderBy("rank").collect()
    assert [r["id"] for r in got] == [r["id"] for r in want] and got[0]["id"] == 90


def test_windowed_stream(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'a' event_type, 1.0D value union all select timestamp'2024-01-01 00:50:00', 'a', 2.0D").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "e"))
    q = maintain.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("windowed").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("select n, total from windowed").first() == (2, 3.0)
