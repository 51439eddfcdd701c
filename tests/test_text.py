"""Text functions against their plain meaning."""

from pyspark.sql import functions as F

from evispan.functions import text as tx
from evispan.operators.answers import audited_match, compose_selective, score_pairs, usage


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_normal_answer_order(spark):
    assert one(spark, tx.normal_answer(F.lit("The A-Team!"))) == "ateam"
    assert one(spark, tx.normal_answer(F.lit("  an  Owl, the bird "))) == "owl bird"


def test_dates(spark):
    forms = ["5 March 2011", "March 5, 2011.", " 5 Mar 2011", "Mar 5, 2011", "2011", "5th of March"]
    rows = spark.createDataFrame([(f,) for f in forms], ["t"]).select(tx.date_key(F.col("t")).alias("d")).collect()
    assert [r["d"] for r in rows] == ["2011-03-05"] * 4 + [None, None]


def test_terminal_answer(spark):
    m = tx.ANSWER_MARK
    cases = {"no marker": ("no marker", False), f"x {m}Oslo.": ("Oslo", True), f"{m}a {m}b": (f"{m}a {m}b", False), f"{m}a\nb": (f"{m}a\nb", False), f"{m} ": (f"{m} ", False)}
    rows = spark.createDataFrame([(k,) for k in cases], ["t"]).select("t", tx.terminal_answer(F.col("t")).alias("r")).collect()
    assert {r["t"]: (r["r"]["answer"], r["r"]["ok"]) for r in rows} == cases


def test_strict_decision(spark):
    good = ['{"decision":"commit","value":7}', ' {"value":0,"decision":"deny"} ']
    bad = ['{"decision":"deny","value":1}', '{"decision":"commit","value":true}', '{"decision":"commit","value":1,"value":2}', '{"decision":"commit"}', '{"decision":"commit","value":-1}', "x", '{"decision":"commit","value":1,"more":2}']
    rows = spark.createDataFrame([(t,) for t in good + bad], ["t"]).select(tx.strict_decision(F.col("t")).alias("d")).collect()
    assert [tuple(r["d"]) for r in rows] == [("commit", 7), ("deny", 0)] + [(None, None)] * len(bad)


def test_occurrences_overlap_or_not(spark):
    assert one(spark, tx.occurrences(F.lit("aaaa"), F.lit("aa"))) == [0, 1, 2]
    assert one(spark, tx.count_apart(F.lit("aaaa"), F.lit("aa"))) == 2
    assert one(spark, tx.occurrences(F.lit(r"a\Eb.*a\Eb"), F.lit(r"\Eb"))) == [1, 7]
    assert one(spark, tx.occurrences(F.lit("abc"), F.lit(""))) == []


def test_anchor(spark):
    got = one(spark, tx.resolve_anchor(F.lit("one two one"), F.lit("one"), F.lit("two "), F.lit(""), F.lit(None).cast("int")))
    assert tuple(got) == ("resolved", 8, 1.0)
    got = one(spark, tx.resolve_anchor(F.lit("one two one"), F.lit("one"), F.lit(""), F.lit(""), F.lit(7)))
    assert tuple(got) == ("resolved", 8, 0.75)
    assert one(spark, tx.resolve_anchor(F.lit("one two one"), F.lit("one"), F.lit(""), F.lit(""), F.lit(4)))["status"] == "ambiguous"
    assert one(spark, tx.resolve_anchor(F.lit("x"), F.lit("one"), F.lit(""), F.lit(""), F.lit(4)))["status"] == "missing"


def test_edits(spark):
    edit = lambda *a: one(spark, tx.apply_edit(F.lit("abcdef"), *[F.lit(x) for x in a]))
    assert edit("insert", 2, 2, "X") == "abXcdef"
    assert edit("delete", 1, 3, "") == "adef"
    assert edit("rewrite", 0, 6, "z") == "z"
    assert edit("move", 0, 2, "", 6) == "cdefab"
    assert edit("move", 4, 6, "", 0) == "efabcd"


def test_answers(spark):
    pairs = spark.createDataFrame([(1, "The cat sat", "a cat"), (1, "The cat sat", "cat sat"), (2, "", "the"), (3, "dog", "")], ["k", "answer", "gold"])
    got = {r["k"]: (r["em"], round(r["f1"], 6)) for r in score_pairs(pairs, ["k"]).collect()}
    assert got == {1: (True, 1.0), 2: (True, 1.0), 3: (False, 0.0)}
    assert one(spark, audited_match(F.lit("5 March 2011"), F.array(F.lit("March 5, 2011"))))


def test_compose_and_usage(spark):
    first = spark.createDataFrame([(1, "UNKNOWN.", ["a"]), (2, "bad", ["b"])], ["k", "answer", "request_ids"])
    back = spark.createDataFrame([(1, "yes", ["c", "c"]), (2, "no", ["d"])], ["k", "answer", "request_ids"])
    done = {r["k"]: (r["answer"], r["request_ids"]) for r in compose_selective(first, back, ["k"]).collect()}
    assert done == {1: ("yes", ["a", "c", "c"]), 2: ("bad", ["b"])}
    paid = usage(compose_selective(first, back, ["k"]), spark.createDataFrame([("a", 1), ("b", 2), ("c", 5)], ["request_id", "tokens"]), ["k"])
    assert {r["k"]: (r["calls"], r["tokens"]) for r in paid.collect()} == {1: (3, 11), 2: (1, 2)}


def test_minimal_ids(spark):
    cases = {"p0001\nEND": (["p0001"], None), "NONE\nEND": ([], None), "p0001": ([], "no_end"), "p1\nEND": ([], "bad_line"), "p0002+p0002\nEND": ([], "repeated_id")}
    rows = spark.createDataFrame([(k,) for k in cases], ["t"]).select("t", tx.minimal_ids(F.col("t")).alias("r")).collect()
    assert {r["t"]: (r["r"]["tiles"], r["r"]["error"]) for r in rows} == cases
