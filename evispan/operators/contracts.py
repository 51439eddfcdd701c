"""Contracts of records that come from outside: keys, labels, external partitions and rankings, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispan.functions.text import count_apart

#: The metadata fields that may hold a case's query, and those that name its resampling cluster, in order.
QUERY_KEYS = ["question", "hypothesis", "claim", "query"]
CLUSTER_KEYS = ["paper_id", "contract_id", "meeting_id", "source_document_id"]


def is_intlike(text: Column) -> Column:
    """Whether a string is an integer: digits after minus signs, white space around them aside."""
    return F.coalesce(F.trim(F.regexp_replace(text, r"^\s+|\s+$", "")).rlike(r"^-*[0-9]+$"), F.lit(False))


def _filled(c: Column) -> Column:
    return F.when(c.cast("string") != "", c.cast("string"))


def query_text(doc_id: Column, fields: dict[str, Column], label: Column) -> Column:
    """The first query field that isn't empty, else the first gold label; none raises."""
    found = F.coalesce(*[_filled(fields[k]) for k in QUERY_KEYS if k in fields], _filled(label))
    return F.when(found.isNull(), F.raise_error(F.concat(doc_id.cast("string"), F.lit(": no visible query"))).cast("string")).otherwise(found)


def cluster_id(dataset: Column, doc_id: Column, fields: dict[str, Column]) -> Column:
    """dataset:field:value of the first cluster field that isn't empty, else dataset:document:id."""
    named = [F.concat_ws(":", F.coalesce(dataset, F.lit("unknown")), F.lit(k), _filled(fields[k])) for k in CLUSTER_KEYS if k in fields]
    have = [_filled(fields[k]).isNotNull() for k in CLUSTER_KEYS if k in fields]
    out = F.concat_ws(":", F.coalesce(dataset, F.lit("unknown")), F.lit("document"), doc_id.cast("string"))
    for value, there in reversed(list(zip(named, have, strict=True))):
        out = F.when(there, value).otherwise(out)
    return out


def turn_groups(turns: DataFrame, size: int = 1) -> DataFrame:
    """(conv_id, block, start, stop): `size` consecutive turns (conv_id, turn, start, stop) as one range."""
    if size <= 0:
        raise ValueError("a group needs a turn")
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return turns.withColumn("block", F.floor(at / size).cast("long")).groupBy("conv_id", "block").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))


def render_policy(scope: Column, kind: Column, revision: Column, params: dict[str, Column], repetitions: Column, padding: Column) -> Column:
    """A policy's text: its scope repeated, its record as JSON with sorted keys, and filler words."""
    record = {"type": F.lit("policy"), "scope": scope, "kind": kind, "revision": revision, **params}
    body = F.to_json(F.struct(*[record[k].alias(k) for k in sorted(record)]))
    words = lambda w, n: F.trim(F.repeat(F.concat(w, F.lit(" ")), n))
    return F.regexp_replace(F.concat(words(scope, repetitions), F.lit("\n"), body, F.lit("\n"), words(F.lit("archive"), padding)), r"^\s+|\s+$", "")


def softmax(logits: DataFrame, keys: list[str]) -> DataFrame:
    """logits (keys, label, logit) with `probability` among the labels of its keys."""
    w = Window.partitionBy(*keys)
    shifted = logits.withColumn("_e", F.exp(F.col("logit") - F.max("logit").over(w)))
    return shifted.withColumn("probability", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def ranking_schema(labels: list[str]) -> dict:
    """The JSON schema of a ranking of all labels: rank_1, rank_2 … each one of them."""
    names = [f"rank_{i}" for i in range(1, len(labels) + 1)]
    return {"type": "object", "properties": {n: {"type": "string", "enum": labels} for n in names}, "required": names, "additionalProperties": False}


def parsed_ranking(body: Column, labels: Column) -> Column:
    """The labels in the order that a response's output text ranks them; null where it isn't a ranking of all."""
    items = "array<struct<type:string,content:array<struct<type:string,text:string>>>>"
    output = F.from_json(F.get_json_object(body, "$.output"), items)
    texts = F.flatten(F.transform(F.filter(output, lambda o: o["type"] == "message"), lambda o: F.transform(F.filter(o["content"], lambda c: c["type"] == "output_text"), lambda c: c["text"])))
    given = F.from_json(F.try_element_at(texts, F.lit(-1)), "map<string,string>")
    ranked = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.element_at(given, F.concat(F.lit("rank_"), i.cast("string"))))
    return F.when((F.size(labels) > 0) & (F.array_sort(ranked) == F.array_sort(labels)), ranked)


TILE = "array<struct<tile_id:string,quotes:array<string>,dependencies:array<string>,confidence:double>>"


def external_problem(text: Column, tiles: Column) -> Column:
    """What is wrong with tiles (TILE) that a model returned for a text; null where nothing is.

    Names must be there and differ, every quote stand in the text exactly once, counted without
    overlap, and dependencies be names of tiles.
    """
    ids = F.transform(tiles, lambda t: t["tile_id"])
    unnamed = F.exists(ids, lambda i: i.isNull() | (i == "")) | (F.size(F.array_distinct(ids)) < F.size(ids))
    empty = F.exists(tiles, lambda t: t["quotes"].isNull() | (F.size(t["quotes"]) < 1) | F.exists(t["quotes"], lambda q: q.isNull() | (q == "")))
    apart = F.exists(tiles, lambda t: F.exists(t["quotes"], lambda q: count_apart(text, q) != 1))
    known = F.exists(tiles, lambda t: F.exists(F.coalesce(t["dependencies"], F.array().cast("array<string>")), lambda d: ~F.array_contains(ids, d)))
    return F.when(unnamed, "tile_id").when(empty, "quotes").when(apart, "quote_count").when(known, "dependency")


def valid_external_tiles(cases: DataFrame) -> DataFrame:
    """cases (doc_id, text, tiles) flattened to (doc_id, tile_id, quotes, dependencies, confidence); a wrong one raises."""
    wrong = external_problem(F.col("text"), F.col("tiles"))
    sure = F.when(wrong.isNotNull(), F.raise_error(F.concat(F.col("doc_id").cast("string"), F.lit(": "), wrong)).cast(TILE)).otherwise(F.col("tiles"))
    return cases.select("doc_id", F.explode(sure).alias("t")).select("doc_id", "t.*")


def sample_fingerprint(sample: DataFrame, order: str) -> DataFrame:
    """One row, `sha`: the SHA-256 of all ids and text digests in order. It hangs on the order, so it is one task's work: for samples."""
    one = F.concat(F.encode(F.col("doc_id").cast("string"), "UTF-8"), F.unhex(F.lit("00")), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), F.unhex(F.lit("0A")))
    line = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), one.alias("b")))), lambda x: x["b"])
    return sample.agg(F.sha2(F.aggregate(line, F.unhex(F.lit("")), lambda a, b: F.concat(a, b)), 256).alias("sha"))


def exported_cases(documents: DataFrame, paragraphs: DataFrame, instruction: str) -> DataFrame:
    """(case_id, query, paragraphs, instruction) of documents (doc_id, query) and their numbered paragraphs (doc_id, pos, id, text); gold has no place in it."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("pos", "id", "text"))), lambda p: F.struct(p["id"].alias("id"), p["text"].alias("text")))
    per = paragraphs.groupBy("doc_id").agg(line.alias("paragraphs"))
    none = F.array().cast("array<struct<id:string,text:string>>")
    return documents.join(per, "doc_id", "left").select(F.col("doc_id").alias("case_id"), "query", F.coalesce("paragraphs", none).alias("paragraphs"), F.lit(instruction).alias("instruction"))


def export_stats(cases: DataFrame) -> DataFrame:
    return cases.agg(F.count("*").alias("cases"), F.coalesce(F.avg(F.size("paragraphs")), F.lit(0.0)).alias("mean_paragraphs"), F.coalesce(F.max(F.size("paragraphs")), F.lit(0)).alias("max_paragraphs"))
