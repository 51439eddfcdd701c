"""Readers and writers of the interchange formats, all through Spark's sources."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORBIDDEN_LABEL_KEYS = ("answers", "support_indices", "supporting_facts")

_TEXT = T.StringType()
_DOC = T.StructType([*[T.StructField(n, _TEXT) for n in ("id", "title", "text", "sha256")], T.StructField("tokens", T.IntegerType())])
JOB = T.StructType([*[T.StructField(n, _TEXT) for n in ("id", "question", "stratum", "split")], T.StructField("docs", T.ArrayType(_DOC))])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, value) of text files; numbers count from 1 in each file, which is read in one piece."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", r"\r?\n", -1)).alias("n", "value")).select("path", (F.col("n") + 1).alias("line_no"), "value")


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of a JSON array or of JSON lines, by the first character; a malformed record fails the read."""
    first = spark.read.text(path, wholetext=True).select(F.substring(F.ltrim("value"), 1, 1)).first()
    array = first is not None and first[0] == "["
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", array).json(path)


def read_jsonl_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank lines are skipped, a malformed one raises with its file and line."""
    rows = _lines(spark, path).where(F.trim("value") != "")
    shape = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = rows.withColumn("r", F.from_json("value", shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    where = F.concat_ws(":", "path", "line_no")
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull() | ~F.col("value").rlike(r"^\s*\{")
    return parsed.where(F.when(bad, F.raise_error(F.concat(F.lit("malformed record at "), where)).cast("boolean")).otherwise(True)).select("r.*").drop("_bad")


def read_jsonl_unique(spark: SparkSession, path: str, schema: T.StructType, key: str) -> tuple[DataFrame, DataFrame]:
    """(first record of each key, audit of malformed lines and repeated keys) of JSON lines."""
    rows = _lines(spark, path).where(F.trim("value") != "").withColumn("r", F.from_json("value", schema))
    good = rows.where(F.col("value").rlike(r"^\s*\{") & F.col(f"r.{key}").isNotNull())
    w = Window.partitionBy(f"r.{key}").orderBy("path", "line_no")
    ranked = good.withColumn("k", F.row_number().over(w))
    audit = rows.agg(F.count("*").alias("lines")).join(ranked.agg(F.count_if(F.col("k") == 1).alias("loaded"), F.count_if(F.col("k") > 1).alias("repeated")))
    return ranked.where("k = 1").select("r.*"), audit.select("lines", "loaded", "repeated", (F.col("lines") - F.col("loaded") - F.col("repeated")).alias("malformed"))


def read_enveloped(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of JSON, JSON lines, or {"rows": [{"row": ...}]}; an empty file has none."""
    whole = spark.read.text(path, wholetext=True).where(F.trim("value") != "")
    inner = f"struct<rows:array<struct<row:{schema.simpleString()}>>>"
    head = F.substring(F.ltrim("value"), 1, 1)
    is_array, is_envelope = head == "[", (head == "{") & F.col("value").rlike(r'^\s*\{\s*"rows"\s*:')
    lines = whole.where(~is_array & ~is_envelope).select(F.explode(F.split("value", r"\r?\n")).alias("value")).where(F.trim("value") != "").select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"))
    arrays = whole.where(is_array).select(F.explode(F.from_json("value", T.ArrayType(schema))).alias("r"))
    wrapped = whole.where(is_envelope).select(F.explode(F.from_json("value", inner)["rows"]["row"]).alias("r"))
    return lines.unionByName(arrays).unionByName(wrapped).where("r is not null").select("r.*")


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet, ORC, CSV with a header (a byte-order mark is tolerated) or JSON, by suffix."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        return df.toDF(*[c.lstrip("﻿") for c in df.columns])
    if kind in ("json", "jsonl", "ndjson"):
        if schema is None:
            raise ValueError("JSON needs a schema")
        return read_records(spark, path, schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.orc(path) if kind == "orc" else reader.parquet(path)


def read_bodies(spark: SparkSession, folder: str, glob: str = "*.txt") -> DataFrame:
    """(name, text) of whole text files under a folder, the name without its suffix."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder, wholetext=True)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("name"), F.col("value").alias("text"))


def locate_once(spark: SparkSession, folder: str, names: list[str]) -> dict[str, str]:
    """Paths of files that must each stand exactly once under a folder."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path").where(F.regexp_extract("path", "([^/]+)$", 1).isin(names)).collect()
    by = {n: [r["path"] for r in listed if r["path"].endswith("/" + n)] for n in names}
    for n, found in by.items():
        if len(found) != 1:
            raise ValueError(f"{n} stands {len(found)} times under {folder}")
    return {n: found[0] for n, found in by.items()}


def file_digests(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, sha256) of files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def feature_pairs(spark: SparkSession, root: str) -> DataFrame:
    """(task, a, b, a_sha256, b_sha256, shared) of unordered feature pairs in <name>_task/task<N>/feature<N>/feature.patch trees.

    shared are the files that both patches touch.
    """
    from evispan.functions.text import touched_files

    patches = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "feature.patch").text(root, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("patch"))
    part = lambda k: F.regexp_extract("path", r"([^/]+_task)/task(\d+)/feature(\d+)/feature\.patch$", k)
    f = patches.select(F.concat_ws("/", part(1), part(2)).alias("task"), part(3).cast("int").alias("n"), F.sha2("patch", 256).alias("sha"), touched_files(F.col("patch")).alias("files"))
    a, b = f.toDF("task", "a", "a_sha256", "a_files"), f.toDF("task", "b", "b_sha256", "b_files")
    return a.join(b, "task").where("a < b").select("task", "a", "b", "a_sha256", "b_sha256", F.array_intersect("a_files", "b_files").alias("shared"))


def job_tables(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions, candidates) of nested jobs; label keys in a job or repeated ids are errors, found in one pass."""
    leaked = [k for k in FORBIDDEN_LABEL_KEYS if k in jobs.columns]
    if leaked:
        raise ValueError(f"labels in jobs: {leaked}")
    flat = jobs.select(F.col("id").alias("job_id"), F.posexplode("docs").alias("pos", "d")).select("job_id", "pos", F.col("d.id").alias("doc_id"), "d.title", "d.text", "d.sha256", "d.tokens")
    checks = F.when(F.sha2("text", 256) != F.col("sha256"), "the digest isn't the body's").when(F.col("tokens") <= 0, "a cost isn't positive").when(F.col("doc_id").isNull() | F.col("title").isNull() | F.col("text").isNull(), "a field is missing")
    again = F.count("*").over(Window.partitionBy("job_id", "doc_id")) > 1
    problem = F.coalesce(checks, F.when(again, "a doc id repeats"))
    sound = flat.withColumn("_p", problem).where(F.when(F.col("_p").isNotNull(), F.raise_error(F.concat_ws(": ", "job_id", "_p")).cast("boolean")).otherwise(True)).drop("_p")
    return jobs.select(F.col("id").alias("job_id"), "question", "stratum"), sound


def nested_jobs(questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """The nested form of job_tables(), candidates in position order."""
    docs = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("doc_id").cast("string").alias("id"), "title", "text", "sha256", "tokens"))), lambda d: d.dropFields("pos"))
    return questions.join(candidates.groupBy("job_id").agg(docs.alias("docs")), "job_id").select(F.col("job_id").alias("id"), "question", "stratum", "docs")


def write_new(df: DataFrame, path: str, kind: str = "json") -> None:
    """Write where nothing stands yet; an existing target is an error."""
    writer = df.write.mode("errorifexists")
    writer.option("header", True).csv(path) if kind == "csv" else getattr(writer, kind)(path)


def replay(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests (request_id, payload) with their stored response; a payload that differs from the stored one, or a missing record, raises.

    There is no live transport: what isn't stored can't be asked.
    """
    c = cache.select("request_id", F.col("payload").alias("_stored"), "response", "model", "usage_tokens")
    met = requests.join(c, "request_id", "left")
    wrong = F.when(F.col("_stored").isNull(), "no stored response for ").when(F.col("_stored") != F.col("payload"), "another payload is stored for ")
    return met.where(F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, "request_id")).cast("boolean")).otherwise(True)).drop("_stored")


def request_id(payload):
    """A request's identity: the digest of its canonical JSON text."""
    return F.sha2(payload, 256)


def normal_columns(df: DataFrame) -> DataFrame:
    """Columns by names without case or punctuation, for sources that spell them differently."""
    return df.toDF(*[re.sub(r"[^a-z0-9]", "", c.lower()) for c in df.columns])
