"""Jobs and labels from records of titled paragraphs: two tables, of which only the second knows the answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A record: titled paragraphs as sentences, the supporting (title, sentence) pairs, and the answer.
RECORD = "id string, question string, answer string, type string, context array<struct<title:string,sentences:array<string>>>, supporting_facts array<struct<title:string,sent:int>>"


def quarter_of_characters(frame: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(frame) / 4)).cast("int")


def jobs_and_labels(records: DataFrame, cost: Callable[[Column], Column] = quarter_of_characters) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs, labels, audit): jobs (id, question, stratum, docs), labels (id, answers, support_indices), audit (id, reason).

    A candidate is a paragraph; its cost is that of its title and text. A record whose support names
    no paragraph or sentence, or that has no answer or repeats a title, goes to the audit.
    """
    title = lambda p: p["title"]
    rows = records.withColumn("_t", F.transform("context", title))
    lost = F.exists("supporting_facts", lambda f: ~F.array_contains("_t", f["title"]))
    size = F.map_from_arrays(F.array_distinct("_t"), F.transform(F.array_distinct("_t"), lambda t: F.size(F.element_at(F.filter("context", lambda p: p["title"] == t), 1)["sentences"])))
    beyond = F.exists("supporting_facts", lambda f: (f["sent"] < 0) | (f["sent"] >= F.element_at(size, f["title"])))
    reason = F.when(F.coalesce(F.length(F.trim("answer")), F.lit(0)) == 0, "no_answer").when(F.size(F.array_distinct("_t")) < F.size("_t"), "title_repeats").when(F.coalesce(F.size("supporting_facts"), F.lit(0)) < 1, "no_support").when(lost, "missing_title").when(beyond, "sentence_id_out_of_range")
    rows = rows.withColumn("_reason", reason)
    good = rows.where("_reason is null")
    text = lambda p: F.array_join(p["sentences"], "")
    doc = lambda p, i: F.struct(F.concat_ws("::", "id", i.cast("string")).alias("id"), p["title"].alias("title"), text(p).alias("text"), F.sha2(text(p), 256).alias("sha256"), cost(F.concat(p["title"], F.lit("\n"), text(p))).alias("tokens"))
    jobs = good.select("id", "question", F.coalesce("type", F.lit("all")).alias("stratum"), F.transform("context", doc).alias("docs"))
    places = F.array_sort(F.array_distinct(F.transform("supporting_facts", lambda f: (F.array_position("_t", f["title"]) - 1).cast("int"))))
    labels = good.select("id", F.array("answer").alias("answers"), places.alias("support_indices"))
    return jobs, labels, rows.where("_reason is not null").select("id", F.col("_reason").alias("reason"))
