"""Adapters from nested benchmark records to documents with offset ranges and gold tiles.

Each gives (documents, gold, audit): documents (doc_id, text, query, atoms), atoms being
half-open ranges; gold (doc_id, tile, alternative, ranges), alternatives of which the best counts;
audit (doc_id, reason) of what was left out and why. Nothing is dropped without an audit row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispan.functions.intervals import KIND, span
from evispan.functions.text import collapse_spaces


def laid_out(pieces: DataFrame, key: str, order: list[str]) -> DataFrame:
    """pieces (key, order, piece, …) with start and stop in the concatenation of a key's pieces."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return pieces.withColumn("stop", F.sum(F.length("piece")).over(w).cast("int")).withColumn("start", F.col("stop") - F.length("piece"))


def whole_text(pieces: DataFrame, key: str, order: list[str]) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(*order, "piece"))), lambda p: p["piece"])
    return pieces.groupBy(key).agg(F.array_join(ordered, "").alias("text"))


def _ranges(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.array_distinct(F.array_sort(F.collect_list(span(F.col("start"), F.col("stop"))))).alias("ranges"))


def multi_hop(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions with titled paragraphs of sentences: (id, question, context array<struct<title,sentences>>, supporting_facts array<struct<title,sent>>).

    A text is "[title]" lines and sentence lines; sentence ranges include the line end. Records
    whose support doesn't resolve are audited with missing_title or sentence_id_out_of_range.
    """
    paras = records.select(F.col("id").alias("doc_id"), F.posexplode("context").alias("p", "c"))
    sents = paras.select("doc_id", "p", F.col("c.title").alias("title"), F.posexplode("c.sentences").alias("s", "sentence"))
    want = records.select(F.col("id").alias("doc_id"), F.explode("supporting_facts").alias("f")).select("doc_id", F.col("f.title").alias("title"), F.col("f.sent").alias("s"))
    titles = paras.select("doc_id", F.col("c.title").alias("title"), F.size("c.sentences").alias("n"))
    judged = want.join(titles, ["doc_id", "title"], "left").withColumn("reason", F.when(F.col("n").isNull(), "missing_title").when((F.col("s") < 0) | (F.col("s") >= F.col("n")), "sentence_id_out_of_range"))
    audit = judged.where("reason is not null").select("doc_id", "reason").distinct()
    heads = paras.select("doc_id", "p", F.lit(-1).alias("s"), F.concat(F.lit("["), F.col("c.title"), F.lit("]\n")).alias("piece"), F.col("c.title").alias("title"))
    body = sents.select("doc_id", "p", "s", F.concat("sentence", F.lit("\n")).alias("piece"), "title")
    pieces = heads.unionByName(body).join(audit.select("doc_id").distinct(), "doc_id", "left_anti")
    placed = laid_out(pieces, "doc_id", ["p", "s"])
    gold = _ranges(placed.where("s >= 0").join(want.distinct(), ["doc_id", "title", "s"], "left_semi"), ["doc_id"]).select("doc_id", F.lit(0).alias("tile"), F.lit(0).alias("alternative"), "ranges")
    atoms = _ranges(placed.where("s >= 0"), ["doc_id"]).withColumnRenamed("ranges", "atoms")
    docs = whole_text(pieces, "doc_id", ["p", "s"]).join(atoms, "doc_id").join(records.select(F.col("id").alias("doc_id"), F.col("question").alias("query")), "doc_id")
    return docs.select("doc_id", "text", "query", "atoms"), gold, audit


def titled_paragraphs(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions with paragraphs: (id, question, answerable, paragraphs array<struct<title,text,is_supporting>>); unanswerable or unsupported ones are audited."""
    reason = F.when(~F.coalesce("answerable", F.lit(True)), "unanswerable").when(~F.exists("paragraphs", lambda p: p["is_supporting"]), "no_support").when(F.size("paragraphs") == 0, "no_paragraphs")
    judged = records.withColumn("reason", reason)
    audit = judged.where("reason is not null").select(F.col("id").alias("doc_id"), "reason")
    flat = judged.where("reason is null").select(F.col("id").alias("doc_id"), F.posexplode("paragraphs").alias("p", "c"))
    head = flat.select("doc_id", "p", F.lit(0).alias("s"), F.concat(F.lit("["), F.col("c.title"), F.lit("]\n")).alias("piece"), F.lit(False).alias("good"))
    body = flat.select("doc_id", "p", F.lit(1).alias("s"), F.concat(F.rtrim("c.text"), F.lit("\n")).alias("piece"), F.col("c.is_supporting").alias("good"))
    pieces = head.unionByName(body)
    placed = laid_out(pieces, "doc_id", ["p", "s"])
    gold = _ranges(placed.where("good"), ["doc_id"]).select("doc_id", F.lit(0).alias("tile"), F.lit(0).alias("alternative"), "ranges")
    atoms = _ranges(placed.where("s = 1"), ["doc_id"]).withColumnRenamed("ranges", "atoms")
    docs = whole_text(pieces, "doc_id", ["p", "s"]).join(atoms, "doc_id").join(records.select(F.col("id").alias("doc_id"), F.col("question").alias("query")), "doc_id")
    return docs.select("doc_id", "text", "query", "atoms"), gold, audit


def annotated_papers(papers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Papers with questions and annotators: (id, paragraphs array<string>, qas array<struct<question, answers array<struct<evidence array<string>>>>>).

    Each annotator is an alternative. Evidence is matched to exactly one paragraph by its text with
    spaces collapsed; figure and table evidence, and what matches none or several, drops the
    annotation with a reason.
    """
    paras = papers.select(F.col("id").alias("paper"), F.posexplode("paragraphs").alias("p", "t"))
    pieces = paras.select("paper", "p", F.concat(F.rtrim("t"), F.lit("\n")).alias("piece"))
    placed = laid_out(pieces, "paper", ["p"]).withColumn("norm", collapse_spaces(F.col("piece")))
    qas = papers.select(F.col("id").alias("paper"), F.posexplode("qas").alias("q", "qa"))
    ann = qas.select("paper", "q", F.posexplode("qa.answers").alias("alternative", "a")).select("paper", "q", "alternative", F.col("a.evidence").alias("evidence"))
    ev = ann.select("paper", "q", "alternative", F.explode_outer("evidence").alias("e")).withColumn("norm", collapse_spaces(F.col("e")))
    met = ev.join(placed.select("paper", "norm", "start", "stop"), ["paper", "norm"], "left").groupBy("paper", "q", "alternative", "e").agg(F.count("start").alias("n"), F.min("start").alias("start"), F.min("stop").alias("stop"))
    why = F.when(F.col("e").isNull(), "no_evidence").when(F.col("e").startswith("FLOAT SELECTED"), "float_evidence").when(F.col("n") == 0, "missing").when(F.col("n") > 1, "ambiguous")
    bad = met.withColumn("reason", why).groupBy("paper", "q", "alternative").agg(F.min("reason").alias("reason"))
    doc = F.concat_ws(":", "paper", "q")
    audit = bad.where("reason is not null").select(doc.alias("doc_id"), "alternative", "reason")
    sound = met.join(bad.where("reason is null").drop("reason"), ["paper", "q", "alternative"], "left_semi")
    gold = _ranges(sound.select(doc.alias("doc_id"), "alternative", "start", "stop"), ["doc_id", "alternative"]).select("doc_id", F.lit(0).alias("tile"), "alternative", "ranges")
    text = whole_text(pieces, "paper", ["p"]).join(_ranges(placed, ["paper"]).withColumnRenamed("ranges", "atoms"), "paper")
    docs = qas.select("paper", doc.alias("doc_id"), F.col("qa.question").alias("query")).join(text, "paper").join(gold.select("doc_id").distinct(), "doc_id", "left_semi")
    return docs.select("doc_id", "text", "query", "atoms"), gold, audit


def span_contracts(contracts: DataFrame, hypotheses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Contracts (id, text, spans array<array<int>>, annotations map<string, struct<choice, spans array<int>>>) against hypotheses (key, hypothesis); NotMentioned is audited."""
    a = contracts.select("id", "text", "spans", F.explode("annotations").alias("key", "v")).join(F.broadcast(hypotheses), "key", "left") if hypotheses.count() <= 10_000 else contracts.select("id", "text", "spans", F.explode("annotations").alias("key", "v")).join(hypotheses, "key", "left")
    doc = F.concat_ws(":", "id", "key")
    reason = F.when(F.col("hypothesis").isNull(), "unknown_hypothesis").when(F.col("v.choice") == "NotMentioned", "not_mentioned").when(F.size("v.spans") == 0, "no_spans").when(F.exists("v.spans", lambda i: (i < 0) | (i >= F.size("spans"))), "span_out_of_range")
    judged = a.withColumn("doc_id", doc).withColumn("reason", reason)
    audit = judged.where("reason is not null").select("doc_id", "reason")
    good = judged.where("reason is null")
    as_span = lambda p: span(p[0], p[1])
    gold = good.select("doc_id", F.lit(0).alias("tile"), F.lit(0).alias("alternative"), F.transform(F.array_distinct("v.spans"), lambda i: as_span(F.get("spans", i))).cast(KIND).alias("ranges"))
    docs = good.select("doc_id", "text", F.col("hypothesis").alias("query"), F.transform("spans", as_span).alias("atoms"))
    return docs, gold, audit


def judged_passages(questions: DataFrame, papers: DataFrame, qrels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions (id, paper, question), paper rows (paper, idx, pidx, sidx, content) and positive qrels (id, pidx): paragraphs in the order of their first idx, all judged ones gold."""
    paras = papers.groupBy("paper", "pidx").agg(F.min("idx").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "sidx", "content"))), lambda s: s["content"]), "").alias("body"))
    pieces = paras.select("paper", "first", "pidx", F.concat("body", F.lit("\n")).alias("piece"))
    placed = laid_out(pieces, "paper", ["first", "pidx"])
    want = questions.select(F.col("id").alias("doc_id"), "paper").join(qrels.select(F.col("id").alias("doc_id"), "pidx").distinct(), "doc_id")
    met = want.join(placed.select("paper", "pidx", "start", "stop"), ["paper", "pidx"], "left")
    audit = met.where("start is null").select("doc_id", F.lit("missing_paragraph").alias("reason")).distinct()
    gold = _ranges(met.join(audit.select("doc_id"), "doc_id", "left_anti"), ["doc_id"]).select("doc_id", F.lit(0).alias("tile"), F.lit(0).alias("alternative"), "ranges")
    text = whole_text(pieces, "paper", ["first", "pidx"]).join(_ranges(placed, ["paper"]).withColumnRenamed("ranges", "atoms"), "paper")
    docs = questions.select("paper", F.col("id").alias("doc_id"), F.col("question").alias("query")).join(text, "paper").join(gold.select("doc_id"), "doc_id", "left_semi")
    return docs.select("doc_id", "text", "query", "atoms"), gold, audit


def meetings(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Transcripts (id, turns array<struct<speaker,content>>, queries array<struct<query, spans array<array<int>>>>): inclusive turn spans become ranges; one out of range raises."""
    turns = records.select(F.col("id").alias("doc_id"), F.posexplode("turns").alias("p", "t")).select("doc_id", "p", F.concat(F.col("t.speaker"), F.lit(": "), F.col("t.content"), F.lit("\n")).alias("piece"))
    placed = laid_out(turns, "doc_id", ["p"])
    spans = records.select(F.col("id").alias("doc_id"), F.posexplode("queries").alias("tile", "q")).select("doc_id", "tile", F.explode("q.spans").alias("s")).select("doc_id", "tile", F.col("s")[0].alias("a"), F.col("s")[1].alias("b"))
    first, last = placed.select("doc_id", F.col("p").alias("a"), "start"), placed.select("doc_id", F.col("p").alias("b"), "stop")
    met = spans.join(first, ["doc_id", "a"], "left").join(last, ["doc_id", "b"], "left")
    met = met.where(F.when(F.col("start").isNull() | F.col("stop").isNull(), F.raise_error(F.lit("a turn span is out of range")).cast("boolean")).otherwise(True))
    gold = _ranges(met, ["doc_id", "tile"]).select("doc_id", "tile", F.lit(0).alias("alternative"), "ranges")
    docs = whole_text(turns, "doc_id", ["p"]).join(_ranges(placed, ["doc_id"]).withColumnRenamed("ranges", "atoms"), "doc_id")
    return docs.select("doc_id", "text", F.lit(None).cast("string").alias("query"), "atoms"), gold, records.sparkSession.createDataFrame([], "doc_id string, reason string")


def clinical_prompts(prompts: DataFrame, annotations: DataFrame, test_ids: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Prompts (prompt, article, intervention, comparator, outcome) of test articles, annotations (prompt, article, start, stop), texts (article, text): different spans are gold alternatives."""
    p = prompts.join(test_ids.distinct(), "article", "left_semi").join(texts, "article", "left")
    doc = F.col("prompt").cast("string")
    spans = annotations.join(p.select("prompt", "article", "text"), ["prompt", "article"]).where((F.col("start") >= 0) & (F.col("start") < F.col("stop")) & (F.col("stop") <= F.length("text"))).select(doc.alias("doc_id"), "start", "stop").distinct()
    has = spans.select("doc_id").distinct().withColumn("_has", F.lit(True))
    judged = p.withColumn("doc_id", doc).join(has, "doc_id", "left").withColumn("reason", F.when(F.col("text").isNull(), "missing_text").when(F.col("_has").isNull(), "no_valid_span"))
    alt = F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "stop")) - 1
    gold = spans.select("doc_id", F.lit(0).alias("tile"), alt.alias("alternative"), F.array(span(F.col("start"), F.col("stop"))).alias("ranges"))
    query = F.format_string("With respect to %s, what is the effect of %s compared with %s?", "outcome", "intervention", "comparator")
    docs = judged.where("reason is null").select("doc_id", "text", query.alias("query"), paragraph_lines(F.col("text")).alias("atoms"))
    return docs, gold, judged.where("reason is not null").select("doc_id", "reason")


def paragraph_lines(text: Column) -> Column:
    """Ranges of non-blank physical lines, line ends included."""
    from evispan.operators.segment import cut_after

    return F.filter(cut_after(text, r"\r\n|\n|\r"), lambda s: F.trim(F.regexp_replace(F.substring(text, s["start"] + 1, s["stop"] - s["start"]), r"[\r\n]", "")) != "")


def revisions(rows: DataFrame) -> DataFrame:
    """(doc_id, depth, before, after, intent) from rows whose texts stand under the first present of two names; one intent of all actions, else mixed or unknown."""
    first = lambda *names: F.coalesce(*[F.col(n) for n in names if n in rows.columns]) if any(n in rows.columns for n in names) else F.lit(None).cast("string")
    intents = F.array_distinct(F.filter(F.transform("edit_actions", lambda a: a["intent"]), lambda x: x.isNotNull())) if "edit_actions" in rows.columns else F.array().cast("array<string>")
    said = first("intent", "label")
    found = F.when(F.size(intents) == 1, intents[0]).when(F.size(intents) > 1, "mixed").otherwise("unknown")
    return rows.select("doc_id", F.col("revision_depth").cast("int").alias("depth"), first("before_revision", "before_sent").alias("before"), first("after_revision", "after_sent").alias("after"), F.coalesce(said, found).alias("intent"))


def memory_sessions(rows: DataFrame) -> DataFrame:
    """(id, sessions, evidence, has_update_signal) of long-memory cases."""
    kind = F.lower(F.col("question_type"))
    return rows.select(F.col("question_id").alias("id"), F.size("haystack_sessions").alias("sessions"), F.coalesce("answer_session_ids", F.array().cast("array<string>")).alias("evidence"), (kind.contains("update") | kind.contains("temporal")).alias("has_update_signal"))


def indexed_paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, id, text): atoms numbered p0001, … without their closing line ends; gold never appears."""
    flat = docs.select("doc_id", "text", F.posexplode("atoms").alias("k", "a"))
    return flat.select("doc_id", F.col("k").alias("paragraph"), F.format_string("p%04d", F.col("k") + 1).alias("id"), F.regexp_replace(F.substring(F.col("text"), F.col("a.start") + 1, F.col("a.stop") - F.col("a.start")), r"[\r\n]+$", "").alias("text"))


def checked_predictions(docs: DataFrame, predictions: DataFrame, most_tiles: int = 8, most_ids: int = 2) -> DataFrame:
    """(doc_id, tiles, failure) for every document: external predictions (doc_id, tiles array<array<string>>) joined fail-closed.

    Missing, repeated or invalid predictions give no tiles and a reason.
    """
    known = indexed_paragraphs(docs).groupBy("doc_id").agg(F.collect_set("id").alias("_known"))
    p = predictions.groupBy("doc_id").agg(F.count("*").alias("_n"), F.first("tiles").alias("_tiles"))
    met = docs.select("doc_id").join(p, "doc_id", "left").join(known, "doc_id", "left")
    tiles = F.col("_tiles")
    reason = (
        F.when(F.col("_n").isNull(), "missing")
        .when(F.col("_n") > 1, "repeated")
        .when(F.size(tiles) > most_tiles, "too_many_tiles")
        .when(F.exists(tiles, lambda t: (F.size(t) < 1) | (F.size(t) > most_ids) | (F.size(F.array_distinct(t)) < F.size(t))), "bad_tile")
        .when(F.exists(tiles, lambda t: F.size(F.array_except(t, F.col("_known"))) > 0), "unknown_id")
        .when(F.size(F.array_distinct(F.transform(tiles, lambda t: F.array_sort(t)))) < F.size(tiles), "repeated_tile")
    )
    return met.select("doc_id", F.when(reason.isNull(), tiles).otherwise(F.array().cast("array<array<string>>")).alias("tiles"), reason.alias("failure"))
