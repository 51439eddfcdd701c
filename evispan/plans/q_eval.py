"""Queries over evaluators and contracts, on cases derived from the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evispan.functions import intervals as iv
from evispan.operators import contracts, evaluate, segment
from evispan.plans.jobs import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Documents whose atoms are pieces of 64 characters, overlays of pieces 0 and 2 and of 1 and 2, and two golds: 0-100 and 120-200 in one, 64-150 in the other


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.length("text").alias("n")).where("n >= 200")


def _atoms(docs):
    return docs.select("doc_id", F.posexplode(segment.fixed_chunks(F.col("text"), 64)).alias("pos", "s")).select("doc_id", "pos", "s.start", "s.stop")


def _piece(k):
    return iv.span(F.lit(64 * k), F.least(F.lit(64 * k + 64), F.col("n")))


def _overlays(docs):
    score, views = (F.col("doc_id") % 7) / 10, F.create_map(F.lit("lexical"), (F.col("doc_id") % 7) / 10, F.lit("title"), F.lit(0.85))
    first = F.struct(F.lit(0).alias("pos"), F.array(_piece(0), _piece(2)).alias("ranges"), F.lit("pair").alias("kind"), score.alias("score"), views.alias("view_scores"), F.array(F.lit("lexical"), F.lit("title")).alias("views"))
    second = F.struct(F.lit(1).alias("pos"), F.array(_piece(1), _piece(2), _piece(1)).alias("ranges"), F.lit("run").alias("kind"), score.alias("score"), F.create_map(F.lit("dense"), F.lit(0.5)).alias("view_scores"), F.array(F.lit("dense")).alias("views"))
    alone = F.struct(F.lit(2).alias("pos"), F.array(_piece(1)).alias("ranges"), F.lit("single").alias("kind"), score.alias("score"), F.create_map(F.lit("fused"), F.lit(0.25)).alias("view_scores"), F.array(F.lit("fused")).alias("views"))
    return docs.select("doc_id", F.explode(F.array(first, second, alone)).alias("o")).select("doc_id", "o.*")


def _golds(docs):
    return docs.select("doc_id", F.array(F.array(iv.span(F.lit(0), F.lit(100)), iv.span(F.lit(120), F.lit(200))), F.array(iv.span(F.lit(64), F.lit(150)))).alias("golds"))


SHAPES = """d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) >= 200),
ats AS (SELECT doc_id, n, i AS pos, 64 * i AS a, least(64 * i + 64, n) AS z FROM d, LATERAL (SELECT unnest(range(0, (n + 63) // 64)) AS i)),
ov AS (SELECT doc_id, n, pos, k, 64 * k AS a, least(64 * k + 64, n) AS z FROM d, (VALUES (0, 0), (0, 2), (1, 1), (1, 2), (2, 1)) o(pos, k)),
gd(g, ga, gz) AS (VALUES (0, 0, 100), (0, 120, 200), (1, 64, 150)), gl AS (SELECT g, sum(gz - ga) AS gn FROM gd GROUP BY g),
oz AS (SELECT doc_id, pos, sum(z - a) AS zn FROM ov GROUP BY ALL),
om AS (SELECT doc_id, pos, g, sum(greatest(0, least(z, gz) - greatest(a, ga))) AS m FROM ov, gd GROUP BY ALL),
os AS (SELECT doc_id, pos, g, CASE WHEN m > 0 THEN 2 * (m / gn) * (m / zn) / (m / gn + m / zn) ELSE 0.0 END AS f1 FROM om JOIN oz USING (doc_id, pos) JOIN gl USING (g)),
am AS (SELECT doc_id, pos, g, z - a AS zn, sum(greatest(0, least(z, gz) - greatest(a, ga))) AS m FROM ats, gd GROUP BY ALL),
ab AS (SELECT doc_id, g, max(CASE WHEN m > 0 THEN 2 * (m / gn) * (m / zn) / (m / gn + m / zn) ELSE 0.0 END) AS base FROM am JOIN gl USING (g) GROUP BY ALL)"""


@query(f"WITH {SHAPES} SELECT doc_id, pos, round(greatest(0.0, max(f1 - base)), 9) AS gain FROM os JOIN ab USING (doc_id, g) GROUP BY ALL")
def overlay_gain(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return evaluate.overlay_gain(_golds(d), _atoms(d), _overlays(d)).select("doc_id", "pos", F.round("gain", 9).alias("gain"))


@query(
    f"""WITH {SHAPES}, k AS (SELECT doc_id, n, greatest(1, (n + 63) // 64 - 1) AS span, (n + 63) // 64 AS atoms FROM d),
v(pos, best, mean, views, lexical, title, fused, dense, m1, m2, reps) AS (VALUES (0, NULL, NULL, 2.0, NULL, 0.85, 0.0, 0.0, 0, 2, 0), (1, 0.5, 0.5, 1.0, 0.0, 0.0, 0.0, 0.5, 1, 2, 1), (2, 0.25, 0.25, 1.0, 0.0, 0.0, 0.25, 0.0, 1, 1, 0)),
x AS (SELECT k.*, v.*, (doc_id % 7) / 10 AS s, least(64 * m2 + 64, n) AS z FROM k, v)
SELECT doc_id, pos, round(coalesce(best, greatest(s, 0.85)), 9) AS best_view, round(coalesce(mean, (s + 0.85) / 2), 9) AS mean_view, views, round(coalesce(lexical, s), 9) AS lexical, title, fused, dense,
  CASE pos WHEN 0 THEN 2.0 WHEN 1 THEN 3.0 ELSE 1.0 END AS members, round(CASE pos WHEN 0 THEN 2 / span WHEN 1 THEN 1 / span ELSE 0.0 END, 9) AS widest_gap,
  round(CASE pos WHEN 0 THEN 2 / span WHEN 1 THEN 2 / 3 / span ELSE 0.0 END, 9) AS mean_gap,
  round((CASE pos WHEN 2 THEN 64 WHEN 1 THEN 128 + z - 128 ELSE 64 + z - 128 END) / n, 9) AS covered,
  round(CASE pos WHEN 2 THEN 1.0 WHEN 1 THEN (z - 64) / (128 + z - 128) ELSE z / (64 + z - 128) END, 9) AS envelope FROM x"""
)
def overlay_features(spark, sf_dir):
    """The second overlay names one atom twice, which counts."""
    d = _docs(spark, sf_dir)
    got = evaluate.overlay_features(_overlays(d), _atoms(d), d.select("doc_id", "n"))
    return got.select("doc_id", "pos", *[F.round(c, 9).alias(c) for c in evaluate.OVERLAY_FEATURES])


@query(
    f"""WITH {SHAPES}, o AS (SELECT doc_id, 'physical_atom' AS kind, 0 AS side, pos, a || '-' || z AS ranges FROM ats UNION ALL
SELECT doc_id, CASE pos WHEN 0 THEN 'pair' ELSE 'run' END, 1, pos, CASE pos WHEN 0 THEN '0-64,128-' || least(192, n) ELSE '64-128,128-' || least(192, n) || ',64-128' END FROM d, (VALUES (0), (1)) p(pos))
SELECT doc_id, 'retrieval_' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY side, pos) - 1 AS VARCHAR), 5, '0') AS tile_id, kind, ranges FROM o"""
)
def inventory_union(spark, sf_dir):
    """Atoms and overlays; the third overlay is an atom and goes."""
    d = _docs(spark, sf_dir)
    got = evaluate.inventory(_atoms(d), _overlays(d))
    return got.select("doc_id", "tile_id", "kind", F.array_join(F.transform("ranges", lambda r: F.concat_ws("-", r["start"], r["stop"])), ",").alias("ranges"))


@query(
    f"""WITH {SHAPES}, t AS (SELECT doc_id, pos, max(f1) AS f1 FROM os WHERE pos < 2 GROUP BY ALL)
SELECT t.doc_id, 'documents:paper_id:' || t.doc_id % 10 AS cluster, CASE WHEN t.doc_id % 2 = 0 THEN 'q' || t.doc_id ELSE 'label' END AS query, octet_length(encode(CASE pos WHEN 0 THEN regexp_replace(text[1:64], '^\\s+|\\s+$', '', 'g') || chr(10) || '[...]' || chr(10) || regexp_replace(text[129:192], '^\\s+|\\s+$', '', 'g')
  ELSE regexp_replace(text[65:128], '^\\s+|\\s+$', '', 'g') || chr(10) || '[...]' || chr(10) || regexp_replace(text[129:192], '^\\s+|\\s+$', '', 'g') || chr(10) || '[...]' || chr(10) || regexp_replace(text[65:128], '^\\s+|\\s+$', '', 'g') END)) AS n_bytes,
  round(f1, 9) AS target_f1, CAST(f1 >= 0.5 AS INTEGER) AS is_positive FROM t JOIN d USING (doc_id)"""
)
def training_pairs(spark, sf_dir):
    d = _docs(spark, sf_dir)
    fields = {"question": F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("q"), "doc_id")).otherwise(""), "paper_id": F.col("doc_id") % 10}
    named = d.select("doc_id", "text", contracts.query_text(F.col("doc_id"), fields, F.lit("label")).alias("query"), contracts.cluster_id(F.lit("documents"), F.col("doc_id"), fields).alias("cluster"))
    got = evaluate.training_pairs(named, evaluate.with_views(_overlays(d), ["title", "dense"]).select("doc_id", "ranges"), _golds(d))
    return got.select("doc_id", "cluster", "query", F.octet_length("candidate_text").alias("n_bytes"), F.round("target_f1", 9).alias("target_f1"), "is_positive")


# Rankings: an order's lines are its candidates


def _candidates(spark, sf_dir):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.row_number().over(order).alias("k"), F.col("l_extendedprice").cast("double").alias("price"))
    return li.select("case_id", F.col("k").cast("string").alias("label"), F.col("k").alias("rrf_rank"), F.concat(F.lit("t"), "k").alias("tile_id"), F.array(iv.span(F.col("k") * 10, F.col("k") * 10 + 5)).alias("ranges"), "price")


def _rankings(candidates):
    line = F.array_sort(F.collect_list(F.struct((-F.col("price")).alias("p"), "label")))
    ranked = F.transform(line, lambda x: x["label"])
    return candidates.groupBy("case_id").agg(F.when(F.col("case_id") % 5 == 1, F.slice(ranked, 1, 1)).otherwise(ranked).alias("ranked")).withColumn("status", F.when(F.col("case_id") % 5 == 0, "FAILED").otherwise("SCORED"))


LINES = """l AS (SELECT l_orderkey AS case_id, CAST(l_extendedprice AS DOUBLE) AS price, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS k FROM lineitem),
c AS (SELECT case_id, CAST(k AS VARCHAR) AS label, k, k AS rr, row_number() OVER (PARTITION BY case_id ORDER BY price DESC, CAST(k AS VARCHAR)) AS lr, count(*) OVER (PARTITION BY case_id) AS m FROM l)"""


@query(f"WITH {LINES} SELECT case_id, lr AS place, 'external_model_rrf_tile_rerank_0' || lr || '_t' || k AS tile_id, k * 10 AS start, CAST(3 - lr AS DOUBLE) AS score FROM c WHERE lr <= 2")
def ranked_tiles(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    whole = c.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("price")).alias("p"), "label"))), lambda x: x["label"]).alias("ranked"))
    got = evaluate.ranked_tiles(c, whole)
    return got.select("case_id", F.col("place").cast("long").alias("place"), "tile_id", F.col("ranges")[0]["start"].cast("long").alias("start"), "score")


@query(f"WITH {LINES}, s AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(1 / (60 + rr) + 1 / (60 + lr), 12) DESC, rr) AS place FROM c WHERE case_id % 5 > 1 OR (case_id % 5 = 1 AND m = 1)) SELECT case_id, place, 't' || k AS tile_id FROM s WHERE place <= 2")
def fused_footprints(spark, sf_dir):
    """A fifth of the rankings failed and a fifth are cut short; those give nothing."""
    c = _candidates(spark, sf_dir)
    return evaluate.fused_footprints(c, _rankings(c)).select("case_id", F.col("place").cast("long").alias("place"), "tile_id")


@query(
    f"""WITH {LINES}, p AS (SELECT case_id, rr, k, row_number() OVER (PARTITION BY case_id ORDER BY sha256(CAST(case_id AS VARCHAR) || chr(0) || chr(CAST(64 + rr AS INTEGER)))) AS w, chr(CAST(64 + rr AS INTEGER)) AS label FROM c WHERE rr <= 8)
SELECT a.case_id, b.label, a.rr AS rrf_rank, 't' || a.k AS tile_id, 'p' || a.k AS paragraph FROM p a JOIN p b ON a.case_id = b.case_id AND a.rr = b.w"""
)
def trace_candidates(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    atoms = c.select("case_id", F.concat(F.lit("p"), F.substring("tile_id", 2, 9)).alias("paragraph_id"), F.col("ranges")[0]["start"].alias("start"), F.col("ranges")[0]["stop"].alias("stop"))
    got = evaluate.trace_candidates(c.select("case_id", F.col("rrf_rank").alias("rank"), "tile_id", "ranges"), atoms, list("ABCDEFGHIJ"))
    return got.select("case_id", "label", F.col("rrf_rank").cast("long").alias("rrf_rank"), "tile_id", F.col("paragraph_ids")[0].alias("paragraph"))


@query("SELECT l_orderkey AS case_id, l_linenumber AS label, round(exp(CAST(l_quantity AS DOUBLE) / 10 - max(CAST(l_quantity AS DOUBLE) / 10) OVER w) / sum(exp(CAST(l_quantity AS DOUBLE) / 10)) OVER w * exp(max(CAST(l_quantity AS DOUBLE) / 10) OVER w), 9) AS probability FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)")
def label_softmax(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("label"), (F.col("l_quantity").cast("double") / 10).alias("logit"))
    return contracts.softmax(li, ["case_id"]).select("case_id", "label", F.round("probability", 9).alias("probability"))


# Bridges: footprints are pieces 0 to doc_id % 3


BRIDGE = """d AS (SELECT doc_id, text, doc_id % 3 AS m, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS method FROM documents WHERE length(text) >= 200),
r AS (SELECT *, CAST(least(64 * m + 64, length(text)) AS INTEGER) AS z, 3 AS gold_supports FROM d),
q AS (SELECT *, CAST(40 <= z AS INTEGER) + CAST(100 <= z AS INTEGER) + CAST(200 <= z AS INTEGER) AS captured_supports,
  list_sum(list_transform(range(0, m + 1), lambda i: octet_length(encode(regexp_replace(text[64 * i + 1:64 * i + 64], '^\\s+|\\s+$', '', 'g'))))) AS context_bytes,
  1 + list_sum(list_transform(range(0, m + 1), lambda i: length('{"id":"' || doc_id || '::f' || i || '","ranges":[[' || 64 * i || ',' || least(64 * i + 64, length(text)) || ']],"version":1}') + 1)) AS witness_metadata_bytes FROM r)"""


def _bridge(spark, sf_dir):
    d = _docs(spark, sf_dir)
    foot = F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int")), lambda i: F.struct(F.concat(F.lit("f"), i.cast("string")).alias("tile_id"), F.array(iv.span(64 * i, F.least(64 * i + 64, F.col("n")))).alias("ranges")))
    golds = F.array(F.array(iv.span(F.lit(0), F.lit(40)), iv.span(F.lit(60), F.lit(100)), iv.span(F.lit(150), F.lit(200))), F.array(iv.span(F.lit(0), F.lit(1))))
    return evaluate.bridge_rows(d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("method"), "text", golds.alias("golds"), foot.alias("footprints")))


@query(f"WITH {BRIDGE} SELECT doc_id, method, gold_supports, captured_supports, round(captured_supports / 3, 9) AS witness_recall, CAST(captured_supports = 3 AS INTEGER) AS complete_witness, CAST(context_bytes AS BIGINT) AS context_bytes, CAST(witness_metadata_bytes AS BIGINT) AS witness_metadata_bytes FROM q")
def bridge_rows(spark, sf_dir):
    got = _bridge(spark, sf_dir).withColumn("witness_recall", F.round("witness_recall", 9))
    return got.select("doc_id", "method", "gold_supports", "captured_supports", "witness_recall", "complete_witness", F.col("context_bytes").cast("long").alias("context_bytes"), F.col("witness_metadata_bytes").cast("long").alias("witness_metadata_bytes"))


@query(
    f"""WITH {BRIDGE} SELECT method, count(*) AS queries, CAST(sum(gold_supports) AS BIGINT) AS gold_support_mutation_scenarios, round(avg(captured_supports / 3), 9) AS witness_recall_macro, round(sum(captured_supports) / sum(gold_supports), 9) AS witness_recall_micro,
  round(avg(CAST(captured_supports = 3 AS INTEGER)), 9) AS complete_witness_rate, round(sum(3 - captured_supports) / sum(gold_supports), 9) AS unsafe_auto_commit_rate_on_stale, round(sum(captured_supports) / (sum(gold_supports) + count(*)), 9) AS non_auto_intervention_rate_all_updates, round(avg(context_bytes), 6) AS mean_context_bytes FROM q GROUP BY method"""
)
def bridge_summary(spark, sf_dir):
    got = evaluate.bridge_summary(_bridge(spark, sf_dir))
    nine = ("witness_recall_macro", "witness_recall_micro", "complete_witness_rate", "unsafe_auto_commit_rate_on_stale", "non_auto_intervention_rate_all_updates")
    return got.select("method", "queries", "gold_support_mutation_scenarios", *[F.round(c, 9).alias(c) for c in nine], F.round("mean_context_bytes", 6).alias("mean_context_bytes"))


@query("SELECT doc_id, 'ranked' AS rule, doc_id % 100 AS target, octet_length(encode(text)) AS achieved, octet_length(encode(text)) <= doc_id % 100 AS feasible, round(octet_length(encode(text)) / greatest(1, doc_id % 100), 9) AS utilization FROM documents")
def budget_utilization(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 100).alias("t"), F.lit(0).alias("b"), F.octet_length("text").cast("long").alias("a"))
    got = evaluate.with_budget(d, "ranked", "t", "b", "a")
    c = F.col("budget_control")
    return got.select("doc_id", c["rule"].alias("rule"), c["target_context_bytes"].alias("target"), c["achieved_context_bytes"].alias("achieved"), c["budget_feasible"].alias("feasible"), F.round(c["budget_utilization"], 9).alias("utilization"))


# Concurrent edits: an event and its user's one before edit a text of 200 characters


EDITS = """e AS (SELECT event_id AS case_id, (event_id % 37) * 5 AS a, (event_id % 37) * 5 + 8 AS az, (pe % 23) * 8 AS b, (pe % 23) * 8 + 5 AS bz, event_type = pt AS guard, CASE event_id % 4 WHEN 0 THEN 'REBASE' WHEN 1 THEN 'REVIEW' ELSE 'COMMUTE' END AS decision
  FROM (SELECT event_id, event_type, lag(event_type) OVER w AS pt, lag(event_id) OVER w AS pe FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE pe IS NOT NULL),
s AS (SELECT e.*, policy, w, a // w AS a0, (az - 1) // w AS a1, b // w AS b0, (bz - 1) // w AS b1, 200 // w AS segs FROM e, (VALUES ('fixed_20', 20), ('fixed_50', 50)) p(policy, w)),
x AS (SELECT *, a0 <= b1 AND b0 <= a1 AS shares FROM s)"""


def _edits(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.lag("event_type").over(w).alias("pt"), F.lag("event_id").over(w).alias("pe")).where("pe is not null")
    a, b = F.col("event_id") % 37 * 5, F.col("pe") % 23 * 8
    decision = F.when(F.col("event_id") % 4 == 0, "REBASE").when(F.col("event_id") % 4 == 1, "REVIEW").otherwise("COMMUTE")
    cases = e.select(F.col("event_id").alias("case_id"), iv.span(a, a + 8).alias("a"), iv.span(b, b + 5).alias("b"), (F.col("event_type") == F.col("pt")).alias("guard"), decision.alias("decision"), F.lit(200).alias("n"))
    spans = lambda w: F.transform(F.sequence(F.lit(0), F.lit(200 - w), F.lit(w)), lambda i: iv.span(i, i + w))
    policies = F.array(*[F.struct(F.lit(f"fixed_{w}").alias("policy"), spans(w).alias("spans")) for w in (20, 50)])
    return evaluate.concurrent_edits(cases, cases.select("case_id", F.explode(policies).alias("p")).select("case_id", "p.*"))


@query(
    f"""WITH {EDITS} SELECT case_id, policy, shares, guard, decision = 'COMMUTE' AND shares AS false_conflict, decision <> 'COMMUTE' AND NOT shares AS unsafe_physical, decision <> 'COMMUTE' AND NOT shares AND NOT guard AS unsafe_guarded,
  round((least(a1, segs - 1) - a0 + 1) * w / 8, 9) AS amp_a, round((b1 - b0 + 1) * w / 5, 9) AS amp_b FROM x"""
)
def concurrent_edits(spark, sf_dir):
    got = _edits(spark, sf_dir)
    return got.select("case_id", "policy", "shares", "guard", "false_conflict", "unsafe_physical", "unsafe_guarded", F.round("amp_a", 9).alias("amp_a"), F.round("amp_b", 9).alias("amp_b"))


@query(
    f"""WITH {EDITS} SELECT policy, count(*) AS cases, count(*) FILTER (WHERE decision = 'COMMUTE' AND shares) AS false_conflicts, round(count(*) FILTER (WHERE decision = 'COMMUTE' AND shares) / count(*) FILTER (WHERE decision = 'COMMUTE'), 9) AS false_conflict_rate,
  count(*) FILTER (WHERE decision <> 'COMMUTE' AND NOT shares AND NOT guard) AS unsafe_accepts_guarded, round(avg((least(a1, segs - 1) - a0 + 1) * w / 8 + (b1 - b0 + 1) * w / 5) / 2, 6) AS mean_write_amplification, CAST(max(segs) AS DOUBLE) AS mean_segment_count, 1.0 AS mean_storage_factor FROM x GROUP BY policy"""
)
def edit_conflict_summary(spark, sf_dir):
    got = evaluate.edit_summary(_edits(spark, sf_dir))
    return got.select("policy", "cases", "false_conflicts", F.round("false_conflict_rate", 9).alias("false_conflict_rate"), "unsafe_accepts_guarded", F.round("mean_write_amplification", 6).alias("mean_write_amplification"), "mean_segment_count", F.round("mean_storage_factor", 9).alias("mean_storage_factor"))


# Contracts


@query("SELECT page_id, regexp_extract(url, '[^/]*$', 0) AS tail, regexp_matches(trim(regexp_extract(url, '[^/]*$', 0)), '^-*[0-9]+$') AS intlike FROM pages")
def int_like(spark, sf_dir):
    tail = F.regexp_extract("url", "[^/]*$", 0)
    return table(spark, sf_dir, "pages").select("page_id", tail.alias("tail"), contracts.is_intlike(tail).alias("intlike"))


@query(
    """WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, length(role || ': ' || text || chr(10)) AS n, sum(length(role || ': ' || text || chr(10))) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM conversations)
SELECT conv_id, CAST(k // 3 AS BIGINT) AS block, CAST(min(e - n) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS stop FROM t GROUP BY ALL"""
)
def turn_groups(spark, sf_dir):
    return contracts.turn_groups(segment.turn_offsets(table(spark, sf_dir, "conversations")), 3)


@query(
    """WITH d AS (SELECT doc_id, text, string_split(text, ' ') AS w FROM documents),
q AS (SELECT doc_id, text, w[1] AS a, w[len(w)] AS b FROM d)
SELECT doc_id, CASE WHEN a = '' OR b = '' THEN 'quotes' WHEN (length(text) - length(replace(text, a, ''))) // length(a) <> 1 OR (length(text) - length(replace(text, b, ''))) // length(b) <> 1 THEN 'quote_count' WHEN doc_id % 3 = 0 THEN 'dependency' END AS problem FROM q"""
)
def external_tiles(spark, sf_dir):
    """Two tiles a document, its first word and its last; a third of the second ones hang on a tile that isn't there."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.split("text", " ").alias("w"))
    none = F.array().cast("array<string>")
    tile = lambda name, quote, deps: F.struct(F.lit(name).alias("tile_id"), F.array(quote).alias("quotes"), deps.alias("dependencies"), F.lit(0.5).alias("confidence"))
    tiles = F.array(tile("a", F.col("w")[0], none), tile("b", F.element_at("w", -1), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("c"))).otherwise(F.array(F.lit("a")))))
    return d.select("doc_id", contracts.external_problem(F.col("text"), tiles).alias("problem"))


@query(
    """SELECT c_custkey, trim(repeat(c_mktsegment || ' ', CAST(c_custkey % 3 AS INTEGER))) || CASE WHEN c_custkey % 3 > 0 THEN chr(10) ELSE '' END || '{"kind":"cap","limit":' || c_custkey % 50 || ',"revision":' || c_custkey % 5 || ',"scope":"' || c_mktsegment || '","type":"policy"}'
  || CASE WHEN c_custkey % 2 > 0 THEN chr(10) || 'archive' ELSE '' END AS rendered FROM customer"""
)
def policy_texts(spark, sf_dir):
    k = F.col("c_custkey")
    text = contracts.render_policy(F.col("c_mktsegment"), F.lit("cap"), k % 5, {"limit": k % 50}, (k % 3).cast("int"), (k % 2).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.alias("rendered"))
