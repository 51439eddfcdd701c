"""Footprint evaluation: inventories, overlay features and gains, label rankings, evidence bridges, edit conflicts.

A tile's ranges are an array of half-open intervals. What belongs to one document or case is
gathered into one row, bounded by the document, and worked on by expressions; documents meet only
in grouped aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispan.functions import intervals as iv
from evispan.operators.rank import is_permutation

NESTED = f"array<{iv.KIND}>"


def _sorted_ranges(ranges: Column) -> Column:
    return F.array_sort(F.transform(ranges, lambda r: iv.span(r["start"], r["stop"])))


def physical(atoms: DataFrame) -> DataFrame:
    """(doc_id, pos, ranges, kind, score): every atom (doc_id, pos, start, stop) as a tile of its own."""
    return atoms.select("doc_id", "pos", F.array(iv.span(F.col("start"), F.col("stop"))).alias("ranges"), F.lit("physical_atom").alias("kind"), F.lit(1.0).alias("score"))


def inventory(atoms: DataFrame, overlays: DataFrame) -> DataFrame:
    """(doc_id, tile_id, ranges, kind, score): atoms, then overlays (doc_id, pos, ranges, kind, score); of equal sets of ranges the first stays."""
    both = physical(atoms).withColumn("side", F.lit(0)).unionByName(overlays.select("doc_id", "pos", "ranges", "kind", F.col("score").cast("double").alias("score")).withColumn("side", F.lit(1)))
    order = F.struct("side", "pos")
    first = both.groupBy("doc_id", _sorted_ranges(F.col("ranges")).alias("_key")).agg(F.min_by(F.struct("side", "pos", "ranges", "kind", "score"), order).alias("t"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("t.side", "t.pos")) - 1
    return first.select("doc_id", F.concat(F.lit("retrieval_"), F.lpad(rank.cast("string"), 5, "0")).alias("tile_id"), "t.ranges", "t.kind", "t.score")


def with_views(overlays: DataFrame, wanted: list[str]) -> DataFrame:
    """Overlays that carry any of the wanted views in their array `views`."""
    return overlays.where(F.arrays_overlap("views", F.array(*[F.lit(v) for v in wanted])))


def gathered_atoms(atoms: DataFrame) -> DataFrame:
    """(doc_id, atoms): the atoms' intervals in order."""
    line = F.array_sort(F.collect_list(F.struct("pos", iv.span(F.col("start"), F.col("stop")).alias("s"))))
    return atoms.groupBy("doc_id").agg(F.transform(line, lambda x: x["s"]).alias("atoms"))


def overlay_gain(golds: DataFrame, atoms: DataFrame, overlays: DataFrame) -> DataFrame:
    """overlays with `gain`: the most by which one beats the best atom's F1 on a gold alternative, 0 at least; golds is (doc_id, golds)."""
    f1 = lambda g, r: iv.match_scores(g, r)["f1"]
    base = golds.join(gathered_atoms(atoms), "doc_id", "left").select(
        "doc_id", F.transform("golds", lambda g: F.struct(g.alias("g"), F.coalesce(F.array_max(F.transform("atoms", lambda a: f1(g, F.array(a)))), F.lit(0.0)).alias("base"))).alias("_bases")
    )
    met = overlays.join(base, "doc_id", "left")
    return met.withColumn("gain", F.greatest(F.lit(0.0), F.coalesce(F.array_max(F.transform("_bases", lambda b: f1(b["g"], F.col("ranges")) - b["base"])), F.lit(0.0)))).drop("_bases")


#: The names of the overlay features, in the model's order.
OVERLAY_FEATURES = ["best_view", "mean_view", "views", "lexical", "title", "fused", "dense", "members", "widest_gap", "mean_gap", "covered", "envelope"]


def overlay_features(overlays: DataFrame, atoms: DataFrame, lengths: DataFrame) -> DataFrame:
    """(doc_id, pos, OVERLAY_FEATURES) of overlays (doc_id, pos, ranges, score, view_scores: a map); lengths is (doc_id, n).

    Members are the atoms that are one of the ranges exactly; gaps are the distances of any two of
    them in atoms, as shares of the document's.
    """
    rows = overlays.join(gathered_atoms(atoms), "doc_id").join(lengths, "doc_id")
    at = F.transform(F.filter(F.transform("ranges", lambda r: F.array_position("atoms", iv.span(r["start"], r["stop"]))), lambda p: p > 0), lambda p: (p - 1).cast("long"))
    rows = rows.withColumn("_m", F.array_sort(at)).withColumn("_v", F.when(F.size("view_scores") > 0, F.map_values("view_scores")).otherwise(F.array(F.col("score").cast("double"))))
    k, span = F.size("_m"), F.greatest(F.lit(1), F.size("atoms") - 1)
    # of sorted places m the sum of all m[j] - m[i] is that of m[j] * (2 j - k + 1)
    spread = F.aggregate(F.transform("_m", lambda m, j: m * (2 * j - k + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    chars = F.aggregate(F.transform("ranges", lambda r: r["stop"] - r["start"]), F.lit(0), lambda a, x: a + x)
    envelope = F.array_max(F.transform("ranges", lambda r: r["stop"])) - F.array_min(F.transform("ranges", lambda r: r["start"]))
    view = lambda name: F.coalesce(F.element_at("view_scores", name), F.lit(0.0))
    values = [
        F.array_max("_v"), total("_v") / F.size("_v"), F.size("view_scores").cast("double"), view("lexical"), view("title"), view("fused"), view("dense"), k.cast("double"),
        F.when(k > 1, (F.element_at("_m", -1) - F.col("_m")[0]) / span).otherwise(0.0), F.when(k > 1, spread / (k * (k - 1) / 2) / span).otherwise(0.0),
        chars / F.greatest(F.lit(1), F.col("n")), envelope / F.greatest(F.lit(1), chars),
    ]
    return rows.select("doc_id", "pos", *[v.cast("double").alias(n) for n, v in zip(OVERLAY_FEATURES, values, strict=True)])


def training_pairs(docs: DataFrame, tiles: DataFrame, golds: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, cluster, query, candidate_text, ranges, target_f1, is_positive) of every tile of docs (doc_id, cluster, query, text)."""
    met = tiles.join(docs, "doc_id").join(golds, "doc_id", "left")
    f1 = F.coalesce(iv.best_gold(F.col("golds"), F.col("ranges"))["f1"], F.lit(0.0))
    return met.select("doc_id", "cluster", "query", iv.sliced_text(F.col("text"), F.col("ranges")).alias("candidate_text"), "ranges", f1.alias("target_f1"), (f1 >= least).cast("int").alias("is_positive"))


def permuted_labels(case_id: Column, pool: list[str], n: Column) -> Column:
    """The pool's first n labels, in the order of the SHA-256 of case and label; too small a pool raises."""
    keyed = F.array_sort(F.transform(F.slice(F.array(*[F.lit(x) for x in pool]), 1, n), lambda x: F.struct(F.sha2(F.concat(case_id, F.lit("\0"), x), 256).alias("h"), x.alias("label"))))
    return F.when(n > len(pool), F.raise_error(F.lit("not enough labels for the candidates")).cast("array<string>")).otherwise(F.transform(keyed, lambda x: x["label"]))


def trace_candidates(trace: DataFrame, atoms: DataFrame, pool: list[str], depth: int = 8) -> DataFrame:
    """(case_id, label, rrf_rank, tile_id, ranges, paragraph_ids) from a trace (case_id, rank, tile_id, ranges) and atoms (case_id, paragraph_id, start, stop).

    Ranks must run from 1 without a gap and every range be an atom; one or two ranges a tile. What
    isn't raises.
    """
    line = trace.groupBy("case_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("rank", "tile_id", "ranges"))), 1, depth).alias("line"))
    known = atoms.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct(iv.span(F.col("start"), F.col("stop")), "paragraph_id"))).alias("known"))
    rows = line.join(known, "case_id", "left").withColumn("labels", permuted_labels(F.col("case_id").cast("string"), pool, F.size("line")))
    tile = lambda x, i: F.struct(
        F.get("labels", i).alias("label"), (i + 1).alias("rrf_rank"), F.coalesce(x["tile_id"], F.concat(F.lit("rrf_"), F.lpad((i + 1).cast("string"), 2, "0"))).alias("tile_id"), x["ranges"].alias("ranges"),
        F.transform(x["ranges"], lambda r: F.element_at("known", iv.span(r["start"], r["stop"]))).alias("paragraph_ids"), x["rank"].alias("rank"),
    )
    flat = rows.select("case_id", F.explode(F.transform("line", tile)).alias("t")).select("case_id", "t.*")
    wrong = F.when(F.col("rank") != F.col("rrf_rank"), "a rank is missing").when(~F.size("ranges").between(1, 2), "a tile has one range or two").when(F.exists("paragraph_ids", lambda p: p.isNull()), "a range is no paragraph")
    return flat.where(F.when(wrong.isNotNull(), F.raise_error(wrong).cast("boolean")).otherwise(True)).drop("rank")


def ranked_tiles(candidates: DataFrame, rankings: DataFrame, k: int = 2, kind: str = "external_model_rrf_tile_rerank") -> DataFrame:
    """(case_id, place, tile_id, ranges, kind, score): the k first labels of a complete ranking (case_id, ranked) as tiles; an incomplete one raises."""
    per = candidates.groupBy("case_id").agg(F.collect_list("label").alias("labels"), F.map_from_entries(F.collect_list(F.struct("label", F.struct("tile_id", "ranges")))).alias("of"))
    met = per.join(rankings, "case_id")
    ranked = F.when(is_permutation(F.col("labels"), F.col("ranked")), F.col("ranked")).otherwise(F.raise_error(F.lit("the ranking isn't one of all labels")).cast("array<string>"))
    top = met.select("case_id", "of", F.posexplode(F.slice(ranked, 1, k)).alias("at", "label")).withColumn("t", F.element_at("of", F.col("label")))
    name = F.concat(F.lit(f"{kind}_"), F.lpad((F.col("at") + 1).cast("string"), 2, "0"), F.lit("_"), F.col("t.tile_id"))
    return top.select("case_id", (F.col("at") + 1).alias("place"), name.alias("tile_id"), "t.ranges", F.lit(kind).alias("kind"), (F.lit(float(k)) - F.col("at")).alias("score"))


def fused_footprints(candidates: DataFrame, rankings: DataFrame, k: int = 2, constant: int = 60) -> DataFrame:
    """(case_id, place, tile_id, ranges): the k best by the sum of reciprocal ranks of the candidates' rrf_rank and a model's ranking.

    rankings is (case_id, status, ranked). A case whose ranking is missing, not "SCORED" or not one
    of all its labels has no footprints; ties go to the better rrf_rank, then the larger label.
    """
    per = candidates.groupBy("case_id").agg(F.collect_list(F.struct("label", "rrf_rank", "tile_id", "ranges")).alias("all"))
    met = per.join(rankings, "case_id").where(F.coalesce(F.col("status") == "SCORED", F.lit(False)) & F.coalesce(is_permutation(F.col("all.label"), F.col("ranked")), F.lit(False)))
    scored = F.transform("all", lambda c: F.struct(-F.round(1 / (constant + c["rrf_rank"]) + 1 / (constant + F.array_position("ranked", c["label"])), 12).alias("v"), c["rrf_rank"].alias("r"), c.alias("c")))
    # ties of score and rank can't be, as ranks differ
    first = met.select("case_id", F.posexplode(F.slice(F.array_sort(scored), 1, k)).alias("at", "x"))
    return first.where(F.size("x.c.ranges") > 0).select("case_id", (F.col("at") + 1).alias("place"), F.col("x.c.tile_id").alias("tile_id"), F.col("x.c.ranges").alias("ranges"))


def context_bytes(text: Column, footprints: Column) -> Column:
    """UTF-8 bytes of all footprints (an array of structs with ranges), each one's pieces joined."""
    return F.aggregate(F.transform(footprints, lambda f: F.octet_length(iv.sliced_text(text, f["ranges"]))), F.lit(0), lambda a, x: a + x)


def witness_bytes(doc_id: Column, footprints: Column) -> Column:
    """UTF-8 bytes of the footprints' identities, versions and ranges as compact JSON with sorted keys."""
    one = lambda f: F.struct(F.concat(doc_id.cast("string"), F.lit("::"), f["tile_id"]).alias("id"), F.transform(f["ranges"], lambda r: F.array(r["start"], r["stop"])).alias("ranges"), F.lit(1).alias("version"))
    return F.octet_length(F.to_json(F.transform(footprints, one)))


def with_budget(rows: DataFrame, rule: str, target: str, base: str, achieved: str) -> DataFrame:
    """rows with `budget_control`: rule, target, base and achieved bytes, feasibility, and utilisation against a target of 1 at least."""
    t, a = F.col(target), F.col(achieved)
    return rows.withColumn("budget_control", F.struct(F.lit(rule).alias("rule"), t.alias("target_context_bytes"), F.col(base).alias("base_context_bytes"), a.alias("achieved_context_bytes"), (a <= t).alias("budget_feasible"), (a / F.greatest(F.lit(1), t)).alias("budget_utilization"), F.lit(True).alias("whole_paragraphs_only")))


def bridge_rows(queries: DataFrame) -> DataFrame:
    """queries (doc_id, method, text, golds, footprints) with what a version bump of each gold range does.

    The canonical gold is the first alternative. A range is captured where one merged interval of
    the footprints covers it; then a bump of it asks for revalidation, else it is committed stale.
    A query without gold raises; an untouched state commits safely.
    """
    golds = F.when(F.size(F.get("golds", F.lit(0))) > 0, F.get("golds", F.lit(0))).otherwise(F.raise_error(F.lit("a query has no gold ranges")).cast(iv.KIND))
    rows = queries.withColumn("_g", golds).withColumn("_f", F.flatten(F.transform("footprints", lambda f: f["ranges"])))
    rows = rows.withColumn("gold_supports", F.size("_g")).withColumn("captured_supports", F.size(F.filter("_g", lambda g: iv.covered_by(g, F.col("_f")))))
    return rows.select(
        "doc_id", "method", "gold_supports", "captured_supports", (F.col("captured_supports") / F.col("gold_supports")).alias("witness_recall"), (F.col("captured_supports") == F.col("gold_supports")).cast("int").alias("complete_witness"),
        F.size("footprints").alias("selected_footprint_count"), context_bytes(F.col("text"), F.col("footprints")).alias("context_bytes"), witness_bytes(F.col("doc_id"), F.col("footprints")).alias("witness_metadata_bytes"),
        (F.col("gold_supports") - F.col("captured_supports")).alias("unsafe_auto_commits"), F.col("captured_supports").alias("revalidate_interventions"),
    )


def bridge_summary(rows: DataFrame) -> DataFrame:
    """A row a method of bridge_rows(): macro and micro recall, and rates over stale and safe updates."""
    n, golds, got = F.count("*"), F.sum("gold_supports"), F.sum("captured_supports")
    some = F.greatest(F.lit(1), golds)
    return rows.groupBy("method").agg(
        n.alias("queries"), golds.alias("gold_support_mutation_scenarios"), (golds + n).alias("total_update_scenarios"), F.avg("witness_recall").alias("witness_recall_macro"), (got / some).alias("witness_recall_micro"),
        F.avg("complete_witness").alias("complete_witness_rate"), (1 - F.avg("complete_witness")).alias("hidden_dependency_rate"), (F.sum("unsafe_auto_commits") / some).alias("unsafe_auto_commit_rate_on_stale"), (F.sum("revalidate_interventions") / some).alias("revalidate_rate_on_stale"),
        (F.sum("revalidate_interventions") / F.greatest(F.lit(1), golds + n)).alias("non_auto_intervention_rate_all_updates"), F.avg("context_bytes").alias("mean_context_bytes"), F.avg("witness_metadata_bytes").alias("mean_witness_metadata_bytes"),
    )


def phrase(text: Column) -> Column:
    """Lower-case words of letters and digits with single spaces."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0)), " ")


def path_connectivity(triples: DataFrame, sentences: DataFrame, tiles: DataFrame) -> DataFrame:
    """triples (doc_id, subject, relation, object) with `mappable` and `covered`.

    An endpoint maps to titles of sentences (doc_id, title, start, stop) equal to its phrase; where
    there are none and it has five characters, to those that it holds or that hold it. A triple is
    covered where one tile touches sentences of both endpoints.
    """
    titles = sentences.groupBy("doc_id", phrase(F.col("title")).alias("key")).agg(F.collect_list(iv.span(F.col("start"), F.col("stop"))).alias("spans"))
    per = titles.groupBy("doc_id").agg(F.collect_list(F.struct("key", "spans")).alias("titles"))
    have = tiles.groupBy("doc_id").agg(F.collect_list("ranges").alias("tiles"))

    def spans(end: str) -> Column:
        want = phrase(F.col(end))
        same = F.filter("titles", lambda t: (t["key"] == want) & (want != ""))
        near = F.filter("titles", lambda t: (F.length(want) >= 5) & (t["key"].contains(want) | want.contains(t["key"])))
        return F.flatten(F.transform(F.when(F.size(same) > 0, same).otherwise(near), lambda t: t["spans"]))

    met = triples.join(per, "doc_id", "left").join(have, "doc_id", "left")
    met = met.withColumn("_s", spans("subject")).withColumn("_o", spans("object")).withColumn("mappable", F.coalesce((F.size("_s") > 0) & (F.size("_o") > 0), F.lit(False)))
    both = F.exists(F.coalesce("tiles", F.array().cast(NESTED)), lambda t: iv.any_overlap(t, F.col("_s")) & iv.any_overlap(t, F.col("_o")))
    return met.withColumn("covered", F.col("mappable") & F.coalesce(both, F.lit(False))).select(*triples.columns, "mappable", "covered")


def connectivity_summary(rows: DataFrame, by: str | None = None) -> DataFrame:
    """Counts of path_connectivity(), in all or by a column, and the share of mappable triples that are covered."""
    mappable, covered = F.sum(F.col("mappable").cast("long")), F.sum(F.col("covered").cast("long"))
    return rows.groupBy(*([by] if by else [])).agg(F.count("*").alias("triples"), mappable.alias("mappable"), covered.alias("covered"), (covered / F.greatest(F.lit(1), mappable)).alias("coverage"))


#: Decisions that call two edits dependent.
DEPENDENT = ("REBASE", "REJECT", "REVALIDATE", "REVIEW")


def concurrent_edits(cases: DataFrame, segments: DataFrame) -> DataFrame:
    """cases (case_id, a, b: intervals, guard, decision, n) by segments (case_id, policy, spans): whether both edits touch one segment, and what follows.

    guard is the semantic check's word that the edits depend on each other.
    """
    met = cases.join(segments, "case_id")
    touched = lambda e: F.filter("spans", lambda s: iv.overlaps(s, F.col(e)))
    size = lambda spans: F.aggregate(F.transform(spans, lambda s: s["stop"] - s["start"]), F.lit(0), lambda x, y: x + y)
    rows = met.withColumn("_a", touched("a")).withColumn("_b", touched("b")).withColumn("shares", F.size(F.array_intersect("_a", "_b")) > 0)
    bad = F.col("decision").isin(*DEPENDENT)
    amp = lambda spans, e: size(spans) / F.greatest(F.lit(1), F.col(e)["stop"] - F.col(e)["start"])
    return rows.select(
        "case_id", "policy", "decision", "shares", "guard", ((F.col("decision") == "COMMUTE") & F.col("shares")).alias("false_conflict"), (bad & ~F.col("shares")).alias("unsafe_physical"), (bad & ~F.col("shares") & ~F.col("guard")).alias("unsafe_guarded"),
        amp("_a", "a").alias("amp_a"), amp("_b", "b").alias("amp_b"), F.size("spans").alias("segment_count"), (size("spans") / F.greatest(F.lit(1), F.col("n"))).alias("storage"),
    )


def edit_summary(rows: DataFrame) -> DataFrame:
    """A row a policy: false conflicts over safe cases, unsafe accepts over dependent ones, amplification, segments, storage."""
    count = lambda c: F.sum(F.col(c).cast("long"))
    rate = lambda c, over: F.when(F.sum(over.cast("long")) > 0, count(c) / F.sum(over.cast("long"))).otherwise(0.0)
    safe, bad = F.col("decision") == "COMMUTE", F.col("decision").isin(*DEPENDENT)
    return rows.groupBy("policy").agg(
        F.count("*").alias("cases"), count("false_conflict").alias("false_conflicts"), rate("false_conflict", safe).alias("false_conflict_rate"), count("unsafe_physical").alias("unsafe_accepts_physical"), rate("unsafe_physical", bad).alias("unsafe_accept_rate_physical"),
        count("unsafe_guarded").alias("unsafe_accepts_guarded"), rate("unsafe_guarded", bad).alias("unsafe_accept_rate_guarded"), (F.avg(F.col("amp_a") + F.col("amp_b")) / 2).alias("mean_write_amplification"), F.avg("segment_count").alias("mean_segment_count"), F.avg("storage").alias("mean_storage_factor"),
    )
