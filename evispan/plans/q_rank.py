"""Queries over rankings, budget controls, snapshots and decisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evispan.operators import lexical, rank, select, snapshot, validate
from evispan.plans.jobs import candidates, questions, support, table
from evispan.plans.q_lexical import OVERLAP

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


TWO = f"""WITH {OVERLAP},
bm AS (SELECT d.job_id, d.pos, coalesce(sum(ln(1 + (n - df.df + 0.5) / (df.df + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * len / al))), 0) AS score
       FROM docs d LEFT JOIN (qt JOIN tf USING (job_id, term) JOIN df USING (job_id, term) JOIN sz USING (job_id, pos)) ON tf.job_id = d.job_id AND tf.pos = d.pos GROUP BY d.job_id, d.pos),
ra AS (SELECT job_id, pos, row_number() OVER (PARTITION BY job_id ORDER BY round(score, 9) DESC, pos) AS r FROM bm),
rb AS (SELECT job_id, pos, row_number() OVER (PARTITION BY job_id ORDER BY round(score, 9) DESC, pos) AS r FROM ov),
fu AS (SELECT job_id, pos, round(sum(1.0 / (60 + r)), 12) AS score FROM (SELECT * FROM ra UNION ALL SELECT * FROM rb) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, pos) AS rank FROM fu)"""


def fused(spark, sf_dir):
    jobs, docs = questions(spark, sf_dir), candidates(spark, sf_dir)
    a = lexical.top_k(lexical.bm25(docs, lexical.query_terms(jobs)), 1 << 30)
    b = lexical.top_k(lexical.query_overlap(jobs, docs), 1 << 30)
    return rank.fuse(a, b, ["job_id"], "pos")


@query(TWO + " SELECT job_id, pos, round(score, 9) AS score, rank FROM rk")
def rrf_fusion(spark, sf_dir):
    return fused(spark, sf_dir).select("job_id", "pos", F.round("score", 9).alias("score"), "rank")


def _graded(spark, sf_dir):
    good = support(spark, sf_dir).withColumn("rel", F.lit(1.0))
    return fused(spark, sf_dir).join(good, ["job_id", "pos"], "left").withColumn("rel", F.coalesce("rel", F.lit(0.0)))


GRADED = TWO + """, gr AS (SELECT rk.job_id, rk.pos, rank, CASE WHEN s.pos IS NULL THEN 0.0 ELSE 1.0 END AS rel FROM rk LEFT JOIN support s ON s.job_id = rk.job_id AND s.pos = rk.pos),
gi AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY rel DESC, rank) AS ideal FROM gr)"""


@query(
    GRADED
    + """ SELECT job_id, """
    + ", ".join(
        f"round(CASE WHEN sum(CASE WHEN ideal <= {k} THEN (pow(2, rel) - 1) / log2(ideal + 1) ELSE 0 END) > 0 THEN sum(CASE WHEN rank <= {k} THEN (pow(2, rel) - 1) / log2(rank + 1) ELSE 0 END) / sum(CASE WHEN ideal <= {k} THEN (pow(2, rel) - 1) / log2(ideal + 1) ELSE 0 END) ELSE 0 END, 7) AS ndcg_{k}, round(coalesce(1.0 / min(CASE WHEN rank <= {k} AND rel >= 0.5 THEN rank END), 0), 7) AS mrr_{k}"
        for k in rank.DEPTHS
    )
    + " FROM gi GROUP BY job_id"
)
def ndcg_mrr(spark, sf_dir):
    m = rank.ranking_metrics(_graded(spark, sf_dir), ["job_id"])
    return m.select("job_id", *[F.round(f"{c}_{k}", 7).alias(f"{c}_{k}") for k in rank.DEPTHS for c in ("ndcg", "mrr")])


@query(
    GRADED
    + """, t AS (SELECT job_id, k, sum(CASE WHEN rank <= k THEN rel ELSE 0 END) AS hit, count(CASE WHEN rank <= k THEN 1 END) AS n, sum(rel) AS g FROM gr, (VALUES (1), (2), (4), (8)) d(k) GROUP BY ALL)
SELECT k AS depth, count(*) AS queries, round(avg(hit / n), 9) AS precision, round(avg(CASE WHEN g > 0 THEN hit / g ELSE 0 END), 9) AS recall, round(avg(CASE WHEN g > 0 AND hit = g THEN 1.0 ELSE 0.0 END), 9) AS complete FROM t GROUP BY k"""
)
def retrieval_metrics(spark, sf_dir):
    rows = _graded(spark, sf_dir).withColumn("depth", F.explode(F.array(*[F.lit(k) for k in rank.DEPTHS])))
    top = F.col("rank") <= F.col("depth")
    per = rows.groupBy("job_id", "depth").agg(F.sum(F.when(top, F.col("rel")).otherwise(0.0)).alias("hit"), F.count_if(top).alias("n"), F.sum("rel").alias("g"))
    return per.groupBy("depth").agg(
        F.count("*").alias("queries"),
        F.round(F.avg(F.col("hit") / F.col("n")), 9).alias("precision"),
        F.round(F.avg(F.when(F.col("g") > 0, F.col("hit") / F.col("g")).otherwise(0.0)), 9).alias("recall"),
        F.round(F.avg(((F.col("g") > 0) & (F.col("hit") == F.col("g"))).cast("double")), 9).alias("complete"),
    )


#: Lines as atoms, ranked by length and then place; the cap is six tenths of the bytes of all that are ranked.
TRACE = """ln AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS item, unnest(x) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
tr AS (SELECT doc_id, item, octet_length(encode(t)) AS cost, row_number() OVER (PARTITION BY doc_id ORDER BY length(t) DESC, item) AS rank FROM ln)"""
FOLD = """cp AS (SELECT doc_id, CAST(floor(sum(cost) * 0.6) AS BIGINT) AS cap FROM tr GROUP BY doc_id),
o AS (SELECT tr.doc_id, item, cost, rank, row_number() OVER (PARTITION BY tr.doc_id ORDER BY rank > 2, {order}) AS k FROM tr {join}),
go(doc_id, k, spent, got) AS (SELECT doc_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS VARCHAR[]) FROM cp
  UNION ALL SELECT g.doc_id, g.k + 1, CASE WHEN o.rank <= 2 OR spent + cost <= cap THEN spent + cost ELSE spent END, CASE WHEN o.rank <= 2 OR spent + cost <= cap THEN list_append(got, CAST(item AS VARCHAR)) ELSE got END
  FROM go g JOIN o ON o.doc_id = g.doc_id AND o.k = g.k + 1 JOIN cp ON cp.doc_id = g.doc_id)
SELECT doc_id, array_to_string(arg_max(got, k), ',') AS selected, max(spent) AS spent, max(spent) <= any_value(cap) AS feasible FROM go JOIN cp USING (doc_id) GROUP BY doc_id"""


def _trace(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("item", "t"))
    ranked = lines.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.length("t").desc(), "item"))).select("doc_id", "item", F.octet_length("t").cast("long").alias("cost"), "rank")
    return ranked.withColumn("cap", F.floor(F.sum("cost").over(Window.partitionBy("doc_id")) * 0.6))


@query(f"WITH RECURSIVE {TRACE}, " + FOLD.replace("{order}", "rank").replace("{join}", ""))
def budget_control_ranked(spark, sf_dir):
    return rank.budget_control(_trace(spark, sf_dir), F.col("cap"), [F.col("rank")])


@query(
    f"WITH RECURSIVE {TRACE}, bs AS (SELECT doc_id, list(item) AS b FROM tr WHERE rank <= 2 GROUP BY doc_id), "
    + FOLD.replace("{order}", "CASE WHEN rank <= 2 THEN rank ELSE list_min(list_transform(b, lambda x: abs(x - item))) END, item").replace("{join}", "JOIN bs ON bs.doc_id = tr.doc_id")
)
def budget_control_adjacent(spark, sf_dir):
    t = _trace(spark, sf_dir)
    base = F.collect_list(F.when(F.col("rank") <= 2, F.col("item"))).over(Window.partitionBy("doc_id"))
    near = F.array_min(F.transform("base", lambda x: F.abs(x - F.col("item"))))
    placed = t.withColumn("base", base).withColumn("near", F.when(F.col("rank") <= 2, F.col("rank")).otherwise(near)).drop("base")
    return rank.budget_control(placed, F.col("cap"), [F.col("near"), F.col("item")])


PARTS = "pt AS (SELECT l_partkey, CAST(sum(l_quantity) AS DOUBLE) AS gain, CAST(avg(l_extendedprice / l_quantity) AS DOUBLE) AS c0 FROM lineitem GROUP BY l_partkey), pc AS (SELECT l_partkey, gain, round(c0, 4) AS cost FROM pt), fr AS (SELECT * FROM pc a WHERE NOT EXISTS (SELECT 1 FROM pc b WHERE b.cost <= a.cost AND b.gain >= a.gain AND (b.cost < a.cost OR b.gain > a.gain)))"


def _parts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_partkey").agg(F.sum("l_quantity").cast("double").alias("gain"), F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).cast("double"), 4).alias("cost"))


@query(f"WITH {PARTS} SELECT l_partkey, gain, cost FROM fr")
def pareto_frontier(spark, sf_dir):
    return rank.pareto(_parts(spark, sf_dir), "cost", "gain")


@query(
    f"WITH {PARTS}, b AS (SELECT min(cost) AS cl, max(cost) AS ch, min(gain) AS gl, max(gain) AS gh FROM fr) SELECT l_partkey, gain, cost, round(sqrt(pow(CASE WHEN ch > cl THEN (cost - cl) / (ch - cl) ELSE 0 END, 2) + pow(1 - CASE WHEN gh > gl THEN (gain - gl) / (gh - gl) ELSE 0 END, 2)), 9) AS distance FROM fr, b ORDER BY distance, cost LIMIT 1"
)
def knee_point(spark, sf_dir):
    return rank.knee(rank.pareto(_parts(spark, sf_dir), "cost", "gain"), "cost", "gain")


# Snapshots: all documents, and the documents before: without ids divisible by 7, those divisible by 11 with other words

PLAN = snapshot.Plan("the of of que zzz the", 10)
NEW = "new AS (SELECT doc_id AS id, text FROM documents)"
OLD = "old AS (SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN text || ' earlier words' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0)"
OKAPI = r"""w AS (SELECT id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS x FROM new),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(x) AS term FROM w) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(x)) AS al FROM w),
rw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), st),
mn AS (SELECT avg(raw) AS mean FROM rw),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM rw CROSS JOIN mn)"""
TOPK = f"""WITH {NEW}, {OKAPI}, p(term) AS (VALUES {", ".join(f"('{t}')" for t in PLAN.terms)}),
sc AS (SELECT w.id, round(coalesce(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(x) / al))), 0), 9) AS score FROM w CROSS JOIN st LEFT JOIN (p JOIN tf USING (term) JOIN idf USING (term)) ON tf.id = w.id GROUP BY w.id),
rk AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM sc)
SELECT id, round(score, 7) AS score, rank FROM rk WHERE rank <= {PLAN.k}"""


def _now(spark, sf_dir):
    return snapshot.Snapshot(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


def _before(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.col("doc_id") % 7 != 0)
    return snapshot.Snapshot(d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit(" earlier words"))).otherwise(F.col("text")).alias("text")))


def _out(df):
    return df.select("id", F.round("score", 7).alias("score"), "rank")


@query(f"WITH {NEW}, {OKAPI} SELECT term, df, round(idf, 7) AS idf FROM idf")
def okapi_idf(spark, sf_dir):
    return _now(spark, sf_dir).idf.select("term", "df", F.round("idf", 7).alias("idf"))


@query(TOPK)
def snapshot_topk(spark, sf_dir):
    return _out(snapshot.top(_now(spark, sf_dir).scores(PLAN), PLAN.k))


@query(TOPK)
def postings_topk(spark, sf_dir):
    """Posting hits first; documents without one keep 0 and may outrank them."""
    s = _now(spark, sf_dir)
    hits = snapshot.top(s.hits(PLAN), PLAN.k).select("id", "score")
    rest = s.lengths.select("id").join(s.hits(PLAN).select("id"), "id", "left_anti").orderBy("id").limit(PLAN.k).select("id", F.lit(0.0).alias("score"))
    return _out(snapshot.top(hits.unionByName(rest), PLAN.k))


@query(TOPK)
def blockmax_topk(spark, sf_dir):
    return _out(snapshot.block_max_top(_now(spark, sf_dir), PLAN))


@query(TOPK)
def receipt_advance(spark, sf_dir):
    """The old snapshot's receipt carried to the new one."""
    old, new = _before(spark, sf_dir), _now(spark, sf_dir)
    done = snapshot.advance(new, PLAN, snapshot.issue(old, PLAN), snapshot.changed(old, new), old.identity)
    return _out(snapshot.receipt_rows(spark, done))


@query(f"WITH {NEW}, {OLD} SELECT coalesce(old.id, new.id) AS id, CASE WHEN old.id IS NULL THEN 'added' WHEN new.id IS NULL THEN 'removed' ELSE 'rewritten' END AS change FROM old FULL JOIN new ON old.id = new.id WHERE old.text IS DISTINCT FROM new.text")
def snapshot_transition(spark, sf_dir):
    return snapshot.changed(_before(spark, sf_dir), _now(spark, sf_dir))


# Decisions

UPDATES = "u AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pt, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pe FROM events)"


def _updates(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", F.lag("event_type").over(w).alias("pt"), F.lag("event_id").over(w).alias("pe"))


@query(
    f"""WITH {UPDATES} SELECT event_id, CASE WHEN event_type = pt THEN 'REBASE' WHEN event_id % 3 = 0 THEN 'REVALIDATE' WHEN (event_id % 10) * 5 < (pe % 10) * 5 + 8 AND (pe % 10) * 5 < (event_id % 10) * 5 + 8 THEN 'REBASE' ELSE 'COMMUTE' END AS class FROM u WHERE pt IS NOT NULL"""
)
def conflict_class(spark, sf_dir):
    u = _updates(spark, sf_dir).where("pt is not null")
    foot = lambda c: F.array(F.struct((F.col(c) % 10 * 5).alias("start"), (F.col(c) % 10 * 5 + 8).alias("stop")))
    none = F.array().cast("array<string>")
    deps = F.when(F.col("event_id") % 3 == 0, F.array("pt")).otherwise(none)
    return u.select("event_id", validate.conflict(F.array("event_type"), deps, foot("event_id"), F.array("pt"), none, foot("pe")).alias("class"))


@query(
    """WITH v AS (SELECT user_id, event_type, count(*) AS version FROM events GROUP BY ALL),
r AS (SELECT event_id, user_id, event_type, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS seen FROM events)
SELECT event_id, CASE WHEN seen = version THEN 'FRESH' ELSE 'REVALIDATE' END AS decision FROM r JOIN v USING (user_id, event_type)"""
)
def freshness(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    name = F.concat_ws(":", "user_id", "event_type")
    seen = F.count("*").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    reads = e.select("event_id", name.alias("object"), seen.alias("version"))
    now = e.groupBy(name.alias("object")).agg(F.count("*").alias("version"))
    return validate.freshness(reads, now, "event_id")


CASES = """c AS (SELECT i AS case_id, CASE WHEN i < 360 THEN ['freshness', 'commitment', 'authority', 'operation', 'view', 'witness_gap'][i // 60 + 1] ELSE 'safe' END AS family FROM range(660) t(i)),
pol(policy) AS (VALUES ('execution_evidence'), ('projection_evidence'), ('model_evidence'), ('without_read_check'), ('read_set_occ'), ('selectors_only'), ('target_version_occ'), ('review_all'), ('append_only')),
dec AS (SELECT case_id, family, policy, CASE
  WHEN policy = 'review_all' THEN 'REVIEW' WHEN policy IN ('append_only', 'target_version_occ') THEN 'AUTO_COMMIT'
  WHEN policy = 'read_set_occ' THEN CASE WHEN family IN ('freshness', 'commitment', 'witness_gap') THEN 'REVALIDATE' ELSE 'AUTO_COMMIT' END
  WHEN family IN ('authority', 'operation') THEN 'REVIEW' WHEN policy = 'selectors_only' OR family = 'safe' THEN 'AUTO_COMMIT'
  WHEN family = 'view' THEN CASE WHEN policy = 'model_evidence' THEN 'AUTO_COMMIT' ELSE 'REVALIDATE' END
  WHEN policy = 'without_read_check' THEN 'AUTO_COMMIT'
  WHEN family = 'witness_gap' THEN CASE WHEN policy = 'model_evidence' THEN 'AUTO_COMMIT' ELSE 'REVALIDATE' END
  ELSE 'REVALIDATE' END AS decision FROM c, pol)"""


@query(f"WITH {CASES} SELECT case_id, family, policy, decision FROM dec")
def policy_decisions(spark, sf_dir):
    return validate.decisions(validate.generated_updates(spark)).select("case_id", "family", "policy", "decision")


@query(
    f"WITH {CASES} SELECT policy, family, count(*) AS cases, count(*) FILTER (WHERE decision = 'AUTO_COMMIT') AS committed, count(*) FILTER (WHERE decision = 'AUTO_COMMIT' AND family <> 'safe') AS unsafe_commits, round(count(*) FILTER (WHERE decision = 'AUTO_COMMIT' AND family <> 'safe') / greatest(1, count(*) FILTER (WHERE family <> 'safe')), 9) AS unsafe_rate FROM dec GROUP BY ALL"
)
def diagnostic_matrix(spark, sf_dir):
    return validate.matrix(validate.decisions(validate.generated_updates(spark)))


@query(
    """WITH p AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) % 2 = 0 AS stale FROM events)
SELECT policy, count(*) AS scenarios, count(*) FILTER (WHERE stale) AS stale, count(*) FILTER (WHERE stale AND commits) AS stale_commits, count(*) FILTER (WHERE NOT commits) AS not_committed FROM (
  SELECT event_id, stale, policy, CASE policy WHEN 'review_all' THEN false WHEN 'execution_evidence' THEN NOT stale WHEN 'projection_evidence' THEN NOT stale WHEN 'model_evidence' THEN NOT stale WHEN 'read_set_occ' THEN NOT stale ELSE true END AS commits
  FROM p, (VALUES ('execution_evidence'), ('projection_evidence'), ('model_evidence'), ('without_read_check'), ('read_set_occ'), ('selectors_only'), ('target_version_occ'), ('review_all'), ('append_only')) v(policy)) GROUP BY policy"""
)
def stale_replay(spark, sf_dir):
    """Every event is an update that read its peer's commitment; the peer of every second one has moved on."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("event_id", (F.row_number().over(w) % 2 == 0).alias("stale"))
    return validate.stale_summary(validate.decisions(validate.stale_updates(e)))


@query(
    """WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) // 2 AS depth FROM events)
SELECT a.event_id, count(b.event_id) AS n_prior, coalesce(max(b.depth), -1) AS last_depth FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.depth < a.depth GROUP BY a.event_id"""
)
def prior_history_spans(spark, sf_dir):
    """Strictly earlier revisions of the same history; equal depths don't see each other, so the window is by range."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.row_number().over(w) / 2).alias("depth"))
    past = Window.partitionBy("user_id").orderBy("depth").rangeBetween(Window.unboundedPreceding, -1)
    return e.select("event_id", F.count("*").over(past).alias("n_prior"), F.coalesce(F.max("depth").over(past), F.lit(-1)).cast("long").alias("last_depth"))


@query("SELECT o_custkey, o_orderkey, o_orderpriority, CASE WHEN o_totalprice >= 150000 THEN 'urgent' ELSE 'normal' END AS route FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest_policy_revision(spark, sf_dir):
    last = select.latest(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return last.select("o_custkey", "o_orderkey", "o_orderpriority", F.when(F.col("o_totalprice") >= 150000, "urgent").otherwise("normal").alias("route"))
