"""Queries over selection policies and the statistics of their results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispan.operators import answers, components, jobwise, select, stats
from evispan.plans.jobs import SQL as JOBS
from evispan.plans.jobs import candidates, questions, support, table
from evispan.plans.q_lexical import BM25, STOPS

QUERIES, ORACLES = {}, {}
BUDGET = 512
CAPS = (512, 2048)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: The rank policy for the budgets of `caps`: candidates in order, each taken where it fits and its body is new.
RANK = f"""WITH RECURSIVE {BM25},
caps(cap) AS (VALUES {{caps}}),
ln AS (SELECT d.job_id, d.pos, tokens, sha256, row_number() OVER (PARTITION BY d.job_id ORDER BY round(rel, 9) DESC, tokens, d.pos) AS k FROM docs d JOIN rel ON rel.job_id = d.job_id AND rel.pos = d.pos),
go(job_id, cap, k, spent, got, seen) AS (
  SELECT j.job_id, cap, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS INTEGER[]), CAST([] AS VARCHAR[]) FROM (SELECT DISTINCT job_id FROM docs) j, caps
  UNION ALL
  SELECT go.job_id, go.cap, go.k + 1, CASE WHEN ok THEN spent + tokens ELSE spent END, CASE WHEN ok THEN list_append(got, pos) ELSE got END, CASE WHEN ok THEN list_append(seen, sha256) ELSE seen END
  FROM (SELECT go.*, ln.pos, ln.tokens, ln.sha256, go.spent + ln.tokens <= go.cap AND NOT list_contains(go.seen, ln.sha256) AS ok FROM go JOIN ln ON ln.job_id = go.job_id AND ln.k = go.k + 1) go),
sel AS (SELECT job_id, cap, arg_max(got, k) AS got, max(spent) AS spent FROM go GROUP BY job_id, cap)
"""


@query(RANK.replace("{caps}", f"({BUDGET})") + "SELECT job_id, array_to_string(list_sort(got), ',') AS selected, spent, CAST(len(got) AS BIGINT) AS steps FROM sel")
def select_rank(spark, sf_dir):
    found = select.select_records(questions(spark, sf_dir), candidates(spark, sf_dir), "rank", BUDGET)
    return found.withColumn("steps", F.col("steps").cast("long"))


@query(f"WITH {JOBS} SELECT job_id, array_to_string(list_sort(list(pos)), ',') AS selected, CAST(sum(tokens) AS BIGINT) AS spent, count(*) AS steps FROM docs GROUP BY job_id")
def select_full(spark, sf_dir):
    return select.select_records(questions(spark, sf_dir), candidates(spark, sf_dir), "full").withColumn("steps", F.col("steps").cast("long"))


#: The single-record policies by recursion: every round takes the best value among what fits.
LOOP = rf"""WITH RECURSIVE {BM25},
un AS (SELECT d.job_id, d.pos, tokens, sha256, round(rel, 9) AS rel FROM docs d JOIN rel ON rel.job_id = d.job_id AND rel.pos = d.pos),
wr AS (SELECT job_id, pos, term, tf * (ln((1.0 + m.n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (job_id, term) JOIN (SELECT job_id, count(*) AS n FROM docs GROUP BY job_id) m USING (job_id) WHERE term NOT IN (SELECT term FROM stops)),
wt AS (SELECT job_id, pos, term, w / sqrt(sum(w * w) OVER (PARTITION BY job_id, pos)) AS w FROM wr),
{{more}},
go(job_id, k, spent, got, seen, terms) AS (
  SELECT DISTINCT job_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS INTEGER[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) FROM docs
  UNION ALL
  SELECT g.job_id, g.k + 1, g.spent + b.tokens, list_append(g.got, b.pos), list_append(g.seen, b.sha256), list_concat(g.terms, b.cov) FROM go g JOIN LATERAL (
    SELECT u.pos, u.tokens, u.sha256, coalesce(c.cov, []) AS cov FROM un u LEFT JOIN cv c ON c.job_id = u.job_id AND c.pos = u.pos
    WHERE u.job_id = g.job_id AND NOT list_contains(g.got, u.pos) AND NOT list_contains(g.seen, u.sha256) AND g.spent + u.tokens <= {BUDGET}
    ORDER BY round({{value}}, 9) DESC, {{tie}} LIMIT 1) b ON true),
sel AS (SELECT job_id, arg_max(got, k) AS got, max(spent) AS spent, max(k) AS steps FROM go GROUP BY job_id)
SELECT job_id, array_to_string(list_sort(got), ',') AS selected, spent, steps FROM sel
"""
COVERS = "cv AS (SELECT job_id, pos, list(term) AS cov FROM tf JOIN qt USING (job_id, term) GROUP BY ALL)"
SIMS = """sm AS (SELECT a.job_id, a.pos, b.pos AS o, round(sum(a.w * b.w), 9) AS sim FROM wt a JOIN wt b ON a.job_id = b.job_id AND a.term = b.term AND a.pos <> b.pos GROUP BY ALL),
sl AS (SELECT job_id, pos, map(list(o), list(sim)) AS m FROM sm GROUP BY ALL)"""
BEST_SIM = "coalesce((SELECT list_max(list_transform(g.got, lambda o: coalesce(m[o], 0.0))) FROM sl WHERE sl.job_id = u.job_id AND sl.pos = u.pos), 0.0)"


def _greedy(policy: str, budget: int = BUDGET):
    def run(spark, sf_dir):
        found = select.select_records(questions(spark, sf_dir), candidates(spark, sf_dir), policy, budget)
        return found.withColumn("steps", F.col("steps").cast("long"))

    return run


QUERIES |= {f"select_{p}": _greedy(p) for p in ("mmr", "mmr_per_cost", "singleton", "iterative", "bundle", "similarity_bundle")}
ORACLES["select_mmr"] = LOOP.replace("{more}", f"{COVERS}, {SIMS}").replace("{value}", f"0.7 * u.rel - 0.3 * {BEST_SIM}").replace("{tie}", "u.pos")
ORACLES["select_mmr_per_cost"] = LOOP.replace("{more}", f"{COVERS}, {SIMS}").replace("{value}", f"(0.7 * u.rel - 0.3 * {BEST_SIM}) / sqrt(u.tokens)").replace("{tie}", "u.tokens, u.pos")
MENTIONS = r"""mt AS (SELECT job_id, pos, array_to_string(regexp_extract_all(lower(title), '[\p{L}\p{N}_]{2,}'), ' ') AS t, array_to_string(regexp_extract_all(lower(title), '[\p{L}\p{N}_]{2,}'), '') AS tj,
              ' ' || array_to_string(regexp_extract_all(lower(title || chr(10) || text), '[\p{L}\p{N}_]{2,}'), ' ') || ' ' AS b FROM docs),
mg AS (SELECT DISTINCT a.job_id, a.pos AS i, b.pos AS j FROM mt a JOIN mt b ON a.job_id = b.job_id AND a.pos <> b.pos AND length(a.tj) >= 4 AND contains(b.b, ' ' || a.t || ' ')),
nb AS (SELECT job_id, pos, list(o) AS near FROM (SELECT job_id, i AS pos, j AS o FROM mg UNION SELECT job_id, j, i FROM mg) GROUP BY ALL),
nt AS (SELECT job_id, count(*) AS nq FROM qt GROUP BY job_id)"""
GAIN = "(SELECT count(*) FROM (SELECT unnest(coalesce(c.cov, [])) AS t) WHERE NOT list_contains(g.terms, t)) / greatest(1.0, coalesce((SELECT nq FROM nt WHERE nt.job_id = u.job_id), 0))"
LINK = "CASE WHEN coalesce((SELECT list_has_any(near, g.got) FROM nb WHERE nb.job_id = u.job_id AND nb.pos = u.pos), false) THEN 1.0 ELSE 0.0 END"
ORACLES["select_singleton"] = LOOP.replace("{more}", f"{COVERS}, {MENTIONS}").replace("{value}", f"(u.rel + 0.35 * {GAIN} + 0.3 * {LINK}) / pow(u.tokens, 0.25)").replace("{tie}", "u.tokens, u.pos")
EXPANDED = """et AS (SELECT job_id, pos, term FROM (SELECT *, row_number() OVER (PARTITION BY job_id, pos ORDER BY round(w, 9) DESC, term) AS rank FROM wt) WHERE rank <= 8),
ht AS (SELECT e.job_id, e.pos AS source, tf.pos, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * len / al))) AS s
        FROM et e JOIN tf ON tf.job_id = e.job_id AND tf.term = e.term JOIN df ON df.job_id = e.job_id AND df.term = e.term JOIN sz ON sz.job_id = tf.job_id AND sz.pos = tf.pos GROUP BY ALL),
ea AS (SELECT x.job_id, x.source, d.pos, coalesce(s, 0) AS s FROM (SELECT DISTINCT job_id, pos AS source FROM et) x JOIN docs d ON d.job_id = x.job_id LEFT JOIN ht h ON h.job_id = x.job_id AND h.source = x.source AND h.pos = d.pos),
ex AS (SELECT job_id, source, pos, round(CASE WHEN max(s) OVER w > min(s) OVER w THEN (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) ELSE 0 END, 9) AS score FROM ea WINDOW w AS (PARTITION BY job_id, source)),
el AS (SELECT job_id, pos, map(list(source), list(score)) AS m FROM ex WHERE source <> pos GROUP BY ALL)"""
BEST_GROW = "coalesce((SELECT list_max(list_transform(g.got, lambda o: coalesce(m[o], 0.0))) FROM el WHERE el.job_id = u.job_id AND el.pos = u.pos), 0.0)"
ORACLES["select_iterative"] = LOOP.replace("{more}", f"{COVERS}, {EXPANDED}").replace("{value}", f"0.6 * u.rel + 0.4 * {BEST_GROW}").replace("{tie}", "u.tokens, u.pos")


def transfer_rows(spark, sf_dir, policies=("rank", "singleton", "bundle"), caps=CAPS) -> DataFrame:
    """(job_id, policy, cap, spent, n_support, found, recall, complete): every job by every policy and cap, from one table of terms a job."""
    jobs, docs, want = questions(spark, sf_dir), candidates(spark, sf_dir), support(spark, sf_dir)
    if set(policies) - {"rank"}:
        return select.support_flags(jobwise.select_jobs(jobs, docs, [(p, c) for p in policies for c in caps]), want)
    scored = docs.join(select.relevance(jobs, docs), ["job_id", "pos"])
    parts = [select.select_rank(scored, c).withColumn("policy", F.lit("rank")).withColumn("cap", F.lit(c)) for c in caps]
    return select.support_flags(reduce(DataFrame.unionByName, parts), want)


def _rows_out(rows: DataFrame) -> DataFrame:
    return rows.select("job_id", "policy", "cap", "spent", F.col("n_support").cast("long").alias("n_support"), F.col("found").cast("long").alias("found"), F.round("recall", 9).alias("recall"), "complete")


@query()
def budget_transfer_rows(spark, sf_dir):
    return _rows_out(transfer_rows(spark, sf_dir))


RANK_ROWS = (
    RANK.replace("{caps}", ", ".join(f"({c})" for c in CAPS))
    + """, sp AS (SELECT job_id, count(*) AS ns FROM support GROUP BY job_id),
rr AS (SELECT sel.job_id, cap, spent, coalesce(ns, 0) AS n_support, (SELECT count(*) FROM support s WHERE s.job_id = sel.job_id AND list_contains(sel.got, s.pos)) AS found FROM sel LEFT JOIN sp USING (job_id))
"""
)


@query(RANK_ROWS + "SELECT job_id, 'rank' AS policy, cap, spent, n_support, found, round(CASE WHEN n_support > 0 THEN found / n_support END, 9) AS recall, n_support > 0 AND found = n_support AS complete FROM rr")
def budget_transfer_rank(spark, sf_dir):
    return _rows_out(transfer_rows(spark, sf_dir, ("rank",)))


@query(
    RANK_ROWS
    + """SELECT cap, stratum, count(*) AS jobs, count(*) FILTER (WHERE n_support > 0) AS feasible, round(avg(CASE WHEN n_support > 0 THEN found / n_support END), 9) AS recall,
  round(avg(CASE WHEN n_support > 0 AND found = n_support THEN 1.0 ELSE 0.0 END), 9) AS complete_rate, round(avg(spent), 6) AS cost
FROM rr JOIN jobs USING (job_id) GROUP BY GROUPING SETS ((cap), (cap, stratum))"""
)
def budget_transfer_summary(spark, sf_dir):
    """Overall and by stratum in one pass of grouping sets."""
    rows = transfer_rows(spark, sf_dir, ("rank",)).join(questions(spark, sf_dir).select("job_id", "stratum"), "job_id")
    return stats.support_summary(rows)


@query()
def budget_transfer_contrast(spark, sf_dir):
    """Per cap: bundle less singleton, gains, losses and ties, and a stratified bootstrap interval with its pinned seed."""
    rows = transfer_rows(spark, sf_dir, ("singleton", "bundle")).join(questions(spark, sf_dir).select("job_id", "stratum"), "job_id")
    return stats.contrasts(rows, "singleton", "bundle", CAPS)


@query(
    """WITH x AS (SELECT o_orderkey AS id, o_orderpriority AS stratum, CAST(o_totalprice AS DOUBLE) AS a, CAST(o_totalprice AS DOUBLE) * (0.9 + (o_orderkey % 7) / 30.0) AS b FROM orders),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY stratum ORDER BY id) - 1 AS BIGINT) AS k, count(*) OVER (PARTITION BY stratum) AS m FROM x),
d AS (SELECT r AS rep, n.stratum, n.m, ('0x' || substr(md5('boot:' || r || ':' || n.stratum || ':' || n.k), 1, 8))::BIGINT % n.m AS pick FROM n, range(50) t(r)),
s AS (SELECT rep, d.stratum, d.m, avg(n.b - n.a) AS v FROM d JOIN n ON n.stratum = d.stratum AND n.k = d.pick GROUP BY ALL),
e AS (SELECT rep, sum(v * m) / sum(m) AS v FROM s GROUP BY rep)
SELECT round((SELECT avg(b - a) FROM x), 4) AS estimate, round(quantile_cont(v, 0.025), 4) AS low, round(quantile_cont(v, 0.975), 4) AS high FROM e"""
)
def paired_bootstrap_hash(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("stratum"), F.col("o_totalprice").cast("double").alias("a"))
    o = o.withColumn("d", F.col("a") * (0.9 + (F.col("id") % 7) / 30.0) - F.col("a"))
    return stats.stratified_hash_bootstrap(o, "id", "stratum", "d", 50, "boot")


@query(
    """WITH c AS (SELECT o_custkey AS cluster, sum(CAST(o_totalprice AS DOUBLE) * ((o_orderkey % 5) - 2) / 10) AS s, count(*) AS n FROM orders GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (ORDER BY cluster) - 1 AS BIGINT) AS k, count(*) OVER () AS m FROM c),
d AS (SELECT r AS rep, ('0x' || substr(md5('cluster:' || r || ':' || k), 1, 8))::BIGINT % m AS pick FROM k, range(50) t(r)),
e AS (SELECT rep, sum(s) / sum(n) AS v FROM d JOIN k ON k.k = d.pick GROUP BY rep)
SELECT round((SELECT sum(s) / sum(n) FROM c), 4) AS estimate, round(quantile_cont(v, 0.025), 4) AS low, round(quantile_cont(v, 0.975), 4) AS high, round(avg(CASE WHEN v <= 0 THEN 1.0 ELSE 0.0 END), 6) AS p_not_positive FROM e"""
)
def cluster_bootstrap_hash(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").alias("cluster"), (F.col("o_totalprice").cast("double") * ((F.col("o_orderkey") % 5) - 2) / 10).alias("v"))
    return stats.cluster_hash_bootstrap(rows, "cluster", "v", 50, "cluster")


@query("SELECT doc_id, sha, rank FROM (SELECT doc_id, sha256('pick:' || doc_id) AS sha, row_number() OVER (ORDER BY sha256('pick:' || doc_id), doc_id) AS rank FROM documents) WHERE rank <= 64")
def hash_sample(spark, sf_dir):
    """The 64 lowest by a hash of the id: the sampling operator."""
    return stats.hash_sample(table(spark, sf_dir, "documents"), "doc_id", 64, "pick:").select("doc_id", "sha", F.col("rank").cast("long").alias("rank"))


@query(
    """WITH h AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('split:' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN r <= round_even(n * 0.2, 0) THEN 'holdout' ELSE 'development' END AS part FROM h"""
)
def hash_split(spark, sf_dir):
    return stats.hash_split(table(spark, sf_dir, "documents"), "doc_id", 0.2, "split:")


EDGES = "e AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, 's:' || sha256(text) AS k FROM documents UNION ALL SELECT doc_id, 't:' || left(text, 40) FROM documents))"
COMPONENTS = f"""WITH RECURSIVE {EDGES}, g AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b USING (k)),
r(x, y) AS (SELECT x, y FROM g UNION SELECT r.x, g.y FROM r JOIN g ON r.y = g.x), c AS (SELECT x AS doc_id, min(y) AS component FROM r GROUP BY x)"""


@query(COMPONENTS + " SELECT doc_id, component FROM c")
def support_components(spark, sf_dir):
    """Documents that share a body or an opening, as components."""
    return components.shared_key_components(_keyed(spark, sf_dir))


def _keyed(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.lit("s:"), F.sha2("text", 256)).alias("k")).unionByName(d.select("doc_id", F.concat(F.lit("t:"), F.substring("text", 1, 40)).alias("k")))


@query(COMPONENTS + ", bad AS (SELECT DISTINCT component FROM c JOIN labels USING (doc_id) WHERE toxic = 1) SELECT component, count(*) AS members, min_by(doc_id, sha256('rep:' || doc_id)) AS representative FROM c WHERE component NOT IN (SELECT component FROM bad) GROUP BY component")
def exclusion_anti_join(spark, sf_dir):
    """Components none of whose members is excluded, each with a hash-chosen representative."""
    found = components.shared_key_components(_keyed(spark, sf_dir))
    banned = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    return components.eligible(found, banned)


@query(
    """SELECT priority AS policy, CASE WHEN b = 0 THEN NULL ELSE b * 512 END AS budget, sel AS selective, count(*) AS n, sum(CASE WHEN t THEN 1 ELSE 0 END)::BIGINT AS fallbacks, round(avg(em), 9) AS em, round(avg(f1), 9) AS f1,
  round(avg(c), 9) AS complete, round(avg(calls), 9) AS calls, round(avg(tokens), 9) AS tokens
FROM (SELECT o_orderpriority AS priority, o_orderkey % 3 AS b, sel, sel AND o_orderkey % 4 = 0 AS t, CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE 0.0 END AS em, (o_orderkey % 10) / 10.0 AS f1, CASE WHEN o_orderkey % 5 = 0 THEN 1.0 ELSE 0.0 END AS c,
  CASE WHEN sel AND o_orderkey % 4 = 0 THEN 2.0 ELSE 1.0 END AS calls, o_orderkey % 97 + 0.0 AS tokens FROM orders, (VALUES (true), (false)) s(sel)) GROUP BY ALL"""
)
def experiment_aggregate(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    rows = o.select(F.col("o_orderpriority").alias("policy"), F.when(k % 3 != 0, k % 3 * 512).alias("budget"), k.alias("k"), F.explode(F.array(F.lit(True), F.lit(False))).alias("selective"))
    k = F.col("k")
    trigger = F.col("selective") & (k % 4 == 0)
    rows = rows.select("policy", "budget", "selective", trigger.alias("trigger"), (k % 2 == 0).cast("int").alias("em"), (k % 10 / 10).alias("f1"), (k % 5 == 0).cast("int").alias("complete"), F.when(trigger, 2).otherwise(1).alias("calls"), (k % 97).alias("tokens"))
    return answers.experiment_summary(rows)


@query(
    """WITH r AS (SELECT l_orderkey AS row_id, l_suppkey AS request_id FROM lineitem), s AS (SELECT s_suppkey AS request_id, s_suppkey % 50 + 1 AS tokens FROM supplier)
SELECT row_id, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens FROM r JOIN s USING (request_id) GROUP BY row_id"""
)
def cache_replay_usage(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("request_ids")).withColumnRenamed("l_orderkey", "row_id")
    stored = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("request_id"), (F.col("s_suppkey") % 50 + 1).alias("tokens"))
    return answers.usage(rows, stored, ["row_id"])


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'fallback ' || role ELSE 'A: ' || role END AS answer, turn % 3 = 0 AS trigger, CASE WHEN turn % 3 = 0 THEN 'first,second,second' ELSE 'first' END AS requests FROM conversations")
def selective_compose(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    first = c.select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, "UNKNOWN.").otherwise(F.concat(F.lit("A: "), "role")).alias("answer"), F.array(F.lit("first")).alias("request_ids"))
    back = c.select("conv_id", "turn", F.concat(F.lit("fallback "), "role").alias("answer"), F.array(F.lit("second"), F.lit("second")).alias("request_ids"))
    done = answers.compose_selective(first, back, ["conv_id", "turn"])
    return done.select("conv_id", "turn", "answer", "trigger", F.array_join("request_ids", ",").alias("requests"))
