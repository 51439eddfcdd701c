"""Queries over lexical and vector scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispan.functions.text import STOP_WORDS
from evispan.operators import graph, jobwise, lexical, validate
from evispan.plans.jobs import SQL as JOBS
from evispan.plans.jobs import candidates, questions, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


STOPS = ", ".join(f"('{w}')" for w in STOP_WORDS)
TERMS = rf"""{JOBS},
stops(term) AS (VALUES {STOPS}),
words AS (SELECT job_id, pos, unnest(regexp_extract_all(lower(title || chr(10) || text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM docs),
tf AS (SELECT job_id, pos, term, count(*) AS tf FROM words GROUP BY ALL),
df AS (SELECT job_id, term, count(*) AS df FROM tf GROUP BY ALL),
sz AS (SELECT d.job_id, d.pos, count(w.term) AS len, avg(count(w.term)) OVER (PARTITION BY d.job_id) AS al, count(*) OVER (PARTITION BY d.job_id) AS n
       FROM docs d LEFT JOIN words w ON w.job_id = d.job_id AND w.pos = d.pos GROUP BY d.job_id, d.pos),
qt AS (SELECT DISTINCT job_id, term FROM (SELECT job_id, unnest(regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM jobs) WHERE term NOT IN (SELECT term FROM stops))"""
BM25 = f"""{TERMS},
bm AS (SELECT d.job_id, d.pos, coalesce(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * len / al))), 0) AS score
       FROM docs d LEFT JOIN (SELECT * FROM qt JOIN tf USING (job_id, term) JOIN df USING (job_id, term) JOIN sz USING (job_id, pos)) h ON h.job_id = d.job_id AND h.pos = d.pos GROUP BY d.job_id, d.pos),
rel AS (SELECT job_id, pos, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END AS rel FROM bm WINDOW w AS (PARTITION BY job_id))"""
TFIDF = f"""{TERMS},
wr AS (SELECT job_id, pos, term, tf * (ln((1.0 + m.n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (job_id, term) JOIN (SELECT job_id, count(*) AS n FROM docs GROUP BY job_id) m USING (job_id) WHERE term NOT IN (SELECT term FROM stops)),
wt AS (SELECT job_id, pos, term, w / sqrt(sum(w * w) OVER (PARTITION BY job_id, pos)) AS w FROM wr)"""
EXPANSION = f"""{TFIDF},
et AS (SELECT job_id, pos, term, rank FROM (SELECT *, row_number() OVER (PARTITION BY job_id, pos ORDER BY round(w, 9) DESC, term) AS rank FROM wt) WHERE rank <= 8)"""


def both(spark, sf_dir):
    return questions(spark, sf_dir), candidates(spark, sf_dir)


@query(f"WITH {BM25} SELECT job_id, pos, round(score, 7) AS score FROM bm")
def bm25_scores(spark, sf_dir):
    jobs, docs = both(spark, sf_dir)
    return lexical.bm25(docs, lexical.query_terms(jobs)).select("job_id", "pos", F.round("score", 7).alias("score"))


@query(f"WITH {BM25} SELECT job_id, pos, round(rel, 7) AS score FROM rel")
def bm25_scaled(spark, sf_dir):
    jobs, docs = both(spark, sf_dir)
    return lexical.scaled(lexical.bm25(docs, lexical.query_terms(jobs))).select("job_id", "pos", F.round("score", 7).alias("score"))


@query(f"WITH {TFIDF} SELECT a.job_id, a.pos AS i, b.pos AS j, round(sum(a.w * b.w), 7) AS sim FROM wt a JOIN wt b ON a.job_id = b.job_id AND a.term = b.term AND a.pos < b.pos GROUP BY ALL")
def tfidf_cosine_pairs(spark, sf_dir):
    return jobwise.cosine_pairs(candidates(spark, sf_dir), 7)


MENTION = rf"""{JOBS},
mt AS (SELECT job_id, pos, array_to_string(regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}_]{{2,}}'), ' ') AS t, array_to_string(regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}_]{{2,}}'), '') AS tj,
              ' ' || array_to_string(regexp_extract_all(lower(title || chr(10) || text), '[\p{{L}}\p{{N}}_]{{2,}}'), ' ') || ' ' AS b FROM docs),
mg AS (SELECT DISTINCT a.job_id, least(a.pos, b.pos) AS i, greatest(a.pos, b.pos) AS j FROM mt a JOIN mt b ON a.job_id = b.job_id AND a.pos <> b.pos AND length(a.tj) >= 4 AND contains(b.b, ' ' || a.t || ' '))"""


@query(f"WITH {MENTION} SELECT * FROM mg")
def title_mention_graph(spark, sf_dir):
    return jobwise.mention_graph(candidates(spark, sf_dir))


@query(f"WITH {TERMS} SELECT job_id, pos, count(*) AS n_covered FROM tf JOIN qt USING (job_id, term) GROUP BY ALL")
def query_coverage(spark, sf_dir):
    jobs, docs = both(spark, sf_dir)
    return lexical.coverage(docs, jobs).groupBy("job_id", "pos").agg(F.count("*").alias("n_covered"))


@query(f"WITH {EXPANSION} SELECT job_id, pos, term, rank FROM et")
def expansion_terms(spark, sf_dir):
    return lexical.expansion_terms(candidates(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@query(
    f"""WITH {EXPANSION},
hit AS (SELECT e.job_id, e.pos AS source, tf.pos, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * len / al))) AS s
        FROM et e JOIN tf ON tf.job_id = e.job_id AND tf.term = e.term JOIN df ON df.job_id = e.job_id AND df.term = e.term JOIN sz ON sz.job_id = tf.job_id AND sz.pos = tf.pos GROUP BY ALL),
al AS (SELECT x.job_id, x.source, d.pos, coalesce(s, 0) AS s FROM (SELECT DISTINCT job_id, pos AS source FROM et) x JOIN docs d ON d.job_id = x.job_id LEFT JOIN hit h ON h.job_id = x.job_id AND h.source = x.source AND h.pos = d.pos)
SELECT job_id, source, pos, round(CASE WHEN max(s) OVER w > min(s) OVER w THEN (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) ELSE 0 END, 7) AS score FROM al WINDOW w AS (PARTITION BY job_id, source)"""
)
def expansion_bm25(spark, sf_dir):
    return jobwise.expansion(candidates(spark, sf_dir), 7)


@query(f"WITH {BM25} SELECT job_id, pos, rank FROM (SELECT job_id, pos, row_number() OVER (PARTITION BY job_id ORDER BY round(score, 9) DESC, pos) AS rank FROM bm) WHERE rank <= 6")
def retrieve_top6(spark, sf_dir):
    jobs, docs = both(spark, sf_dir)
    return lexical.top_k(lexical.bm25(docs, lexical.query_terms(jobs)), 6).select("job_id", "pos", F.col("rank").cast("long").alias("rank"))


OVERLAP = f"""{TERMS},
ct AS (SELECT job_id, pos, term FROM tf WHERE length(term) > 2 AND term NOT IN (SELECT term FROM stops)),
cd AS (SELECT job_id, term, count(*) AS df FROM ct GROUP BY ALL),
qi AS (SELECT qt.job_id, qt.term, ln((m.n + 1.0) / (coalesce(df, 0) + 1)) + 1 AS idf FROM qt JOIN (SELECT job_id, count(*) AS n FROM docs GROUP BY job_id) m USING (job_id) LEFT JOIN cd ON cd.job_id = qt.job_id AND cd.term = qt.term WHERE length(qt.term) > 2),
qm AS (SELECT job_id, sum(idf) AS mass, count(*) AS nq FROM qi GROUP BY job_id),
gt AS (SELECT ct.job_id, pos, sum(idf) AS got FROM ct JOIN qi USING (job_id, term) GROUP BY ALL),
ns AS (SELECT job_id, pos, count(*) AS nt FROM ct GROUP BY ALL),
ov AS (SELECT d.job_id, d.pos, coalesce(got / mass / sqrt(greatest(1.0, coalesce(nt, 0) / greatest(coalesce(nq, 0), 1.0))), 0) AS score
       FROM docs d LEFT JOIN gt ON gt.job_id = d.job_id AND gt.pos = d.pos LEFT JOIN ns ON ns.job_id = d.job_id AND ns.pos = d.pos LEFT JOIN qm ON qm.job_id = d.job_id)"""


@query(f"WITH {OVERLAP} SELECT job_id, pos, round(score, 7) AS score FROM ov")
def lexical_query_scores(spark, sf_dir):
    jobs, docs = both(spark, sf_dir)
    return lexical.query_overlap(jobs, docs).select("job_id", "pos", F.round("score", 7).alias("score"))


@query(
    f"""WITH {OVERLAP},
bm AS (SELECT d.job_id, d.pos, coalesce(sum(ln(1 + (n - df.df + 0.5) / (df.df + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * len / al))), 0) AS score
       FROM docs d LEFT JOIN (qt JOIN tf USING (job_id, term) JOIN df USING (job_id, term) JOIN sz USING (job_id, pos)) ON tf.job_id = d.job_id AND tf.pos = d.pos GROUP BY d.job_id, d.pos),
sc AS (SELECT ov.job_id, ov.pos, ov.score AS a, bm.score AS b FROM ov JOIN bm ON ov.job_id = bm.job_id AND ov.pos = bm.pos)
SELECT job_id, pos, round(0.5 * CASE WHEN max(a) OVER w > min(a) OVER w THEN (a - min(a) OVER w) / (max(a) OVER w - min(a) OVER w) ELSE 0 END
  + 0.5 * CASE WHEN max(b) OVER w > min(b) OVER w THEN (b - min(b) OVER w) / (max(b) OVER w - min(b) OVER w) ELSE 0 END, 7) AS score FROM sc WINDOW w AS (PARTITION BY job_id)"""
)
def hybrid_scores(spark, sf_dir):
    jobs, docs = both(spark, sf_dir)
    mixed = lexical.hybrid(lexical.query_overlap(jobs, docs), lexical.bm25(docs, lexical.query_terms(jobs)))
    return mixed.select("job_id", "pos", F.round("score", 7).alias("score"))


@query(
    """WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 50 = 0), e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT query_id, vec_id, round(list_dot_product(q.v, e.v), 6) AS score FROM q JOIN e ON vec_id <> query_id)
SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""
)
def embedding_topk(spark, sf_dir):
    """The stated query set (ids divisible by 50) against all vectors, ten best each."""
    return graph.vector_top_k(table(spark, sf_dir, "embeddings"), 10)


@query(
    """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT a.vec_id AS i, b.vec_id AS j, round(list_dot_product(a.v, b.v), 6) AS score FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id),
t AS (SELECT i, j, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, j) AS r FROM s) WHERE r = 1)
SELECT least(i, j) AS i, greatest(i, j) AS j, max(score) AS score FROM t GROUP BY ALL"""
)
def embedding_neighbors(spark, sf_dir):
    """Each vector's nearest within its label, as undirected pairs with the larger score."""
    return graph.nearest_in_group(table(spark, sf_dir, "embeddings"))


@query(
    f"""WITH {JOBS}, v AS (SELECT job_id, 'repeated_body' AS problem, count(*) AS n FROM (SELECT job_id, sha256, count(*) AS c FROM docs GROUP BY ALL HAVING c > 1) GROUP BY ALL
  UNION ALL SELECT job_id, 'no_support', 1 FROM jobs WHERE job_id NOT IN (SELECT job_id FROM support)
  UNION ALL SELECT job_id, 'blank_title', count(*) FROM docs WHERE title = '' GROUP BY ALL)
SELECT job_id, problem, CAST(n AS BIGINT) AS n FROM v"""
)
def job_validation_violations(spark, sf_dir):
    from evispan.plans.jobs import support

    jobs, docs = both(spark, sf_dir)
    return validate.job_problems(jobs, docs, support(spark, sf_dir))
