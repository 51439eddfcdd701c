"""Queries over text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispan.functions import text as tx
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


TOK = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]{{2,}}')"
PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
NORMAL = "array_to_string(list_filter(regexp_split_to_array(translate(lower({0}), '" + PUNCT.replace("{", "{{").replace("}", "}}") + "', ''), '\\s+'), lambda w: w NOT IN ('a', 'an', 'the', '')), ' ')"


@query(f"SELECT doc_id, len({TOK.format('text')}) AS n_tokens FROM documents")
def tokens_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tx.word_tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query(f"SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TOK.format('text')}) AS term FROM documents) GROUP BY term")
def token_vocab_df(spark, sf_dir):
    terms = table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.word_tokens(F.col("text"))).alias("term"))
    per = terms.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))  # counts before the distinct, so one shuffle carries both
    return per.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


@query(f"SELECT item_id, {NORMAL.format('text')} AS normal FROM benchmark")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", tx.normal_answer(F.col("text")).alias("normal"))


@query(
    f"""WITH {JOBS},
a AS (SELECT d.doc_id, list_filter(string_split({NORMAL.format("split_part(d.text, chr(10), 1)")}, ' '), lambda w: w <> '') AS p,
             list_filter(string_split({NORMAL.format("j.question")}, ' '), lambda w: w <> '') AS g FROM docs d JOIN jobs j USING (job_id)),
pc AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(p) AS w FROM a) GROUP BY ALL),
gc AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(g) AS w FROM a) GROUP BY ALL),
o AS (SELECT doc_id, sum(least(pc.c, gc.c)) AS s FROM pc JOIN gc USING (doc_id, w) GROUP BY doc_id)
SELECT doc_id, p = g AS em, round(CASE WHEN len(p) = 0 OR len(g) = 0 THEN CAST(p = g AS DOUBLE) ELSE 2.0 * coalesce(s, 0) / (len(p) + len(g)) END, 9) AS f1 FROM a LEFT JOIN o USING (doc_id)"""
)
def answer_em_f1(spark, sf_dir):
    from evispan.operators.answers import score_pairs

    both = candidates(spark, sf_dir).join(questions(spark, sf_dir), "job_id")
    pairs = both.select("doc_id", F.split("text", "\n")[0].alias("answer"), F.col("question").alias("gold"))
    return score_pairs(pairs, ["doc_id"]).select("doc_id", "em", F.round("f1", 9).alias("f1"))


@query("""SELECT doc_id, sha256('{"id":"' || doc_id || '","sha256":"' || sha256(text) || '","text":' || CAST(to_json(text) AS VARCHAR) || ',"title":' || CAST(to_json(lang || ' ' || source) AS VARCHAR) || '}' || chr(10)) AS digest FROM documents""")
def record_frame_digest(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    frame = tx.record_frame(F.col("doc_id").cast("string"), F.concat_ws(" ", "lang", "source"), F.col("text"), F.sha2("text", 256))
    return d.select("doc_id", F.sha2(frame, 256).alias("digest"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS day FROM orders")
def date_key(spark, sf_dir):
    o, d = table(spark, sf_dir, "orders"), F.col("o_orderdate").cast("date")
    forms = ["d MMMM yyyy", "MMMM d, yyyy", "d MMM yyyy", "MMM d, yyyy"]
    said = F.when(F.col("o_orderkey") % 5 == 4, F.date_format(d, "yyyy"))
    for k, form in enumerate(forms):
        said = said.when(F.col("o_orderkey") % 5 == k, F.concat(F.lit(" "), F.date_format(d, form), F.lit("..")))
    return o.select("o_orderkey", tx.date_key(said).alias("day"))


SPOTS = "list_filter(range(0, length(text) - length(q) + 1), lambda i: substring(text, i + 1, length(q)) = q)"


@query(
    f"""WITH a AS (SELECT doc_id, text, substring(text, 21, 6) AS q, CASE WHEN doc_id % 2 = 0 THEN substring(text, 16, 5) ELSE '' END AS b FROM documents WHERE length(text) >= 26),
e AS (SELECT *, {SPOTS} AS spots FROM a),
f AS (SELECT *, list_filter(spots, lambda i: i >= length(b) AND substring(text, i + 1 - length(b), length(b)) = b) AS fits FROM e),
n AS (SELECT *, list_sort(list_transform(fits, lambda i: abs(i - 20))) AS near FROM f)
SELECT doc_id, CASE WHEN len(fits) = 1 OR near[1] < near[2] THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN len(fits) = 1 THEN fits[1] WHEN near[1] < near[2] THEN 20 END AS start,
       CASE WHEN len(fits) = 1 THEN CASE WHEN b <> '' OR len(spots) = 1 THEN 1.0 ELSE 0.9 END WHEN near[1] < near[2] THEN 0.75 END::DOUBLE AS confidence FROM n
UNION ALL SELECT doc_id, 'missing', NULL, NULL FROM documents WHERE length(text) < 26"""
)
def anchor_resolution(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    short = F.length("text") < 26
    quote = F.when(short, F.lit("\x01")).otherwise(F.substring("text", 21, 6))
    before = F.when(F.col("doc_id") % 2 == 0, F.substring("text", 16, 5)).otherwise("")
    rows = d.select("doc_id", "text", quote.alias("q"), before.alias("b"))
    found = rows.withColumn("r", tx.resolve_anchor(F.col("text"), F.col("q"), F.col("b"), F.lit(""), F.lit(20)))
    return found.select("doc_id", "r.status", F.col("r.start").cast("long").alias("start"), F.col("r.confidence").cast("double").alias("confidence"))


@query(f"WITH a AS (SELECT doc_id, text, substring(text, 1, 2) AS q FROM documents) SELECT doc_id, len({SPOTS}) AS n_overlapping, CAST((length(text) - length(replace(text, q, ''))) / length(q) AS BIGINT) AS n_apart FROM a WHERE q <> '' UNION ALL SELECT doc_id, 0, 0 FROM a WHERE q = ''")
def quote_uniqueness(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("q", F.substring("text", 1, 2))
    return d.select("doc_id", F.size(tx.occurrences(F.col("text"), F.col("q"))).cast("long").alias("n_overlapping"), tx.count_apart(F.col("text"), F.col("q")).cast("long").alias("n_apart"))


@query(
    """WITH a AS (SELECT doc_id, text, length(text) AS n, length(text) // 4 AS s, length(text) // 2 AS e, doc_id % 6 AS k FROM documents)
SELECT doc_id, md5(CASE k WHEN 0 THEN substring(text, 1, s) || 'NEW' || substring(text, s + 1, n) WHEN 1 THEN substring(text, 1, s) || substring(text, e + 1, n)
  WHEN 2 THEN substring(text, 1, s) || 'NEW' || substring(text, e + 1, n) WHEN 3 THEN substring(text, 1, s) || chr(10) || substring(text, s + 1, n)
  WHEN 4 THEN substring(text, 1, s) || '' || substring(text, e + 1, n) ELSE substring(text, 1, s) || substring(text, e + 1, n) || substring(text, s + 1, e - s) END) AS digest FROM a"""
)
def edit_apply(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("n", F.length("text")).withColumn("k", F.col("doc_id") % 6)
    d = d.withColumn("s", F.floor(F.col("n") / 4).cast("int")).withColumn("e", F.floor(F.col("n") / 2).cast("int"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("insert", "delete", "rewrite", "split", "merge", "move")]), (F.col("k") + 1).cast("int"))
    new = F.when(F.col("k").isin(0, 2), "NEW").when(F.col("k") == 3, "\n").otherwise("")
    return d.select("doc_id", F.md5(tx.apply_edit(F.col("text"), kind, F.col("s"), F.col("e"), new, F.col("n"))).alias("digest"))


@query(
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'commit' WHEN 1 THEN 'deny' END AS decision, CASE event_id % 6 WHEN 0 THEN event_id WHEN 1 THEN 0 END AS value FROM events"""
)
def strict_decision_parse(spark, sf_dir):
    e, i = table(spark, sf_dir, "events"), F.col("event_id").cast("string")
    forms = [
        F.concat(F.lit('{"decision":"commit","value":'), i, F.lit("}")),
        F.lit(' {"value": 0, "decision": "deny"}'),
        F.concat(F.lit('{"decision":"deny","value":'), (F.col("event_id") + 1).cast("string"), F.lit("}")),
        F.lit('{"decision":"commit","value":true}'),
        F.lit('{"decision":"commit","value":1,"value":1}'),
        F.col("props"),
    ]
    raw = F.element_at(F.array(*forms), (F.col("event_id") % 6 + 1).cast("int"))
    return e.select("event_id", tx.strict_decision(raw).alias("d")).select("event_id", "d.decision", "d.value")


@query(
    """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'p0001,p0002+p0003' ELSE '' END AS tiles,
  CASE event_id % 7 WHEN 2 THEN 'no_end' WHEN 3 THEN 'bad_line' WHEN 4 THEN 'repeated_tile' WHEN 5 THEN 'repeated_id' WHEN 6 THEN 'empty' END AS error FROM events"""
)
def minimal_id_parse(spark, sf_dir):
    forms = ["p0001\np0002+p0003\nEND", "NONE\nEND", "p0001", "p1\nEND", "p0004\np0004\nEND", "p0005+p0005\nEND", "END"]
    raw = F.element_at(F.array(*[F.lit(x) for x in forms]), (F.col("event_id") % 7 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", tx.minimal_ids(raw).alias("r"))
    return rows.select("event_id", F.array_join("r.tiles", ",").alias("tiles"), F.col("r.error").alias("error"))


@query(
    """SELECT conv_id, turn, md5(CASE turn % 4 WHEN 1 THEN role WHEN 0 THEN text WHEN 2 THEN 'So the answer is: x So the answer is: y' ELSE 'So the answer is: ' || role || chr(10) || 'more' END) AS answer_md5, turn % 4 = 1 AS ok FROM conversations"""
)
def terminal_answer_parse(spark, sf_dir):
    c, k = table(spark, sf_dir, "conversations"), F.col("turn") % 4
    mark = tx.ANSWER_MARK
    raw = F.when(k == 1, F.concat("text", F.lit("\n" + mark + " "), "role", F.lit(". "))).when(k == 0, F.col("text")).when(k == 2, f"{mark}x {mark}y").otherwise(F.concat(F.lit(mark), "role", F.lit("\nmore")))
    return c.select("conv_id", "turn", tx.terminal_answer(raw).alias("r")).select("conv_id", "turn", F.md5("r.answer").alias("answer_md5"), "r.ok")
