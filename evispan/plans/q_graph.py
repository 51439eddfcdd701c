"""Queries over segments, intervals, tile graphs and inventories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evispan.functions import intervals as iv
from evispan.operators import graph, rank, segment
from evispan.plans.jobs import table
from evispan.functions.text import SHORT_STOPS

STOPS = ", ".join(f"('{w}')" for w in SHORT_STOPS)

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _spans(df, column="spans"):
    return df.select("doc_id", F.posexplode(column).alias("seg", "s")).select("doc_id", "seg", F.col("s.start").alias("start"), F.col("s.stop").alias("stop"))


@query("SELECT doc_id, CAST(i AS INTEGER) AS seg, CAST(i * 64 AS INTEGER) AS start, CAST(least((i + 1) * 64, length(text)) AS INTEGER) AS stop FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 63) // 64)) AS i FROM documents)")
def fixed_chunks(spark, sf_dir):
    return _spans(docs(spark, sf_dir).withColumn("spans", segment.fixed_chunks(F.col("text"), 64)))


@query(
    """WITH a AS (SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 0),
s AS (SELECT doc_id, n, unnest(CASE WHEN n <= 80 THEN [0] ELSE list_sort(list_distinct(list_append(list_filter(range(0, n, 40), lambda x: x + 80 <= n), n - 80))) END) AS st FROM a)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY st) - 1 AS INTEGER) AS seg, CAST(st AS INTEGER) AS start, CAST(least(st + 80, n) AS INTEGER) AS stop FROM s"""
)
def overlap_windows(spark, sf_dir):
    return _spans(docs(spark, sf_dir).withColumn("spans", segment.overlapping_windows(F.col("text"), 80, 40)))


PIECES = """WITH p AS (SELECT doc_id, generate_subscripts(x, 1) AS k, unnest(x) AS t FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '{cut}', '\\0' || chr(1), 'g'), chr(1)), lambda v: v <> '') AS x FROM documents)),
q AS (SELECT doc_id, k, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY k) AS e, length(t) AS n FROM p)
SELECT doc_id, CAST(k - 1 AS INTEGER) AS seg, CAST(e - n AS INTEGER) AS start, CAST(e AS INTEGER) AS stop FROM q"""


@query(PIECES.replace("{cut}", r"""[.!?]["'')\]]*\s+|\n\s*\n+"""))
def sentence_chunks(spark, sf_dir):
    return _spans(docs(spark, sf_dir).withColumn("spans", segment.sentence_chunks(F.col("text"))))


@query(PIECES.replace("{cut}", r"\n\s*\n+"))
def paragraph_chunks(spark, sf_dir):
    return _spans(docs(spark, sf_dir).withColumn("spans", segment.paragraph_chunks(F.col("text"))))


def _policy(name: str):
    def run(spark, sf_dir):
        return segment.segments(docs(spark, sf_dir), name)

    return run


QUERIES |= {name: _policy(policy) for name, policy in (("lexical_tiling", "lexical_tiling"), ("lexical_change_point", "lexical_change_point"), ("tfidf_change_point", "tfidf_change_point"), ("cdc_gear", "cdc_gear"), ("boundary_dp", "boundary_dp"), ("boundary_dp_tuned", "boundary_dp_tuned"))}

CUTS = PIECES.replace("{cut}", r"""[.!?]["'')\]]*\s+|\n\s*\n+""").replace("WITH p AS", "p AS").replace("SELECT doc_id, CAST(k - 1 AS INTEGER) AS seg, CAST(e - n AS INTEGER) AS start, CAST(e AS INTEGER) AS stop FROM q", "")
#: Cosine of the bags of {reach} characters on either side of every sentence cut.
COHESION = (
    f"WITH {CUTS.rstrip()}"
    + r""", k AS (SELECT q.doc_id, q.k, CAST(e AS BIGINT) AS c, length(text) AS len, text FROM q JOIN documents USING (doc_id) WHERE e < length(text)),
lw AS (SELECT doc_id, k, w, count(*) AS c FROM (SELECT doc_id, k, unnest(regexp_extract_all(lower(substr(text, greatest(0, c - {reach}) + 1, least(c, {reach}))), '[A-Za-z0-9_]+')) AS w FROM k) GROUP BY ALL),
rw AS (SELECT doc_id, k, w, count(*) AS c FROM (SELECT doc_id, k, unnest(regexp_extract_all(lower(substr(text, c + 1, {reach})), '[A-Za-z0-9_]+')) AS w FROM k) GROUP BY ALL),
ln AS (SELECT doc_id, k, sum(c * c) AS n FROM lw GROUP BY ALL), rn AS (SELECT doc_id, k, sum(c * c) AS n FROM rw GROUP BY ALL),
dt AS (SELECT doc_id, k, sum(lw.c * rw.c) AS d FROM lw JOIN rw USING (doc_id, k, w) GROUP BY ALL),
si AS (SELECT k.doc_id, k.k, k.c, coalesce(CAST(d AS DOUBLE) / sqrt(CAST(ln.n * rn.n AS DOUBLE)), 0.0) AS s FROM k LEFT JOIN dt USING (doc_id, k) LEFT JOIN ln USING (doc_id, k) LEFT JOIN rn USING (doc_id, k)),
ct AS ({keep}),
bd AS (SELECT doc_id, 0 AS a FROM documents WHERE length(text) > 0 UNION ALL SELECT doc_id, c FROM ct)
SELECT doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS seg, CAST(a AS INTEGER) AS start, CAST(coalesce(lead(a) OVER w, length(text)) AS INTEGER) AS stop FROM bd JOIN documents USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY a)"""
)
ORACLES["lexical_change_point"] = COHESION.replace("{reach}", "72").replace("{keep}", "SELECT doc_id, c FROM si WHERE s <= 0.48")
ORACLES["lexical_tiling"] = COHESION.replace("{reach}", "100").replace("{keep}", "SELECT doc_id, c FROM (SELECT *, coalesce(lag(s) OVER o, 1.0) AS before, coalesce(lead(s) OVER o, 1.0) AS later FROM si WINDOW o AS (PARTITION BY doc_id ORDER BY c)) WHERE s <= 0.22 OR (s < 0.45 AND s < before AND s < later)")
ORACLES["tfidf_change_point"] = f"WITH {CUTS.rstrip()}" + r""", us AS (SELECT doc_id, k, t, CAST(e AS BIGINT) AS c, count(*) OVER (PARTITION BY doc_id) AS m FROM q JOIN p USING (doc_id, k)),
tw AS (SELECT doc_id, k, m, w, count(*) AS c FROM (SELECT doc_id, k, m, unnest(regexp_extract_all(lower(t), '[A-Za-z0-9_]+')) AS w FROM us) GROUP BY ALL),
tv AS (SELECT doc_id, k, w, c * (ln((1 + m) / (1 + count(*) OVER (PARTITION BY doc_id, w))) + 1) AS v FROM tw),
nm AS (SELECT doc_id, k, sum(v * v) AS n FROM tv GROUP BY ALL),
dt AS (SELECT a.doc_id, a.k, sum(a.v * b.v) AS d FROM tv a JOIN tv b ON a.doc_id = b.doc_id AND b.k = a.k + 1 AND a.w = b.w GROUP BY ALL),
si AS (SELECT us.doc_id, us.k, us.c, round(coalesce(d / sqrt(x.n * y.n), 0.0), 12) AS s FROM us LEFT JOIN dt USING (doc_id, k) LEFT JOIN nm x ON x.doc_id = us.doc_id AND x.k = us.k LEFT JOIN nm y ON y.doc_id = us.doc_id AND y.k = us.k + 1 WHERE us.k < m),
ct AS (SELECT doc_id, c FROM (SELECT *, coalesce(lag(s) OVER o, 1.0) AS before, coalesce(lead(s) OVER o, 1.0) AS later FROM si WINDOW o AS (PARTITION BY doc_id ORDER BY c)) WHERE s <= 0.32 OR (s < 0.5 AND s < before AND s < later)),
bd AS (SELECT doc_id, 0 AS a FROM documents WHERE length(text) > 0 UNION ALL SELECT doc_id, c FROM ct)
SELECT doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS seg, CAST(a AS INTEGER) AS start, CAST(coalesce(lead(a) OVER w, length(text)) AS INTEGER) AS stop FROM bd JOIN documents USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY a)"""
#: The rolling sum's low six bits hang on the last six bytes.
ORACLES["cdc_gear"] = """WITH RECURSIVE g AS (SELECT i, CAST('0x' || substr(sha256('gear-' || i), 1, 2) AS INTEGER) & 63 AS v FROM range(256) t(i)),
hx AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE length(text) > 0),
bs AS (SELECT doc_id, pos, CAST('0x' || substr(h, CAST(2 * pos - 1 AS INTEGER), 2) AS INTEGER) AS b FROM hx, LATERAL (SELECT unnest(range(1, length(h) // 2 + 1)) AS pos)),
ws AS (SELECT doc_id, pos, sum(CASE WHEN b & 192 <> 128 THEN 1 ELSE 0 END) OVER o AS ch, coalesce(lead(b) OVER o, 0) & 192 <> 128 AS whole,
  (v + 2 * coalesce(lag(v) OVER o, 0) + 4 * coalesce(lag(v, 2) OVER o, 0) + 8 * coalesce(lag(v, 3) OVER o, 0) + 16 * coalesce(lag(v, 4) OVER o, 0) + 32 * coalesce(lag(v, 5) OVER o, 0)) % 64 AS h
  FROM bs JOIN g ON g.i = bs.b WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
cs AS (SELECT doc_id, coalesce(list(ch ORDER BY ch) FILTER (WHERE h = 0 AND whole), []) AS cuts, CAST(max(ch) AS BIGINT) AS n FROM ws GROUP BY doc_id),
go(doc_id, seg, a, z) AS (
  SELECT doc_id, 0, CAST(0 AS BIGINT), CAST(least(coalesce(list_min(list_filter(cuts, lambda c: c >= 32)), n), 128, n) AS BIGINT) FROM cs
  UNION ALL
  SELECT go.doc_id, seg + 1, z, CAST(least(coalesce(list_min(list_filter(cuts, lambda c: c >= z + 32)), n), z + 128, n) AS BIGINT) FROM go JOIN cs USING (doc_id) WHERE z < n)
SELECT doc_id, CAST(seg AS INTEGER) AS seg, CAST(a AS INTEGER) AS start, CAST(z AS INTEGER) AS stop FROM go"""

#: Spans authored from numbers: three a document, some touching, some overlapping.
AUTHORED = """sp AS (SELECT doc_id, length(text) AS n, CAST(least(length(text), length(text) * a // 10) AS INTEGER) AS s, CAST(least(length(text), length(text) * b // 10) AS INTEGER) AS e
  FROM documents, (VALUES (1, 3), (2, 5), (5, 6), (8, 9)) v(a, b))"""
GOLD = "gd AS (SELECT doc_id, CAST(length(text) * 2 // 10 AS INTEGER) AS s, CAST(length(text) * 4 // 10 AS INTEGER) AS e FROM documents UNION ALL SELECT doc_id, CAST(length(text) * 8 // 10 AS INTEGER), CAST(length(text) AS INTEGER) FROM documents)"


def _authored(d):
    cut = lambda a, b: iv.span(F.floor(F.length("text") * a / 10), F.floor(F.length("text") * b / 10))
    return d.select("doc_id", "text", F.array(*[cut(a, b) for a, b in ((1, 3), (2, 5), (5, 6), (8, 9))]).alias("pred"), F.array(cut(2, 4), cut(8, 10)).alias("gold"))


ISLANDS = """i1 AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM {src}),
i2 AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM i1),
mg AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM i2 GROUP BY doc_id, g)"""


@query(f"WITH {AUTHORED}, {ISLANDS.format(src='sp')} SELECT doc_id, CAST(sum(e - s) AS INTEGER) AS covered, CAST(count(*) AS INTEGER) AS islands FROM mg GROUP BY doc_id")
def interval_union_length(spark, sf_dir):
    return _authored(docs(spark, sf_dir)).select("doc_id", iv.union_length(F.col("pred")).alias("covered"), F.size(iv.merged(F.col("pred"))).alias("islands"))


@query(
    f"""WITH {AUTHORED}, {GOLD}, {ISLANDS.format(src='sp')},
x AS (SELECT gd.doc_id, sum(greatest(0, least(gd.e, mg.e) - greatest(gd.s, mg.s))) AS o FROM gd JOIN mg USING (doc_id) GROUP BY ALL),
y AS (SELECT gd.doc_id, sum(greatest(0, least(gd.e, sp.e) - greatest(gd.s, sp.s))) AS o2 FROM gd JOIN sp USING (doc_id) GROUP BY ALL),
z AS (SELECT x.doc_id, o, o2, (SELECT sum(e - s) FROM gd WHERE gd.doc_id = x.doc_id) AS g, (SELECT sum(e - s) FROM mg WHERE mg.doc_id = x.doc_id) AS p FROM x JOIN y USING (doc_id))
SELECT doc_id, CAST(o2 AS INTEGER) AS overlap_sum, round(CASE WHEN g > 0 THEN o / g ELSE 0 END, 9) AS recall, round(CASE WHEN p > 0 THEN o / p ELSE 0 END, 9) AS precision, round(CASE WHEN o > 0 THEN 2 * (o / g) * (o / p) / (o / g + o / p) ELSE 0 END, 9) AS f1 FROM z"""
)
def interval_overlap_f1(spark, sf_dir):
    a = _authored(docs(spark, sf_dir)).withColumn("m", iv.match_scores(F.col("gold"), F.col("pred")))
    return a.select("doc_id", iv.overlap_sum(F.col("gold"), F.col("pred")).alias("overlap_sum"), *[F.round(f"m.{c}", 9).alias(c) for c in ("recall", "precision", "f1")])


@query(
    """WITH g AS (SELECT doc_id, text, length(text) AS n, least(length(text) // 3, length(text)) AS s, least(length(text) // 3 + 100, length(text)) AS e FROM documents),
w AS (SELECT g.*, unnest(range(0, (n + 63) // 64)) AS i FROM g)
SELECT doc_id, count(*) AS touched, round(sum(least((i + 1) * 64, n) - i * 64) / greatest(1, max(e - s)), 9) AS amplification FROM w WHERE i * 64 < e AND s < least((i + 1) * 64, n) GROUP BY doc_id"""
)
def segment_touch_amplification(spark, sf_dir):
    d = docs(spark, sf_dir)
    n = F.length("text")
    edits = d.select("doc_id", F.floor(n / 3).cast("int").alias("start"), F.least(F.floor(n / 3) + 100, n).cast("int").alias("stop"))
    segs = _spans(d.withColumn("spans", segment.fixed_chunks(F.col("text"), 64)))
    return rank.touch_metrics(segs, edits).select("doc_id", "touched", F.round("amplification", 9).alias("amplification"))


@query(
    """WITH t AS (SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS fresh FROM conversations),
g AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM t)
SELECT conv_id, CAST(island AS BIGINT) AS island, min(role) AS role, min(turn) AS first_turn, max(turn) AS last_turn FROM g GROUP BY conv_id, island"""
)
def paragraph_islands(spark, sf_dir):
    return segment.islands(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role").select("conv_id", "island", "role", F.col("first").alias("first_turn"), F.col("last").alias("last_turn"))


@query("SELECT conv_id, turn, CAST(e - n AS BIGINT) AS start, CAST(e AS BIGINT) AS stop FROM (SELECT conv_id, turn, length(role || ': ' || text || chr(10)) AS n, sum(length(role || ': ' || text || chr(10))) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM conversations)")
def turn_offsets(spark, sf_dir):
    return segment.turn_offsets(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "start", "stop")


@query(
    f"""WITH stops(term) AS (VALUES {STOPS}),
w AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_]+')) AS term FROM conversations),
c AS (SELECT conv_id, turn, term, count(*) AS c FROM w WHERE length(term) > 2 AND term NOT IN (SELECT term FROM stops) GROUP BY ALL),
k AS (SELECT a.conv_id, a.turn FROM conversations a WHERE EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn < a.turn)),
l AS (SELECT k.conv_id, k.turn, term, sum(c) AS c FROM k JOIN c ON c.conv_id = k.conv_id AND c.turn BETWEEN k.turn - 3 AND k.turn - 1 GROUP BY ALL),
r AS (SELECT k.conv_id, k.turn, term, sum(c) AS c FROM k JOIN c ON c.conv_id = k.conv_id AND c.turn BETWEEN k.turn AND k.turn + 2 GROUP BY ALL),
d AS (SELECT l.conv_id, l.turn, sum(l.c * r.c) AS d FROM l JOIN r USING (conv_id, turn, term) GROUP BY ALL)
SELECT k.conv_id, k.turn, round(coalesce(d / sqrt((SELECT sum(c * c) FROM l WHERE l.conv_id = k.conv_id AND l.turn = k.turn) * (SELECT sum(c * c) FROM r WHERE r.conv_id = k.conv_id AND r.turn = k.turn)), 0), 9) AS cohesion
FROM k LEFT JOIN d ON d.conv_id = k.conv_id AND d.turn = k.turn"""
)
def boundary_cohesion(spark, sf_dir):
    """Cosine of the three turns before each boundary and the three after it."""
    return segment.boundary_cohesion(table(spark, sf_dir, "conversations"), 3).select("conv_id", "turn", F.round("cohesion", 9).alias("cohesion"))


ATOMS = r"""ls AS (SELECT doc_id, generate_subscripts(x, 1) AS k, unnest(x) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
lo AS (SELECT doc_id, k, t, sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY k) - 1 AS e FROM ls),
atoms AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS atom, e - length(t) AS s, e, t FROM lo WHERE trim(t) <> '')"""
EDGES = rf"""{ATOMS}, stops(term) AS (VALUES {STOPS}),
tw AS (SELECT doc_id, atom, term, count(*) AS tf FROM (SELECT doc_id, atom, unnest(regexp_extract_all(lower(t), '[A-Za-z0-9_]+')) AS term FROM atoms) WHERE length(term) > 2 AND term NOT IN (SELECT term FROM stops) GROUP BY ALL),
tx AS (SELECT doc_id, atom, term, tf * (ln((1.0 + n) / (1 + df)) + 1) AS w FROM tw JOIN (SELECT doc_id, term, count(*) AS df FROM tw GROUP BY ALL) USING (doc_id, term) JOIN (SELECT doc_id, count(*) AS n FROM atoms GROUP BY ALL) USING (doc_id)),
ty AS (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY doc_id, atom)) AS nn FROM tx),
ed AS (SELECT a.doc_id, a.atom AS i, b.atom AS j, round(sum(a.w * b.w / (a.nn * b.nn)), 9) AS score FROM ty a JOIN ty b ON a.doc_id = b.doc_id AND a.term = b.term AND b.atom >= a.atom + 2 GROUP BY ALL)"""


@query(f"WITH {EDGES} SELECT doc_id, i, j, round(score, 7) AS score FROM ed")
def lexical_graph_edges(spark, sf_dir):
    return graph.lexical_edges(graph.line_atoms(docs(spark, sf_dir))).select("doc_id", "i", "j", F.round("score", 7).alias("score"))


EGO = """tk{v} AS (SELECT doc_id, a, b, score, row_number() OVER (PARTITION BY doc_id, a ORDER BY score DESC, b) AS r FROM (SELECT doc_id, i AS a, j AS b, score FROM {src} WHERE score >= {t} UNION ALL SELECT doc_id, j, i, score FROM {src} WHERE score >= {t})),
eg{v} AS (SELECT doc_id, members, max(score) AS score FROM (SELECT doc_id, a, array_to_string(list_sort(list_append(list(b), a)), ',') AS members, max(score) AS score FROM tk{v} WHERE r <= {k} GROUP BY doc_id, a) GROUP BY ALL)"""


@query(f"WITH {EDGES}, {EGO.format(v='', src='ed', t=0.16, k=2)} SELECT doc_id, members, round(score, 7) AS score FROM eg")
def ego_tiles(spark, sf_dir):
    return graph.ego_tiles(graph.lexical_edges(graph.line_atoms(docs(spark, sf_dir))), 0.16, 2).select("doc_id", "members", F.round("score", 7).alias("score"))


BRIDGES = rf"""bw AS (SELECT doc_id, atom, ' ' || array_to_string(regexp_extract_all(lower(t), '\p{{L}}[\p{{L}}\p{{N}}]*'), ' ') || ' ' AS b, list_slice(regexp_extract_all(lower(t), '\p{{L}}[\p{{L}}\p{{N}}]*'), 1, 2) AS h FROM atoms),
br AS (SELECT DISTINCT x.doc_id, least(x.atom, y.atom) AS i, greatest(x.atom, y.atom) AS j, 0.34 AS score FROM (SELECT doc_id, atom, array_to_string(h, ' ') AS p FROM bw WHERE len(h) > 0) x JOIN bw y ON x.doc_id = y.doc_id AND abs(x.atom - y.atom) >= 2 AND length(p) >= 3 AND contains(y.b, ' ' || p || ' '))"""


@query(
    f"""WITH {EDGES}, {BRIDGES}, fu AS (SELECT doc_id, i, j, max(score) AS score FROM (SELECT * FROM ed UNION ALL SELECT * FROM br) GROUP BY ALL),
{EGO.format(v='1', src='ed', t=0.16, k=1)}, {EGO.format(v='2', src='br', t=0.16, k=1)}, {EGO.format(v='3', src='fu', t=0.16, k=1)}
SELECT doc_id, members, round(max(score), 7) AS score, string_agg(v, ',' ORDER BY v) AS views FROM (SELECT *, 'lexical' AS v FROM eg1 UNION ALL SELECT *, 'title' FROM eg2 UNION ALL SELECT *, 'fused' FROM eg3) GROUP BY doc_id, members"""
)
def multiview_inventory(spark, sf_dir):
    return graph.document_inventory(docs(spark, sf_dir), 0.16, 1).select("doc_id", "members", F.round("score", 7).alias("score"), "views")


@query(f"WITH {ATOMS}, pr AS (SELECT a.doc_id, a.atom AS i, b.atom AS j, row_number() OVER (PARTITION BY a.doc_id ORDER BY b.atom - a.atom, a.atom) AS r FROM atoms a JOIN atoms b ON a.doc_id = b.doc_id AND a.atom < b.atom) SELECT doc_id, i, j FROM pr WHERE r <= (SELECT count(*) FROM atoms x WHERE x.doc_id = pr.doc_id)")
def locality_pairs(spark, sf_dir):
    return graph.locality_pairs(graph.line_atoms(docs(spark, sf_dir))).select("doc_id", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"))


@query()
def overlay_budget(spark, sf_dir):
    return graph.document_budget(docs(spark, sf_dir), 0.16, 1, 1.0, "locality")


@query()
def capped_union_tiles(spark, sf_dir):
    atoms = graph.line_atoms(docs(spark, sf_dir))
    return graph.capped_tiles(atoms, graph.lexical_edges(atoms))


@query("SELECT lang, count(*) AS documents, count(DISTINCT sha256(text)) AS different, round(avg(n), 9) AS mean_atoms, CAST(sum(u) AS BIGINT) AS atoms_once FROM (SELECT lang, text, len(string_split(text, chr(10))) AS n, CASE WHEN row_number() OVER (PARTITION BY lang, sha256(text) ORDER BY doc_id) = 1 THEN len(string_split(text, chr(10))) ELSE 0 END AS u FROM documents) GROUP BY lang")
def inventory_cost(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("h"), F.size(F.split("text", "\n", -1)).alias("n"))
    return rank.inventory_cost(d, "lang", "h", "n")


@query(
    """WITH o AS (SELECT doc_id, md5(unnest(string_split(text, chr(10)))) AS sig FROM documents), w AS (SELECT doc_id, md5(unnest(string_split(CASE WHEN doc_id % 11 = 0 THEN text || ' changed' ELSE text END, chr(10)))) AS sig FROM documents),
a AS (SELECT doc_id, sig, count(*) AS c FROM o GROUP BY ALL), b AS (SELECT doc_id, sig, count(*) AS c FROM w GROUP BY ALL)
SELECT a.doc_id, round(sum(least(a.c, coalesce(b.c, 0))) / sum(a.c), 9) AS reuse FROM a LEFT JOIN b ON a.doc_id = b.doc_id AND a.sig = b.sig GROUP BY a.doc_id"""
)
def reuse_rate(spark, sf_dir):
    d = docs(spark, sf_dir)
    old = d.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("piece"))
    changed = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    new = d.select("doc_id", F.explode(F.split(changed, "\n", -1)).alias("piece"))
    return rank.reuse_rate(old, new, "doc_id", "piece").select("doc_id", F.round("reuse", 9).alias("reuse"))
