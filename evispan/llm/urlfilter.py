"""URL filters: rules, and a path-template tree per host for what no rule decides.

A host's distinct paths are walked a segment at a time. Under each node of the tree a segment
becomes a wildcard where it looks like a value or is a rare one of very many. Labelled branches
whose rate doesn't differ from that of their siblings, each held against the others without it,
are merged into one; a labelled branch that differs stays literal even if rare, and an unlabelled
one is never merged with labelled ones. A template is rejected where its own labelled purity,
smoothed towards the corpus's rate, is high enough, so one without labels never is. Labels are the
rules' own verdicts on the urls they decide. Every step is a grouped count and a join on keys of
distinct paths, so a hot host or a hot url is summed before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispan.llm.common import read_table, settle, union_all

#: The contract's rules: (rule, verdict).
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
MOST_CHILDREN = 24  # a node with more children keeps as literals those with LEAST_SHARE of its urls, and those whose labels differ
LEAST_SHARE = 0.05
LEAST_SCORE = 3.0  # standard errors from the other siblings' rate from which a branch stays apart
MERGED = "+"  # stands for the labelled branches of a node that are alike
SMOOTHING, MOST_PRIOR = 4.0, 0.5  # the prior stays under REJECT, so that labels alone reject
REJECT = 0.8
SALTS = 16
VALUE = r"^(?:[0-9]+(?:\.[a-z0-9]{1,5})?|[0-9a-fA-F-]{16,}|[0-9]{4}-[0-9]{2}-[0-9]{2})$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty for null and where there is no ://."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict), the longest that fits, null for none; the rules are a short fixed list."""
    if len(rules) > 200:
        raise ValueError("rules by expression are for short lists")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        where, cut = text.partition("/")[0], text.partition("/")[1] + text.partition("/")[2]
        fits = ((host == where) | host.endswith("." + where)) & path.startswith(cut)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _differs(bad: Column, known: Column, all_bad: Column, all_known: Column) -> Column:
    """Whether a branch's labelled rate differs from that of its siblings without it; null where either side has no label."""
    others, rest = all_bad - bad, all_known - known
    p, q = (bad + 1) / (known + 2), (others + 1) / (rest + 2)
    z = F.abs(p - q) / F.sqrt(p * (1 - p) / (known + 2) + q * (1 - q) / (rest + 2))
    return F.when((known > 0) & (rest > 0), z >= LEAST_SCORE)


def templates(urls: DataFrame) -> DataFrame:
    """(host, path, template, n, known, block_rate, rejected) for the different (host, path) of urls (host, path, label: 1 block, 0 allow or null).

    A path leaves the walk where it is the only one under its node: what is left of it is generalised
    by itself. So there are as many rounds as any two paths share segments, and one more. An empty
    path is its own template; null hosts and paths count as empty; repeated rows add up.
    """
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in ("host", "path")]
    flat = urls.select(*blank, "label").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.coalesce("label", F.lit(0))).cast("double").alias("bad"), F.count("label").cast("double").alias("known"))
    parts = F.filter(F.split("path", "/", -1), lambda s: s != "")
    walk = settle(flat.withColumn("_s", parts).withColumn("template", F.lit("")))
    done, k = [], 0
    while True:
        ended = F.size("_s") <= k
        here = walk.where(~ended).withColumn("_seg", F.col("_s")[k])
        child = here.groupBy("host", "template", "_seg").agg(F.count("*").alias("_paths"), *[F.sum(c).alias(c) for c in ("n", "bad", "known")])
        dealt = child.withColumn("_salt", F.pmod(F.xxhash64("_seg"), F.lit(SALTS)).cast("int"))
        part = dealt.groupBy("host", "template", "_salt").agg(F.count("*").alias("_children"), *[F.sum(c).alias(f"_{c}") for c in ("n", "bad", "known")])
        node = part.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("_children", "_n", "_bad", "_known")])
        # a hot host's children are dealt over SALTS tasks, its one node row being copied to each
        spread = node.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = dealt.join(spread, ["host", "template", "_salt"])
        differs = _differs(F.col("bad"), F.col("known"), F.col("_bad"), F.col("_known"))
        rare = (F.col("_children") > MOST_CHILDREN) & (F.col("n") < LEAST_SHARE * F.col("_n"))
        alike = (F.col("_children") > 1) & F.coalesce(~differs, F.lit(False))
        name = F.when(F.col("_seg").rlike(VALUE), F.lit("*")).when(F.coalesce(differs, F.lit(False)), F.col("_seg")).when(rare, F.lit("*")).when(alike, F.lit(MERGED)).otherwise(F.col("_seg"))
        named = both.select("host", "template", "_seg", name.alias("_as"), (F.col("_paths") == 1).alias("_sole"))
        step = settle(here.join(named, ["host", "template", "_seg"]).withColumn("template", F.concat("template", F.lit("/"), "_as")))
        left = F.transform(F.slice("_s", k + 2, F.greatest(F.size("_s") - k - 1, F.lit(0))), lambda x: F.concat(F.lit("/"), F.when(x.rlike(VALUE), F.lit("*")).otherwise(x)))
        alone = F.col("_sole") & ~F.col("_as").isin("*", MERGED)  # below a wildcard other branches' paths may meet this one's
        keep = ["host", "path", "n", "bad", "known", "template"]
        done += [walk.where(ended).select(*keep), step.where(alone).withColumn("template", F.concat("template", F.array_join(left, ""))).select(*keep)]
        walk, k = step.where(~alone).select(*keep, "_s"), k + 1
        if walk.isEmpty():
            break
    flat = settle(union_all(done))
    leaf = flat.groupBy("host", "template").agg(*[F.sum(c).alias(f"_{c}") for c in ("n", "bad", "known")])
    every = leaf.agg(F.coalesce(F.sum("_bad"), F.lit(0.0)).alias("_b"), F.coalesce(F.sum("_known"), F.lit(0.0)).alias("_k")).first()
    prior = min((every["_b"] + 0.5) / (every["_k"] + 1), MOST_PRIOR)
    rate = (F.col("_bad") + SMOOTHING * prior) / (F.col("_known") + SMOOTHING)
    judged = leaf.select("host", "template", F.col("_n").alias("n"), F.col("_known").cast("long").alias("known"), rate.alias("block_rate"), (rate >= REJECT).alias("rejected"))
    return flat.select("host", "path", "template").join(judged, ["host", "template"])


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, *, url: str = "url") -> DataFrame:
    """pages' page_id with host, path, rule, verdict, template, block_rate, a row per row of pages.

    Urls without :// have an empty host and path, which form a template of their own; repeated rows
    each keep their row; other columns, whatever their names, play no part.
    """
    host, path = split_url(F.col(url))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("_said", said)
    label = F.when(F.col("_said") == "block", 1).when(F.col("_said") == "allow", 0)
    tree = templates(rows.select("host", "path", label.alias("label")))
    method = F.when(F.col("rejected"), "block").otherwise("allow")
    return rows.join(tree, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("_said", method).alias("verdict"), "template", "block_rate")


def op1_path_templates(spark, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict, with its template and that template's smoothed rate; as judge() otherwise."""
    return judge(read_table(spark, sf_dir, "pages"))
