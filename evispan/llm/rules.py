"""Quality rules as learned decision lists.

Text statistics are column expressions. Sequential covering grows conjunctions of threshold
conditions by information gain on one part of the labelled rows and prunes them on the other; the
list becomes one ordered CASE expression that Spark evaluates over all documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispan.llm.common import lowest, read_table, seeded, settle, words_of

#: Rows of each class that are learned from, the lowest by a seeded hash.
MOST_ROWS = 4000
MOST_RULES, MOST_CONDITIONS, BINS = 12, 4, 24
LEAST_PRECISION, LEAST_COVER = 0.97, 5
SEED = "rules-1"
SYMBOLS = "#*$%&|<>"

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "distinct_share", "mark_share", "digit_share", "short_share"]


def statistics(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, BASE, FEATURES), a row per row of docs; null and empty texts have zeros throughout.

    Repeated windows are found by sorting (hash, place) pairs in the row, so a text costs
    n log n and no shuffle; the 64-bit hashes are compared within one text only.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), t.alias("_t")).withColumn("_w", words_of(F.col("_t")))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != "")
    rows = rows.withColumn("_lines", F.when(F.instr("_t", "\n") > 0, lines).otherwise(F.array().cast("array<string>")))
    n, chars = F.size("_w"), F.length("_t")
    less = lambda what: (chars - F.length(F.translate("_t", what, ""))).cast("long")
    windows = F.transform(F.slice("_w", 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2)))
    rows = rows.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        less(SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        less("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("_upper"),
        less("!?.,;:").alias("_marks"),
        less("0123456789").alias("_digits"),
        F.size(F.array_distinct("_w")).cast("long").alias("_distinct"),
        F.size(F.filter("_w", lambda w: F.length(w) <= 3)).cast("long").alias("_short"),
        windows.alias("_h"),
    )
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    rows = rows.withColumn("_s", F.when(twice, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    same = lambda s, j: F.coalesce(F.get("_s", j)["h"] == s["h"], F.lit(False))
    marked = F.filter(F.transform("_s", lambda s, j: F.when(same(s, j + 1) | F.when(j > 0, same(s, j - 1)).otherwise(False), s["i"])), lambda i: i.isNotNull())
    rows = rows.withColumn("_at", F.sort_array(marked)).drop("_h", "_s")
    spread = F.transform("_at", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("_at", j + 1) - p, F.lit(3))))
    rows = rows.withColumn("n_repeat_words", F.aggregate(spread, F.lit(0), lambda a, x: a + x).cast("long")).drop("_at")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return rows.select(
        "doc_id",
        *BASE,
        share("word_chars", "n_words").alias("word_length"),
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "n_words").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("_upper", "word_chars").alias("upper_share"),
        share("_distinct", "n_words").alias("distinct_share"),
        share("_marks", "word_chars").alias("mark_share"),
        share("_digits", "word_chars").alias("digit_share"),
        share("_short", "n_words").alias("short_share"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    at: float

    def column(self) -> Column:
        return F.col(self.feature) > self.at if self.above else F.col(self.feature) <= self.at

    def holds(self, row: dict) -> bool:
        return (row[self.feature] > self.at) == self.above


DecisionList = list[tuple[Condition, ...]]


def _grow(rows: list[tuple[dict, int]]) -> list[Condition]:
    """A conjunction that sets the rejected (1) apart from the rest, by the best gain at each step."""
    rule: list[Condition] = []
    while len(rule) < MOST_CONDITIONS:
        p = sum(y for _, y in rows)
        if p == len(rows) or not p:
            break
        best, kept = (1e-9, None), []
        for f in FEATURES:
            ordered = sorted((r[f], y) for r, y in rows)
            below = [0, 0]
            every, at = max(1, len(ordered) // BINS), 0
            for i, (x, y) in enumerate(ordered):
                below[y] += 1
                if i + 1 == len(ordered) or ordered[i + 1][0] == x or i + 1 - at < every:
                    continue
                at = i + 1
                cut = (x + ordered[i + 1][0]) / 2
                for above, q, m in ((False, below[1], below[0]), (True, p - below[1], len(rows) - p - below[0])):
                    if q:
                        gain = q * (math.log2(q / (q + m)) - math.log2(p / len(rows)))
                        if gain > best[0]:
                            best = (gain, Condition(f, above, cut))
        if best[1] is None:
            break
        rule.append(best[1])
        kept = [(r, y) for r, y in rows if best[1].holds(r)]
        rows = kept
    return rule


def _worth(rule: tuple[Condition, ...], rows: list[tuple[dict, int]]) -> tuple[float, int, float]:
    """(p - n) / (p + n), rows covered, and precision."""
    hit = [y for r, y in rows if all(c.holds(r) for c in rule)]
    p = sum(hit)
    return ((2 * p - len(hit)) / len(hit) if hit else -1.0, len(hit), p / len(hit) if hit else 0.0)


def learn(rows: list[tuple[dict, int]]) -> DecisionList:
    """Ordered rules that reject; rows are (statistics, 1 where the text is to be rejected), in a seeded order.

    Every third row prunes, the others grow. A rule stays if it is precise enough on both parts;
    with no labelled row, or only one class, the list is empty and keeps everything.
    """
    prune = [x for i, x in enumerate(rows) if i % 3 == 2]
    grow = [x for i, x in enumerate(rows) if i % 3 != 2]
    found: DecisionList = []
    while len(found) < MOST_RULES and any(y for _, y in grow):
        rule = tuple(_grow(grow))
        if not rule:
            break
        short = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (_worth(r, prune)[0], -len(r)))
        both = _worth(short, grow + prune)
        if both[1] < LEAST_COVER or both[2] < LEAST_PRECISION:
            break
        found.append(short)
        grow = [(r, y) for r, y in grow if not all(c.holds(r) for c in short)]
        prune = [(r, y) for r, y in prune if not all(c.holds(r) for c in short)]
    return found


def rejected_by(rules: DecisionList) -> Column:
    """The number, from 1, of the first rule that a row meets; null for none."""
    out = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        met = F.lit(True)
        for c in rules[k - 1]:
            met = met & c.column()
        out = F.when(met, F.lit(k)).otherwise(out)
    return out


def train(stats: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DecisionList:
    """Learn from labelled rows, at most `most_rows` of each class; of several labels for an id the lowest counts."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    both = stats.join(known, "doc_id").select("doc_id", "quality", *FEATURES, seeded(SEED, F.col("doc_id")).alias("_h"))
    total = {r["quality"]: r["n"] for r in both.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    parts = [lowest(both.where(F.col("quality") == q), total.get(q, 0), most_rows) for q in (0, 1)]
    rows = sorted((r for part in parts for r in part), key=lambda r: (r["_h"], r["doc_id"], *[r[f] for f in FEATURES]))
    return learn([({f: float(r[f]) for f in FEATURES}, 1 - int(r["quality"])) for r in rows])


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, BASE, base_failed, rule, kept), a row per row of docs; rule is the first learned rule met, or null.

    Null and empty texts have no words and fail the base; without labels of both classes nothing
    is learned and only the base rejects; columns other than doc_id and text play no part.
    """
    stats = settle(statistics(docs))
    rules = train(stats, labels)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.select("doc_id", *BASE, failed.alias("base_failed"), rejected_by(rules).alias("rule")).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op6_decision_list(spark, sf_dir: str) -> DataFrame:
    """Every document's base statistics and verdict; edge cases as in apply_rules()."""
    return apply_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
