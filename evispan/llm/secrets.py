"""Secret scans through a trigram inverted index.

Each rule's regex is reduced to a Boolean query over trigrams: alternatives, each a set of
trigrams that a text must hold. The corpus gets posting lists (trigram, block, row ids) for the
trigrams that the rules use; an alternative's candidates are the intersection of its lists, a
rule's their union, and the regex runs on the candidates only. A rule that has no mandatory
trigram is run on every text. All of it is DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as rc
from re import _parser as rp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispan.llm import spans as sp
from evispan.llm.common import read_table

BLOCK_ROWS = 4096
#: Strings kept exact while a regex is read, and the largest class that is spelt out.
MOST_EXACT, MOST_CLASS = 32, 8


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its regex (read alike by Java and Python), and a test of a hit."""

    kind: str
    regex: str
    least: int = 0  # characters of the hit, or of the value after `lead`
    lead: str = ""  # regex of what stands before the value
    base: bool = True


_LEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""

RULES = (
    Rule("assign", _LEAD + r"[A-Za-z0-9+/_.=-]+", 6, _LEAD),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 40, base=False),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 15, base=False),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", 39, base=False),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}", 24, base=False),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 30, base=False),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 20, base=False),
)

Query = frozenset  # of alternatives, each a frozenset of trigrams; an empty alternative is true


def _trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _and(a: Query, b: Query) -> Query:
    """Either side may stand for both where their product grows too large; that only widens the candidates."""
    if len(a) * len(b) > 4 * MOST_EXACT:
        return a
    return frozenset(x | y for x in a for y in b)


TRUE: Query = frozenset([frozenset()])


def _class(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is rc.LITERAL:
            out.add(chr(arg).lower())
        elif op is rc.RANGE and arg[1] - arg[0] < MOST_CLASS:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_CLASS else None


def _walk(tree) -> tuple[set[str] | None, Query]:
    """(all strings that match, if they are few; what any match holds), in lower case."""
    exact: set[str] | None = {""}
    query = TRUE

    def flush() -> None:
        nonlocal exact, query
        if exact is not None:
            query = _and(query, frozenset(_trigrams(s) for s in exact))
        exact = None

    def then(more: set[str] | None, held: Query) -> None:
        nonlocal exact
        if more is not None and exact is not None and len(exact) * len(more) <= MOST_EXACT:
            exact = {a + b for a in exact for b in more}
            return
        flush()
        nonlocal query
        query = _and(query, held)
        exact = more

    for op, arg in tree:
        if op is rc.LITERAL:
            then({chr(arg).lower()}, TRUE)
        elif op is rc.IN:
            then(_class(arg), TRUE)
        elif op is rc.SUBPATTERN:
            then(*_closed(_walk(arg[-1])))
        elif op is rc.BRANCH:
            parts = [_walk(t) for t in arg[1]]
            then(set().union(*(e for e, _ in parts)) if all(e is not None for e, _ in parts) else None, frozenset().union(*(_closed(p)[1] for p in parts)))
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT):
            low, high, sub = arg
            e, q = _walk(sub)
            if (low, high) == (0, 1) and e is not None:
                then(e | {""}, TRUE)
            elif low == high and e is not None and len(e) == 1:
                then({next(iter(e)) * low}, TRUE)
            else:
                then(None, _closed((e, q))[1] if low else TRUE)
        elif op in (rc.ASSERT, rc.ASSERT_NOT, rc.AT):
            pass
        else:
            then(None, TRUE)
    return exact, query


def _closed(found: tuple[set[str] | None, Query]) -> tuple[set[str] | None, Query]:
    exact, query = found
    return exact, query if exact is None else _and(query, frozenset(_trigrams(s) for s in exact))


def trigram_query(regex: str) -> Query:
    """Alternatives of mandatory trigrams of lower-cased texts; TRUE where there are none for some alternative."""
    query = _closed(_walk(rp.parse(regex)))[1]
    return TRUE if frozenset() in query else query


def with_row_id(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows that collide, at worst, share candidates: the regex still runs on each row's own text."""
    return docs.withColumn("_rid", F.xxhash64(doc_id, text))


def build_index(docs: DataFrame, grams: list[str], *, doc_id: str = "doc_id", text: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Posting lists (gram, block, ids) of the given trigrams over all of docs, ids sorted.

    A block has about `block_rows` rows, so no list grows with the corpus.
    """
    rows = docs.count()
    blocks = max(1, -(-rows // block_rows))
    low = F.lower(F.col(text))
    kept = with_row_id(docs.select(doc_id, text), doc_id, text).select("_rid", low.alias("_low"))
    held = F.filter(F.array(*[F.when(F.col("_low").contains(g), F.lit(g)) for g in grams]), lambda g: g.isNotNull())
    flat = kept.select("_rid", F.explode(held).alias("gram"))
    return flat.groupBy("gram", F.pmod("_rid", F.lit(blocks)).alias("block")).agg(F.sort_array(F.collect_set("_rid")).alias("ids"))


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """(_rid, rules): the rows that a rule's Boolean query leaves."""
    spark = index.sparkSession
    terms = [(r.kind, n, g, len(alt)) for r in rules for n, alt in enumerate(sorted(map(sorted, trigram_query(r.regex)))) for g in alt]
    wanted = spark.createDataFrame(terms, "kind string, alt int, gram string, need int")
    lists = index.join(F.broadcast(wanted), "gram").groupBy("block", "kind", "alt", "need").agg(F.collect_list("ids").alias("lists"))
    met = lists.where(F.size("lists") == F.col("need")).select(
        "kind", F.explode(F.aggregate(F.slice("lists", 2, F.size("lists")), F.col("lists")[0], lambda a, b: F.array_intersect(a, b))).alias("_rid")
    )
    return met.groupBy("_rid").agg(F.collect_set("kind").alias("_rules"))


def _long_enough(rule: Rule):
    if rule.lead:
        return lambda s: F.length(F.regexp_replace(s["hit"], F.lit("^" + rule.lead), F.lit(""))) >= rule.least
    return lambda s: F.length(s["hit"]) >= rule.least


def _scanned(docs: DataFrame, rules: tuple[Rule, ...], doc_id: str, text: str) -> DataFrame:
    """(row, base_spans, spans): row has all of docs' columns, so that none can meet the names used here."""
    indexed = [r for r in rules if trigram_query(r.regex) != TRUE]
    grams = sorted({g for r in indexed for alt in trigram_query(r.regex) for g in alt})
    found = candidates(build_index(docs.select(doc_id, text), grams, doc_id=doc_id, text=text), indexed)
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    rows = rows.withColumn("_rid", F.xxhash64(F.col("row")[doc_id], F.col("row")[text])).join(found, "_rid", "left").withColumn("_clean", sp.clean(F.col("row")[text]))
    scanned = {r.kind for r in rules} - {r.kind for r in indexed}
    for r in rules:
        gate = F.lit(True) if r.kind in scanned else F.coalesce(F.array_contains("_rules", r.kind), F.lit(False))
        rows = rows.withColumn(f"_p_{r.kind}", sp.pieces(F.col("_clean"), r.regex, gate))
    rows = rows.drop("_clean", "_rid", "_rules")
    for r in rules:
        rows = rows.withColumn(f"_s_{r.kind}", F.filter(sp.located(F.col(f"_p_{r.kind}")), _long_enough(r))).drop(f"_p_{r.kind}")
    rows = rows.withColumn("base_spans", F.flatten(F.array(*[sp.keyed(F.col(f"_s_{r.kind}"), i) for i, r in enumerate(rules) if r.base])))
    more = [sp.keyed(F.col(f"_s_{r.kind}"), i) for i, r in enumerate(rules) if not r.base]
    if not more:
        return rows.select("row", "base_spans", F.col("base_spans").alias("spans"))
    free = F.filter(F.flatten(F.array(*more)), lambda s: ~F.exists("base_spans", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    return rows.select("row", "base_spans", F.concat("base_spans", free).alias("spans"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with `base_spans` and `spans`, arrays of (start, kind, stop), kind being the rule's place.

    A hit of a later rule that overlaps a base hit is left out. Null and empty texts have no spans;
    repeated rows each keep theirs; columns of docs with these two names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("base_spans", "spans")]
    return _scanned(docs, rules, doc_id, text).select(*[F.col("row")[c].alias(c) for c in kept], "base_spans", "spans")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every span's characters in `text` replaced by its kind in brackets; n_chars follows; other rows and columns stay."""
    kinds = F.array(*[F.lit(f"[{r.kind}]") for r in rules])
    text = F.col("row")["text"]

    def step(acc: Column, s: Column) -> Column:
        new = F.concat(acc["out"], F.substring(text, acc["at"], F.greatest(s["start"] + 1 - acc["at"], F.lit(0))), F.get(kinds, s["kind"]))
        over = s["start"] + 1 < acc["at"]  # overlaps the span before: only its end counts
        return F.struct(F.when(over, acc["out"]).otherwise(new).alias("out"), F.greatest(acc["at"], s["stop"] + 1).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    redone = F.aggregate(F.sort_array("spans"), start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"], F.length(text))))
    found = _scanned(docs, rules, "doc_id", "text").withColumn("new", F.when(F.size("spans") > 0, redone).otherwise(text))
    own = {"text": F.col("new"), "n_chars": F.when(F.size("spans") > 0, F.length("new").cast("long")).otherwise(F.col("row")["n_chars"]) if "n_chars" in docs.columns else None}
    return found.select(*[own.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op5_trigram_secrets(spark, sf_dir: str) -> DataFrame:
    rules = RULES
    kinds = [r.kind for r in rules]
    found = scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"), rules).drop("text")
    count = lambda i: F.size(F.filter("base_spans", lambda s: s["kind"] == i)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{r.kind}") for i, r in enumerate(rules) if r.base],
        F.sha2(sp.written(F.col("base_spans"), kinds), 256).alias("base_sha256"),
        sp.written(F.col("spans"), kinds).alias("spans"),
    )
