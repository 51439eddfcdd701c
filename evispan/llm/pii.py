"""Personal data by weak supervision: labelers vote on spans, EM weighs them, a span classifier decides.

Candidates are the base hits (email, ip, card, phone) and the looser hits of further kinds: other
numbers, account numbers, titled names, street addresses. Six labelers vote 1, -1 or 0 on each:
the written shape, check digits and lengths, gazetteers, whether the hit stands alone, and words
before it that speak for or against it. Votes and shape buckets are counted over all documents;
that table is bounded by the number of vote patterns, so expectation-maximisation over the
two-class model of labeler reliabilities, and the logistic span classifier trained on its
posteriors, run on counts. The classifier is then one more column expression; what it accepts of
the further kinds is added. Base hits always stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from evispan.llm import spans as sp
from evispan.llm.common import read_table, settle

KINDS = ["email", "ip", "card", "phone", "number", "iban", "person", "street"]
BASE_KINDS = KINDS[:4]
MORE_KINDS = KINDS[4:]

#: Titles before names, and the last words of street names, in natural order.
TITLES = ["Don", "Doña", "Dr", "Frau", "Herr", "Miss", "Mme", "Mr", "Mrs", "Ms", "Prof", "Sra"]
STREETS = ["Avenue", "Boulevard", "Court", "Drive", "Lane", "Place", "Road", "Square", "Street", "Way"]

#: The base patterns, written so that no start is tried twice: a hit begins where its run does.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?+[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "number": r"(?<![A-Za-z0-9+.(-])\(?[0-9](?:[\x20().-]{0,2}+[0-9]){6,17}+(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "person": r"(?<![\p{L}])(?:" + "|".join(TITLES) + r")\.?\x20\p{Lu}\p{Ll}+(?:\x20\p{Lu}\p{Ll}+)?(?![\p{L}])",
    "street": r"(?<![\p{L}0-9])[0-9]{1,5}\x20(?:\p{Lu}\p{Ll}+\x20){1,3}(?:" + "|".join(STREETS) + r")(?![\p{L}])",
}
#: What must be there for a pattern to be tried.
GATES = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    "phone": lambda t: t.contains("+"),
    "number": lambda t: t.rlike("[0-9]{2}"),
    "iban": lambda t: t.rlike("[A-Z]{2}[0-9]{2}"),
    "person": lambda t: t.rlike(r"(?:" + "|".join(TITLES) + r")\.?\x20"),
    "street": lambda t: t.rlike(r"[0-9]\x20") & t.rlike("|".join(STREETS)),
}

#: Written shapes that speak for a kind, and for numbers those that speak against.
SHAPES = {
    "email": r"^[A-Za-z0-9](?:[^@]*[A-Za-z0-9])?@[A-Za-z0-9].*\.[A-Za-z]{2,}$",
    "ip": r"^(?:0|[1-9][0-9]*)(?:\.(?:0|[1-9][0-9]*)){3}$",
    "card": r"^(?:[0-9]+|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7})$",
    "phone": r"^\+[0-9]{1,3}[\x20.-]?\(?[0-9]{1,4}\)?[\x20.-]?[0-9]{2,4}(?:[\x20.-]?[0-9]{2,4}){1,3}$",
    "number": r"^(?:\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{15,16})$",
    "iban": r"^[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)$",
    "person": r"\x20\p{Lu}\p{Ll}+\x20\p{Lu}\p{Ll}+$",
    "street": r"^[1-9]",
}
NOT_SHAPES = r"^(?:[0-9]+(?:\.[0-9]+){1,2}|(?:19|20)[0-9]{2}[ .-][0-9]{1,2}[ .-][0-9]{1,2}|[0-9]{1,3}(?:[ .][0-9]{3})+)$"
FOR_WORDS = r"(?i)(?:phone|tel|call|mobile|cell|fax|contact|e-?mail|mail|ssn|social|card|visa|account|iban|passport|address|ip|host)[^\n]{0,24}$"
AGAINST_WORDS = r"(?i)(?:version|isbn|issn|page|item|order|invoice|ref|section|figure|table|total|price|id)[^\n]{0,12}$"
#: Gazetteers: mail domains' ends, first digits of card issuers, and countries of account numbers, in natural order.
MAIL_ENDS = ["com", "de", "edu", "es", "fr", "gov", "info", "io", "net", "org", "uk"]
ISSUERS = ["3", "4", "5", "6"]
COUNTRIES = ["AT", "BE", "CH", "DE", "DK", "ES", "FI", "FR", "GB", "GR", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE"]

LABELERS = ["shape", "valid", "gazetteer", "alone", "speaks_for", "speaks_against"]
ROUNDS, STEPS, RATE, CUT = 60, 400, 0.5, 0.8


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(d: Column) -> Column:
    n = F.length(d)
    each = F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.when(i % 2 == 1, _digit(d, n, i)).otherwise(F.when(_digit(d, n, i) > 4, 2 * _digit(d, n, i) - 9).otherwise(2 * _digit(d, n, i))),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _digit(d: Column, n: Column, i: Column) -> Column:
    return F.ascii(F.substring(d, n - i + 1, F.lit(1))) - 48


def octets_ok(hit: Column) -> Column:
    return hit.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$")


def valid(kind: str, hit: Column) -> Column:
    """The contract's test of a base hit."""
    n = F.length(digits(hit))
    if kind == "ip":
        return octets_ok(hit)
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits(hit))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def account_ok(hit: Column) -> Column:
    """The check digits of an account number: moved to its end and read as digits (A is 10) it is 1 modulo 97."""
    flat = F.regexp_replace(hit, "\\x20", "")
    turned = F.concat(F.substring(flat, 5, F.length(flat)), F.substring(flat, 1, F.lit(4)))
    values = F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48))
    return F.aggregate(values, F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


def _votes(kind: str, s: Column) -> Column:
    hit, before = s["hit"], s["before"]
    d = digits(hit)
    n, first = F.length(d), F.substring(d, 1, 1)
    no = F.lit(False)
    vote = lambda plus, minus: F.when(plus, 1).when(minus, -1).otherwise(0)
    against = {"email": ~hit.rlike(SHAPES["email"]), "ip": ~hit.rlike(SHAPES["ip"]), "number": hit.rlike(NOT_SHAPES)}
    checked = {
        "email": vote(~hit.rlike(r"\.\.|-\.|\.-|@-|-$"), F.lit(True)),
        "ip": vote(F.split(hit, r"\.")[0].cast("int").between(1, 223), F.lit(True)),
        "card": vote(n.between(15, 16), no),
        "phone": vote(n.between(11, 13), no),
        "number": vote(F.when(n.between(14, 19), luhn(d)).otherwise(False), (n < 9) | (n > 16)),
        "iban": vote(account_ok(hit), F.lit(True)),
    }
    known = {
        "email": vote(F.lower(F.element_at(F.split(hit, r"\."), -1)).isin(MAIL_ENDS), no),
        "card": vote(first.isin(ISSUERS), no),
        "phone": vote(no, first == "0"),
        "number": vote((n.between(13, 16) & first.isin(ISSUERS)) | ((n < 13) & hit.rlike("[ ().-]") & (first != "0")), d.rlike(r"^([0-9])\1+$") | ((n < 13) & (first == "0"))),
        "iban": vote(F.substring(hit, 1, 2).isin(COUNTRIES), no),
        "person": F.lit(1),
        "street": F.lit(1),
    }
    return F.struct(
        s["start"].alias("start"),
        F.lit(KINDS.index(kind)).alias("kind"),
        s["stop"].alias("stop"),
        vote(hit.rlike(SHAPES[kind]), against.get(kind, no)).alias("shape"),
        checked.get(kind, F.lit(0)).alias("valid"),
        known.get(kind, F.lit(0)).alias("gazetteer"),
        vote(before.rlike(r"(?:^|[^0-9A-Za-z][\s\"'(\[:;=]|[A-Za-z\p{L}][.,:;]?[\s\"'(\[]+)$"), before.rlike(r"[0-9][.,/:]?\s?$")).alias("alone"),
        vote(before.rlike(FOR_WORDS), no).alias("speaks_for"),
        vote(no, before.rlike(AGAINST_WORDS)).alias("speaks_against"),
        F.least(F.floor(n / 3), F.lit(6)).cast("int").alias("digits"),
        F.least(F.length(hit) - n, F.lit(5)).cast("int").alias("marks"),
    )


def _checked(kind: str):
    return lambda s: valid(kind, s["hit"])


def _voted(kind: str):
    return lambda s: _votes(kind, s)


def candidates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base_spans, votes): the base hits, and every candidate with its votes, further kinds that touch a base hit left out."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), sp.clean(F.col(text)).alias("_clean"))
    for k, pattern in PATTERNS.items():
        rows = rows.withColumn(f"_p_{k}", sp.pieces(F.col("_clean"), pattern, GATES[k](F.col("_clean"))))
    rows = rows.drop("_clean")
    for k in PATTERNS:
        rows = rows.withColumn(f"_s_{k}", F.filter(sp.located(F.col(f"_p_{k}")), _checked(k))).drop(f"_p_{k}")
    rows = rows.withColumn("base_spans", F.flatten(F.array(*[sp.keyed(F.col(f"_s_{k}"), KINDS.index(k)) for k in BASE_KINDS])))
    for k in MORE_KINDS:
        rows = rows.withColumn(f"_s_{k}", F.filter(f"_s_{k}", lambda s: ~F.exists("base_spans", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))))
    votes = F.flatten(F.array(*[F.transform(f"_s_{k}", _voted(k)) for k in PATTERNS]))
    return rows.select("doc_id", "base_spans", votes.alias("votes"))


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[dict], list[float]]:
    """EM over vote patterns with counts: the share of true spans, each labeler's P(vote | class), each pattern's posterior.

    Starts from the majority vote; counts are smoothed by 1, so an empty or one-sided table is fine.
    """
    n = len(patterns[0][0]) if patterns else 0
    post = [1 / (1 + math.exp(-1.5 * sum(v))) for v, _ in patterns]
    prior, tables = 0.5, []
    for _ in range(rounds):
        on = sum(c * p for (_, c), p in zip(patterns, post, strict=True))
        total = sum(c for _, c in patterns)
        prior = (on + 1) / (total + 2)
        tables = []
        for k in range(n):
            t = {(v, y): 1.0 for v in (-1, 0, 1) for y in (0, 1)}
            for (votes, c), p in zip(patterns, post, strict=True):
                t[votes[k], 1] += c * p
                t[votes[k], 0] += c * (1 - p)
            for y in (0, 1):
                s = sum(t[v, y] for v in (-1, 0, 1))
                for v in (-1, 0, 1):
                    t[v, y] /= s
            tables.append(t)
        post = []
        for votes, _ in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(tables[k][v, 1] / tables[k][v, 0]) for k, v in enumerate(votes))
            post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    return prior, tables, post


FEATURES = [*LABELERS, "digits", "marks"]


def _inputs(get) -> list:
    """Numbers that the classifier sees; get(name) is a value or a column."""
    return [get(k) * 1.0 for k in LABELERS] + [get("digits") / 6.0, get("marks") / 5.0]


def train_span_classifier(table: list[Row], steps: int = STEPS, rate: float = RATE) -> list[float]:
    """Logistic weights (bias last) from counted feature rows and EM's posteriors of their vote patterns."""
    by: dict[tuple[int, ...], int] = {}
    for r in table:
        votes = tuple(r[k] for k in LABELERS)
        by[votes] = by.get(votes, 0) + r["n"]
    patterns = sorted(by.items())
    _, _, post = reliabilities(patterns)
    target = {votes: p for (votes, _), p in zip(patterns, post, strict=True)}
    rows = sorted((_inputs(lambda k, r=r: r[k]), target[tuple(r[k] for k in LABELERS)], r["n"]) for r in table)
    total = sum(n for *_, n in rows) or 1
    w = [0.0] * (len(FEATURES) + 1)
    for _ in range(steps):
        grad = [1e-3 * x for x in w]
        for x, y, n in rows:
            z = w[-1] + sum(a * b for a, b in zip(w, x, strict=False))
            d = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y) * n / total
            for i, v in enumerate(x):
                grad[i] += d * v
            grad[-1] += d
        w = [a - rate * g for a, g in zip(w, grad, strict=True)]
    return w


def probability(weights: list[float], s: Column) -> Column:
    z = F.lit(weights[-1])
    for w, x in zip(weights, _inputs(lambda k: s[k]), strict=False):
        z = z + w * x
    return 1 / (1 + F.exp(-z))


def detect(docs: DataFrame, *, cut: float = CUT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base_spans, spans), a row per row of docs: arrays of (start, kind, stop) as in KINDS.

    Null and empty texts have no spans; repeated rows each have theirs; other columns are ignored.
    With no candidates in any document the classifier adds nothing.
    """
    found = settle(candidates(docs, doc_id=doc_id, text=text))
    table = found.select(F.explode("votes").alias("v")).select("v.*").groupBy(*FEATURES).agg(F.count("*").alias("n")).collect()
    weights = train_span_classifier(table)
    added = F.filter("votes", lambda s: (s["kind"] >= len(BASE_KINDS)) & (probability(weights, s) >= cut))
    added = F.transform(added, lambda s: F.struct(s["start"], s["kind"], s["stop"]))
    return found.select("doc_id", "base_spans", F.concat("base_spans", added).alias("spans"))


def op4_weak_supervision(spark, sf_dir: str) -> DataFrame:
    """Per document the counts and digest of the base spans, and all spans; nulls, repeated rows and empty tables as in detect()."""
    found = detect(read_table(spark, sf_dir, "documents"))
    count = lambda i: F.size(F.filter("base_spans", lambda s: s["kind"] == i)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)],
        F.sha2(sp.written(F.col("base_spans"), KINDS), 256).alias("base_sha256"),
        sp.written(F.col("spans"), KINDS).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )
