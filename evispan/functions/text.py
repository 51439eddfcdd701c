"""Text functions as column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of two or more Unicode letters, digits or underscores.
WORD2 = r"[\p{L}\p{N}_]{2,}"
ASCII_WORD = "[A-Za-z0-9_]+"

#: The 318 English stop words of the selection scorer.
STOP_WORDS = """
a about above across after afterwards again against all almost alone along already also although always am
among amongst amoungst amount an and another any anyhow anyone anything anyway anywhere are around as at back
be became because become becomes becoming been before beforehand behind being below beside besides between
beyond bill both bottom but by call can cannot cant co con could couldnt cry de describe detail do done down
due during each eg eight either eleven else elsewhere empty enough etc even ever every everyone everything
everywhere except few fifteen fifty fill find fire first five for former formerly forty found four from front
full further get give go had has hasnt have he hence her here hereafter hereby herein hereupon hers herself
him himself his how however hundred i ie if in inc indeed interest into is it its itself keep last latter
latterly least less ltd made many may me meanwhile might mill mine more moreover most mostly move much must my
myself name namely neither never nevertheless next nine no nobody none noone nor not nothing now nowhere of
off often on once one only onto or other others otherwise our ours ourselves out over own part per perhaps
please put rather re same see seem seemed seeming seems serious several she should show side since sincere six
sixty so some somehow someone something sometime sometimes somewhere still such system take ten than that the
their them themselves then thence there thereafter thereby therefore therein thereupon these they thick thin
third this those though three through throughout thru thus to together too top toward towards twelve twenty
two un under until up upon us very via was we well were what whatever when whence whenever where whereafter
whereas whereby wherein whereupon wherever whether which while whither who whoever whole whom whose why will
with within without would yet you your yours yourself yourselves
""".split()

#: Words that a rewritten query drops, openings of reasoning sentences, and the terms' own short stop list.
WH_WORDS = ["who", "what", "when", "where", "why", "which", "how", "does", "is"]
REASONING = ["thus ", "thus,", "so ", "so,", "that is,", "therefore", "hence"]
SHORT_STOPS = """
a an and are as at be been but by for from has have he her his i in is it its of on or she that the their them
they this to was we were will with you your
""".split()
ANSWER_MARK = "So the answer is: "


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD2), F.lit(0))


def content_tokens(text: Column) -> Column:
    """ASCII words of three or more characters; the segmenters' and tile graphs' terms."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(ASCII_WORD), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(SHORT_STOPS))


def normal_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces; in that order."""
    bare = F.translate(F.lower(text), string.punctuation, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "), r"(?U)\s+", " "))


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def record_frame(doc_id: Column, title: Column, text: Column, sha256: Column) -> Column:
    """A source record's canonical JSON, keys sorted, and a line end: what its cost is counted on."""
    return F.concat(F.to_json(F.struct(doc_id.alias("id"), sha256.alias("sha256"), text.alias("text"), title.alias("title"))), F.lit("\n"))


def date_key(text: Column) -> Column:
    """A full date in one of four English forms as an ISO date, else null."""
    bare = F.regexp_replace(F.trim(text), r"\.+$", "")
    parsed = [F.try_to_date(bare, f) if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(bare, F.lit(f))) for f in ("d MMMM yyyy", "MMMM d, yyyy", "d MMM yyyy", "MMM d, yyyy")]
    return F.date_format(F.coalesce(*parsed), "yyyy-MM-dd")


def mentions(title_tokens: Column, text_tokens: Column) -> Column:
    """The title's tokens stand in a row in the text; titles of under four characters never do."""
    joined = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    return (F.length(F.array_join(title_tokens, "")) >= 4) & joined(text_tokens).contains(joined(title_tokens))


def terminal_answer(raw: Column, marker: str = ANSWER_MARK) -> Column:
    """(answer, ok): the line after the only marker, without one closing dot; otherwise the raw text and false."""
    parts = F.split(F.trim(raw), marker, -1)
    tail = F.regexp_replace(F.trim(F.get(parts, 1)), r"\.$", "")
    ok = (F.size(parts) == 2) & (F.trim(F.get(parts, 1)) != "") & ~F.get(parts, 1).contains("\n")
    return F.struct(F.when(ok, tail).otherwise(raw).alias("answer"), F.coalesce(ok, F.lit(False)).alias("ok"))


def first_sentence(raw: Column) -> Column:
    return F.split(raw, r"(?<=[.!?])\s+(?=\p{Lu})", 2)[0]


def answer_is(sentence: Column) -> Column:
    """What follows the last "answer is", without one closing dot; null where it doesn't occur."""
    found = F.regexp_extract(sentence, r"^.* answer is:? (.*)", 1)
    return F.when(sentence.rlike(r"^.* answer is:? "), F.regexp_replace(found, r"\.$", ""))


def is_reasoning(sentence: Column) -> Column:
    """Opens with a connective or holds a sum."""
    low = F.lower(sentence)
    opens = low.startswith(REASONING[0])
    for word in REASONING[1:]:
        opens = opens | low.startswith(word)
    number = r"(?:\d[\d,]*\.?\d+|\d+)"
    return opens | sentence.rlike(rf"{number} [+-] {number} = {number}")


def without_wh_words(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, " "), lambda w: ~F.lower(F.trim(w)).isin(WH_WORDS)), " ")


def next_query(question: Column, sentences: Column) -> Column:
    """The last sentence that isn't reasoning, or the question, without wh-words."""
    plain = F.filter(sentences, lambda s: ~is_reasoning(s))
    return without_wh_words(F.when(F.size(plain) > 0, F.element_at(plain, -1)).otherwise(question))


def occurrences(text: Column, quote: Column) -> Column:
    """Offsets of a quote, overlapping ones too; none for an empty quote. One regex pass marks every start."""
    mark = "\ufdd0"
    literal = F.concat(F.lit(r"(?=\Q"), F.replace(quote, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    parts = F.split(F.regexp_replace(text, literal, F.lit(mark)), mark, -1)
    ends = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("got"))
    found = F.aggregate(ends, zero, lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), F.concat(s["got"], F.array(s["at"] + F.length(p))).alias("got")), lambda s: s["got"])
    return F.when(F.length(quote) > 0, found).otherwise(F.array().cast("array<int>"))


def count_apart(text: Column, quote: Column) -> Column:
    """Occurrences that don't overlap, from the left."""
    return F.when(F.length(quote) > 0, ((F.length(text) - F.length(F.replace(text, quote, F.lit("")))) / F.length(quote)).cast("int")).otherwise(0)


def resolve_anchor(text: Column, quote: Column, before: Column, after: Column, hint: Column) -> Column:
    """(status, start, confidence): occurrences with the exact context, else the only nearest to the hint; never fuzzy."""
    every = occurrences(text, quote)
    has_context = (F.length(F.coalesce(before, F.lit(""))) > 0) | (F.length(F.coalesce(after, F.lit(""))) > 0)
    b, a = F.coalesce(before, F.lit("")), F.coalesce(after, F.lit(""))
    q = F.length(quote)
    fits = F.filter(every, lambda i: (F.substring(text, i + 1 - F.least(F.length(b), i), F.least(F.length(b), i)) == b) & (F.substring(text, i + q + 1, F.length(a)) == a))
    near = F.array_sort(F.transform(fits, lambda i: F.struct(F.abs(i - hint).alias("d"), i.alias("i"))))
    lone = (F.size(fits) > 1) & hint.isNotNull() & (F.get(near, 0)["d"] < F.get(near, 1)["d"])
    status = F.when(F.size(every) == 0, "missing").when(F.size(fits) == 1, "resolved").when(lone, "resolved").when(F.size(fits) == 0, "missing").otherwise("ambiguous")
    start = F.when(F.size(fits) == 1, F.get(fits, 0)).when(lone, F.get(near, 0)["i"])
    sure = F.when(F.size(fits) == 1, F.when(has_context | (F.size(every) == 1), 1.0).otherwise(0.9)).when(lone, 0.75)
    return F.struct(status.alias("status"), start.alias("start"), sure.alias("confidence"))


def apply_edit(text: Column, kind: Column, start: Column, stop: Column, new: Column, to: Column | None = None) -> Column:
    """insert, delete, rewrite, split, merge or move on code-point offsets; an edit out of bounds raises."""
    n = F.length(text)
    head, cut, tail = F.substring(text, F.lit(1), start), F.substring(text, start + 1, stop - start), F.substring(text, stop + 1, n)
    rest = F.concat(head, tail)
    at = F.coalesce(to if to is not None else F.lit(None).cast("int"), F.lit(0))
    at = F.when(at >= stop, at - (stop - start)).otherwise(at)
    moved = F.concat(F.substring(rest, F.lit(1), at), cut, F.substring(rest, at + 1, n))
    done = (
        F.when(kind.isin("insert", "split"), F.concat(F.substring(text, F.lit(1), start), F.coalesce(new, F.lit("")), F.substring(text, start + 1, n)))
        .when(kind == "delete", rest)
        .when(kind.isin("rewrite", "merge"), F.concat(head, F.coalesce(new, F.lit("")), tail))
        .when(kind == "move", moved)
        .otherwise(F.raise_error(F.concat(F.lit("unknown edit "), kind)).cast("string"))
    )
    bad = (start < 0) | (stop < start) | (stop > n)
    return F.when(bad, F.raise_error(F.lit("the edit is out of bounds")).cast("string")).otherwise(done)


def touched_files(patch: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(patch, F.lit(r"(?m)^diff --git a/(\S+)"), F.lit(1))))


def strict_decision(raw: Column) -> Column:
    """(decision, value) of JSON with exactly these keys, each once, value a whole number of 0 or more and 0 unless committing; else nulls."""
    bare = F.trim(raw)
    shape = bare.rlike(r'^\{\s*(?:"decision"\s*:\s*"[^"\\]*"\s*,\s*"value"\s*:\s*\d+|"value"\s*:\s*\d+\s*,\s*"decision"\s*:\s*"[^"\\]*")\s*\}$')
    decision = F.regexp_extract(bare, r'"decision"\s*:\s*"([^"\\]*)"', 1)
    value = F.try_cast(F.regexp_extract(bare, r'"value"\s*:\s*(\d+)', 1), "bigint") if hasattr(F, "try_cast") else F.regexp_extract(bare, r'"value"\s*:\s*(\d+)', 1).try_cast("bigint")
    ok = shape & value.isNotNull() & ((decision == "commit") | (value == 0))
    return F.struct(F.when(ok, decision).alias("decision"), F.when(ok, value).alias("value"))


def minimal_ids(raw: Column) -> Column:
    """(tiles, error) of lines pNNNN or pNNNN+pNNNN closed by END, or NONE and END."""
    lines = F.split(F.trim(raw), r"\r?\n")
    body = F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))
    error = (
        F.when(F.element_at(lines, -1) != "END", "no_end")
        .when(F.size(body) == 0, "empty")
        .when((F.size(body) == 1) & (F.get(body, 0) == "NONE"), None)
        .when(~F.forall(body, lambda x: x.rlike(r"^p\d{4}(?:\+p\d{4})?$")), "bad_line")
        .when(F.size(F.array_distinct(body)) < F.size(body), "repeated_tile")
        .when(F.exists(body, lambda x: F.get(F.split(x, r"\+"), 0) == F.get(F.split(x, r"\+"), 1)), "repeated_id")
        .when(F.size(body) > 8, "too_many")
    )
    none = (F.size(body) == 1) & (F.get(body, 0) == "NONE")
    return F.struct(F.when(error.isNull() & ~none, body).otherwise(F.array().cast("array<string>")).alias("tiles"), error.alias("error"))
