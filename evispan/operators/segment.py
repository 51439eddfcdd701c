"""Text segmentation into half-open code-point intervals.

Policies that are positions of a pattern or a size are column expressions. Those that scan with a
state or optimise globally run in Arrow batches, a document at a time.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispan.functions.intervals import KIND, span
from evispan.functions.text import content_tokens

MARK = "﷐"
SENTENCE_END = r"""[.!?]["')\]]*\s+|\n\s*\n+"""
BLANK_LINES = r"\n\s*\n+"

Spans = list[tuple[int, int]]


def fixed_chunks(text: Column, size: int = 64) -> Column:
    n = F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: span(i, F.least(i + size, n)))


def overlapping_windows(text: Column, size: int = 80, stride: int = 40) -> Column:
    """Windows of `size` every `stride`, the last one pinned to the text's end; a short text is one."""
    n = F.length(text)
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)), F.lit(stride)), F.array(F.greatest(n - size, F.lit(0)))))
    return F.when(n > 0, F.transform(starts, lambda i: span(i, F.least(i + size, n)))).otherwise(F.array().cast(KIND))


def cut_after(text: Column, pattern: str) -> Column:
    """Pieces that end after each match of the pattern."""
    parts = F.filter(F.split(F.regexp_replace(text, F.lit(pattern), F.lit("$0" + MARK)), MARK, -1), lambda p: p != "")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(KIND).alias("got"))
    step = lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), F.concat(s["got"], F.array(span(s["at"], s["at"] + F.length(p)))).alias("got"))
    return F.aggregate(parts, zero, step, lambda s: s["got"])


def sentence_chunks(text: Column) -> Column:
    return cut_after(text, SENTENCE_END)


def paragraph_chunks(text: Column) -> Column:
    return cut_after(text, BLANK_LINES)


# Policies with state, on plain strings


def _words(text: str) -> list[str]:
    return re.findall(r"[A-Za-z0-9_]+", text.lower())


def bag_cosine(a: str, b: str) -> float:
    x, y = Counter(_words(a)), Counter(_words(b))
    if not x or not y:
        return 0.0
    return sum(c * y[w] for w, c in x.items()) / math.sqrt(sum(c * c for c in x.values()) * sum(c * c for c in y.values()))


def _closed(text: str, cuts: list[int]) -> Spans:
    edges = [0, *sorted({c for c in cuts if 0 < c < len(text)}), len(text)]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b]


def sentence_cuts(text: str) -> list[int]:
    return [m.end() for m in re.finditer(SENTENCE_END, text) if m.end() < len(text)]


def gear_table(prefix: str) -> list[int]:
    """256 numbers, each the first 8 bytes, little end first, of the SHA-256 of the prefix and its index."""
    return [int.from_bytes(hashlib.sha256(f"{prefix}{i}".encode()).digest()[:8], "little") for i in range(256)]


def cdc_gear(text: str, low: int = 32, average: int = 64, high: int = 128, prefix: str = "gear-") -> Spans:
    """Content-defined chunks: a rolling hash over UTF-8 bytes, cut at whole code points between the limits."""
    if not 0 < low <= average <= high:
        raise ValueError("limits must rise")
    bits = max(1, round(math.log2(average)))
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    # the low bits of the rolling sum hang on the last `bits` bytes alone, so all places are summed at once
    gear = np.array([g & ((1 << bits) - 1) for g in gear_table(prefix)], np.int64)[data]
    rolled = np.zeros(len(data), np.int64)
    for k in range(min(bits, len(data))):
        rolled[k:] += gear[: len(data) - k] << k
    last_byte = np.flatnonzero(np.append((data[1:] & 0xC0) != 0x80, True)) if len(data) else np.zeros(0, np.int64)
    hits = np.flatnonzero(rolled[last_byte] & ((1 << bits) - 1) == 0) + 1  # ends of characters that may be cuts
    out, start = [], 0
    while start < len(text):
        far = start + max(low, bits)  # fewer bytes than bits after a cut: the sum has begun anew
        early = [i for i in range(start + low, min(far, len(text) + 1)) if _restarted(gear, last_byte, start, i, bits)]
        k = int(np.searchsorted(hits, far))
        end = early[0] if early else min(int(hits[k]) if k < len(hits) else len(text), start + high, len(text))
        end = min(end, start + high)
        out.append((start, end))
        start = end
    return out


def _restarted(gear: np.ndarray, last_byte: np.ndarray, start: int, stop: int, bits: int) -> bool:
    """Whether the sum over the bytes of the characters from start to stop alone is a cut."""
    own = gear[(last_byte[start - 1] + 1 if start else 0) : last_byte[stop - 1] + 1][::-1][:bits]
    return int(sum(int(g) << k for k, g in enumerate(own.tolist()))) & ((1 << bits) - 1) == 0


def lexical_tiling(text: str, threshold: float = 0.22, reach: int = 100) -> Spans:
    cuts = sentence_cuts(text)
    sims = [bag_cosine(text[max(0, c - reach) : c], text[c : c + reach]) for c in cuts]
    around = [1.0, *sims, 1.0]
    return _closed(text, [c for k, c in enumerate(cuts) if sims[k] <= threshold or (sims[k] < 0.45 and sims[k] < around[k] and sims[k] < around[k + 2])])


def lexical_change_point(text: str, threshold: float = 0.48, reach: int = 72) -> Spans:
    return _closed(text, [c for c in sentence_cuts(text) if bag_cosine(text[max(0, c - reach) : c], text[c : c + reach]) <= threshold])


def tfidf_change_point(text: str, threshold: float = 0.32) -> Spans:
    units = _closed(text, sentence_cuts(text))
    bags = [Counter(_words(text[a:b])) for a, b in units]
    df = Counter(w for b in bags for w in b)
    vectors = [{w: c * (math.log((1 + len(bags)) / (1 + df[w])) + 1) for w, c in b.items()} for b in bags]

    def cosine(x: dict, y: dict) -> float:
        if not x or not y:
            return 0.0
        return sum(v * y.get(w, 0.0) for w, v in x.items()) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))

    sims = [cosine(x, y) for x, y in zip(vectors, vectors[1:], strict=False)]
    around = [1.0, *sims, 1.0]
    return _closed(text, [units[k][1] for k, s in enumerate(sims) if s <= threshold or (s < 0.5 and s < around[k] and s < around[k + 2])])


#: How strongly the mark before a cut speaks for it; a blank line does with 1.
STRUCTURE = {".": 0.85, "!": 0.85, "?": 0.85, ";": 0.65, ":": 0.20, ",": 0.10}


def boundary_strength(text: str, at: int, reach: int = 90) -> float:
    """From 0 to 1.5: change of vocabulary over the cut, and a blank line within two characters or the last mark of the four before."""
    if not 0 < at < len(text):
        return 1.0
    blank = "\n\n" in text[max(0, at - 2) : at + 2]
    mark = text[max(0, at - 4) : at].rstrip()[-1:]
    change = 1 - bag_cosine(text[max(0, at - reach) : at], text[at : at + reach])
    return min(1.5, 0.72 * change + 0.55 * (1.0 if blank else STRUCTURE.get(mark, 0.0)))


def candidate_cuts(text: str, target: int) -> list[int]:
    """Structural cuts, and word starts each far enough from the word start taken before."""
    least, last = max(16, target // 3), 0
    cuts = {m.end() for m in re.finditer(r"""\n\s*\n|[.!?;]["')\]]*\s+""", text)}
    for m in re.finditer(r"\s+", text):
        if m.end() - last >= least:
            last = m.end()
            cuts.add(last)
    return sorted(c for c in cuts if 0 < c < len(text))


def boundary_dp(text: str, target: int = 64, low: int = 20, high: int = 140, collision: float = 1.0, metadata: float = 0.18, weak: float = 0.55, mass: Callable[[int, int], float] | None = None) -> Spans:
    """Cuts of least total cost: (L/T)^2 collisions, size, a price a segment, and weak boundaries; nearest start wins ties.

    mass(a, b), if given, replaces one of the L/T by the share of past edits. Text that no cut
    sequence can divide within the limits falls back to pieces of the target size.
    """
    if not text:
        return []
    edges = [0, *candidate_cuts(text, target), len(text)]
    strength = [boundary_strength(text, e) for e in edges]
    best, back = [math.inf] * len(edges), [-1] * len(edges)
    best[0] = 0.0
    for j in range(1, len(edges)):
        for i in range(j - 1, -1, -1):
            n = edges[j] - edges[i]
            if n > high:
                break
            if (n < low and edges[j] < len(text)) or best[i] == math.inf:
                continue
            load = n / target * (mass(edges[i], edges[j]) / target if mass else n / target)
            cost = best[i] + collision * load + 0.10 * ((n - target) / target) ** 2 + metadata
            if edges[j] < len(text):
                cost += weak * max(0.0, 1 - strength[j])
            if cost < best[j]:
                best[j], back[j] = cost, i
    if best[-1] == math.inf:
        step = max(low, target)
        return [(a, min(a + step, len(text))) for a in range(0, len(text), step)]
    out, j = [], len(edges) - 1
    while j > 0:
        out.append((edges[back[j]], edges[j]))
        j = back[j]
    return out[::-1]


def edit_mass(length: int, past: list[tuple[float, float]], weight: float = 4.0, bandwidth: float = 0.02) -> list[float]:
    """Running sums of an edit prior of mean 1: triangles around past edits' centres, given as shares of the text."""
    density = [1.0] * length
    radius = max(6, round(bandwidth * length))
    for a, b in past:
        centre = round((a + b) / 2 * (length - 1))
        for p in range(max(0, centre - radius), min(length, centre + radius + 1)):
            density[p] += weight * (1 - abs(p - centre) / (radius + 1))
    total = sum(density) or 1.0
    out = [0.0]
    for d in density:
        out.append(out[-1] + d * length / total)
    return out


def history_dp(text: str, past: list[tuple[float, float]], target: int = 48, low: int = 8, high: int = 120, collision: float = 1.0, metadata: float = 0.3, weak: float = 0.55, weight: float = 4.0, bandwidth: float = 0.02) -> Spans:
    """boundary_dp with the prior of past edits; without any it is the plain one."""
    sums = edit_mass(len(text), past, weight, bandwidth)
    return boundary_dp(text, target, low, high, collision, metadata, weak, lambda a, b: sums[b] - sums[a])


def turn_blocks(texts: list[str], low: int = 4, high: int = 24, target: int = 12, reach: int = 3) -> Spans:
    """Blocks of turns of least cost: a price a block, size, incoherence inside and cohesion at the cut."""
    n = len(texts)
    at = [1.0] + [bag_cosine(" ".join(texts[max(0, k - reach) : k]), " ".join(texts[k : k + reach])) for k in range(1, n)] + [0.0]
    inside = [0.0]
    for k in range(1, n):
        inside.append(inside[-1] + 1 - at[k])
    best, back = [math.inf] * (n + 1), [-1] * (n + 1)
    best[0] = 0.0
    for j in range(1, n + 1):
        for i in range(j - 1, max(-1, j - high - 1), -1):
            size = j - i
            if (size < low and j < n) or best[i] == math.inf:
                continue
            loose = (inside[j - 1] - inside[i]) / (size - 1) if size > 1 else 0.0
            cost = best[i] + 0.08 + 0.35 * ((size - target) / target) ** 2 + 0.70 * loose + (0.40 * at[j] if j < n else 0.0)
            if cost < best[j]:
                best[j], back[j] = cost, i
    out, j = [], n
    while j > 0 and back[j] >= 0:
        out.append((back[j], j))
        j = back[j]
    return out[::-1]


POLICIES: dict[str, Callable[[str], Spans]] = {
    "cdc_gear": cdc_gear,
    "lexical_tiling": lexical_tiling,
    "lexical_change_point": lexical_change_point,
    "tfidf_change_point": tfidf_change_point,
    "boundary_dp": boundary_dp,
    "boundary_dp_tuned": lambda t: boundary_dp(t, 48, 8, 120, 1.5, 0.6, 0.2),
}
EXPRESSIONS: dict[str, Callable[[Column], Column]] = {
    "whole": lambda t: F.when(F.length(t) > 0, F.array(span(F.lit(0), F.length(t)))).otherwise(F.array().cast(KIND)),
    "fixed_48": lambda t: fixed_chunks(t, 48),
    "overlap_72_36": lambda t: overlapping_windows(t, 72, 36),
    "sentence": sentence_chunks,
    "paragraph": paragraph_chunks,
}


def segments(docs: DataFrame, policy: str) -> DataFrame:
    """(doc_id, seg, start, stop) by any of the eleven policies; null and empty texts have none."""
    if policy in EXPRESSIONS:
        flat = docs.select("doc_id", F.posexplode(EXPRESSIONS[policy](F.coalesce("text", F.lit("")))).alias("seg", "s"))
        return flat.select("doc_id", "seg", "s.start", "s.stop")
    cut = POLICIES[policy]

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                rows = [(d, k, a, b) for d, t in zip(part["doc_id"], part["text"], strict=True) for k, (a, b) in enumerate(cut(t or ""))]
                yield pd.DataFrame(rows, columns=["doc_id", "seg", "start", "stop"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, seg int, start int, stop int")


def uncovered(segs: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, problem) of segmentations with an empty, outlying or missing stretch."""
    merged = segs.groupBy("doc_id").agg(F.sum(F.col("stop") - F.col("start")).alias("stored"), F.min("start").alias("low"), F.max("stop").alias("high"), F.min(F.col("stop") - F.col("start")).alias("least"))
    w = Window.partitionBy("doc_id").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    gaps = segs.withColumn("_e", F.coalesce(F.max("stop").over(w), F.lit(0))).where(F.col("start") > F.col("_e")).select("doc_id").distinct().withColumn("gap", F.lit(True))
    both = docs.select("doc_id", F.length("text").alias("n")).join(merged, "doc_id", "left").join(gaps, "doc_id", "left").where("n > 0")
    problem = F.when(F.col("stored").isNull(), "no_segments").when(F.col("least") <= 0, "empty_segment").when((F.col("low") < 0) | (F.col("high") > F.col("n")), "out_of_bounds").when(F.col("gap") | (F.col("low") > 0) | (F.col("high") < F.col("n")), "gap")
    return both.select("doc_id", problem.alias("problem")).where("problem is not null")


# Turns


def islands(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Runs of equal values: (key, island, value, first, last)."""
    w = Window.partitionBy(key).orderBy(order)
    marked = rows.withColumn("_new", (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int"))
    numbered = marked.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "island").agg(F.min(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"))


def turn_offsets(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, piece, start, stop): "role: text" lines and where they stand in the whole."""
    piece = turns.withColumn("piece", F.concat(F.col("role"), F.lit(": "), F.col("text"), F.lit("\n")))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return piece.withColumn("stop", F.sum(F.length("piece")).over(w)).withColumn("start", F.col("stop") - F.length("piece")).select("conv_id", "turn", "piece", "start", "stop")


def boundary_cohesion(turns: DataFrame, reach: int = 3) -> DataFrame:
    """(conv_id, turn, cohesion) for every turn but the first: the cosine of the `reach` turns before it and from it on.

    Each term of a turn is dealt to the boundaries that see it, 2 x reach at most, so nothing is
    joined by range.
    """
    counts = turns.select("conv_id", "turn", F.explode(content_tokens(F.col("text"))).alias("term")).groupBy("conv_id", "turn", "term").agg(F.count("*").alias("c"))
    dealt = counts.select("conv_id", "term", "c", F.explode(F.transform(F.sequence(F.lit(1 - reach), F.lit(reach)), lambda d: F.struct((F.col("turn") + d).alias("at"), (d > 0).alias("left")))).alias("x"))
    sides = dealt.groupBy("conv_id", F.col("x.at").alias("turn"), "term").agg(F.sum(F.when(F.col("x.left"), F.col("c")).otherwise(0)).alias("l"), F.sum(F.when(F.col("x.left"), 0).otherwise(F.col("c"))).alias("r"))
    cosine = sides.groupBy("conv_id", "turn").agg(F.sum(F.col("l") * F.col("r")).alias("d"), F.sum(F.col("l") * F.col("l")).alias("ll"), F.sum(F.col("r") * F.col("r")).alias("rr"))
    first = Window.partitionBy("conv_id")
    cuts = turns.select("conv_id", "turn", F.min("turn").over(first).alias("_first")).where(F.col("turn") > F.col("_first")).select("conv_id", "turn")
    value = F.when((F.col("ll") > 0) & (F.col("rr") > 0), F.col("d") / F.sqrt(F.col("ll") * F.col("rr"))).otherwise(0.0)
    return cuts.join(cosine, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce(value, F.lit(0.0)).alias("cohesion"))
