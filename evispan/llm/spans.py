"""Match positions of a regular expression as column expressions, without Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two noncharacters mark a match's ends; texts that hold them get U+FFFD in their place, which keeps all offsets.
OPEN, SHUT = "﷐", "﷑"
CHUNK = 256
CONTEXT = 40
SPAN = "array<struct<start:int,stop:int,hit:string,before:string>>"


def clean(text: Column) -> Column:
    """The text with null as empty and the markers replaced, offsets unchanged."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.contains(OPEN) | t.contains(SHUT), F.translate(t, OPEN + SHUT, "��")).otherwise(t)


def pieces(text: Column, pattern: str, gate: Column) -> Column:
    """The text cut before every match, each match followed by a marker; one empty piece where the gate is false."""
    cut = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{OPEN}$0{SHUT}")), OPEN, -1)
    return F.when(gate, cut).otherwise(F.array(F.lit("")))


def located(parts: Column) -> Column:
    """Spans (start, stop, hit, the characters before) from a column of pieces().

    Offsets are code points. The running offset is folded in chunks, so that a text with very many
    matches costs n * (CHUNK + n / CHUNK) and not n squared.
    """
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    tails = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    both = F.zip_with(
        rest,
        tails,
        lambda p, q: F.struct(
            F.substring_index(p, SHUT, 1).alias("hit"),
            (F.length(p) - 1).alias("size"),
            F.right(F.substring_index(q, SHUT, -1), F.lit(CONTEXT)).alias("before"),
        ),
    )
    last = F.floor((F.greatest(F.size(parts), F.lit(2)) - 2) / CHUNK).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(both, i * CHUNK + 1, F.lit(CHUNK)))

    def offsets(cs: Column) -> Column:
        return F.aggregate(
            cs,
            F.array(F.length(parts[0])),
            lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + F.aggregate(c, F.lit(0), lambda s, x: s + x["size"]))),
        )

    def laid(c: Column, base: Column) -> Column:
        zero = F.struct(base.alias("at"), F.array().cast(SPAN).alias("got"))
        return F.aggregate(
            c,
            zero,
            lambda acc, x: F.struct(
                (acc["at"] + x["size"]).alias("at"),
                F.concat(
                    acc["got"],
                    F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(x["hit"])).alias("stop"), x["hit"].alias("hit"), x["before"].alias("before"))),
                ).alias("got"),
            ),
            lambda acc: acc["got"],
        )

    made = F.transform(
        F.array(chunks),  # bound once, so that the chunks aren't cut again for each use
        lambda cs: F.flatten(F.zip_with(cs, F.slice(offsets(cs), 1, F.size(cs)), laid)),
    )[0]
    return F.when(F.size(parts) > 1, made).otherwise(F.array().cast(SPAN))


def keyed(spans: Column, kind: int) -> Column:
    """(start, kind, stop) of spans."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["stop"].alias("stop")))


def written(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of (start, kind, stop), by start and then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")
