"""Offsets of pattern matches as column expressions, in time linear in the text and its matches.

An array that grows by one in a fold is copied in each step. Folds here run over slices of STEP elements, and what slices give is put
together once more, so that copies stay short.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = 512


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x computed once however often f names it: what a lambda names from outside is computed again for each element."""
    return F.element_at(F.transform(F.array(x), f), 1)


def scan(items: Column, zero: Column, step: Callable[[Column, Column], tuple[Column, Column]], out: str) -> Column:
    """A fold that emits: step(state, item) gives the next state and an array to emit. A struct of the last `state` and of all that was emitted,
    `out`, in order. out: type of the arrays."""
    slices = bound(items, lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), F.lit(STEP)), lambda i: F.slice(x, i + 1, F.lit(STEP))))

    def inner(acc: Column, x: Column) -> Column:
        state, new = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], new).alias("out"))

    def outer(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(acc["state"].alias("state"), F.array().cast(out).alias("out")), inner)
        return F.struct(done["state"].alias("state"), F.concat(acc["out"], F.array(done["out"])).alias("out"))

    start = F.struct(zero.alias("state"), F.array().cast(f"array<{out}>").alias("out"))
    return F.aggregate(slices, start, outer, lambda acc: F.struct(acc["state"].alias("state"), F.flatten(acc["out"]).alias("out")))


def located(text: Column, pattern: str, before: int = 0) -> Column:
    """Leftmost non-overlapping matches of a pattern: array of (start, end, m), code points, from 0, end exclusive; with `before`, also (near),
    up to so many code points in front of the match."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("near"))

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        start = state["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        near = F.substring(F.concat(state["near"], x["gap"]), -before, before) if before else F.lit("")
        span = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"), *([near.alias("near")] if before else []))
        after = F.substring(F.concat(near, x["m"]), -before, before) if before else F.lit("")
        return F.struct(end.alias("at"), after.alias("near")), F.when(x["m"].isNull(), F.array().cast(kind)).otherwise(F.array(span))

    kind = "array<struct<start:int,end:int,m:string" + (",near:string>>" if before else ">>")
    return scan(parts, zero, step, kind)["out"]


def pieces(text: Column, cuts: Column, width: int = 1024) -> Column:
    """The stretches of a text given by `cuts`, an array of (start, end): array of strings. The text is cut into chunks of `width` code points first,
    since a substring of the whole would be sought from its start."""
    all_ = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))

    def one(chunks: Column, c: Column) -> Column:
        first, last = F.floor(c["start"] / width).cast("int"), F.floor((c["end"] - 1) / width).cast("int")
        within = F.array_join(F.slice(chunks, first + 1, last - first + 1), "")
        return F.when(c["end"] > c["start"], F.substring(within, c["start"] - first * width + 1, c["end"] - c["start"])).otherwise(F.lit(""))

    return bound(all_, lambda chunks: F.transform(cuts, lambda c: one(chunks, c)))


def joined(spans: Column, kind: Callable[[Column], Column] = lambda s: s["kind"]) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))))
