"""Places of regular expression matches, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimlake.functions.binding import let

SPAN = "array<struct<start:int,end:int,piece:string>>"
BLOCK = 128


def running_totals(lengths: Column) -> Column:
    """Running sums of an int array. Appending copies the array, so it is done block by block and then over blocks."""
    within = lambda xs: F.aggregate(
        xs, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x))
    )
    last = lambda xs: F.coalesce(F.try_element_at(xs, F.lit(-1)), F.lit(0))
    cut = lambda xs: F.transform(F.sequence(F.lit(0), F.ceil(F.size(xs) / BLOCK).cast("int") - 1), lambda b: within(F.slice(xs, b * BLOCK + 1, BLOCK)))
    starts = lambda blocks: F.aggregate(
        blocks, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + last(b)))
    )
    moved = lambda blocks, at: F.flatten(F.zip_with(blocks, F.slice(at, 1, F.size(blocks)), lambda b, s: F.transform(b, lambda x: x + s)))
    whole = lambda xs: let(cut(xs), lambda blocks: let(blocks, starts(blocks), moved))
    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).when(F.size(lengths) <= BLOCK, within(lengths)).otherwise(whole(lengths))


def matches(text: Column, pattern: str) -> Column:
    """``start, end, piece`` of all leftmost non-overlapping matches, in code points, end exclusive.

    ``pattern`` matches at least one character. Null text: null.
    """
    none = F.array().cast(SPAN)
    gaps = lambda t: F.split(t, pattern, -1)

    def placed(found: Column, parts: Column) -> Column:
        steps = F.zip_with(found, F.slice(parts, 1, F.size(found)), lambda f, p: F.length(f) + F.length(p))
        ends = lambda totals: F.zip_with(
            found, totals, lambda f, e: F.struct((e - F.length(f)).alias("start"), e.alias("end"), f.alias("piece"))
        )
        return let(steps, lambda s: let(running_totals(s), ends))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, text, lambda f, t: F.when(F.size(f) == 0, none).otherwise(let(f, gaps(t), placed)))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of an array of ``start, rank, end, kind`` structs, by start, then rank, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def ranked(spans: Column, kind: str, rank: int) -> Column:
    """Spans with their kind, in the form that ``joined`` sorts."""
    return F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")),
    )
