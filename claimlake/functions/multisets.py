"""Arrays as multisets, counted and compared within their row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimlake.functions.binding import let


def _runs(ordered: Column, differs) -> Column:
    """``at, size`` of the runs of equal neighbours; ``differs(value, last)`` says where a new one begins."""
    first = lambda x, i: F.when((i == 0) | differs(x, F.get(ordered, F.greatest(i - 1, F.lit(0)))), i)
    starts = F.filter(F.transform(ordered, first), lambda i: i.isNotNull())
    size = F.size(ordered)
    return let(starts, size, lambda at, n: F.transform(at, lambda a, j: F.struct(a.alias("at"), (F.coalesce(F.get(at, j + 1), n) - a).alias("size"))))


def piece(values: Column, at: Column, size: Column) -> Column:
    """``size`` elements from place ``at`` on, one by one: ``slice`` reads the whole array each time."""
    return F.when(size > 0, F.transform(F.sequence(at, at + size - 1), lambda k: F.get(values, k))).otherwise(F.array())


def multiset(values: Column) -> Column:
    """``array<struct<gram,n>>``: each value once, in order, with its count."""
    counted = lambda s: F.transform(_runs(s, lambda a, b: a != b), lambda r: F.struct(F.get(s, r["at"]).alias("gram"), r["size"].alias("n")))
    return let(F.sort_array(values), counted)


def side_counts(*sides: Column) -> Column:
    """``array<struct<gram,c0,c1,...>>``: each value of any side once, in order, with its count on each side."""
    tag = lambda x, i: F.transform(x, lambda g: F.struct(g.alias("gram"), F.lit(i).alias("side")))
    tagged = F.concat(*[tag(x, i) for i, x in enumerate(sides)])
    count = lambda run, i: F.size(F.filter(run, lambda e: e["side"] == i)).alias(f"c{i}")
    merged = lambda s: F.transform(
        _runs(s, lambda a, b: a["gram"] != b["gram"]),
        lambda r: let(piece(s, r["at"], r["size"]), lambda run: F.struct(F.get(run, F.lit(0))["gram"].alias("gram"), *[count(run, i) for i in range(len(sides))])),
    )
    return let(F.sort_array(tagged), merged)


def total(values: Column, of) -> Column:
    """Sum of ``of(value)``, whole numbers, over an array."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, v: acc + of(v))


def last_before(places: Column, size: Column) -> Column:
    """For each of ``size`` positions, how many of the ascending ``places`` come before it, less one; written in one go."""

    def filled(at: Column, n: Column) -> Column:
        upto = lambda k: F.coalesce(F.get(at, k + 1), n - 1)
        gaps = F.transform(at, lambda x, k: F.array_repeat(k, F.greatest(upto(k) - x, F.lit(0)).cast("int")))
        lead = F.array_repeat(F.lit(-1), F.least(F.coalesce(F.get(at, F.lit(0)) + 1, n), n).cast("int"))
        return F.concat(lead, F.flatten(gaps))

    return let(places, size, filled)


def run_starts(ordered: Column, differs) -> Column:
    """For each element of an array the place where its run of neighbours begins."""
    runs = lambda rs: F.flatten(F.transform(rs, lambda r: F.array_repeat(r["at"], r["size"])))
    return let(_runs(ordered, differs), runs)
