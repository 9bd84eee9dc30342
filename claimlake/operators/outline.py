"""Column helpers over the element array of a parsed page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimlake.functions.binding import let
from claimlake.functions.multisets import last_before, piece, run_starts


def shown(elements: Column | str = "elements") -> Column:
    """The elements of the page order."""
    return F.filter(elements, lambda e: e["pos"].isNotNull())


def outline(elements_: Column | str = "elements") -> Column:
    """The shown sections ``struct(sections, nearest, groups, group_of, from)`` in a form that knows each one's chain.

    Neighbouring sections of one level are a group, of which the last counts. Going back from a section, groups are
    taken while they are less deep; so the groups of a chain are neighbours, from the first one after a deeper group on.
    All of it is worked out in passes over the sections; a chain is then a slice.
    """
    found = F.transform(
        F.filter(elements_, lambda e: (e["kind"] == "section") & e["pos"].isNotNull()),
        lambda e: F.struct(e["key"].alias("key"), e["pos"].alias("pos"), e["level"].alias("level"), e["text"].alias("text")),
    )
    size = F.coalesce(F.array_max(F.transform(elements_, lambda e: e["pos"])), F.lit(-1)) + 1

    def grouped(sections: Column, n: Column) -> Column:
        begins = run_starts(sections, lambda a, b: ~a["level"].eqNullSafe(b["level"]))
        lasts = lambda at: F.filter(F.transform(sections, lambda s, i: F.when(~F.get(at, i).eqNullSafe(F.get(at, i + 1)), s)), lambda s: s.isNotNull())
        # the number of a section's group: how many groups begin at it or before it, less one
        numbers = lambda at: F.slice(last_before(F.array_distinct(at), F.size(sections) + 1), 2, F.size(sections))
        return let(begins, lambda at: let(lasts(at), lambda groups: F.struct(
            sections.alias("sections"),
            last_before(F.transform(sections, lambda s: s["pos"]), n).alias("nearest"),
            groups.alias("groups"),
            numbers(at).alias("group_of"),
            run_starts(groups, lambda s, last: ~F.coalesce(last["level"] < s["level"], F.lit(True))).alias("from"),
        )))

    return let(found, size, grouped)


def section_chain(outlined: Column, pos: Column) -> Column:
    """Enclosing sections of a page position, innermost first, from an ``outline``.

    Going back, the nearest section is taken, then every section that is less deep than the one taken
    last; a deeper one ends the walk and one of equal depth is passed over.
    """

    def chain(n: Column) -> Column:
        group = F.get(outlined["group_of"], n)
        first = F.get(outlined["from"], group)
        outer = F.reverse(piece(outlined["groups"], first, group - first))
        return F.when(n >= 0, F.concat(F.array(F.get(outlined["sections"], n)), outer)).otherwise(F.array())

    return let(F.coalesce(F.get(outlined["nearest"], pos), F.lit(-1)), chain)
