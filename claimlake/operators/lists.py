"""Page lists: numbered lines, items and levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlake.functions.binding import let
from claimlake.functions.multisets import piece
from claimlake.functions.rows import rows_of
from claimlake.functions.text import process_text

#: Entries of a list that are numbered together.
BLOCK = 128

LIST_TYPE = "type STRING, list ARRAY<STRUCT<id: STRING, value: STRING, level: INT, type: STRING>>"


def list_status(lst: Column) -> Column:
    entries = F.coalesce(lst["list"], F.array())
    bad = lst["list"].isNull() | F.exists(
        entries,
        lambda e: e["value"].isNull() | e["level"].isNull() | e["id"].isNull() | (e["level"] < 0),
    )
    blank = F.forall(entries, lambda e: F.coalesce(e["value"], F.lit("")) == "")
    return F.when(lst["list"].isNotNull() & blank, "empty").when(bad, "format_error").otherwise("ok")


def _set(a: Column, at: Column, value: Column) -> Column:
    return F.transform(a, lambda x, i: F.when(i == at, value).otherwise(x))


def _mark(kind: Column, count: Column) -> Column:
    number = F.when(kind == "ordered_list", count + 1).when(kind == "unordered_list", F.lit(0)).otherwise(count)
    mark = F.when(kind == "ordered_list", F.concat((count + 1).cast("string"), F.lit(". "))).when(kind == "unordered_list", F.lit("- "))
    return F.struct(number.alias("number"), mark.alias("mark"))


def lines_of(list_type: Column, entries: Column) -> Column:
    """``array<struct(id, level, mark, text)>`` of the entries that show.

    The state of the fold holds the type and the counter of each level that the list has, however deep. An entry
    that carries a type sets it for the level below; going up resets the counter of the deeper level.
    """
    own = F.transform(entries, lambda e: e["level"])
    known = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), own, F.transform(own, lambda x: x + 1))))
    return let(known, entries, lambda levels, es: _folded(list_type, es, levels))


def _folded(list_type: Column, entries: Column, levels: Column) -> Column:
    place = lambda level: (F.array_position(levels, level) - 1).cast("int")
    types = F.transform(levels, lambda x: F.when(x == 0, list_type))
    line = "array<struct<id:string,level:int,mark:string,text:string>>"
    state = lambda types_, counts, level, lines: F.struct(types_.alias("types"), counts.alias("counts"), level.alias("level"), lines.alias("lines"))
    none = F.array().cast(line)

    def step(s: Column, e: Column) -> Column:
        return let(place(e["level"]), lambda level: at_level(s, e, level))

    def at_level(s: Column, e: Column, level: Column) -> Column:
        below = place(e["level"] + 1)
        types_ = F.when(e["type"].isNotNull(), _set(s["types"], below, e["type"])).otherwise(s["types"])
        counts = F.when(s["level"] > level, _set(s["counts"], s["level"], F.lit(0))).otherwise(s["counts"])
        return let(types_, counts, lambda types, counts: let(_mark(types[level], counts[level]), lambda m: after(s, e, level, types, counts, m)))

    def after(s: Column, e: Column, level: Column, types: Column, counts: Column, m: Column) -> Column:
        made = F.struct(
            e["id"].alias("id"), e["level"].alias("level"), m["mark"].alias("mark"), process_text(e["value"]).alias("text")
        )
        shows = m["mark"].isNotNull() & (e["value"] != "")
        return F.struct(
            types.alias("types"),
            _set(counts, level, m["number"]).alias("counts"),
            level.alias("level"),
            F.when(shows, F.concat(s["lines"], F.array(made).cast(line))).otherwise(s["lines"]).alias("lines"),
        )

    # appending copies the lines so far, so a block of entries makes a block of lines, and blocks are put together at the end
    def blocks(es: Column, size: Column) -> Column:
        count = F.ceil(size / BLOCK).cast("int")
        cut = F.transform(F.sequence(F.lit(0), count - 1), lambda b: piece(es, b * BLOCK, F.least(F.lit(BLOCK), size - b * BLOCK)))
        return F.when(size > 0, cut).otherwise(F.array())

    def block(s: Column, es: Column) -> Column:
        end = F.aggregate(es, state(s["types"], s["counts"], s["level"], none), step)
        return let(end, lambda e: state(e["types"], e["counts"], e["level"], F.concat(s["lines"], F.array(e["lines"]))))

    start = state(types, F.transform(levels, lambda x: F.lit(0)), place(F.lit(0)), F.array().cast(f"array<{line}>"))
    return F.aggregate(let(entries, F.size(entries), blocks), start, block, lambda s: F.flatten(s["lines"]))


def line_text(line: Column) -> Column:
    return F.concat(F.repeat(F.lit("[SUB] "), line["level"]), line["mark"], line["text"])


def list_text(list_type: Column, entries: Column) -> Column:
    return F.array_join(F.transform(lines_of(list_type, entries), line_text), "\n")


def _lists(parsed: DataFrame) -> DataFrame:
    only = F.filter("elements", lambda e: (e["kind"] == "list") & (e["status"] == "ok"))
    return parsed.transform(rows_of, ["page_id"], only, "e").select(
        "page_id", F.col("e.key").alias("list_key"), "e.list_type", "e.entries"
    )


def list_lines(parsed: DataFrame) -> DataFrame:
    """``(page_id, list_key, line_no, level, line)`` with ``[SUB] `` per level and ``- `` or ``n. ``."""
    made = _lists(parsed).transform(rows_of, ["page_id", "list_key"], lines_of(F.col("list_type"), F.col("entries")), "l", "line_no")
    return made.select("page_id", "list_key", "line_no", "l.level", line_text(F.col("l")).alias("line"))


def list_items(parsed: DataFrame) -> DataFrame:
    """``(page_id, list_key, item_id, text)`` of every entry."""
    made = _lists(parsed).transform(rows_of, ["page_id", "list_key"], "entries", "i")
    return made.select("page_id", "list_key", F.col("i.id").alias("item_id"), process_text("i.value").alias("text"))


def list_by_level(parsed: DataFrame) -> DataFrame:
    """``(page_id, list_key, level, contents)``: shown entries of a level in order, numbered ones with number."""
    page = _lists(parsed).select("page_id", "list_key", lines_of(F.col("list_type"), F.col("entries")).alias("_lines"))
    levels = F.array_distinct(F.transform("_lines", lambda l: l["level"]))
    shown = lambda l: F.when(l["mark"] == "- ", l["text"]).otherwise(F.concat(l["mark"], l["text"]))
    return page.transform(rows_of, ["page_id", "list_key", "_lines"], levels, "level").select(
        "page_id",
        "list_key",
        "level",
        F.transform(F.filter("_lines", lambda l: l["level"] == F.col("level")), shown).alias("contents"),
    )
