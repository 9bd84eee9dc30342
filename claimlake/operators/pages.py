"""Page JSON to elements, and what can be said about an element from its page alone.

A page is one row. ``parse_pages`` turns its JSON into one array of elements in that row; neighbours,
enclosing sections, page text and quality counters are computed on the array. So none of them shuffles, and
no page is ever put together again from exploded rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlake.functions.rows import rows_of
from claimlake.functions.binding import let
from claimlake.functions.text import process_text, strip
from claimlake.operators.lists import LIST_TYPE, list_status, list_text
from claimlake.operators.outline import outline, section_chain, shown
from claimlake.operators.tables import TABLE_TYPE, expand_spans, fill_grid, grid_text, layout_of

_SECTION_TYPE = "value STRING, level INT"
_BODY = "map<string,string>"


def _json_map(data: Column) -> Column:
    """Top-level members of a JSON object; nested members stay JSON text."""
    return F.from_json(data, _BODY)


# Place of elements that the page order does not list: after all others.
UNLISTED = 2**31 - 1


def _kind(key: Column) -> Column:
    return F.when(key.rlike("^(sentence|section|table|list)_"), F.substring_index(key, "_", 1))


def parse_pages(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(page_id, title, elements)`` of a page table ``(page_id, data)``, and the columns to ``keep``.

    Each element is ``struct(key, kind, pos, status, text, level, caption, grid, list_type, entries)``.
    Elements stand in page order; ``pos`` counts the well-formed ones and is null for elements the page does
    not list. ``status`` is ``ok``, ``empty`` or ``format_error``.
    """
    page = pages.select("page_id", *keep, _json_map(F.col("data")).alias("_m"))
    page = page.select(
        "page_id",
        *keep,
        strip(F.coalesce(F.col("_m")["title"], F.col("page_id").cast("string"))).alias("title"),
        F.coalesce(F.from_json(F.col("_m")["order"], "array<string>"), F.array().cast("array<string>")).alias("_order"),
        F.transform(
            F.filter(F.map_entries(F.coalesce("_m", F.create_map().cast(_BODY))), lambda e: _kind(e["key"]).isNotNull()),
            lambda e: F.struct(
                e["key"].alias("key"),
                _kind(e["key"]).alias("kind"),
                e["value"].alias("raw"),
                F.when(_kind(e["key"]) == "section", F.from_json(e["value"], _SECTION_TYPE)).alias("section"),
                F.when(_kind(e["key"]) == "table", F.from_json(e["value"], TABLE_TYPE)).alias("tab"),
                F.when(_kind(e["key"]) == "list", F.from_json(e["value"], LIST_TYPE)).alias("lst"),
            ),
        ).alias("_raw"),
    )
    page = page.withColumn("_layouts", F.transform("_raw", lambda e: layout_of(e["tab"])))
    # only pages with a table that has spans or ragged rows send something to Python
    page = page.withColumn("_grids", expand_spans(F.col("_layouts")))
    parts = F.arrays_zip(
        F.col("_raw").alias("raw"), F.col("_layouts").alias("layout"), F.coalesce("_grids", F.array()).alias("grid")
    )
    page = page.select("page_id", *keep, "title", "_order", "_raw", F.transform(parts, _grid).alias("_grid"))
    page = page.select("page_id", *keep, "title", "_order", F.zip_with("_raw", "_grid", _element).alias("_shaped"))
    return page.select("page_id", *keep, "title", let(F.col("_shaped"), F.col("_order"), _in_order).alias("elements"))


def _in_order(shaped: Column, order: Column) -> Column:
    """The elements in page order, numbered. What is sorted are keys and places: a transform copies all that it hands on,
    so the elements with their tables and lists are fetched once, at the end."""
    numbered = lambda placed: F.transform(_numbered(placed), lambda n: _with_pos(F.get(shaped, n["i"]), n["pos"]))
    return let(let(_rows(shaped, order), _placed), numbered)


def _rows(shaped: Column, order: Column) -> Column:
    """Sorted by key, an element comes right after its entry in the order, which gives its place."""
    none = F.lit(None).cast("int")
    row = lambda key, own, at, i, ok: F.struct(key.alias("key"), F.lit(own).alias("own"), at.alias("at"), i.alias("i"), ok.alias("ok"))
    listed = F.transform(F.array_distinct(order), lambda key, i: row(key, False, i, none, F.lit(False)))
    elements_ = F.transform(shaped, lambda e, i: row(e["key"], True, none, i, e["status"] == "ok"))
    return F.array_sort(F.concat(listed, elements_))


def _placed(rows: Column) -> Column:
    before = lambda i: F.get(rows, i - 1)
    known = lambda x, i: (before(i)["key"] == x["key"]) & ~before(i)["own"]
    at = lambda x, i: F.when(known(x, i), before(i)["at"]).otherwise(F.lit(UNLISTED))
    place = lambda x, i: F.when(x["own"], F.struct(at(x, i).alias("at"), x["key"].alias("key"), x["i"].alias("i"), x["ok"].alias("ok")))
    return F.array_sort(F.filter(F.transform(rows, place), lambda x: x.isNotNull()))


def _numbered(placed: Column) -> Column:
    """Number the elements that the page lists and that are well-formed; the order stays."""
    shows = lambda p: (p["at"] != UNLISTED) & p["ok"]
    row = lambda p, pos: F.struct(p["at"].alias("at"), p["key"].alias("key"), p["i"].alias("i"), pos.alias("pos"))
    shown = F.transform(F.filter(placed, shows), lambda p, n: row(p, n))
    hidden = F.transform(F.filter(placed, lambda p: ~shows(p)), lambda p: row(p, F.lit(None).cast("int")))
    return F.array_sort(F.concat(shown, hidden))


def _grid(part: Column) -> Column:
    return F.when(part["raw"]["kind"] == "table", fill_grid(part["raw"]["tab"], part["layout"], part["grid"]))


def _status(e: Column, grid: Column) -> Column:
    rows = F.size(e["tab"]["table"])
    return (
        F.when(e["kind"] == "table", F.when(rows == 0, "empty").when((rows > 0) & grid.isNotNull(), "ok").otherwise("format_error"))
        .when(e["kind"] == "list", list_status(e["lst"]))
        .when((e["kind"] == "section") & (e["section"]["value"].isNull() | e["section"]["level"].isNull()), "format_error")
        .otherwise("ok")
    )


def _element(e: Column, grid: Column) -> Column:
    text = F.when(e["kind"] == "sentence", process_text(e["raw"])).when(e["kind"] == "section", e["section"]["value"])
    return F.struct(
        e["key"].alias("key"),
        e["kind"].alias("kind"),
        _status(e, grid).alias("status"),
        text.alias("text"),
        e["section"]["level"].alias("level"),
        F.when(e["kind"] == "table", F.coalesce(e["tab"]["caption"], F.lit(""))).alias("caption"),
        grid.alias("grid"),
        e["lst"]["type"].alias("list_type"),
        F.when(_status(e, grid) == "ok", e["lst"]["list"]).alias("entries"),
    )


def _with_pos(e: Column, at: Column) -> Column:
    return F.struct(
        e["key"].alias("key"),
        e["kind"].alias("kind"),
        at.alias("pos"),
        *[e[name].alias(name) for name in ("status", "text", "level", "caption", "grid", "list_type", "entries")],
    )


def text_of(e: Column) -> Column:
    """Text of an element. Tables and lists are rendered here, only where a text is asked for."""
    rendered = (
        F.when(e["kind"] == "table", grid_text(e["grid"]))
        .when(e["kind"] == "list", process_text(list_text(e["list_type"], e["entries"])))
        .otherwise(e["text"])
    )
    return F.when(e["status"] == "ok", rendered)


def elements(parsed: DataFrame, intro: bool = False, contains: str | None = None) -> DataFrame:
    """``(page_id, title, key, kind, pos, status, text, level)``, one row per page element.

    ``intro`` keeps what the page shows before ``section_0``; a page that starts with it keeps everything.
    ``contains`` keeps keys with that part.
    """
    chosen = select_elements(parsed, intro, contains)
    return chosen.transform(rows_of, ["page_id", "title"], "elements", "e").select(
        "page_id", "title", "e.key", "e.kind", "e.pos", "e.status", text_of(F.col("e")).alias("text"), "e.level"
    )


def select_elements(parsed: DataFrame, intro: bool = False, contains: str | None = None) -> DataFrame:
    """Drop elements from the arrays of a parsed page table."""
    out = parsed
    if intro:
        first = F.get(F.transform(F.filter("elements", lambda e: e["key"] == "section_0"), lambda e: e["pos"]), F.lit(0))
        before = lambda all_, at: F.when(at > 0, F.filter(all_, lambda e: e["pos"] < at)).otherwise(all_)
        out = out.withColumn("elements", let(F.col("elements"), first, before))
    if contains is not None:
        out = out.withColumn("elements", F.filter("elements", lambda e: F.contains(e["key"], F.lit(contains))))
    return out


def page_quality(parsed: DataFrame) -> DataFrame:
    """Counters per page for empty and malformed tables and lists."""

    def count(kind: str, status: str) -> Column:
        return F.size(F.filter("elements", lambda e: (e["kind"] == kind) & (e["status"] == status)))

    return parsed.select(
        "page_id",
        count("table", "empty").alias("tables_empty"),
        count("table", "format_error").alias("tables_formatting_errors"),
        count("list", "empty").alias("list_empty"),
        count("list", "format_error").alias("list_formatting_errors"),
    )


def corpus_from_pages(pages: DataFrame) -> DataFrame:
    """``(id, contents)``: the title, a tab, and the sentences before the first section.

    Reads only the order list and the sentences of the JSON; tables and lists are not parsed.
    """
    title = strip(F.col("page_id").cast("string"))
    text = let(_json_map(F.col("data")), lambda m: let(F.from_json(m["order"], "array<string>"), lambda order: _intro_text(m, order)))
    return pages.select(F.col("page_id").alias("id"), F.concat(title, F.lit("\t"), text).alias("contents"))


def _intro_text(members: Column, order: Column) -> Column:
    first = F.array_position(order, F.lit("section_0"))
    # section_0 in first place leaves nothing to show, and then the whole page counts
    intro = F.when(first > 1, F.slice(order, F.lit(1), (first - 1).cast("int"))).otherwise(order)
    sentences = F.filter(intro, lambda k: F.startswith(k, F.lit("sentence_")) & members[k].isNotNull())
    return F.array_join(F.transform(sentences, lambda k: process_text(members[k])), " ")


def previous_k(parsed: DataFrame, k: int = 1) -> DataFrame:
    """For every shown element its up to ``k`` predecessors, nearest first."""
    return _neighbours(parsed, lambda all_, e: F.reverse(_slice(all_, F.greatest(e["pos"] - k, F.lit(0)), e["pos"])))


def next_k(parsed: DataFrame, k: int = 1) -> DataFrame:
    """For every shown element its up to ``k`` successors in page order."""
    return _neighbours(parsed, lambda all_, e: _slice(all_, e["pos"] + 1, e["pos"] + 1 + k))


def _slice(a: Column, start: Column, end: Column) -> Column:
    return F.slice(a, start + 1, F.greatest(F.least(end, F.size(a)) - start, F.lit(0)))


def _neighbours(parsed: DataFrame, pick) -> DataFrame:
    outline = F.transform(shown(), lambda e: F.struct(e["key"].alias("key"), e["pos"].alias("pos"), text_of(e).alias("text")))
    near = let(
        outline,
        lambda all_: F.transform(
            all_, lambda e: F.struct(e["key"].alias("key"), e["pos"].alias("pos"), pick(all_, e).alias("near"))
        ),
    )
    return (
        parsed.transform(rows_of, ["page_id"], near, "n")
        .transform(rows_of, ["page_id", "n.key", "n.pos"], "n.near", "m", "distance")
        .select("page_id", "key", "pos", (F.col("distance") + 1).alias("distance"), F.col("m.key").alias("near_key"), F.col("m.text").alias("near_text"))
    )


def section_context(parsed: DataFrame) -> DataFrame:
    """``(page_id, key, depth, section_key, section_text, level)``, innermost section first."""
    places = F.transform(shown(), lambda e: F.struct(e["key"].alias("key"), e["pos"].alias("pos")))
    chain_of = lambda e, outlined: F.struct(e["key"].alias("key"), section_chain(outlined, e["pos"]).alias("chain"))
    chains = let(outline(), places, lambda outlined, all_: F.transform(all_, lambda e: chain_of(e, outlined)))
    return (
        parsed.transform(rows_of, ["page_id"], chains, "c")
        .transform(rows_of, ["page_id", "c.key"], "c.chain", "s", "depth")
        .select("page_id", "key", "depth", F.col("s.key").alias("section_key"), F.col("s.text").alias("section_text"), "s.level")
    )


def page_text(parsed: DataFrame) -> DataFrame:
    """The shown elements as one text, a line break between them."""
    return parsed.select("page_id", F.array_join(F.transform(shown(), text_of), "\n").alias("text"))


def ids_of(e: Column) -> Column:
    """Ids of what can be cited in an element."""
    caption = F.array(caption_id(e["key"]))
    cells = F.transform(F.flatten(e["grid"]), lambda c: c["id"])
    return (
        F.when(e["kind"] == "table", F.concat(cells, caption))
        .when(e["kind"] == "list", F.transform(e["entries"], lambda i: i["id"]))
        .otherwise(F.array(e["key"]))
    )


def caption_id(table_key: Column) -> Column:
    """Id of the caption of a table."""
    return F.concat(F.lit("table_caption_"), F.substring_index(table_key, "_", -1))


def element_ids(parsed: DataFrame) -> DataFrame:
    """``(page_id, local_id)`` of everything on a page that can be cited, cells and items included."""
    ok = F.filter("elements", lambda e: e["status"] == "ok")
    return parsed.transform(rows_of, ["page_id"], F.flatten(F.transform(ok, ids_of)), "local_id")
