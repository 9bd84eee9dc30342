"""Content and context of any evidence id of a page, as long tables and as lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlake.functions.binding import let
from claimlake.functions.rows import rows_of
from claimlake.functions.text import process_text
from claimlake.operators.outline import outline, section_chain
from claimlake.operators.pages import caption_id, ids_of, parse_pages, text_of
from claimlake.operators.tables import cell_text, header_context

_ENTRY = "array<struct<local_id:string,kind:string,text:string>>"
_PART = "array<struct<id:string,text:string>>"
_CONTEXT = f"array<struct<local_id:string,context:{_PART}>>"
_FOUND = f"array<struct<local_id:string,text:string,sections:array<string>,headers:{_PART}>>"


def _contents_of(e: Column) -> Column:
    own = F.array(F.struct(e["key"].alias("local_id"), e["kind"].alias("kind"), text_of(e).alias("text")))
    last_slots = F.filter(F.flatten(e["grid"]), lambda c: c["last"])
    cells = F.transform(
        last_slots,
        lambda c: F.struct(
            c["id"].alias("local_id"), F.when(c["is_header"], "header_cell").otherwise("cell").alias("kind"), cell_text(c).alias("text")
        ),
    )
    caption = F.array(F.struct(caption_id(e["key"]).alias("local_id"), F.lit("table_caption").alias("kind"), e["caption"].alias("text")))
    items = F.transform(
        e["entries"], lambda i: F.struct(i["id"].alias("local_id"), F.lit("item").alias("kind"), process_text(i["value"]).alias("text"))
    )
    return (
        F.when(e["kind"] == "table", F.concat(own.cast(_ENTRY), cells.cast(_ENTRY), caption.cast(_ENTRY)))
        .when(e["kind"] == "list", F.concat(own.cast(_ENTRY), items.cast(_ENTRY)))
        .otherwise(own.cast(_ENTRY))
    )


def contents(parsed: DataFrame) -> DataFrame:
    """``(page_id, local_id, kind, text)`` of everything on a page that can be cited."""
    ok = F.filter("elements", lambda e: e["status"] == "ok")
    return parsed.transform(rows_of, ["page_id"], F.flatten(F.transform(ok, _contents_of)), "c").select(
        "page_id", "c.local_id", "c.kind", "c.text"
    )


def wanted_pages(pages: DataFrame, ids: DataFrame) -> DataFrame:
    """The cited pages, parsed, each with ``_wanted``: the different ids that are asked of it.

    ``pages`` is a raw page table ``(page_id, data)``, of which only cited pages get parsed, or a parsed one. Ids are
    combined before they move, so a page that is cited very often has each of its ids once.
    """
    wanted = ids.where(F.col("local_id").isNotNull()).groupBy("page_id").agg(F.collect_set("local_id").alias("_wanted"))
    kept = pages.join(wanted, "page_id")
    kept = kept if "elements" in kept.columns else parse_pages(kept, ("_wanted",))
    # elements without a wanted id are left before anything is made of them
    hit = lambda wanted_: F.filter("elements", lambda e: F.arrays_overlap(ids_of(e), wanted_) | F.array_contains(wanted_, e["key"]))
    return kept.withColumn("_hit", let(F.col("_wanted"), hit))


def content(pages: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids`` (with ``page_id``, ``local_id``) plus ``text`` and ``found``; unknown ids get an empty text.

    Wanted ids are looked up in the row of their page, and only what is found is put beside the ids. An id has one
    text, so an id cited very often makes one side of that join large only; adaptive execution splits that side.
    """
    ok = lambda hit: F.flatten(F.transform(F.filter(hit, lambda e: e["status"] == "ok"), _contents_of))
    known = let(F.col("_wanted"), ok(F.col("_hit")), lambda wanted, found: F.filter(found, lambda c: F.array_contains(wanted, c["local_id"])))
    rows = wanted_pages(pages, ids).transform(rows_of, ["page_id"], known, "c").select("page_id", "c.local_id", "c.text")
    joined = ids.join(rows, ["page_id", "local_id"], "left")
    return joined.withColumn("found", F.col("text").isNotNull()).withColumn("text", F.coalesce("text", F.lit("")))


def _contexts_of(e: Column, title: Column, outlined: Column, wanted: Column | None = None) -> Column:
    chain = F.transform(section_chain(outlined, e["pos"]), lambda s: F.struct(s["key"].alias("id"), s["text"].alias("text")))
    head = F.array(F.struct(F.lit("_title").alias("id"), title.alias("text")))
    entry = lambda local, parts: F.struct(local.alias("local_id"), parts.alias("context"))

    def all_of(p: Column) -> Column:
        titled = F.concat(head.cast(_PART), p)
        cells = F.transform(
            header_context(e["grid"], wanted),
            lambda c: entry(
                c["id"],
                F.when(F.startswith(c["id"], F.lit("header_cell_")), titled).otherwise(
                    F.concat(p, c["row_headers"].cast(_PART), c["col_headers"].cast(_PART))
                ),
            ),
        )
        return (
            F.when(e["kind"] == "table", F.concat(cells, F.array(entry(caption_id(e["key"]), titled))))
            .when(e["kind"] == "list", F.transform(e["entries"], lambda i: entry(i["id"], titled)))
            .when(e["kind"] == "sentence", F.array(entry(e["key"], titled)))
        )

    # bind the section chain to a variable, so it is made once per element
    return F.flatten(F.transform(F.array(chain.cast(_PART)), all_of))


def contexts(parsed: DataFrame) -> DataFrame:
    """``(page_id, local_id, context)``, context being ``array<struct(id, text)>``.

    Sentences, list items, captions and header cells: the title, then the enclosing sections. Other cells:
    the sections around the table, then their row headers and column headers.
    """
    made = lambda outlined, shown_: F.flatten(F.transform(shown_, lambda e: F.coalesce(_contexts_of(e, F.col("title"), outlined), F.array().cast(_CONTEXT))))
    every = let(outline(), F.filter("elements", lambda e: e["pos"].isNotNull()), made)
    return parsed.transform(rows_of, ["page_id"], every, "c").select("page_id", "c.local_id", "c.context")


def context(pages: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids`` (with ``page_id``, ``local_id``) plus ``context``; ids without one get an empty array."""
    made = lambda outlined, hit, wanted: F.flatten(
        F.transform(hit, lambda e: F.coalesce(F.filter(_contexts_of(e, F.col("title"), outlined, wanted), lambda c: F.array_contains(wanted, c["local_id"])), F.array().cast(_CONTEXT)))
    )
    found = let(outline(), F.filter("_hit", lambda e: e["pos"].isNotNull()), F.col("_wanted"), made)
    known = wanted_pages(pages, ids).transform(rows_of, ["page_id"], found, "c").select("page_id", "c.local_id", "c.context")
    joined = ids.join(known, ["page_id", "local_id"], "left")
    return joined.withColumn("context", F.coalesce("context", F.array().cast(_PART)))


def evidence_parts(pages: DataFrame, ids: DataFrame) -> DataFrame:
    """``page_id, local_id, text, sections, headers`` of the wanted sentences, cells and captions of well-formed
    elements: a sentence has the texts of its sections, a cell the header cells over and before it."""
    plain = lambda local, text, sections: F.struct(local.alias("local_id"), text.alias("text"), sections.alias("sections"), F.array().cast(_PART).alias("headers"))
    none = F.array().cast("array<string>")
    texts = lambda outlined, e: F.when(e["pos"].isNotNull(), F.transform(section_chain(outlined, e["pos"]), lambda s: s["text"])).otherwise(none)
    heads = lambda c: F.filter(F.concat(c["row_headers"], c["col_headers"]), lambda h: F.contains(h["id"], F.lit("header_cell_"))).cast(_PART)
    cells = lambda e, wanted: F.transform(
        header_context(e["grid"], wanted), lambda c: F.struct(c["id"].alias("local_id"), c["text"].alias("text"), none.alias("sections"), heads(c).alias("headers"))
    )
    captions = lambda e, wanted: F.when(F.array_contains(wanted, caption_id(e["key"])), F.array(plain(caption_id(e["key"]), e["caption"], none)))
    part = lambda outlined, e, wanted: F.when(e["kind"] == "table", F.concat(cells(e, wanted).cast(_FOUND), F.coalesce(captions(e, wanted), F.array()).cast(_FOUND))).when(
        (e["kind"] == "sentence") & F.array_contains(wanted, e["key"]), F.array(plain(e["key"], e["text"], texts(outlined, e))).cast(_FOUND)
    )
    made = lambda outlined, hit, wanted: F.flatten(F.transform(hit, lambda e: F.coalesce(part(outlined, e, wanted), F.array().cast(_FOUND))))
    found = let(outline(), F.filter("_hit", lambda e: e["status"] == "ok"), F.col("_wanted"), made)
    return wanted_pages(pages, ids).transform(rows_of, ["page_id"], found, "f").select("page_id", "f.*")
