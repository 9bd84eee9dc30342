"""Paragraphs, sections, links and corpora of a document table.

A document is one row and its parts are arrays inside that row, so splitting needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlake.functions.rows import rows_of
from claimlake.functions.text import extract_links, strip_tags
from claimlake.functions.titles import ensure_suffix, normalize_title, normalize_titles, title_of, wiki_id
from claimlake.session import keep_listed, spread_join

BLANK_LINE = "\n\n"
SECTION_MARK = "Section::::"


def paragraphs(docs: DataFrame, decompose: bool = True) -> DataFrame:
    """``(id, pos, text, links)``: one row per blank-line paragraph, tags removed, link titles in order."""
    parts = docs.transform(rows_of, ["id"], F.split("text", BLANK_LINE), "raw", "pos")
    links = extract_links("raw")
    return parts.select(
        "id", "pos", strip_tags("raw").alias("text"), (normalize_titles(links) if decompose else links).alias("links")
    )


def paragraph_table(docs: DataFrame, ids: DataFrame | None = None, decompose: bool = True) -> DataFrame:
    """Paragraphs without the title paragraph, keyed ``title_i`` from 0, for the wanted ids."""
    if ids is not None:
        docs = keep_listed(docs, ids.select(ensure_suffix("id").alias("id")), ["id"])
    body = paragraphs(docs, decompose).where("pos > 0")
    key = wiki_id(title_of("id"), F.col("pos") - 1)
    return body.select("id", key.alias("paragraph_id"), (F.col("pos") - 1).alias("pos"), "text", "links")


def missing_documents(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Wanted ids that no document has."""
    return ids.select(ensure_suffix("id").alias("id")).join(docs.select("id"), "id", "left_anti")


#: Fixed value: paragraphs of a child section count from so many characters on.
LEAST_PARAGRAPH = 11


def sections(docs: DataFrame, least_paragraph: int = LEAST_PARAGRAPH) -> DataFrame:
    """``(id, pos, section_name, type, parent_section_name, paragraphs)`` per section mark.

    The text before the first mark is the introduction when it has a second, non-empty paragraph. A section
    with nothing but its name is a parent of the sections after it. Child paragraphs of fewer than
    ``least_paragraph`` characters are dropped.
    """
    marked = F.transform(F.split("text", SECTION_MARK), lambda section, pos: _read_section(section, pos, least_paragraph))
    # parents and the introduction name the parent of whatever follows
    naming = F.transform(
        F.filter(F.col("_sections"), lambda s: s["type"] != "child"),
        lambda s: F.struct(s["pos"].alias("pos"), s["section_name"].alias("name")),
    )

    def parent_of(s: Column) -> Column:
        before = F.filter(F.col("_naming"), lambda n: n["pos"] < s["pos"])
        nearest = F.coalesce(F.get(before, F.size(before) - 1)["name"], F.lit(""))
        return F.when(s["type"] == "intro", s["section_name"]).when(s["type"] == "child", nearest)

    return (
        docs.select("id", marked.alias("_sections"))
        .withColumn("_naming", naming)
        .transform(rows_of, ["id", "_naming"], "_sections", "s")
        .select(
            "id",
            F.col("s.pos").alias("pos"),
            F.col("s.section_name").alias("section_name"),
            F.col("s.type").alias("type"),
            parent_of(F.col("s")).alias("parent_section_name"),
            F.col("s.paragraphs").alias("paragraphs"),
        )
    )


def _read_section(section: Column, pos: Column, least: int) -> Column:
    parts = F.split(section, BLANK_LINE)
    is_intro = (pos == 0) & (F.length(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))) > 0)
    has_name = F.contains(section, F.lit("\n"))
    body = F.when(has_name, F.substring(section, F.instr(section, "\n") + 1, F.length(section))).otherwise(section)
    kind = F.when(is_intro, F.lit("intro")).when(F.length(body) == 0, F.lit("parent")).otherwise(F.lit("child"))
    name = F.when(is_intro, F.lit("Introduction")).when(has_name, F.substring_index(section, "\n", 1))
    kept = (
        F.when(is_intro, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))))
        .when(F.length(body) == 0, F.array().cast("array<string>"))
        .otherwise(F.filter(F.split(body, BLANK_LINE), lambda p: F.length(p) >= least))
    )
    return F.struct(pos.alias("pos"), name.alias("section_name"), kind.alias("type"), kept.alias("paragraphs"))


def link_edges(docs: DataFrame, decompose: bool = True) -> DataFrame:
    """``(src_id, pos, dst_title)``, one row per link of a document."""
    edges = docs.transform(rows_of, [F.col("id").alias("src_id")], "links", "raw", "pos")
    return edges.select("src_id", "pos", (normalize_title("raw") if decompose else F.col("raw")).alias("dst_title"))


def linked_documents(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the id of the document they lead to; dangling links keep a null.

    One title may be the target of very many links, so the join spreads such titles.
    """
    targets = docs.select(title_of("id").alias("dst_title"), F.col("id").alias("dst_id"))
    return spread_join(edges, targets, ["dst_title"], [F.col("src_id"), F.col("pos")])


def lookup(docs: DataFrame, ids: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """The asked columns for every wanted id; ids without a document get nulls and ``found`` false."""
    wanted = docs.select(key, *columns, F.lit(True).alias("_hit"))
    return ids.join(wanted, key, "left").select(
        *ids.columns, *columns, F.coalesce("_hit", F.lit(False)).alias("found")
    )


def corpus_from_documents(docs: DataFrame, compat: bool = False) -> DataFrame:
    """``(id, contents)`` for the search index."""
    return docs.select(title_of("id", compat).alias("id"), F.col("text").alias("contents"))
