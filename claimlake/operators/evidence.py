"""Annotations: evidence sets, groups, texts and model input.

An annotation is one row with nested evidence, so grouping evidence of one claim works on its arrays. Only
fetching page content needs joins. Where ``pages`` is asked for, a raw page table is best: pages that no
evidence cites are then dropped before parsing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlake.functions.rows import rows_of
from claimlake.functions.binding import let
from claimlake.functions.text import is_number_text, strip
from claimlake.functions.titles import kind_of, local_id, page_of, table_no
from claimlake.operators import context as ctx
from claimlake.operators.filters import filter_evidence_kind, map_labels

_IDS = "array<string>"
SEPARATOR = " </s> "


def flat_ids(column: str = "evidence") -> Column:
    """All evidence ids of a claim over its sets, in order."""
    return F.flatten(F.transform(F.col(column), lambda s: s["content"]))


def flatten_evidence(ann: DataFrame) -> DataFrame:
    """One row per cited id; claims without evidence keep one row with nulls.

    ``verdict`` is the label; without any ``evidence`` it is ``SUPPORTS``. ``operations`` names what the annotator did.
    """
    done = F.transform("annotator_operations", lambda o: o["operation"]) if "annotator_operations" in ann.columns else F.lit(None)
    sets = ann.select(
        "id",
        F.when(F.col("evidence").isNull(), F.lit("SUPPORTS")).otherwise(F.col("label")).alias("verdict"),
        F.coalesce(done, F.array()).cast("array<string>").alias("operations"),
        F.size("evidence").alias("n_sets"),
        F.coalesce(F.size(flat_ids()) > 0, F.lit(False)).alias("has_evidence"),
        F.posexplode_outer("evidence").alias("set_no", "s"),
    )
    rows = sets.select("id", "verdict", "operations", "n_sets", "has_evidence", "set_no", F.posexplode_outer("s.content").alias("pos", "evidence_id"))
    return rows.select(
        "*", page_of("evidence_id").alias("page_id"), local_id("evidence_id").alias("local_id"), kind_of("evidence_id").alias("kind")
    )


def _type_of(evidence_id: Column) -> Column:
    has = lambda part: F.contains(evidence_id, F.lit(part))
    return (
        F.when(has("_cell_"), "TABLE").when(has("_sentence_"), "SENTENCE").when(has("_item_"), "LIST").when(has("_caption_"), "TABLE")
    )


def _set_type(s: Column) -> Column:
    types = F.array_compact(F.array_distinct(F.transform(s["content"], _type_of)))
    return F.when(F.size(types) > 1, F.lit("JOINT")).otherwise(F.get(types, F.lit(0)))


def evidence_type(ann: DataFrame) -> DataFrame:
    """``(id, set_no, set_type, claim_type)``; a set without a known kind has a null type."""
    types = ann.select("id", F.transform("evidence", _set_type).alias("_types"))
    claim = F.when(F.size("_types") > 1, F.lit("JOINT")).otherwise(F.get("_types", F.lit(0)))
    return types.transform(rows_of, ["id", claim.alias("claim_type")], "_types", "set_type", "set_no")


def _grouped(ids: Column, key) -> Column:
    """Ids by key, keys in first-seen order, as ``array<struct(key, ids)>``."""
    pairs = F.transform(ids, lambda e: F.struct(key(e).alias("key"), e.alias("id")))
    of_key = lambda keyed, k: F.transform(F.filter(keyed, lambda e: e["key"] == k), lambda e: e["id"])
    keys = lambda keyed: F.array_distinct(F.filter(F.transform(keyed, lambda k: k["key"]), lambda k: k.isNotNull()))
    return let(
        pairs,
        lambda keyed: F.transform(keys(keyed), lambda k: F.struct(k.alias("key"), of_key(keyed, k).alias("ids"))),
    )


def evidence_by_page(ann: DataFrame, ids: Column | None = None) -> DataFrame:
    """``(id, page_no, page_id, ids)``: evidence ids of a claim by page, pages in first-seen order."""
    groups = _grouped(flat_ids() if ids is None else ids, page_of)
    return ann.transform(rows_of, ["id"], groups, "g", "page_no").select(
        "id", "page_no", F.col("g.key").alias("page_id"), F.col("g.ids").alias("ids")
    )


def evidence_by_table(by_page: DataFrame) -> DataFrame:
    """Cell and caption ids of a claim and page by table number; other ids are left out."""
    groups = _grouped(F.col("ids"), table_no)
    return by_page.transform(rows_of, ["id", "page_no", "page_id"], groups, "g", "table_pos").select(
        "id", "page_no", "page_id", "table_pos", F.col("g.key").alias("table_no"), F.col("g.ids").alias("ids")
    )


def evidence_by_header(by_table: DataFrame, pages: DataFrame) -> DataFrame:
    """Distinct texts of the evidence cells under each header cell.

    ``(id, page_no, page_id, table_pos, table_no, header_id, header_text, header_no, texts)``; evidence that
    is a header itself is ignored. Headers stand in the order in which the evidence meets them.
    """
    cells = by_table.transform(rows_of, ["id", "page_no", "page_id", "table_pos", "table_no"], "ids", "evidence_id", "pos")
    cells = cells.where(kind_of("evidence_id") == "cell").withColumn("local_id", local_id("evidence_id"))
    known = ctx.evidence_parts(pages, cells)
    met = cells.join(known, ["page_id", "local_id"]).transform(rows_of, ["id", "page_no", "page_id", "table_pos", "table_no", "pos", "text"], "headers", "h", "header_pos")
    return (
        met.groupBy("id", "page_no", "page_id", "table_pos", "table_no", F.col("h.id").alias("header_id"), F.col("h.text").alias("header_text"))
        .agg(F.sort_array(F.collect_set("text")).alias("texts"), F.min(F.struct("pos", "header_pos")).alias("header_no"))
    )


def header_type(groups: DataFrame) -> DataFrame:
    """Adds ``header_type``: ``real`` when numbers are at least as many as other texts, else ``text``."""
    numbers = F.size(F.filter("texts", is_number_text))
    return groups.withColumn("header_type", F.when(numbers >= F.size("texts") - numbers, "real").otherwise("text"))


def _table_parts(page_id: Column, found: Column) -> Column:
    """Title, caption and a line per header from what is ``found`` of the evidence of one table, in evidence order.

    A line reads ``header is value ; header is other value.`` with sorted values; headers stand in the order in which
    the evidence meets them. The first caption counts, even if the page does not have it.
    """
    met = F.flatten(F.transform(found, lambda e: F.when(e["kind"] == "cell", F.transform(e["headers"], lambda h: F.struct(h["id"].alias("id"), h["text"].alias("head"), e["text"].alias("text")))).otherwise(F.array().cast("array<struct<id:string,head:string,text:string>>"))))
    named = lambda head: strip(F.get(F.split(head, r"\[H\] "), F.lit(1)))
    values = lambda every, k: F.array_sort(F.array_distinct(F.transform(F.filter(every, lambda m: (m["id"] == k["id"]) & m["head"].eqNullSafe(k["head"])), lambda m: m["text"])))
    line = lambda every, k: let(named(k["head"]), lambda name: F.concat(F.array_join(F.transform(values(every, k), lambda t: F.concat(name, F.lit(" is "), t)), " ; "), F.lit(".")))
    heads = lambda every: F.array_distinct(F.transform(every, lambda m: F.struct(m["id"].alias("id"), m["head"].alias("head"))))
    lines = let(met, lambda every: F.transform(heads(every), lambda k: line(every, k)))
    captions = F.transform(F.filter(found, lambda e: e["kind"] == "table_caption"), lambda e: F.coalesce(e["text"], F.lit("")))
    return F.concat(F.array(page_id), F.slice(captions, 1, 1), F.coalesce(F.filter(lines, lambda l: l.isNotNull()), F.array().cast(_IDS)))


def linearize_table_evidence(by_table: DataFrame, pages: DataFrame) -> DataFrame:
    """``(id, page_no, page_id, table_pos, table_no, parts)``: title, caption and a line per header."""
    key = ["id", "page_no", "page_id", "table_pos", "table_no"]
    cited = by_table.transform(rows_of, key, "ids", "evidence_id", "pos").select(*key, "pos", local_id("evidence_id").alias("local_id"), _cited_kind().alias("kind"))
    found = cited.join(ctx.evidence_parts(pages, cited), ["page_id", "local_id"], "left")
    # a claim's parts come from its own evidence array, so the list stays as short as that array
    whole = found.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("pos", "kind", "text", "headers"))).alias("_found"))
    return whole.select(*key, _table_parts(F.col("page_id"), F.col("_found")).alias("parts"))


def _cited_kind() -> Column:
    return F.when(F.contains("evidence_id", F.lit("_caption_")), "table_caption").otherwise(kind_of("evidence_id"))


def model_input(ann: DataFrame, pages: DataFrame, gold: bool = True) -> DataFrame:
    """``(id, text)``: the claim, sentence evidence with its sections, then tables, page by page.

    All evidence of a claim is looked up by one join and put together in its row.
    """
    ids = flat_ids() if gold else F.col("predicted_evidence")
    cited = ann.select("id", "claim", F.posexplode_outer(ids).alias("pos", "evidence_id"))
    cited = cited.select("*", page_of("evidence_id").alias("page_id"), local_id("evidence_id").alias("local_id"), _cited_kind().alias("kind"), table_no("evidence_id").alias("table_no"))
    found = cited.join(ctx.evidence_parts(pages, cited), ["page_id", "local_id"], "left")
    entry = F.struct("pos", "page_id", "evidence_id", "kind", "table_no", "text", "sections", "headers")
    whole = found.groupBy("id", "claim").agg(F.sort_array(F.collect_list(F.when(F.col("evidence_id").isNotNull(), entry))).alias("_found"))

    # without sections, or without the sentence, the part still starts with its blank
    said = lambda e: F.concat(F.array_join(F.coalesce(e["sections"], F.array().cast(_IDS)), ". "), F.lit(" "), F.coalesce(e["text"], F.lit("")))
    sentences = lambda found_: F.transform(F.filter(found_, lambda e: F.contains(e["evidence_id"], F.lit("_sentence_"))), said)
    numbers = lambda found_: F.filter(F.array_distinct(F.transform(found_, lambda e: e["table_no"])), lambda n: n.isNotNull())
    tables = lambda page, found_: F.flatten(F.transform(numbers(found_), lambda n: let(F.filter(found_, lambda e: e["table_no"] == n), lambda own: _table_parts(page, own))))
    of_page = lambda every, page: let(F.filter(every, lambda e: e["page_id"] == page), lambda own: F.concat(sentences(own), tables(page, own)))
    page_ids = lambda every: F.filter(F.array_distinct(F.transform(every, lambda e: e["page_id"])), lambda p: p.isNotNull())
    parts = let(F.col("_found"), lambda every: F.flatten(F.transform(page_ids(every), lambda p: of_page(every, p))))
    return whole.select("id", F.array_join(F.concat(F.array("claim"), F.coalesce(parts, F.array().cast(_IDS))), SEPARATOR).alias("text"))


def gold_evidence(ann: DataFrame, pages: DataFrame, missing: str = "None") -> DataFrame:
    """``(id, evidence)``: ``title<TAB>sentence`` lines in evidence order, duplicates kept.

    A sentence its page does not have is written as ``missing``.
    """
    cited = flatten_evidence(ann).where(F.contains("evidence_id", F.lit("_sentence_"))).select("id", "set_no", "pos", "page_id", "local_id")
    texts = ctx.content(pages, cited)
    line = F.concat(strip("page_id"), F.lit("\t"), F.when(F.col("found"), F.col("text")).otherwise(F.lit(missing)))
    return texts.groupBy("id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("set_no", "pos", line.alias("line")))), lambda l: l["line"]), "\n").alias(
            "evidence"
        )
    )


def prepare_claims(ann: DataFrame, pages: DataFrame) -> DataFrame:
    """``(id, claim, label, challenge, evidence)`` for claims that rest on sentences only."""
    kept = filter_evidence_kind(map_labels(ann))
    texts = gold_evidence(kept, pages)
    return kept.select("id", "claim", "label", "challenge").join(texts, "id", "left").withColumn(
        "evidence", F.coalesce("evidence", F.lit(""))
    )


def _merged(maps: Column) -> Column:
    """``array<struct(key, value)>`` of several maps, the last map with a key wins."""
    keys = lambda back: F.array_distinct(F.flatten(F.transform(F.reverse(back), F.map_keys)))
    last = lambda back, k: F.get(F.filter(back, lambda m: F.map_contains_key(m, k)), F.lit(0))[k]
    return let(
        F.reverse(F.filter(maps, lambda m: m.isNotNull())),
        lambda back: F.transform(keys(back), lambda k: F.struct(k.alias("key"), last(back, k).alias("value"))),
    )


def context_map(ann: DataFrame) -> DataFrame:
    """``(id, evidence_id, context)``: context ids per evidence id over all sets of a claim."""
    merged = _merged(F.transform("evidence", lambda s: s["context"]))
    return ann.transform(rows_of, ["id"], merged, "m").select("id", F.col("m.key").alias("evidence_id"), F.col("m.value").alias("context"))


def evidence_text_map(ann: DataFrame) -> DataFrame:
    """``(id, evidence_id, text)`` for annotations that carry texts; none if ids and texts do not match up."""
    ids, texts = flat_ids(), F.flatten(F.transform("evidence", lambda s: F.coalesce(s["text"], F.array().cast(_IDS))))
    rows = ann.where(F.size(ids) == F.size(texts)).transform(rows_of, ["id"], F.arrays_zip(ids.alias("evidence_id"), texts.alias("text")), "z", "pos")
    return rows.groupBy("id", F.col("z.evidence_id").alias("evidence_id")).agg(F.max_by(F.col("z.text"), F.col("pos")).alias("text"))


def context_text_map(ann: DataFrame) -> DataFrame:
    """``(id, context_id, text)`` for annotations that carry context texts; the last one of an id wins."""
    ids = _merged(F.transform("evidence", lambda s: s["context"]))
    texts = F.map_from_entries(_merged(F.transform("evidence", lambda s: s["context_text"])))
    zipped = lambda e, of: F.arrays_zip(e["value"].alias("context_id"), F.try_element_at(of, e["key"]).alias("text"))
    pairs = let(ids, texts, lambda merged, of: F.flatten(F.transform(merged, lambda e: zipped(e, of))))
    rows = ann.transform(rows_of, ["id"], pairs, "z", "pos")
    rows = rows.where(F.col("z.context_id").isNotNull() & F.col("z.text").isNotNull())
    return rows.groupBy("id", F.col("z.context_id").alias("context_id")).agg(F.max_by(F.col("z.text"), F.col("pos")).alias("text"))


def annotation_universe(ann: DataFrame) -> DataFrame:
    """``(what, value)``: all evidence ids, page titles and keys of the context maps, duplicates kept."""
    ids = flat_ids()
    contexts = F.transform(_merged(F.transform("evidence", lambda s: s["context"])), lambda m: m["key"])
    tagged = lambda what, values: F.transform(values, lambda v: F.struct(F.lit(what).alias("what"), v.alias("value")))
    everything = F.concat(tagged("evidence", ids), tagged("title", F.transform(ids, lambda e: page_of(e))), tagged("context", contexts))
    return ann.transform(rows_of, [], everything, "u").select("u.what", "u.value")
