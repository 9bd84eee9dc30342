"""Repeated lines across documents, as compressed keep bitmaps.

Line keys are hashed to 128 bits, range-partitioned by hash and lane (a hash of the document, so that one very
common line lies in many partitions), sorted by document and position, and read in order: documents that follow
enough others of their hash and lane are dropped at once. What is left, a few documents a lane, meets by hash in a
second pass that decides the rest. Texts do not move until their bitmaps are known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlake.functions.binding import let
from claimlake.llm.rowkeys import WHITE, kept_table

LANES = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROW = ["doc_id", "row_key"]


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case, all else as it is; a text of single bytes goes the fast way."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def text_lines(text: Column) -> Column:
    """Lines of a text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def row_key(docs: DataFrame) -> Column:
    """Tells rows of one id apart by their text."""
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def dropped_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, lanes: int = LANES) -> DataFrame:
    """``doc_id, row_key, runs``: the runs of lines (``at, n``) that each row of ``docs`` loses; rows that lose none are absent.

    A line's key is the line without white space at its ends and with A-Z in lower case. Keys of ``least_chars``
    code points or more in at least ``least_docs`` documents (two or more) lose all their lines except those of
    the largest ``doc_id``. Rows without an id are one document, smaller than all others.
    """
    if least_docs < 2:
        raise ValueError("a line has to be in two documents to repeat")
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("row_key"), F.posexplode_outer(text_lines(F.col("text"))).alias("at", "line"))
    keyed = every.withColumn("line", F.btrim("line", F.lit(WHITE))).where(F.length("line") >= least_chars)
    keyed = keyed.withColumn("line", lower_ascii(F.col("line")))
    hashed = kept_table(
        keyed.select(F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), *ROW, "at"), "line-hashes"
    )
    lane = F.pmod(F.xxhash64("doc_id"), F.lit(lanes)).cast("int")
    spread = hashed.withColumn("lane", lane).repartitionByRange("h", "g", "lane")
    each = spread.groupBy("h", "g", "lane", "doc_id").agg(F.collect_list(F.struct("row_key", "at")).alias("places"))
    in_lane = Window.partitionBy("h", "g", "lane").orderBy(F.desc_nulls_last("doc_id"))
    first_pass = kept_table(each.withColumn("nth", F.row_number().over(in_lane)), "line-places")
    sure = first_pass.where(F.col("nth") > least_docs).select("doc_id", "places")
    # a lane keeps as many documents as it takes to see that there are enough of them
    open_rows = first_pass.where(F.col("nth") <= least_docs).select("h", "g", "doc_id", "places")
    by_hash = Window.partitionBy("h", "g").orderBy(F.desc_nulls_last("doc_id"))
    decided = open_rows.withColumn("nth", F.row_number().over(by_hash))
    for k in range(1, least_docs):
        decided = decided.withColumn(f"next{k}", F.coalesce(F.lead(F.lit(True), k).over(by_hash), F.lit(False)))
    # the nth document has enough company if it is the least_docs-th or later, or those up to there follow it
    enough = F.col("nth") >= least_docs
    for k in range(1, least_docs):
        enough = enough | ((F.col("nth") == least_docs - k) & F.col(f"next{k}"))
    rest = decided.where((F.col("nth") > 1) & enough).select("doc_id", "places")
    gone = sure.unionByName(rest).select("doc_id", F.explode("places").alias("p")).select("doc_id", "p.row_key", "p.at").distinct()
    by_row = Window.partitionBy(*ROW).orderBy("at")
    runs = gone.withColumn("run", F.col("at") - F.row_number().over(by_row)).groupBy(*ROW, "run").agg(F.min("at").alias("at"), F.count(F.lit(1)).cast("int").alias("n"))
    return runs.groupBy(*ROW).agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("runs"))


def keep_bitmap(runs: Column, n_lines: Column) -> Column:
    """A keep bitmap in run lengths: kept, dropped, kept, ... lines, starting with kept (which may be 0)."""
    gaps = lambda rs: F.transform(
        F.sequence(F.lit(0), F.size(rs) - 1),
        lambda i: F.array(
            (F.get(rs, i)["at"] - F.when(i == 0, F.lit(0)).otherwise(F.get(rs, i - 1)["at"] + F.get(rs, i - 1)["n"])), F.get(rs, i)["n"]
        ),
    )
    tail = lambda rs: F.array(n_lines - F.element_at(rs, -1)["at"] - F.element_at(rs, -1)["n"])
    return F.when(runs.isNull(), F.array(n_lines)).otherwise(let(runs, lambda rs: F.concat(F.flatten(gaps(rs)), tail(rs))))


def kept_text(text: Column, runs: Column) -> Column:
    """The lines outside the runs, joined again; linear in the lines."""
    gone = lambda rs: F.flatten(F.transform(rs, lambda r: F.sequence(r["at"], r["at"] + r["n"] - 1)))
    stay = lambda ls, rs: F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), gone(rs))
    pick = lambda ls, at: F.array_join(F.transform(at, lambda i: F.get(ls, i)), "\n")
    return F.when(runs.isNull(), text).otherwise(let(text_lines(text), runs, lambda ls, rs: let(ls, stay(ls, rs), pick)))


def with_runs(docs: DataFrame, **how: int) -> DataFrame:
    """``docs``, all columns, with ``__runs`` of the lines to drop."""
    runs = dropped_lines(docs, **how)
    runs = runs.select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key"), F.col("runs").alias("__runs"))
    found = docs["doc_id"].cast("long").eqNullSafe(runs["__id"]) & (row_key(docs) == runs["__key"])
    return docs.join(runs.hint("shuffle_hash"), found, "left").drop("__id", "__key")


def line_bitmaps(docs: DataFrame, **how: int) -> DataFrame:
    """``doc_id, n_lines, n_dropped, keep`` (bitmap as run lengths), ``text`` (the rest) for every row of ``docs``.

    ``doc_id, text`` are read. A null or empty text is one empty line, which is kept. Repeated rows give rows each,
    with one decision. An empty table gives no rows.
    """
    rows = with_runs(docs.select("doc_id", "text"), **how).withColumn("n_lines", F.size(text_lines(F.col("text"))))
    n_dropped = F.aggregate(F.coalesce("__runs", F.array().cast("array<struct<at:int,n:int>>")), F.lit(0), lambda s, r: s + r["n"])
    return rows.select(
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        n_dropped.cast("long").alias("n_dropped"),
        keep_bitmap(F.col("__runs"), F.col("n_lines")).alias("keep"),
        kept_text(F.coalesce("text", F.lit("")), F.col("__runs")).alias("text"),
    )


def drop_repeated(docs: DataFrame, **how: int) -> DataFrame:
    """``docs``, all columns, with the repeated lines taken out of ``text``; ``n_chars``, if there, follows the new text."""
    rows = with_runs(docs, **how)
    text = kept_text(F.col("text"), F.col("__runs"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("__runs").isNull(), F.col("n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType)))
    return rows.withColumn("text", text).select(*docs.columns)
