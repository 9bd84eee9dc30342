"""Encyclopedia dumps: article files in, document table out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlake.functions.text import extract_links
from claimlake.functions.titles import normalize_title, wiki_id

_STRINGS = T.ArrayType(T.StringType())
_HEAD = [T.StructField(n, T.StringType()) for n in ("id", "url", "title")]

# Offset columns of the dump are left out of the schema, so they are never parsed into rows.
_BROKEN = T.StructField("_broken", T.StringType())
INTRO_SCHEMA = T.StructType([*_HEAD, T.StructField("text", _STRINGS), T.StructField("text_with_links", _STRINGS), _BROKEN])
FULL_SCHEMA = T.StructType([*_HEAD, T.StructField("text", T.StringType()), _BROKEN])


def read_wiki_dump(
    spark: SparkSession,
    path: str,
    fmt: str = "intro",
    glob: str = "wiki_*",
    preprocess: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Document table ``(id, text, links, original_title, wiki_id, source_file)`` of a dump folder tree.

    ``intro`` files hold sentence lists plus the same sentences with anchors; ``full`` files hold one text
    whose anchors stay in it. Compressed files are read as they are. ``preprocess`` may change the raw
    articles before they are shaped. Broken lines and articles without a title are no documents.
    """
    if fmt not in ("intro", "full"):
        raise ValueError(f"unknown dump format: {fmt}")
    raw = (
        spark.read.schema(INTRO_SCHEMA if fmt == "intro" else FULL_SCHEMA)
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .option("columnNameOfCorruptRecord", "_broken")
        .json(path)
        .withColumn("source_file", F.col("_metadata.file_name"))
        .where(F.col("_broken").isNull() & F.col("title").isNotNull())
        .drop("_broken")
    )
    if preprocess is not None:
        raw = raw.transform(preprocess)
    if fmt == "intro":
        text = F.array_join("text", "")
        links = extract_links(F.array_join("text_with_links", ""))
    else:
        text, links = F.col("text"), F.array().cast("array<string>")
    return raw.select(
        wiki_id(normalize_title("title")).alias("id"),
        text.alias("text"),
        links.alias("links"),
        F.col("title").alias("original_title"),
        F.col("id").alias("wiki_id"),
        "source_file",
    )
