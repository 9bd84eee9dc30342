"""Filters, projections and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlake.functions.text import strip
from claimlake.session import keep_listed

# Which labels are kept and how they are written afterwards.
LABEL_MAP = {"SUPPORTS": "supports", "REFUTES": "refutes"}
EMPTY_PROMPT = "No input provided."


def filter_label(df: DataFrame, label: str, column: str = "label") -> DataFrame:
    """Rows with one label."""
    return df.where(F.col(column) == label)


def map_labels(df: DataFrame, mapping: dict[str, str] | None = None, column: str = "label") -> DataFrame:
    """Rename labels; rows whose label is not in the mapping are dropped."""
    mapping = LABEL_MAP if mapping is None else mapping
    renamed = F.lit(None).cast("string")
    for old, new in mapping.items():
        renamed = F.when(F.col(column) == old, F.lit(new)).otherwise(renamed)
    # the plain membership test reaches the scan, the renaming does not have to
    return df.where(F.col(column).isin(list(mapping))).withColumn(column, renamed)


def filter_evidence_kind(df: DataFrame, part: str = "_sentence_", column: str = "evidence") -> DataFrame:
    """Claims whose evidence ids all contain ``part``; claims without evidence pass."""
    return df.where(
        F.forall(F.col(column), lambda s: F.forall(s["content"], lambda e: F.contains(e, F.lit(part))))
    )


def non_empty_pages(pages: DataFrame, column: str = "data") -> DataFrame:
    """Pages with more than blanks in them."""
    return pages.where(F.length(F.trim(F.col(column))) > 0)


def restrict_titles(pages: DataFrame, titles: DataFrame, on: str = "title") -> DataFrame:
    """Pages whose title is on the list."""
    return keep_listed(pages, titles, [on])


def valid_pages(pages: DataFrame, title: str = "title", order: list[str] | None = None) -> DataFrame:
    """Pages with more than two JSON keys; of several pages with one title the first in ``order``."""
    keep = pages.where(F.size(F.json_object_keys("data")) > 2)
    first = Window.partitionBy(title).orderBy(*[F.col(c) for c in (order or ["page_id"])])
    return keep.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")


def drop_incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows where all the columns hold text."""
    for c in columns:
        df = df.where(F.length(strip(c)) > 0)
    return df


def fill_empty_prompt(prompt: Column) -> Column:
    """A placeholder for blank prompts."""
    return F.when(strip(prompt) == "", F.lit(EMPTY_PROMPT)).otherwise(prompt)


def keep_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns, in the order of the table."""
    return df.select(*[c for c in df.columns if c in names])


def head(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """First ``n`` rows by ``order``."""
    return df.orderBy(*order).limit(n)


def sample_fewshot(df: DataFrame, n: int = 8, seed: int = 0, key: str = "id") -> DataFrame:
    """``n`` rows without replacement, repeatable for a seed."""
    mixed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return df.orderBy(mixed, key).limit(n)
