"""Titles, document ids and evidence ids."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlake.functions.text import _col, capitalize_first, percent_decode, strip

# Kinds of page parts an evidence id can point to.
_ID = r"\A(.*?)_((?:header_)?cell|sentence|item|table_caption|section|table|list)_([0-9]+(?:_[0-9]+)*)\z"


@F.pandas_udf(T.StringType())
def _nfd(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFD", t))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfd_all(s: pd.Series) -> pd.Series:
    return s.map(lambda ts: None if ts is None else [unicodedata.normalize("NFD", t) for t in ts])


def nfd(c: Column | str) -> Column:
    """Canonical decomposition. Spark has no such function; ASCII text never leaves the JVM."""
    c = _col(c)
    ascii_only = c.rlike(r"\A\p{ASCII}*\z")
    return F.when(ascii_only, c).otherwise(_nfd(F.when(~ascii_only, c)))


def normalize_title(c: Column | str, capitalize: bool = True) -> Column:
    """Decomposed title, by default with its first character upper-cased. Empty stays empty."""
    out = nfd(c)
    return capitalize_first(out) if capitalize else out


def normalize_titles(c: Column | str) -> Column:
    """``normalize_title`` for an array of titles."""
    c = _col(c)
    plain = F.forall(c, lambda t: t.rlike(r"\A\p{ASCII}*\z"))
    return F.transform(F.when(plain, c).otherwise(_nfd_all(F.when(~plain, c))), capitalize_first)


def wiki_id(title: Column | str, index: Column | int = 0) -> Column:
    """``title_index``."""
    return F.concat_ws("_", _col(title), F.lit(index) if isinstance(index, int) else index)


def title_of(c: Column | str, compat: bool = False) -> Column:
    """Title of a document id: without its trailing ``_0``; ``compat`` cuts at the first ``_0``."""
    c = _col(c)
    return F.substring_index(c, "_0", 1) if compat else F.regexp_replace(c, r"_0\z", "")


def ensure_suffix(c: Column | str) -> Column:
    """Append ``_0`` when the id has none."""
    c = _col(c)
    return F.when(F.contains(c, F.lit("_0")), c).otherwise(F.concat(c, F.lit("_0")))


def clean_title(c: Column | str, decompose: bool = True) -> Column:
    """Decoded, trimmed title with web addresses replaced, ready for a page lookup."""
    out = F.regexp_replace(strip(percent_decode(c)), r"(?:https?://|www\.)[^\s<>]+", "<URL>")
    return strip(nfd(out)) if decompose else out


def page_of(c: Column | str, compat: bool = False) -> Column:
    """Page of an evidence id; ``compat`` cuts at the first underscore."""
    c = _col(c)
    if compat:
        return F.substring_index(c, "_", 1)
    return F.when(c.rlike(_ID), F.regexp_extract(c, _ID, 1)).otherwise(F.regexp_replace(c, r"_title\z", ""))


def kind_of(c: Column | str) -> Column:
    """Kind of an evidence id, null if it has none."""
    c = _col(c)
    return F.when(c.rlike(_ID), F.regexp_extract(c, _ID, 2)).when(c.rlike(r"_title\z"), F.lit("title"))


def local_id(c: Column | str) -> Column:
    """Evidence id without its page."""
    c = _col(c)
    tail = F.concat_ws("_", F.regexp_extract(c, _ID, 2), F.regexp_extract(c, _ID, 3))
    return F.when(c.rlike(_ID), tail).when(c.rlike(r"_title\z"), F.lit("title"))


def parse_evidence_id(c: Column | str) -> Column:
    """``struct(page, kind, local_id, i1, i2, i3)``."""
    c = _col(c)
    numbers = F.split(F.regexp_extract(c, _ID, 3), "_")
    at = [F.when(c.rlike(_ID), F.get(numbers, F.lit(i)).cast("int")) for i in range(3)]
    return F.struct(
        page_of(c).alias("page"),
        kind_of(c).alias("kind"),
        local_id(c).alias("local_id"),
        *[n.alias(f"i{i + 1}") for i, n in enumerate(at)],
    )


def table_no(c: Column | str) -> Column:
    """Table number of a cell, header cell or caption id, null for other kinds."""
    c = _col(c)
    first = F.get(F.split(F.regexp_extract(c, _ID, 3), "_"), F.lit(0)).cast("int")
    return F.when(kind_of(c).isin("cell", "header_cell", "table_caption"), first)
