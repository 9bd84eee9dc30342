"""ROUGE and SARI: n-gram overlap of text pairs, one row per pair.

A pair is a row, and its n-grams are counted in that row: sorted, and counted by runs on each side. Nothing is shuffled,
and rows of one key are scored one by one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlake.functions.binding import let
from claimlake.functions.multisets import side_counts, total
from claimlake.functions.stemming import stem_tokens
from claimlake.functions.text import SPACE, _col


def rouge_tokens(c: Column | str, stem: bool = False) -> Column:
    """Lower-case runs of ASCII letters and digits; stemming leaves words of up to three letters."""
    tokens = F.filter(F.split(F.lower(_col(c)), "[^a-z0-9]+"), lambda t: t != "")
    return stem_tokens(tokens, 3) if stem else tokens


def sari_tokens(c: Column | str) -> Column:
    """Lower-case words between whitespace."""
    return F.filter(F.split(F.lower(_col(c)), f"{SPACE}+"), lambda t: t != "")


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of ``n`` tokens, joined by a blank."""
    if n == 1:
        return tokens
    # tokens one by one: a slice would read the whole array for each of them
    joined = lambda ts: F.transform(starts_of(ts), lambda i: F.concat_ws(" ", *[F.get(ts, i + k) for k in range(n)]))
    starts_of = lambda ts: F.when(F.size(ts) >= n, F.sequence(F.lit(0), F.size(ts) - n)).otherwise(F.array().cast("array<int>"))
    return let(tokens, joined)


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def rouge_grams(pred: Column | str, ref: Column | str, sizes: tuple[int, ...] = (1, 2), stem: bool = False) -> Column:
    """``struct(rouge{n}_p, rouge{n}_r, rouge{n}_f, ...)`` from clipped n-gram counts."""

    def scores(a: Column, b: Column) -> Column:
        parts = []
        for n in sizes:
            x, y = ngrams(a, n), ngrams(b, n)
            same = total(side_counts(x, y), lambda g: F.least(g["c0"], g["c1"]))
            parts.append(let(_ratio(same, F.size(x)), _ratio(same, F.size(y)), lambda p, r: F.struct(p.alias("p"), r.alias("r"), _f1(p, r).alias("f"))))
        named = lambda *s: F.struct(*[s[i][m].alias(f"rouge{n}_{m}") for i, n in enumerate(sizes) for m in "prf"])
        return let(*parts, named)

    return let(rouge_tokens(pred, stem), rouge_tokens(ref, stem), scores)


def rouge_n(
    df: DataFrame, key: list[str], pred: str, ref: str, sizes: tuple[int, ...] = (1, 2), stem: bool = False
) -> DataFrame:
    """``key, rouge{n}_p, rouge{n}_r, rouge{n}_f`` of each row; a missing text has no scores."""
    return df.select(*key, rouge_grams(pred, ref, sizes, stem).alias("_s")).select(*key, "_s.*")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by the bit-parallel method of Hyyro (2004)."""
    places: dict[str, int] = {}
    for i, token in enumerate(a):
        places[token] = places.get(token, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        hit = row & places.get(token, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.IntegerType())
def _common_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _common(x, y) for x, y in zip(a, b)], dtype="Int32")


def rouge_l(pred: Column | str, ref: Column | str, stem: bool = False) -> Column:
    """``struct(p, r, f)`` from the longest common subsequence of the whole texts."""
    a, b = rouge_tokens(pred, stem), rouge_tokens(ref, stem)
    same = _common_length(a, b)
    p, r = _ratio(same, F.size(a)), _ratio(same, F.size(b))
    return F.struct(p.alias("p"), r.alias("r"), _f1(p, r).alias("f"))


def sari_score(source: Column | str, pred: Column | str, refs: list[Column | str]) -> Column:
    """SARI (0 to 100): mean of keep F1, delete precision and add F1 over 1- to 4-grams.

    Counts of source and prediction are weighted by the number of references. An empty denominator scores
    1, and F1 is 0 when precision and recall are.
    """
    m = len(refs)
    names = ["kp", "kn", "ko", "ka", "dp", "dn", "ao", "an", "aw"]
    kinds = ["double" if n in ("kp", "dp") else "long" for n in names]

    def step(acc: Column, g: Column) -> Column:
        s, c = g["c0"] * m, g["c1"] * m
        r = sum((g[f"c{i + 2}"] for i in range(1, m)), g["c2"])
        kept, kept_ok = F.least(s, c), F.least(s, c, r)
        gone = F.greatest(s - c, F.lit(0))
        new, wanted = (c > 0) & (s == 0), (r > 0) & (s == 0)
        values = [
            F.when(kept > 0, kept_ok / kept).otherwise(0.0), kept > 0, kept_ok, F.least(s, r),
            F.when(gone > 0, F.greatest(gone - r, F.lit(0)) / gone).otherwise(0.0), gone > 0, new & wanted, new, wanted,
        ]
        return F.struct(*[(acc[n] + v.cast("int").cast(k) if k == "long" else acc[n] + v).alias(n) for n, k, v in zip(names, kinds, values)])

    def size_score(*sides: Column) -> Column:
        zero = F.struct(*[F.lit(0).cast(k).alias(n) for n, k in zip(names, kinds)])
        share = lambda t, a, b: F.when(t[b] > 0, t[a] / t[b]).otherwise(F.lit(1.0))
        keep = lambda t: _f1(share(t, "kp", "kn"), share(t, "ko", "ka"))
        add = lambda t: _f1(share(t, "ao", "an"), share(t, "ao", "aw"))
        return let(F.aggregate(side_counts(*sides), zero, step), lambda t: (keep(t) + share(t, "dp", "dn") + add(t)) / 3)

    def mean(*sides: Column) -> Column:
        # a size without any n-gram on any side scores 1 throughout
        return sum((size_score(*[ngrams(x, n) for x in sides]) for n in (2, 3, 4)), size_score(*sides)) / 4 * 100

    return let(*[sari_tokens(c) for c in (source, pred, *refs)], mean)


def sari(df: DataFrame, key: list[str], source: str, pred: str, refs: list[str]) -> DataFrame:
    """``key, sari`` of each row."""
    return df.select(*key, sari_score(source, pred, list(refs)).alias("sari"))


def score_pairs(
    df: DataFrame, key: list[str], source: str = "mutated", pred: str = "prediction", ref: str = "original",
    reference_col: str | None = None, stem: bool = False,
) -> DataFrame:
    """``key, rouge1, rouge2, rougeL, sari`` of every pair that has a prediction.

    ROUGE compares with ``reference_col`` (the reference by default, or the source), SARI with ``ref``.
    """
    against = reference_col or ref
    scored = df.where(F.col(pred).isNotNull()).select(
        *key, rouge_grams(pred, against, (1, 2), stem).alias("_g"), rouge_l(pred, against, stem)["f"].alias("rougeL"), sari_score(source, pred, [ref]).alias("sari")
    )
    return scored.select(*key, F.col("_g.rouge1_f").alias("rouge1"), F.col("_g.rouge2_f").alias("rouge2"), "rougeL", "sari")


def skipped_pairs(df: DataFrame, key: list[str], pred: str = "prediction") -> DataFrame:
    """Keys of pairs without a prediction."""
    return df.where(F.col(pred).isNull()).select(*key)
