"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows_of(df: DataFrame, keep: list[str | Column], array: Column | str, name: str, pos: str | None = None) -> DataFrame:
    """One row per array element, with ``keep`` and, if wanted, the position.

    From an inner explode Spark derives a filter on the array's size and pushes it to the scan, where the
    array is computed a second time. The outer form with a check of its result computes it once.
    """
    if pos is None:
        return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())
    return df.select(*keep, F.posexplode_outer(array).alias(pos, name)).where(F.col(pos).isNotNull())
