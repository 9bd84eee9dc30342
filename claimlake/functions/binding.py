"""Binding values to names inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(*values_and_body: Column | Callable[..., Column]) -> Column:
    """``let(a, b, body)`` is ``body(a, b)`` with ``a`` and ``b`` computed once per row.

    Lambda bodies that mention a derived column get its whole expression put in by the optimizer, which then
    computes it for every element and cannot run a pandas function in it. Values bound here are lambda
    variables and are not put in again.
    """
    *values, body = values_and_body
    bound = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.get(F.transform(F.array(bound), lambda s: body(*[s[f"v{i}"] for i in range(len(values))])), F.lit(0))
