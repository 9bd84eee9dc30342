"""Named queries over the given tables, each with the same result in DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, whole: list[str] | None = None) -> Callable[[Query], Query]:
    """Register a query. ``whole`` names SQL columns to be widened to bigint."""
    if sql is not None and whole:
        sql = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in whole)}) FROM ({sql})"

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _plain(fn(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _plain(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint and fractions as double, as the SQL side gives them."""
    wide = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double"}
    return df.select(*[df[f"`{c}`"].cast(wide[t]).alias(c) if t in wide else df[f"`{c}`"] for c, t in df.dtypes])
