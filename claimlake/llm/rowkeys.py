"""Names and keys the operators of this folder share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.session import scratch_path

WHITE = " \t\n\x0b\x0c\r"


def kept_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the folder all executors share and go on from there.

    Several readers then share one computation, and losing an executor costs no more than a read.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_key(text: Column) -> Column:
    """128 bits of a text, null as empty: tells rows of one id apart."""
    whole = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(whole).alias("a"), F.xxhash64(F.lit(1), whole).alias("b"))


def id_text(name: str = "doc_id") -> Column:
    """An id on its way through pandas, where a column of whole numbers with nulls would become one of fractions."""
    return F.col(name).cast("long").cast("string").alias(name)


def id_number(name: str = "doc_id") -> Column:
    return F.col(name).cast("long")


def same(left: DataFrame, right: DataFrame, *names: tuple[str, str] | str) -> Column:
    """Equality of the named columns of two frames, nulls equal to nulls."""
    pairs = [(n, n) if isinstance(n, str) else n for n in names]
    found = [left[a].eqNullSafe(right[b]) for a, b in pairs]
    out = found[0]
    for x in found[1:]:
        out = out & x
    return out
