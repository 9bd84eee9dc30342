"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlake.llm.rowkeys import kept_table


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the least node of each neighbourhood: greater ones (large) or smaller ones (small)."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    around = edges.unionByName(back) if large else edges.where("a > b").unionByName(back.where("a > b"))
    # written, so that the join shuffles both sides itself and Spark can split the rows of a hub
    least = kept_table(around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "components-least")
    moved = around.join(least, "a")
    if large:
        out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``), root being the least node of its component.

    Alternates large and small stars until nothing changes: the edges then are a star around each root. Every
    round is written to shared storage, so lineage stays short. Null ends and loops are dropped.
    """
    state = kept_table(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), "components")
    mark = None
    for _ in range(most_rounds):
        state = kept_table(_stars(_stars(state, True), False), "components")
        now = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
