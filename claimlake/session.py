"""Session settings, shared scratch space and the skew-safe join."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A key is hot when it holds more than 1/HOT_SHARE of the rows, so there are never more than HOT_SHARE
# hot keys. That is the size bound of the broadcast in ``spread_join``.
HOT_SHARE = 500


def get_session(app: str = "claimlake", **conf: str) -> SparkSession:
    """A session with the settings the operators are written for; cluster settings win where given."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "128MB")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, so that its Python functions run wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_claimlake_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="claimlake-")) / "claimlake_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for name in ("claimlake", "catalog"):
            for f in sorted((root / name).rglob("*.py")):
                z.write(f, f.relative_to(root))
    sc.addPyFile(str(target))
    sc._claimlake_shipped = True


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder all executors share (``spark.checkpoint.dir``).

    Only a local-mode session without that setting falls back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="claimlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/claimlake/{label}-{uuid.uuid4().hex}"


def use_all_cores(df: DataFrame) -> DataFrame:
    """Spread an input of a few small files over all cores.

    Input that has a partition per core already, as any large table does, is not moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to shared storage and go on from the written table, which outlives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_listed(df: DataFrame, listed: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``df`` whose key is listed. Spark broadcasts the keys if it finds them small."""
    return df.join(listed.select(*on).distinct(), on, "left_semi")


def spread_join(
    left: DataFrame, right: DataFrame, on: list[str], spread_by: list[Column], how: str = "left",
    stored: bool = False,
) -> DataFrame:
    """Join a skewed ``left`` to a ``right``, spreading hot keys over many tasks.

    ``left`` is read more than once, so it is written first, unless it is ``stored`` already.

    Hot keys are found by a count per key (combined before the shuffle). Their left rows get a salt from
    ``spread_by`` (columns that tell rows of one key apart) and their right rows are repeated once per
    salt. All other keys are joined as they are.
    """
    if how not in ("left", "inner"):
        raise ValueError(how)
    if not stored:
        left = cut_lineage(left, "spread")
    counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total")).scalar()
    hot = (
        counts.withColumn("_total", total)
        .where(F.col("_n") * HOT_SHARE > F.col("_total"))
        .select(*on, F.ceil(F.col("_n") * HOT_SHARE / F.col("_total")).cast("int").alias("_salts"))
    )
    salted_left = (
        left.join(F.broadcast(hot), on, "left")
        .withColumn(
            "_salt",
            F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(
                F.pmod(F.xxhash64(*spread_by), F.col("_salts")).cast("int")
            ),
        )
        .drop("_salts")
    )
    salted_right = (
        right.join(F.broadcast(hot), on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
        .drop("_salts")
    )
    return salted_left.join(salted_right, [*on, "_salt"], how).drop("_salt")
