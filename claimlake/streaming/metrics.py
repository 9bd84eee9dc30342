"""Running metric means over result files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimlake.session import scratch_path


def stream_metrics(stream: DataFrame, metrics: list[str], by: str = "model") -> DataFrame:
    """Counts and means per group, kept up to date; the state is one row per group."""
    means = [F.avg(m).alias(m) for m in metrics]
    return stream.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *means)


def publish_metrics(means: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery:
    """Process what is there and write the whole metric table to ``path`` after every batch.

    The sink folder of a batch is replaced when a batch is repeated, so a restart gives the same table.
    """
    checkpoint = checkpoint or scratch_path(means.sparkSession, "metrics-checkpoint")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id:09d}")

    return (
        means.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def latest_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The table of the newest batch."""
    published = spark.read.option("basePath", path).parquet(path)
    newest = published.select(F.max("batch").alias("newest")).scalar()
    return published.withColumn("_newest", newest).where("batch = _newest").drop("batch", "_newest")
