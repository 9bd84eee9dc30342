"""Writers and the document upsert."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimlake.session import cut_lineage

_MANIFEST = "seq LONG, bucket INT, folder STRING"


def upsert_documents(
    existing: DataFrame, incoming: DataFrame, key: str = "id", order: list[str] | None = None
) -> DataFrame:
    """Insert or replace by ``key``: incoming rows win, and among them the greatest ``order`` wins.

    Keeping one row per key lets Spark drop all but one row of a key in every partition before the
    shuffle, so a key with very many copies is no burden.
    """
    ranked: list[Column] = [F.col("_new").desc()] + [F.col(c).desc() for c in (order or [])]
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    by_key = Window.partitionBy(key).orderBy(*ranked)
    return both.withColumn("_rank", F.row_number().over(by_key)).where("_rank = 1").drop("_rank", "_new")


def write_corpus(corpus: DataFrame, path: str) -> None:
    """One ``{id, contents}`` object per line; an existing corpus is left alone."""
    corpus.select("id", "contents").write.mode("ignore").json(path)


def write_claims(claims: DataFrame, path: str, split: str, mode: str) -> None:
    """Prepared claims, in a folder per split and mode."""
    out = claims.withColumn("split", F.lit(split)).withColumn("mode", F.lit(mode))
    out.write.mode("append").partitionBy("split", "mode").json(path)


def write_results(results: DataFrame, path: str, fmt: str = "json") -> None:
    """Predictions or metric reports."""
    results.write.mode("overwrite").format(fmt).save(path)


def _bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, path: str) -> dict[int, str]:
    """Folder of each bucket of a document store, from its newest manifest; a row per bucket, so there are few."""
    try:
        found = spark.read.schema(_MANIFEST).json(f"{path}/manifests")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return {}
        raise
    newest = found.agg(F.max("seq")).scalar()
    return {r["bucket"]: r["folder"] for r in found.where(F.col("seq") == newest).collect()}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a store of ``upsert_into``, as of its newest manifest."""
    folders = _manifest(spark, path)
    if not folders:
        raise FileNotFoundError(f"no document store at {path}")
    return spark.read.parquet(*[f"{path}/{f}" for f in folders.values()])


def upsert_into(incoming: DataFrame, path: str, key: str = "id", order: list[str] | None = None, buckets: int = 256) -> None:
    """Insert or replace documents of a store by ``key``, see ``upsert_documents``, rewriting only buckets that change.

    Documents lie in folders by a hash of the key. The buckets that ``incoming`` touches are merged into new folders;
    the others keep their files. A manifest that names the folder of every bucket is written last, as one file, so an
    upsert that breaks off leaves the documents before it, and a reader sees one state. ``buckets`` is set by the first
    upsert and has to stay. Old folders stay for readers that are still at it.
    """
    spark = incoming.sparkSession
    now = _manifest(spark, path)
    rows = cut_lineage(incoming.withColumn("key_bucket", _bucket_of(key, buckets)), "upsert")
    touched = sorted(r[0] for r in rows.select("key_bucket").distinct().collect())
    if not touched:
        return
    rows = rows.drop("key_bucket")
    old = [f"{path}/{now[b]}" for b in touched if b in now]
    existing = spark.read.schema(rows.schema).parquet(*old) if old else rows.limit(0)
    merged = upsert_documents(existing, rows, key, order).withColumn("key_bucket", _bucket_of(key, buckets))
    version = uuid.uuid4().hex
    placed = merged.repartitionByRange("key_bucket", key)
    placed.write.partitionBy("key_bucket").parquet(f"{path}/data/{version}")
    folders = now | {b: f"data/{version}/key_bucket={b}" for b in touched}
    newest = spark.read.schema(_MANIFEST).json(f"{path}/manifests").agg(F.max("seq")).scalar() if now else None
    named = spark.createDataFrame(sorted(folders.items()), "bucket int, folder string")
    seq = F.coalesce(newest, F.lit(0)) + 1 if newest is not None else F.lit(1)
    named.coalesce(1).select(seq.cast("long").alias("seq"), "bucket", "folder").write.mode("append").json(f"{path}/manifests")
