"""Token totals by source, language and tokenizer version, kept up by signed batches.

A change is an insert (+ new), a delete (- old) or a revised count (new - old). A batch of changes is summed per key
before anything moves and written to a folder of its own; a small commit record, written last, names the folder that is valid
for the batch. Sending a batch again makes a new folder and a new record, so a repeated commit counts once, a broken-off
one not at all, and a batch is never missing meanwhile. Totals are the sum of all valid folders. A compaction keeps their
sum and their names; where a batch was sent again since, its old folder is taken off again and the new one added.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

KEYS = ["source", "lang", "tokenizer"]
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
FOLDERS = "batch string, attempt string"
COMMITS = f"{FOLDERS}, at long"
#: Versions of the counting rule, as patterns of a token.
TOKENIZERS = {"words-1": r"[^\x20\x09-\x0D]+", "pieces-1": r"[\p{L}\p{N}]+|[^\x20\x09-\x0D\p{L}\p{N}]"}


def count_tokens(text: Column, tokenizer: str) -> Column:
    """Tokens of a text under a version; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKENIZERS[tokenizer])), F.lit(0)).cast("long")


def signed(changes: DataFrame) -> DataFrame:
    """``source, lang, tokenizer, n_docs, n_tokens`` (signed) of ``changes`` with ``kind, old_tokens, new_tokens``.

    ``kind``: ``insert``, ``delete`` or ``revise``; any other kind is an error. Null counts are 0, and null keys are
    keys like others.
    """
    old, new = (F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("old_tokens", "new_tokens"))
    known = F.when(F.col("kind").isin("insert", "delete", "revise"), F.col("kind")).otherwise(
        F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce(F.col("kind"), F.lit("null"))))
    )
    is_ = lambda k: F.col("__kind") == k
    return changes.withColumn("__kind", known).select(
        *[F.col(k).cast("string").alias(k) for k in KEYS],
        F.when(is_("insert"), 1).when(is_("delete"), -1).otherwise(0).cast("long").alias("n_docs"),
        F.when(is_("insert"), new).when(is_("delete"), -old).otherwise(new - old).alias("n_tokens"),
    )


def rollup(rows: DataFrame) -> DataFrame:
    """Sums per key; combined before the shuffle, so a hot source is no more than a row per task."""
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def commit_batch(changes: DataFrame, store: str, batch: str) -> None:
    """Write the summed deltas of a batch, then its commit record. Committing a name again replaces what it said."""
    if not batch or "/" in batch:
        raise ValueError("a batch needs a name that can be a folder")
    spark, attempt, at = changes.sparkSession, uuid.uuid4().hex, time.time_ns()
    rollup(signed(changes)).write.parquet(f"{store}/deltas/batch={batch}/attempt={attempt}")
    record = spark.createDataFrame([(batch, attempt, at)], COMMITS).coalesce(1)
    record.write.mode("append").parquet(f"{store}/commits")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def committed(spark: SparkSession, store: str) -> DataFrame:
    """``batch, attempt``: the valid folder of every batch, named by its last commit record."""
    records = _read(spark, f"{store}/commits", COMMITS)
    return records.groupBy("batch").agg(F.max_by("attempt", F.struct("at", "attempt")).alias("attempt"))


def _rows(spark: SparkSession, store: str, valid: DataFrame, compacted: str | None) -> DataFrame:
    """Deltas whose sum is that of the ``valid`` folders, from a compaction on if there is one."""
    deltas = _read(spark, f"{store}/deltas", f"{TOTALS}, {FOLDERS}")
    of = lambda folders: deltas.join(folders, ["batch", "attempt"], "left_semi").drop("batch", "attempt")
    if compacted is None:
        return of(valid)
    done = _read(spark, f"{store}/compacted/{compacted}/batches", FOLDERS)
    base = _read(spark, f"{store}/compacted/{compacted}/totals", TOTALS)
    stale = of(done.join(valid, ["batch", "attempt"], "left_anti"))
    taken_off = stale.select(*KEYS, (-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))
    return of(valid.join(done, ["batch", "attempt"], "left_anti")).unionByName(taken_off).unionByName(base)


def totals(spark: SparkSession, store: str, compacted: str | None = None) -> DataFrame:
    """``source, lang, tokenizer, n_docs, n_tokens`` of all committed batches; keys that come to nothing are left out.

    ``compacted`` names a compaction to start from; only folders that are valid since, or no more, are read besides. A
    store without batches gives no rows.
    """
    return rollup(_rows(spark, store, committed(spark, store), compacted)).where("n_docs <> 0 or n_tokens <> 0")


def compact(spark: SparkSession, store: str, name: str, before: str | None = None) -> None:
    """Write the totals so far, and which folders they hold, as the compaction ``name``.

    The list of folders is written first and the totals are made from those alone, so a batch that comes meanwhile is
    in neither.
    """
    committed(spark, store).write.mode("overwrite").parquet(f"{store}/compacted/{name}/batches")
    valid = spark.read.schema(FOLDERS).parquet(f"{store}/compacted/{name}/batches")
    rollup(_rows(spark, store, valid, before)).write.mode("overwrite").parquet(f"{store}/compacted/{name}/totals")
