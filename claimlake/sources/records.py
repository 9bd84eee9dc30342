"""Readers for pages, annotations, claims, correction pairs, predictions and metric files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.functions.rows import rows_of

ANNOTATION_SCHEMA = """
    id BIGINT, claim STRING, label STRING, challenge STRING,
    annotator_operations ARRAY<STRUCT<operation: STRING, value: STRING, time: STRING>>,
    evidence ARRAY<STRUCT<content: ARRAY<STRING>, context: MAP<STRING, ARRAY<STRING>>,
                          text: ARRAY<STRING>, context_text: MAP<STRING, ARRAY<STRING>>>>,
    predicted_evidence ARRAY<STRING>, predicted_verdict STRING
    """
CLAIM_SCHEMA = "id STRING, claim STRING, label STRING, num_hops INT, evidence STRING"
PAIR_SCHEMA = "id STRING, mutated STRING, original STRING, gold_evidence STRING"
PREDICTION_SCHEMA = "id STRING, claim STRING, gold STRING, prediction STRING"
RESULT_SCHEMA = (
    "average_results MAP<STRING, MAP<STRING, DOUBLE>>, detailed_results MAP<STRING, MAP<STRING, ARRAY<DOUBLE>>>"
)
METRIC_SCHEMA = (
    "sample_id STRING, prediction STRING, metrics STRUCT<rouge1: DOUBLE, rouge2: DOUBLE, rougeL: DOUBLE, sari: DOUBLE>"
)


def read_pages(spark: SparkSession, path: str, fmt: str = "jsonl", glob: str = "*.jsonl") -> DataFrame:
    """Page table ``(page_id, data)``, ``data`` being the page JSON.

    ``jsonl`` walks a folder tree of line files and also keeps ``source_file``; ``parquet`` reads a page
    table with the columns ``id`` and ``data``.
    """
    if fmt == "parquet":
        return spark.read.parquet(path).select(F.col("id").alias("page_id"), "data")
    if fmt != "jsonl":
        raise ValueError(f"unknown page format: {fmt}")
    lines = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path)
    return lines.select(
        F.get_json_object("value", "$.title").alias("page_id"),
        F.col("value").alias("data"),
        F.col("_metadata.file_path").alias("source_file"),
    ).where(F.col("page_id").isNotNull())


def read_annotations(spark: SparkSession, path: str, skip_header: bool = True) -> DataFrame:
    """Annotation lines; broken lines are dropped, and with ``skip_header`` so are lines without a claim."""
    rows = read_whole(spark, path, ANNOTATION_SCHEMA)
    # the header line carries neither a usable id nor a claim
    return rows.where(F.col("id").isNotNull() & (F.trim("claim") != "")) if skip_header else rows


def read_whole(spark: SparkSession, path: str, schema: str, multi_line: bool = False, **options: object) -> DataFrame:
    """JSON rows of a schema without the broken ones.

    With ``multi_line`` a file is one JSON value, a broken file has no rows, and one task reads a file: large data
    are line files.
    """
    reader = spark.read.schema(schema + ", _broken STRING").option("columnNameOfCorruptRecord", "_broken").option("multiLine", multi_line)
    rows = reader.options(**options).json(path)
    # a row that says nothing is none; this also keeps _broken from being the only column read, which Spark refuses
    says = [F.col(c).isNotNull() for c in rows.columns if c != "_broken"]
    return rows.where(F.col("_broken").isNull() & reduce(Column.__or__, says)).drop("_broken")


def broken_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``value``: the lines of line files that ``read_whole`` leaves out because they are not JSON of the schema."""
    parsed = F.from_json("value", schema + ", _broken STRING", {"columnNameOfCorruptRecord": "_broken"})
    return spark.read.text(path).where(parsed["_broken"].isNotNull())


def read_claims(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Claims from JSON array files, or from line files."""
    return read_whole(spark, path, CLAIM_SCHEMA, multi_line)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Correction pairs, one JSON object per line."""
    return read_whole(spark, path, PAIR_SCHEMA)


def read_predictions(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Predictions from JSON array files, or from line files (which large results are split into)."""
    return read_whole(spark, path, PREDICTION_SCHEMA, multi_line)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result files as they are: stored means and metric arrays per model."""
    return read_whole(spark, path, RESULT_SCHEMA, True)


def read_result_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Result files with parallel metric arrays as rows ``(model, metric, seq, score)``."""
    return (
        read_results(spark, path)
        .select(F.explode("detailed_results").alias("model", "metrics"))
        .select("model", F.explode("metrics").alias("metric", "scores"))
        .transform(rows_of, ["model", "metric"], "scores", "score", "seq")
    )


def read_metric_rows(spark: SparkSession, path: str) -> DataFrame:
    """Per-sample metrics, one JSON object per line."""
    return read_whole(spark, path, METRIC_SCHEMA)
