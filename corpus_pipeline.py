"""A training corpus from raw documents: five stages, each written and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimlake.llm.bpe import encode_documents
from claimlake.llm.decontam import keep_uncontaminated
from claimlake.llm.lines import drop_repeated
from claimlake.llm.quality import keep_good
from claimlake.llm.queries import tokenizer_path
from claimlake.llm.rowkeys import kept_table, read_table
from claimlake.llm.simhash import keep_one

#: As in the near-duplicate query: three-word shingles, and fingerprints of 64 bits that differ in three bits or fewer.
NEAR = {"words": 3, "bits": 64, "radius": 3}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules of their language and source."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a later document has too."""
    return drop_repeated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one(docs, **NEAR)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return keep_uncontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, the token ids and their digests."""
    return encode_documents(docs, tokenizer_path(), ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("bpe_encoding", tokenize),
]

#: SQL has no SimHash and no BPE; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
