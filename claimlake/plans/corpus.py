"""From dump files to a searchable corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimlake.operators.documents import corpus_from_documents
from claimlake.operators.retrieval import ANALYZER, SearchIndex, index_corpus, read_index, write_index
from claimlake.sources.dumps import read_wiki_dump
from claimlake.sources.sinks import upsert_documents, write_corpus


def dump_to_documents(spark: SparkSession, path: str, fmt: str = "intro", glob: str = "wiki_*") -> DataFrame:
    """Document table with one row per id; of several articles with one id the last by file and id stays."""
    docs = read_wiki_dump(spark, path, fmt, glob)
    return upsert_documents(docs.limit(0), docs, "id", ["source_file", "wiki_id"])


def dump_to_index(
    spark: SparkSession, path: str, out: str, fmt: str = "intro", glob: str = "wiki_*", analyzer: str = ANALYZER
) -> SearchIndex:
    """Write corpus and index of a dump to ``out`` and open the index."""
    write_corpus(corpus_from_documents(dump_to_documents(spark, path, fmt, glob)), f"{out}/corpus")
    corpus = spark.read.schema("id STRING, contents STRING").json(f"{out}/corpus")
    write_index(index_corpus(corpus, analyzer), f"{out}/index")
    return read_index(spark, f"{out}/index", analyzer)
