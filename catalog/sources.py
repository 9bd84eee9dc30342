"""Readers and writers: the given tables are written in a source format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.registry import query
from claimlake.operators.documents import corpus_from_documents
from claimlake.plans.corpus import dump_to_documents, dump_to_index
from claimlake.session import scratch_path
from claimlake.sources import records, sinks
from claimlake.sources.dumps import read_wiki_dump

def _break(spark, path, **options):
    """Add lines that are cut off, are no JSON or say nothing."""
    lines = ['{"id": "7", "title": "cut o', "no json", "{}", '{"mutated": "x" "original": 1}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").options(**options).text(path)


# Every document is an article, its lines are sentences, and its language is linked.


def _dump(spark, d, fmt="intro"):
    lines = F.split("text", "\n")
    title = F.concat(F.lit("page "), F.col("doc_id").cast("string"))
    linked = F.transform(lines, lambda s: F.concat(s, F.lit(' <a href="in%20'), F.col("lang"), F.lit('">l</a>')))
    text = lines if fmt == "intro" else F.replace("text", F.lit("\n"), F.lit("\n\n"))
    extra = [linked.alias("text_with_links")] if fmt == "intro" else []
    path = scratch_path(spark, f"dump-{fmt}")
    rows = fx.table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.lit("u").alias("url"), title.alias("title"), text.alias("text"), *extra
    )
    rows.write.option("compression", "bzip2").json(path)
    _break(spark, path, compression="bzip2")
    return path


_GLOB = "*.bz2"
_INTRO = """SELECT 'Page ' || doc_id || '_0' AS id, replace(text, chr(10), '') AS text,
    array_to_string(list_transform(string_split(text, chr(10)), lambda s: 'In ' || lang), '|') AS links, 'page ' || doc_id AS original_title FROM documents"""


@query("S1_read_intro_dump", _INTRO)
def _(spark, d):
    docs = read_wiki_dump(spark, _dump(spark, d), "intro", _GLOB)
    return docs.select("id", "text", F.array_join("links", "|").alias("links"), "original_title")


@query(
    "S2_read_full_dump",
    "SELECT 'Page ' || doc_id || '_0' AS id, replace(text, chr(10), chr(10) || chr(10)) AS text, 0 AS n_links, 'page ' || doc_id AS original_title FROM documents",
    whole=["n_links"],
)
def _(spark, d):
    docs = read_wiki_dump(spark, _dump(spark, d, "full"), "full", _GLOB)
    return docs.select("id", "text", F.size("links").alias("n_links"), "original_title")


@query(
    "X1_preprocess_hook",
    "SELECT 'Page ' || doc_id || '_0' AS id, length(text) - len(string_split(text, chr(10))) + 1 AS size FROM documents WHERE doc_id <> 13",
)
def _(spark, d):
    drop = lambda raw: raw.where(F.col("id") != "13")
    docs = read_wiki_dump(spark, _dump(spark, d), "intro", _GLOB, preprocess=drop)
    return docs.select("id", F.length("text").alias("size"))


@query("S3_read_pages", f"WITH {fx.SQL_PAGE} SELECT page_id, count(*) + 5 AS n_keys FROM lines_el GROUP BY page_id")
def _(spark, d):
    path = scratch_path(spark, "pages")
    fx.pages(spark, d).select("data").write.text(path)
    pages = records.read_pages(spark, path, glob="*.txt")
    return pages.select("page_id", F.size(F.json_object_keys("data")).alias("n_keys"))


@query("S3_read_page_table", f"WITH {fx.SQL_PAGE} SELECT page_id, count(*) + 5 AS n_keys FROM lines_el GROUP BY page_id")
def _(spark, d):
    path = scratch_path(spark, "page-table")
    fx.pages(spark, d).select(F.col("page_id").alias("id"), "data").write.parquet(path)
    return records.read_pages(spark, path, "parquet").select("page_id", F.size(F.json_object_keys("data")).alias("n_keys"))


@query(
    "S4_read_annotations",
    f"""WITH {fx.SQL_LINES}, {fx.SQL_ANNOTATIONS} SELECT a.id, a.claim, a.label, a.challenge, count(e.local_id) AS n_ids
        FROM ann a LEFT JOIN ev e USING (id) WHERE a.id % 10 <> 9 GROUP BY ALL""",
)
def _(spark, d):
    path = scratch_path(spark, "annotations")
    rows = fx.annotations(spark, d)
    body = F.to_json(F.struct(*[c for c in rows.columns]))
    # every tenth line is cut off, and every file has a header line
    broken = F.when(F.col("id") % 10 == 9, F.substring(body, F.lit(1), F.length(body) - 5)).otherwise(body)
    head = rows.select(F.lit('{"id": "", "claim": "", "evidence": [{"content": [], "context": {}}]}').alias("value")).limit(3)
    rows.select(broken.alias("value")).union(head).write.text(path)
    read = records.read_annotations(spark, path)
    ids = F.aggregate("evidence", F.lit(0), lambda n, s: n + F.size(s["content"]))
    return read.select("id", "claim", "label", "challenge", ids.alias("n_ids"))


@query("S5_read_pairs", f"WITH {fx.SQL_PAIRS} SELECT id, mutated, original, gold_evidence FROM pairs")
def _(spark, d):
    path = scratch_path(spark, "pairs")
    fx.pairs(spark, d).select("id", "mutated", "original", "gold_evidence").write.json(path)
    _break(spark, path)
    return records.read_pairs(spark, path)


@query("S5_read_claims", "SELECT CAST(doc_id AS VARCHAR) AS id, 2 + doc_id % 3 AS num_hops FROM documents")
def _(spark, d):
    path = scratch_path(spark, "claims")
    # one JSON array per source, as a claims file holds one
    claims = fx.table(spark, d, "documents").select("source", F.struct(F.col("doc_id").cast("string").alias("id"), (2 + F.col("doc_id") % 3).alias("num_hops")).alias("c"))
    chunk = F.concat_ws("-", "source", F.floor(F.col("c.id").cast("long") / 500))
    claims.groupBy(chunk).agg(F.to_json(F.collect_list("c")).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    _break(spark, path)
    return records.read_claims(spark, path).select("id", "num_hops")


@query("S6_read_predictions", f"WITH {fx.SQL_PREDICTIONS} SELECT CAST(id AS VARCHAR) AS id, gold, prediction FROM pred")
def _(spark, d):
    path = scratch_path(spark, "predictions")
    sinks.write_results(fx.predictions(spark, d), path)
    _break(spark, path)
    read = records.read_predictions(spark, path, multi_line=False)
    return read.select("id", F.trim("gold").alias("gold"), F.trim("prediction").alias("prediction"))


@query("S6_read_result_arrays", f"WITH {fx.SQL_SCORES} SELECT model, 'score' AS metric, count(*) AS n, round(sum(score), 2) AS total FROM scores GROUP BY model")
def _(spark, d):
    path = scratch_path(spark, "results")
    # result files of up to 1000 samples each, models and metrics as maps of arrays
    rows = fx.scores(spark, d).withColumn("file", F.floor(F.col("seq") / 1000))
    arrays = rows.groupBy("file", "model").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "score"))), lambda s: s["score"]).alias("scores"))
    models = arrays.groupBy("file").agg(
        F.map_from_entries(F.collect_list(F.struct("model", F.create_map(F.lit("score"), F.col("scores"))))).alias("detailed_results")
    )
    models.repartition(8, "file").select("detailed_results").write.option("maxRecordsPerFile", 1).json(path)
    read = records.read_result_arrays(spark, path)
    return read.groupBy("model", "metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 2).alias("total"))


@query(
    "S7_upsert_documents",
    """SELECT source AS id, max(doc_id) AS doc_id, 'new' AS origin FROM documents GROUP BY source
       UNION ALL SELECT lang, max(doc_id), 'old' FROM documents GROUP BY lang""",
)
def _(spark, d):
    docs = fx.table(spark, d, "documents")
    by_source = docs.select(F.col("source").alias("id"), "doc_id", F.lit("old").alias("origin"))
    existing = by_source.union(docs.select(F.col("lang").alias("id"), "doc_id", F.lit("old")))
    incoming = docs.select(F.col("source").alias("id"), "doc_id", F.lit("new").alias("origin"))
    return sinks.upsert_documents(existing, incoming, "id", ["doc_id"])


@query(
    "S7_upsert_into",
    """SELECT 'd' || doc_id AS id, doc_id, CASE WHEN doc_id % 10 = 3 THEN 'new' ELSE 'old' END AS origin FROM documents
       UNION ALL SELECT 'n' || item_id, item_id, 'new' FROM benchmark""",
)
def _(spark, d):
    """A stored document table, of which a tenth is replaced and to which some documents are added."""
    docs = fx.table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "doc_id")
    added = fx.table(spark, d, "benchmark").select(F.concat(F.lit("n"), F.col("item_id").cast("string")).alias("id"), F.col("item_id").alias("doc_id"))
    path = scratch_path(spark, "documents")
    sinks.upsert_into(docs.withColumn("origin", F.lit("old")), path, "id", ["doc_id"], buckets=32)
    sinks.upsert_into(docs.where("doc_id % 10 = 3").unionByName(added).withColumn("origin", F.lit("new")), path, "id", ["doc_id"], buckets=32)
    return sinks.read_documents(spark, path)


@query("S8_write_corpus", f"WITH {fx.SQL_DOCUMENTS} SELECT regexp_replace(id, '_0$', '') AS id, text AS contents FROM docs")
def _(spark, d):
    path = scratch_path(spark, "corpus")
    corpus = corpus_from_documents(fx.documents(spark, d))
    sinks.write_corpus(corpus, path)
    # a second write leaves the corpus alone
    sinks.write_corpus(corpus.limit(1), path)
    return spark.read.schema("id STRING, contents STRING").json(path)


@query(
    "S9_write_claims",
    f"""WITH {fx.SQL_LINES}, {fx.SQL_ANNOTATIONS} SELECT id, claim, label, split, 'oracle' AS mode FROM ann, (VALUES ('dev'), ('train')) s(split)""",
)
def _(spark, d):
    path = scratch_path(spark, "claims-out")
    claims = fx.annotations(spark, d).select("id", "claim", "label")
    for split in ("train", "dev"):
        sinks.write_claims(claims, path, split, "oracle")
    return spark.read.schema("id LONG, claim STRING, label STRING, split STRING, mode STRING").json(path)


@query("S1_dump_to_documents", _INTRO)
def _(spark, d):
    docs = dump_to_documents(spark, _dump(spark, d), "intro", _GLOB)
    return docs.select("id", "text", F.array_join("links", "|").alias("links"), "original_title")


_JOINED_TERMS = fx.sql_terms("replace(text, chr(10), '')")


@query(
    "R1_dump_to_index",
    f"WITH t AS (SELECT doc_id, unnest({_JOINED_TERMS}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df FROM t GROUP BY term",
)
def _(spark, d):
    terms = dump_to_index(spark, _dump(spark, d), scratch_path(spark, "searchable"), "intro", _GLOB, "simple").terms
    return terms.groupBy("term").agg(F.sum("df").alias("df"))
