"""BM25 and TF-IDF retrieval as joins over a postings table."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from claimlake.functions.binding import let
from claimlake.functions.multisets import multiset
from claimlake.functions.rows import rows_of
from claimlake.functions.stemming import stem_tokens
from claimlake.functions.text import _col, strip, truncate_tokens
from claimlake.functions.words import SEARCH_STOP_WORDS
from claimlake.session import cut_lineage

# Default ranking parameters.
K1, B, TOP_K = 0.9, 0.4, 10
#: Default of the number of folders a written postings table is split into by term; it is stored with the index.
TERM_BUCKETS = 64
#: A document's score is a sum of whole numbers, points of 1e-12, so that the order of adding does not matter.
POINT = 1_000_000_000_000
#: Steps in which the terms are added that bring no document in by themselves.
STEPS = 3

ANALYZER = "english_stem"


def analyze(c: Column | str, analyzer: str = ANALYZER) -> Column:
    """Terms of a text: ``simple`` is lower case split on anything but letters and digits; ``english`` also
    drops possessive endings and stop words; ``english_stem`` then stems."""
    text = F.lower(_col(c))
    if analyzer != "simple":
        text = F.regexp_replace(text, r"(?<=[\p{L}\p{N}])['\u2019\uFF07]s(?![\p{L}\p{N}])", "")
    terms = F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda t: t != "")
    if analyzer == "simple":
        return terms
    kept = F.filter(terms, lambda t: ~t.isin(SEARCH_STOP_WORDS))
    if analyzer == "english":
        return kept
    if analyzer == "english_stem":
        return stem_tokens(kept)
    raise ValueError(f"unknown analyzer: {analyzer}")


@dataclass
class SearchIndex:
    """``postings(doc_id, term, tf, dl)``, ``terms(term, span, df, most_tf, least_dl)`` and one row ``stats(n_docs,
    avgdl, buckets)``.

    A span is a range of document lengths, so there are few; ``buckets`` is null unless the postings lie in folders.
    ``vectors(doc_id, dl, terms)`` has a document's terms and counts in one row; an index may lack them.
    """

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    analyzer: str = ANALYZER
    vectors: DataFrame | None = None


def index_corpus(corpus: DataFrame, analyzer: str = ANALYZER) -> SearchIndex:
    """Postings and collection statistics of ``corpus(id, contents)``.

    Each text is analysed once and its terms are counted in its row; what is written is a row per document, from which
    postings and statistics are read. Texts are not moved.
    """
    vector = let(analyze("contents", analyzer), lambda t: F.struct(F.size(t).alias("dl"), multiset(t).alias("terms")))
    docs = cut_lineage(corpus.select(F.col("id").alias("doc_id"), vector.alias("v")).select("doc_id", "v.*"), "term-vectors")
    postings = _postings_of(docs)
    # texts without a term are not counted
    some = F.col("dl") > 0
    stats = docs.agg(F.count_if(some).alias("n_docs"), F.avg(F.when(some, F.col("dl"))).alias("avgdl"), F.lit(None).cast("int").alias("buckets"))
    return SearchIndex(postings, _term_counts(postings), stats, analyzer, docs)


def _postings_of(vectors: DataFrame) -> DataFrame:
    return vectors.transform(rows_of, ["doc_id", "dl"], "terms", "t").select("doc_id", F.col("t.gram").alias("term"), F.col("t.n").cast("long").alias("tf"), "dl")


def _span(dl: Column | str) -> Column:
    """Documents of 1, 2-3, 4-7, 8-15, ... terms."""
    return F.floor(F.log2(_col(dl).cast("double") + 0.5)).cast("int")


def _term_counts(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term", _span("dl").alias("span")).agg(F.count(F.lit(1)).alias("df"), F.max("tf").alias("most_tf"), F.min("dl").alias("least_dl"))


def write_index(index: SearchIndex, path: str, buckets: int = TERM_BUCKETS) -> None:
    """Store an index; postings go into ``buckets`` folders by term, so a few queries read the folders of their terms.

    Ranges over bucket, term and document give files of even size: a term that is in every document is split
    over many of them, and a task writes into few folders.
    """
    placed = index.postings.withColumn("bucket", _bucket(F.lit(buckets)))
    placed = placed.repartitionByRange("bucket", "term", "doc_id").sortWithinPartitions("bucket", "term")
    placed.write.partitionBy("bucket").parquet(f"{path}/postings")
    stored = index.postings.sparkSession.read.parquet(f"{path}/postings")
    _term_counts(stored).write.parquet(f"{path}/terms")
    index.stats.withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/stats")
    if index.vectors is not None:
        index.vectors.write.parquet(f"{path}/vectors")


def _bucket(buckets: Column) -> Column:
    return F.pmod(F.xxhash64("term"), buckets).cast("int")


def read_index(spark: SparkSession, path: str, analyzer: str = ANALYZER) -> SearchIndex:
    """An index stored by ``write_index``."""
    read = lambda part: spark.read.parquet(f"{path}/{part}")
    try:
        vectors = read("vectors")
    except AnalysisException:  # stored without them
        vectors = None
    return SearchIndex(read("postings"), read("terms"), read("stats"), analyzer, vectors)


def query_terms(queries: DataFrame, analyzer: str = ANALYZER) -> DataFrame:
    """``(query_id, term, qtf)`` of ``queries(query_id, text)``."""
    return queries.transform(rows_of, ["query_id"], analyze("text", analyzer), "term").groupBy("query_id", "term").agg(
        F.count(F.lit(1)).alias("qtf")
    )


def _weighted_terms(index: SearchIndex, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, term, weight, avgdl, seed``: the terms of each query; seeds are its rarest ones, until their
    documents are ``k`` together."""
    n_docs, avgdl, buckets = (index.stats.select(c).scalar() for c in ("n_docs", "avgdl", "buckets"))
    counts = index.terms.groupBy("term").agg(F.sum("df").alias("df"))
    terms = query_terms(queries, index.analyzer).join(counts, "term").withColumns({"n_docs": n_docs, "avgdl": avgdl, "buckets": buckets})
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rarest = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, 0)
    return terms.select(
        "query_id", "term", (F.col("qtf") * idf).alias("weight"), "avgdl", (F.sum("df").over(rarest) - F.col("df") < k).alias("seed"),
        *([_bucket(F.col("buckets")).alias("bucket")] if "bucket" in index.postings.columns else []),
    )


def _points(weight: Column, tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    length = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * dl / avgdl)
    return F.round(weight * tf / (tf + length) * POINT).cast("long")


def _scored(index: SearchIndex, terms: DataFrame, on: list[str], k1: float, b: float) -> DataFrame:
    """``query_id, doc_id, points`` of the postings that join ``terms``."""
    on = [*on, *(["bucket"] if "bucket" in index.postings.columns else [])]
    points = _points(F.col("weight"), F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
    return index.postings.withColumn("span", _span("dl")).join(terms, on).select("query_id", "doc_id", "span", points.alias("points"))


def _added(scored: DataFrame) -> DataFrame:
    return scored.groupBy("query_id", "doc_id", "span").agg(F.sum("points").alias("points"))


def _completed(index: SearchIndex, pairs: DataFrame, terms: DataFrame, on: list[str], k1: float, b: float) -> DataFrame:
    """``pairs`` with the points of their query's other ``terms`` added, which are looked up by term and document."""
    wanted = pairs.select("query_id", "doc_id", "span").join(terms, on)
    rest = _scored(index, wanted.drop("span"), ["term", "doc_id"], k1, b)
    return _added(pairs.unionByName(rest))


def bm25_candidates(index: SearchIndex, queries: DataFrame, k: int = TOP_K, k1: float = K1, b: float = B) -> tuple[DataFrame, DataFrame]:
    """``(query_id, doc_id, span, points)`` of the pairs that can still be among the ``k`` best, and the terms to
    complete them.

    The documents of a query's rarest terms are scored, and the k-th best of them is a threshold. In each span a term has
    a greatest possible number of points, from its greatest count and the shortest document there. Terms that stay under
    the threshold all together bring no document of the span in by themselves, so their postings, the long ones, are
    read for the candidates of the other terms only. They are added in steps, the greatest first, and after each step a
    candidate goes if what is left cannot lift it to the threshold.
    """
    terms = cut_lineage(_weighted_terms(index, queries, k), "query-terms")
    best = lambda: Window.partitionBy("query_id").orderBy(F.col("points").desc(), "doc_id")
    top = lambda scored, n: scored.withColumn("_rank", F.row_number().over(best())).where(F.col("_rank") <= n)
    seeds = cut_lineage(top(_added(_scored(index, terms.where("seed"), ["term"], k1, b)), 2 * k).drop("_rank"), "bm25-seeds")
    whole = top(_completed(index, seeds, terms.where("not seed"), ["query_id"], k1, b), k)
    floors = whole.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("points")).otherwise(0).alias("floor"))

    most = _points(F.col("weight"), F.col("most_tf"), F.col("least_dl"), F.col("avgdl"), k1, b) + 1
    spans = terms.drop("seed").join(index.terms.drop("df"), "term").withColumn("most", most).drop("most_tf", "least_dl").join(floors, "query_id")
    upwards = Window.partitionBy("query_id", "span").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
    # step 0: terms that bring documents in; then those whose sum is under the threshold, half of it, a quarter, ...
    under = F.sum("most").over(upwards)
    step = F.lit(0)
    for i in range(STEPS):
        step = F.when(under * 2**i < F.col("floor"), i + 1).otherwise(step)
    spans = spans.withColumn("step", step)
    rests = [F.sum(F.when(F.col("step") > i, F.col("most")).otherwise(0)).alias(f"rest{i}") for i in range(STEPS)]
    spans = cut_lineage(spans, "query-spans")
    reach = spans.groupBy("query_id", "span", "floor").agg(*rests)
    terms_of = lambda i: spans.where(F.col("step") == i).drop("floor", "most", "step")
    found = _added(_scored(index, terms_of(0), ["term", "span"], k1, b))
    for i in range(STEPS):
        if i:
            found = _completed(index, found, terms_of(i), ["query_id", "span"], k1, b)
        found = found.join(reach, ["query_id", "span"]).where(F.col("points") + F.col(f"rest{i}") >= F.col("floor"))
        found = cut_lineage(found.select("query_id", "doc_id", "span", "points"), "bm25-candidates")
    return found, terms_of(STEPS)


def _scored_in_place(index: SearchIndex, queries: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """``(query_id, doc_id, points)`` of every document with a term of the query. The vectors are dealt out by document,
    so a document's points are added where it lies, and pairs of queries and documents never move."""
    terms = cut_lineage(_weighted_terms(index, queries, k).select("query_id", "term", "weight", "avgdl"), "query-terms")
    postings = _postings_of(index.vectors.repartition("doc_id"))
    points = _points(F.col("weight"), F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
    return postings.join(terms, "term").groupBy("query_id", "doc_id").agg(F.sum(points).alias("points"))


def bm25_topk(index: SearchIndex, queries: DataFrame, k: int = TOP_K, k1: float = K1, b: float = B) -> DataFrame:
    """Ranked hits ``(query_id, rank, doc_id, score)``, rank from 0, ties by document id.

    With vectors, documents are scored where they lie. From postings alone, only pairs that can reach the k-th best
    score are scored in full, because pairs move there. Spark chooses how to join: few queries are broadcast, frequent
    terms are split by adaptive execution. The rank filter keeps at most ``k`` rows per query in each partition before
    the last shuffle.
    """
    if index.vectors is not None:
        scored = _scored_in_place(index, queries, k, k1, b)
    else:
        candidates, left = bm25_candidates(index, queries, k, k1, b)
        scored = _completed(index, candidates, left, ["query_id", "span"], k1, b)
    return _top(scored.select("query_id", "doc_id", (F.col("points") / POINT).alias("score")), ["query_id"], k, "doc_id")


def _top(scored: DataFrame, by: list[str], k: int, tie: str) -> DataFrame:
    best = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col(tie))
    ranked = scored.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= k)
    return ranked.select(*by, (F.col("_rank") - 1).alias("rank"), *[c for c in scored.columns if c not in by])


def bm25_search(corpus: DataFrame, queries: DataFrame, k: int = TOP_K, k1: float = K1, b: float = B, analyzer: str = ANALYZER) -> DataFrame:
    """Top hits straight from a corpus, which is indexed for this call."""
    return bm25_topk(index_corpus(corpus, analyzer), queries, k, k1, b)


def with_text(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """Hits plus the trimmed ``text`` of their documents. Hits are written, so that Spark knows their size: few are
    broadcast and leave the corpus where it is, a document that is hit very often is split."""
    hits = cut_lineage(hits, "hits")
    texts = corpus.select(F.col("id").alias("doc_id"), strip("contents").alias("text"))
    return hits.join(texts, "doc_id").select(*hits.columns, "text")


def retrieve_evidence(hits: DataFrame, max_tokens: int | None = None) -> DataFrame:
    """``(query_id, evidence, log)``: hit texts in rank order, cut to ``max_tokens`` words, and what was found.

    A query has at most k hits, so its list is short.
    """
    ordered = F.sort_array(F.collect_list(F.struct("rank", "text", "doc_id", "score")))
    joined = hits.groupBy("query_id").agg(ordered.alias("_hits"))
    return joined.select(
        "query_id",
        truncate_tokens(F.array_join(F.transform("_hits", lambda h: strip(h["text"])), "\n"), max_tokens).alias("evidence"),
        F.transform("_hits", lambda h: F.struct(h["doc_id"].alias("id"), h["score"].alias("score"))).alias("log"),
    )


def tfidf_terms(paragraphs: DataFrame, analyzer: str = ANALYZER) -> DataFrame:
    """The term table of each document, ``doc_id, term, idf, places``: in which paragraphs a term is, how often.

    Terms are counted in the paragraph's row. What moves, once, are term counts by document and term, so that a document
    of very many paragraphs is split by its terms. ``idf`` is ``ln((1 + n) / (1 + df)) + 1`` over the paragraphs of the
    one document.
    """
    counted = paragraphs.select("doc_id", "pos", multiset(analyze("text", analyzer)).alias("terms"))
    sizes = paragraphs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    grouped = counted.transform(rows_of, ["doc_id", "pos"], "terms", "t").groupBy("doc_id", F.col("t.gram").alias("term"))
    terms = grouped.agg(F.collect_list(F.struct("pos", F.col("t.n").alias("tf"))).alias("places"))
    idf = F.log((1 + F.col("n")) / (1 + F.size("places"))) + 1
    return cut_lineage(terms.join(sizes, "doc_id").select("doc_id", "term", idf.alias("idf"), "places"), "paragraph-terms")


def _asked_terms(paragraphs: DataFrame, asked: DataFrame, analyzer: str) -> DataFrame:
    """``doc_id, idf, places, asks`` of each term of a document: where it is, and the questions that ask for it.

    Counted paragraphs and questions are dealt out by document once, and all that follows is added up where they lie.
    """
    counted = paragraphs.select("doc_id", "pos", multiset(analyze("text", analyzer)).alias("terms"))
    counted = counted.repartition("doc_id").transform(rows_of, ["doc_id", "pos"], "terms", "t")
    places = counted.groupBy("doc_id", F.col("t.gram").alias("term")).agg(F.collect_list(F.struct("pos", F.col("t.n").alias("tf"))).alias("places"))
    by_term = asked.groupBy("doc_id", "term").agg(F.collect_list(F.struct("question_id", "q")).alias("asks"))
    by_doc = by_term.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "asks"))).alias("all_asks"))
    sizes = paragraphs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    idf = F.log((1 + F.col("n")) / (1 + F.size("places"))) + 1
    found = places.join(sizes.join(by_doc, "doc_id", "left"), "doc_id")
    return cut_lineage(found.select("doc_id", idf.alias("idf"), "places", F.col("all_asks")[F.col("term")].alias("asks")), "asked-terms")


def tfidf_prune(questions: DataFrame, paragraphs: DataFrame, keep: int = 10, analyzer: str = ANALYZER, terms: DataFrame | None = None) -> DataFrame:
    """The ``keep`` best paragraphs ``(question_id, doc_id, pos, rank, score)`` of a document for a question.

    ``questions(question_id, doc_id, text)``, ``paragraphs(doc_id, pos, text)``. Weights are ``tf * idf``. The score is
    the dot product divided by the paragraph's length; the question's length would not change the ranking. Many
    questions may ask the same ``terms`` of ``tfidf_terms``; paragraph lengths are worked out once per paragraph.
    Sums are decimals, so the order of adding does not matter.
    """
    exact = lambda x: F.sum(x.cast("decimal(38, 12)")).cast("double")
    weight = F.col("p.tf") * F.col("idf")
    asked = questions.transform(rows_of, ["question_id", "doc_id"], multiset(analyze("text", analyzer)), "q")
    asked = asked.select("question_id", "doc_id", F.col("q.gram").alias("term"), F.col("q.n").alias("q"))
    if terms is None:
        terms = _asked_terms(paragraphs, asked, analyzer)
        found = terms.transform(rows_of, ["doc_id", "idf", "places"], "asks", "a").select(F.col("a.question_id").alias("question_id"), "doc_id", F.col("a.q").alias("q"), "idf", F.explode("places").alias("p"))
    else:
        found = asked.join(terms, ["doc_id", "term"]).select("question_id", "doc_id", "q", "idf", F.explode("places").alias("p"))
    norms = terms.select("doc_id", "idf", F.explode("places").alias("p")).groupBy("doc_id", "p.pos").agg(F.sqrt(exact(weight * weight)).alias("norm"))
    dots = found.groupBy("question_id", "doc_id", "p.pos").agg(exact(F.col("q") * F.col("idf") * weight).alias("dot"))
    # paragraphs without a common term score 0; no text moves for them
    every = questions.select("question_id", "doc_id").join(paragraphs.select("doc_id", "pos"), "doc_id")
    scored = every.join(dots.join(norms, ["doc_id", "pos"]), ["question_id", "doc_id", "pos"], "left")
    score = F.coalesce(F.col("dot") / F.col("norm"), F.lit(0.0))
    return _top(scored.select("question_id", "doc_id", "pos", score.alias("score")), ["question_id", "doc_id"], keep, "pos")


class Retriever(Protocol):
    """Ranks documents for queries; one call serves a single query as well as a batch."""

    def retrieve(self, queries: DataFrame, top_k: int = TOP_K) -> DataFrame:
        """``queries(query_id, text)`` to ``(query_id, rank, doc_id, score, text)``."""


@dataclass
class Bm25Retriever:
    """BM25 over a corpus, from a stored index when there is one."""

    corpus: DataFrame
    index: SearchIndex | None = None
    k1: float = K1
    b: float = B
    analyzer: str = ANALYZER

    def retrieve(self, queries: DataFrame, top_k: int = TOP_K) -> DataFrame:
        index = index_corpus(self.corpus, self.analyzer) if self.index is None else self.index
        return with_text(bm25_topk(index, queries, top_k, self.k1, self.b), self.corpus)


@dataclass
class TfidfRetriever:
    """Paragraphs of the documents a question is bound to, best first."""

    paragraphs: DataFrame
    analyzer: str = ANALYZER

    def retrieve(self, queries: DataFrame, top_k: int = TOP_K) -> DataFrame:
        """``queries(query_id, doc_id, text)``; ``doc_id`` of a hit is ``document_paragraph``."""
        asked = queries.select(F.col("query_id").alias("question_id"), "doc_id", "text")
        best = tfidf_prune(asked, self.paragraphs, top_k, self.analyzer)
        return best.join(self.paragraphs, ["doc_id", "pos"]).select(
            F.col("question_id").alias("query_id"), "rank", F.concat_ws("_", "doc_id", "pos").alias("doc_id"), "score", "text"
        )
