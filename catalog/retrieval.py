"""Index, BM25, evidence and paragraph pruning."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.registry import query
from claimlake.functions.words import SEARCH_STOP_WORDS
from claimlake.operators import retrieval as rt
from claimlake.plans.verification import claim_evidence

_INDEX = f"""toks AS (SELECT doc_id, unnest({fx.sql_terms('text')}) AS term FROM documents),
postings AS (SELECT doc_id, term, count(*) AS tf, CAST(sum(count(*)) OVER (PARTITION BY doc_id) AS BIGINT) AS dl FROM toks GROUP BY doc_id, term),
terms AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
stats AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM (SELECT doc_id, any_value(dl) AS dl FROM postings GROUP BY doc_id))"""


def _ranked(k: int, query_sql: str = "SELECT item_id AS query_id, text FROM benchmark", terms=fx.sql_terms) -> str:
    return f"""{_INDEX.replace(fx.sql_terms('text'), terms('text'))}, queries AS ({query_sql}),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({terms('text')}) AS term FROM queries) GROUP BY ALL),
scored AS (
    SELECT query_id, doc_id, sum(CAST(round(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf / (tf + 0.9 * (1 - 0.4 + 0.4 * dl / avgdl)) * 1e12) AS BIGINT)) / 1e12 AS score
    FROM qt JOIN terms USING (term) JOIN postings USING (term), stats GROUP BY query_id, doc_id),
hits AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank, doc_id, round(score, 6) AS score
    FROM scored QUALIFY rank < {k})"""


def _hits(hits):
    return hits.withColumn("score", F.round("score", 6))


def _english(x: str) -> str:
    """Terms without possessive endings and stop words."""
    # RE2 cannot look ahead, so the sign after an ending is put back
    bare = f"regexp_replace(lower({x}) || ' ', '([\\p{{L}}\\p{{N}}])[''\u2019\uFF07]s([^\\p{{L}}\\p{{N}}])', '\\1\\2', 'g')"
    listed = ", ".join(f"'{w}'" for w in SEARCH_STOP_WORDS)
    return f"list_filter(regexp_split_to_array({bare}, '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '' AND t NOT IN ({listed}))"


@query("R1_index_corpus", f"WITH {_INDEX} SELECT doc_id, term, tf, dl FROM postings")
def _(spark, d):
    return rt.index_corpus(fx.corpus(spark, d), "simple").postings


@query("R1_index_terms", f"WITH {_INDEX} SELECT term, df, n_docs, round(avgdl, 6) AS avgdl FROM terms, stats")
def _(spark, d):
    index = rt.index_corpus(fx.corpus(spark, d), "simple")
    n_docs, avgdl = index.stats.select("n_docs").scalar(), index.stats.select("avgdl").scalar()
    return index.terms.groupBy("term").agg(F.sum("df").alias("df")).withColumn("n_docs", n_docs).withColumn("avgdl", F.round(avgdl, 6))


@query("R1_stored_index", f"WITH {_INDEX} SELECT term, df, CAST(sum(tf) AS BIGINT) AS cf FROM terms JOIN postings USING (term) GROUP BY ALL")
def _(spark, d):
    from claimlake.session import scratch_path

    path = scratch_path(spark, "index")
    rt.write_index(rt.index_corpus(fx.corpus(spark, d), "simple"), path)
    index = rt.read_index(spark, path, "simple")
    return index.terms.groupBy("term").agg(F.sum("df").alias("df")).join(index.postings.groupBy("term").agg(F.sum("tf").alias("cf")), "term")


@query("R2_bm25_topk", f"WITH {_ranked(10)} SELECT query_id, rank, doc_id, score FROM hits")
def _(spark, d):
    return _hits(rt.bm25_topk(rt.index_corpus(fx.corpus(spark, d), "simple"), fx.claims(spark, d), 10))


@query("R2_bm25_search", f"WITH {_ranked(5)} SELECT query_id, rank, doc_id, score FROM hits")
def _(spark, d):
    return _hits(rt.bm25_search(fx.corpus(spark, d), fx.claims(spark, d), 5, analyzer="simple"))


@query("R2_bm25_english", f"WITH {_ranked(10, terms=_english)} SELECT query_id, rank, doc_id, score FROM hits")
def _(spark, d):
    return _hits(rt.bm25_search(fx.corpus(spark, d), fx.claims(spark, d), 10, analyzer="english"))


@query("R2_bm25_stemmed")
def _(spark, d):
    """The default analyzer, with stems."""
    return _hits(rt.bm25_search(fx.corpus(spark, d), fx.claims(spark, d), 10))


@query("R2_bm25_many_queries", f"WITH {_ranked(3)} SELECT query_id, rank, doc_id, score FROM hits")
def _(spark, d):
    """Against a stored index, whose folders are picked by the terms of the queries."""
    from claimlake.session import scratch_path

    path = scratch_path(spark, "index")
    rt.write_index(rt.index_corpus(fx.corpus(spark, d), "simple"), path, buckets=16)
    return _hits(rt.bm25_topk(rt.read_index(spark, path, "simple"), fx.claims(spark, d), 3))


@query(
    "R3_retrieve_evidence",
    f"""WITH {_ranked(5)}, texts AS (SELECT h.query_id, string_agg({fx.sql_strip('d.text')}, chr(10) ORDER BY h.rank) AS t,
               string_agg(CAST(h.doc_id AS VARCHAR), ',' ORDER BY h.rank) AS doc_ids FROM hits h JOIN documents d USING (doc_id) GROUP BY h.query_id),
        cut AS (SELECT *, {fx.sql_words('t')} AS w FROM texts)
        SELECT query_id, CASE WHEN len(w) > 1000 THEN array_to_string(w[1:1000], ' ') ELSE t END AS evidence, doc_ids FROM cut""",
)
def _(spark, d):
    found = claim_evidence(fx.corpus(spark, d), fx.claims(spark, d), 5, 1000, analyzer="simple")
    ids = F.array_join(F.transform("log", lambda h: h["id"].cast("string")), ",")
    return found.select("query_id", "evidence", ids.alias("doc_ids"))


def _pruned(k: int) -> str:
    """CTE ``best(question_id, doc_id, rank, pos, score, text)``."""
    total = lambda x: f"CAST(sum(CAST({x} AS DECIMAL(38, 12))) AS DOUBLE)"
    return f"""paras AS (SELECT doc_id, unnest(l) AS text, unnest(range(len(l))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
        asked AS (SELECT b.item_id AS question_id, d.doc_id, {fx.sql_terms('b.text')} AS all_q
                  FROM benchmark b JOIN documents d ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id),
        tf AS (SELECT doc_id, pos, term, count(*) AS tf FROM (SELECT doc_id, pos, unnest({fx.sql_terms('text')}) AS term FROM paras) GROUP BY ALL),
        df AS (SELECT doc_id, term, count(*) AS df FROM tf GROUP BY ALL),
        n AS (SELECT doc_id, count(*) AS n FROM paras GROUP BY ALL),
        w AS (SELECT doc_id, pos, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w, ln((1 + n) / (1 + df)) + 1 AS idf FROM tf JOIN df USING (doc_id, term) JOIN n USING (doc_id)),
        norms AS (SELECT doc_id, pos, sqrt({total('w * w')}) AS norm FROM w GROUP BY ALL),
        qt AS (SELECT question_id, doc_id, term, count(*) AS qtf FROM (SELECT question_id, doc_id, unnest(all_q) AS term FROM asked) GROUP BY ALL),
        dots AS (SELECT q.question_id, w.doc_id, w.pos, {total('qtf * idf * w')} AS dot FROM w JOIN qt q USING (doc_id, term) GROUP BY ALL),
        scored AS (SELECT a.question_id, p.doc_id, p.pos, p.text, coalesce(d.dot / m.norm, 0) AS score
                   FROM paras p JOIN asked a USING (doc_id) LEFT JOIN norms m USING (doc_id, pos) LEFT JOIN dots d ON d.question_id = a.question_id AND d.doc_id = p.doc_id AND d.pos = p.pos),
        best AS (SELECT question_id, doc_id, row_number() OVER (PARTITION BY question_id, doc_id ORDER BY score DESC, pos) - 1 AS rank, pos, round(score, 6) AS score, text FROM scored QUALIFY rank < {k})"""


@query("R4_tfidf_prune", f"WITH {_pruned(3)} SELECT question_id, doc_id, rank, pos, score FROM best")
def _(spark, d):
    return _hits(rt.tfidf_prune(_questions(spark, d), _paragraphs(spark, d), 3, "simple"))


def _paragraphs(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))


def _questions(spark, d):
    """Every document is asked one of the benchmark's questions, in turn."""
    asked = fx.table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    n = asked.agg(F.count(F.lit(1)).alias("n")).scalar()
    docs = fx.table(spark, d, "documents").select("doc_id").withColumn("question_id", F.pmod(F.col("doc_id"), n))
    return docs.join(asked, "question_id")


@query("X2_tfidf_retriever", f"WITH {_pruned(2)} SELECT question_id AS query_id, rank, doc_id || '_' || pos AS doc_id, score, text FROM best")
def _(spark, d):
    asked = _questions(spark, d).withColumnRenamed("question_id", "query_id")
    return _hits(rt.TfidfRetriever(_paragraphs(spark, d), "simple").retrieve(asked, 2))


@query(
    "X2_bm25_retriever",
    f"WITH {_ranked(4)} SELECT h.query_id, h.rank, h.doc_id, h.score, {fx.sql_strip('d.text')} AS text FROM hits h JOIN documents d USING (doc_id)",
)
def _(spark, d):
    return _hits(rt.Bm25Retriever(fx.corpus(spark, d), analyzer="simple").retrieve(fx.claims(spark, d), 4))
