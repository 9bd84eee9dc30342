import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from claimlake.operators import retrieval as rt
from claimlake.plans.verification import claim_evidence
from claimlake.session import spread_join

TEXTS = {
    1: "The red mill stands in Arden. The mill is old.",
    2: "Arden is a town; its mill burned down.",
    3: "Nothing of note.",
    4: "",
    5: "mill mill mill mill",
    6: "Older mills: the red one, the blue one.",
}
QUERIES = [("a", "red mill mill"), ("b", "Arden town"), ("c", "zebra"), ("d", "the of one")]


def tokens(text):
    return [t for t in re.split(r"[^\w]+", text.lower()) if t]


def brute_bm25(texts, queries, k, k1=0.9, b=0.4):
    docs = {i: Counter(tokens(t)) for i, t in texts.items() if tokens(t)}
    size = {i: sum(c.values()) for i, c in docs.items()}
    avg = sum(size.values()) / len(size)
    out = {}
    for qid, query in queries:
        scores = Counter()
        for term, qtf in Counter(tokens(query)).items():
            df = sum(term in c for c in docs.values())
            idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
            for i, c in docs.items():
                if term in c:
                    scores[i] += qtf * idf * c[term] / (c[term] + k1 * (1 - b + b * size[i] / avg))
        best = sorted(scores.items(), key=lambda s: (-round(s[1], 12), s[0]))[:k]
        out.update({(qid, rank): (i, round(s, 6)) for rank, (i, s) in enumerate(best)})
    return out


def frames(spark, texts=TEXTS):
    items = list(texts.items())
    random.Random(1).shuffle(items)
    return spark.createDataFrame(items, "id long, contents string"), spark.createDataFrame(QUERIES, "query_id string, text string")


def as_dict(hits):
    return {(r.query_id, r["rank"]): (r.doc_id, pytest.approx(r.score, abs=1e-6)) for r in hits.collect()}


def test_bm25_all_ways_match_brute_force(spark, tmp_path):
    corpus, queries = frames(spark)
    want = brute_bm25(TEXTS, QUERIES, 3)
    index = rt.index_corpus(corpus, "simple")
    rt.write_index(index, str(tmp_path / "index"), buckets=3)
    stored = rt.read_index(spark, str(tmp_path / "index"), "simple")
    assert stored.stats.first()["buckets"] == 3
    for hits in (rt.bm25_topk(index, queries, 3), rt.bm25_topk(stored, queries, 3), rt.bm25_search(corpus, queries, 3, analyzer="simple")):
        assert as_dict(hits) == want


def test_bm25_does_not_depend_on_input_order(spark):
    corpus, queries = frames(spark)
    a = rt.bm25_search(corpus.orderBy("id"), queries, 5, analyzer="simple")
    b = rt.bm25_search(corpus.orderBy(F.desc("id")).repartition(3), queries, 5, analyzer="simple")
    assert as_dict(a) == as_dict(b)


def many_texts(size=600):
    """Frequent words in every text, rare ones in a few, and texts that are the same."""
    r = random.Random(6)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(400)]
    text = lambda n: " ".join(r.choice(common) if r.random() < 0.8 else rare[min(int(r.expovariate(0.02)), 399)] for _ in range(n))
    texts = {i: text(r.randint(1, 60)) for i in range(size)}
    texts |= {size + 100 + i: texts[i] for i in range(40)}
    return texts, [(f"q{i}", text(r.randint(1, 25))) for i in range(40)] + [("none", "zzz"), ("empty", ""), ("common", "c0 c1 c1")]


@pytest.mark.parametrize("k,k1,b", [(5, 0.9, 0.4), (1, 1.2, 0.75), (30, 0.5, 0.0), (1000, 0.9, 1.0)])
def test_pruning_changes_no_hit(spark, k, k1, b):
    texts, queries = many_texts()
    corpus = spark.createDataFrame(list(texts.items()), "id long, contents string").repartition(4)
    asked = spark.createDataFrame(queries, "query_id string, text string")
    got = as_dict(rt.bm25_topk(rt.index_corpus(corpus, "simple"), asked, k, k1, b))
    assert got == brute_bm25(texts, queries, k, k1, b)


def test_few_pairs_are_scored(spark):
    """Frequent words bring no document in, so far less than queries x documents are looked at."""
    texts, queries = many_texts(2500)
    queries = [q for q in queries if any(t.startswith("r") for t in q[1].split())]
    corpus = spark.createDataFrame(list(texts.items()), "id long, contents string")
    asked = spark.createDataFrame(queries, "query_id string, text string")
    pairs, left = rt.bm25_candidates(rt.index_corpus(corpus, "simple"), asked, 3)
    assert left.count() > 0
    assert pairs.count() < len(texts) * len(queries) / 10


def test_evidence_text_and_log(spark):
    corpus, queries = frames(spark)
    rows = {r.query_id: r for r in claim_evidence(corpus, queries, 2, 4, analyzer="simple").collect()}
    assert set(rows) == {"a", "b", "d"}
    assert rows["b"].evidence == "Arden is a town;"
    assert [h.id for h in rows["b"].log] == [2, 1]


def test_analyzers(spark):
    df = spark.createDataFrame([("The mills' running",)], "c string")
    assert df.select(rt.analyze("c", "english")).first()[0] == ["mills", "running"]
    assert df.select(rt.analyze("c", "english_stem")).first()[0] == ["mill", "run"]
    with pytest.raises(ValueError):
        rt.analyze("c", "none")
    df = spark.createDataFrame([("The mill's wheel isn't John\u2019s; 's s'S o'shea",)], "c string")
    assert df.select(rt.analyze("c", "english")).first()[0] == ["mill", "wheel", "isn", "t", "john", "s", "s", "o", "shea"]


def test_stems_are_the_default(spark):
    corpus = spark.createDataFrame([(1, "running mills"), (2, "the blue sky"), (3, "nothing")], "id long, contents string")
    asked = spark.createDataFrame([("a", "The mill runs"), ("b", "was it the")], "query_id string, text string")
    assert [(r.query_id, r.doc_id) for r in rt.bm25_search(corpus, asked, 5).collect()] == [("a", 1)]


def test_tfidf_prune(spark):
    paras = spark.createDataFrame([(1, 0, "red mill"), (1, 1, "blue sky"), (1, 2, ""), (1, 3, "mill of the sky"), (2, 0, "red")], "doc_id long, pos int, text string")
    asked = spark.createDataFrame([("q", 1, "the red mill"), ("r", 2, "none")], "question_id string, doc_id long, text string")
    got = {(r.question_id, r["rank"]): r.pos for r in rt.tfidf_prune(asked, paras, 2, "simple").collect()}
    assert got == {("q", 0): 0, ("q", 1): 3, ("r", 0): 0}


@pytest.mark.parametrize("how", ["left", "inner"])
def test_spread_join_equals_join(spark, how):
    # one key holds most of the rows
    left = spark.range(2000).select("id", F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id")).alias("k"))
    right = spark.range(0, 1500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    spread = spread_join(left, right, ["k"], [F.col("id")], how)
    plain = left.join(right, ["k"], how)
    assert sorted(map(tuple, spread.collect()), key=repr) == sorted(map(tuple, plain.select(*spread.columns).collect()), key=repr)


def test_term_table_serves_many_questions(spark):
    r = random.Random(3)
    paras = [(d, p, " ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 9)))) for d in range(12) for p in range(r.randint(1, 25))]
    asked = [(f"q{i}", r.randint(0, 12), " ".join(r.choice("abcdxyz") for _ in range(r.randint(0, 6)))) for i in range(60)]
    want = {}
    for q, d, text in asked:
        own = [(p, Counter(t.split())) for doc, p, t in paras if doc == d]
        idf = lambda t: math.log((1 + len(own)) / (1 + sum(t in c for _, c in own))) + 1
        scores = []
        for p, c in own:
            norm = math.sqrt(sum((c[t] * idf(t)) ** 2 for t in c))
            dot = sum(n * idf(t) * c[t] * idf(t) for t, n in Counter(text.split()).items() if t in c)
            scores.append((-round(dot / norm, 9) if norm else 0.0, p))
        for rank, (score, p) in enumerate(sorted(scores)[:4]):
            want[q, rank] = (p, pytest.approx(-score, abs=1e-6))
    frame = spark.createDataFrame(paras, "doc_id long, pos int, text string")
    terms = rt.tfidf_terms(frame, "simple")
    got = rt.tfidf_prune(spark.createDataFrame(asked, "question_id string, doc_id long, text string"), frame, 4, "simple", terms).collect()
    assert {(x.question_id, x["rank"]): (x.pos, x.score) for x in got} == want


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_stay_where_they_are(spark):
    corpus, queries = frames(spark)
    index = rt.index_corpus(corpus, "simple")
    assert "Exchange" not in plan_of(index.postings)
    plan = plan_of(rt.bm25_topk(index, queries, 3))
    assert "WindowGroupLimit" in plan and "BroadcastHashJoin" in plan


def test_documents_are_scored_where_they_lie(spark, tmp_path):
    """A stored index scores from its vectors, no pair of query and document moves, and postings alone give the same."""
    texts, queries = many_texts(200)
    corpus = spark.createDataFrame(list(texts.items()), "id long, contents string").repartition(3)
    asked = spark.createDataFrame(queries, "query_id string, text string")
    rt.write_index(rt.index_corpus(corpus, "simple"), str(tmp_path / "index"), buckets=3)
    stored = rt.read_index(spark, str(tmp_path / "index"), "simple")
    hits = rt.bm25_topk(stored, asked, 4)
    assert not re.search(r"Exchange hashpartitioning\(query_id#\w+, doc_id#", plan_of(hits))
    assert as_dict(hits) == brute_bm25(texts, queries, 4)
    stored.vectors = None
    assert as_dict(rt.bm25_topk(stored, asked, 4)) == as_dict(hits)


def test_pruning_deals_terms_out_once(spark):
    """Without a term table no table of terms is joined by document and term, and the result is that of the table."""
    paras = spark.createDataFrame([(d, p, " ".join("abcdefg"[(d * p + i) % 7] for i in range(p))) for d in range(9) for p in range(6)], "doc_id long, pos int, text string")
    asked = spark.createDataFrame([(f"q{i}", i % 10, "a b b g" if i % 2 else "c zz") for i in range(30)], "question_id string, doc_id long, text string")
    plain = rt.tfidf_prune(asked, paras, 3, "simple")
    by_term = r"Join \[doc_id#\w+, term#"
    assert not re.search(by_term, plan_of(plain))
    assert re.search(by_term, plan_of(rt.tfidf_prune(asked, paras, 3, "simple", rt.tfidf_terms(paras, "simple"))))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, rt.tfidf_prune(asked, paras, 3, "simple", rt.tfidf_terms(paras, "simple")).collect()))
