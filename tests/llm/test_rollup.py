import random

import pytest

from claimlake.llm.token_rollup import commit_batch, compact, count_tokens, signed, totals

SCHEMA = "source string, lang string, tokenizer string, kind string, old_tokens long, new_tokens long, n_docs string"


def rows_of(spark, rows):
    """With a column of the caller's own that has the name of a result."""
    return spark.createDataFrame([(*r, "own") for r in rows], SCHEMA)


def brute(rows):
    out = {}
    for source, lang, tokenizer, kind, old, new in rows:
        docs, tokens = out.get((source, lang, tokenizer), (0, 0))
        old, new = old or 0, new or 0
        step = {"insert": (1, new), "delete": (-1, -old), "revise": (0, new - old)}[kind]
        out[source, lang, tokenizer] = (docs + step[0], tokens + step[1])
    return {k: v for k, v in out.items() if v != (0, 0)}


def as_dict(df):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in df.collect()}


@pytest.fixture
def batches():
    r = random.Random(6)
    row = lambda: (r.choice(["a", "b", None, ""]), r.choice(["en", None]), r.choice(["t1", "t2"]), r.choice(["insert", "delete", "revise"]), r.choice([None, 3, 9]), r.choice([None, 0, 5]))
    return [[row() for _ in range(n)] for n in (60, 40, 1)] + [[("x", "en", "t1", "insert", None, 7)], [("x", "en", "t1", "delete", 7, None)]]


def test_totals_match_recounting(spark, tmp_path, batches):
    store, sent = str(tmp_path / "s"), []
    assert totals(spark, store).count() == 0
    for k, rows in enumerate(batches):
        commit_batch(rows_of(spark, rows), store, f"b{k}")
        commit_batch(rows_of(spark, rows).repartition(3), store, f"b{k}")  # sent twice
        sent += rows
        assert as_dict(totals(spark, store)) == brute(sent)
        if k == 1:
            compact(spark, store, "c1")
        if k == 2:
            compact(spark, store, "c2", before="c1")
    assert as_dict(totals(spark, store, "c1")) == as_dict(totals(spark, store, "c2")) == brute(sent)


def test_empty_batches_and_unknown_kinds(spark, tmp_path):
    store = str(tmp_path / "s")
    commit_batch(rows_of(spark, [("a", "b", "c", "insert", None, 1)]).limit(0), store, "none")
    assert totals(spark, store).count() == 0
    with pytest.raises(Exception, match="unknown kind"):
        signed(rows_of(spark, [("a", "b", "c", None, 1, 1)])).collect()
    with pytest.raises(ValueError):
        commit_batch(rows_of(spark, [("a", "b", "c", "insert", None, 1)]), store, "a/b")


def test_counting_rules(spark):
    df = spark.createDataFrame([("a b,\tc\u00a0d",), ("",), (None,), ("Öl!! x2",)], "t string")
    got = df.select(count_tokens(df["t"], "words-1").alias("w"), count_tokens(df["t"], "pieces-1").alias("p")).collect()
    assert [(r["w"], r["p"]) for r in got] == [(3, 6), (0, 0), (0, 0), (2, 4)]


def test_a_compacted_batch_is_sent_again(spark, tmp_path):
    store, row = str(tmp_path / "store"), lambda n: rows_of(spark, [("a", "b", "c", "insert", None, n), ("a", "x", "c", "insert", None, 1)])
    commit_batch(row(5), store, "one")
    commit_batch(row(2), store, "two")
    compact(spark, store, "c1")
    commit_batch(row(9), store, "one")  # other counts under the old name
    commit_batch(rows_of(spark, [("n", "b", "c", "insert", None, 4)]), store, "three")
    compact(spark, store, "c2", before="c1")
    want = {("a", "b", "c"): (2, 11), ("a", "x", "c"): (2, 2), ("n", "b", "c"): (1, 4)}
    assert as_dict(totals(spark, store)) == as_dict(totals(spark, store, "c1")) == as_dict(totals(spark, store, "c2")) == want


def test_a_broken_commit_leaves_the_batch_as_it_was(spark, tmp_path):
    store = str(tmp_path / "store")
    commit_batch(rows_of(spark, [("a", "b", "c", "insert", None, 5)]), store, "one")
    with pytest.raises(Exception):
        commit_batch(rows_of(spark, [("a", "b", "c", "unknown", None, 7)]), store, "one")
    assert as_dict(totals(spark, store)) == {("a", "b", "c"): (1, 5)}
