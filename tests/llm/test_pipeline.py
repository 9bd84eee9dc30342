import duckdb
import pytest

import corpus_pipeline
from claimlake.llm.queries import ORACLES, QUERIES
from claimlake.llm.rowkeys import kept_table
from tests.llm.conftest import documents
from tests.llm.test_simhash import brute_groups, brute_print, near_copies
from tools.check import TABLES, _rows

DATA = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    df = QUERIES[name](spark, DATA)
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(columns, want.fetchall())


def planted():
    base = near_copies(1, 150, 0, 11)[0]
    clean = [near_copies(1, 120, 0, 200 + k)[0] for k in range(30)]
    item = " ".join(f"bench{k}" for k in range(40))
    footer = "this footer line stands under many of the documents"
    texts = [f"{t}\n{footer}" if k < 6 else t for k, t in enumerate(clean)]
    texts += [base, base, base.replace(" ", "  ", 3), *near_copies(3, 900, 1, 11)]
    texts += [f"{clean[0][:300]} {item} {near_copies(1, 100, 0, 900)[0]}", "too short", "word " * 200, None, ""]
    return texts, item, footer


def test_stages_do_their_work(spark, tmp_path):
    texts, item, footer = planted()
    docs = documents(spark, texts).where("doc_id is not null and not (doc_id = 6 and text like 'another%')").dropDuplicates(["doc_id"])
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = kept_table(stage(spark, now, str(tmp_path)), "test-pipeline")
        left[name] = now.collect()
        if name != "bpe_encoding":
            assert now.columns == docs.columns
    ids = {n: {r["doc_id"] for r in rows} for n, rows in left.items()}
    assert ids["quality_rules"] == set(range(37))  # the short, the repetitive and the empty ones are gone
    assert ids["line_dedup"] == ids["quality_rules"]
    assert [r["doc_id"] for r in left["line_dedup"] if footer in r["text"]] == [5]
    before = [(r["doc_id"], brute_print(r["text"])) for r in left["line_dedup"]]
    firsts = set(brute_groups(before, 3))
    assert ids["simhash_near_dedup"] == firsts >= set(range(31)) | {36}
    assert not firsts & {31, 32} and len(firsts & {33, 34, 35}) == 1  # exact copies, and long near copies
    assert ids["benchmark_decontamination"] == firsts - {36}
    assert ids["bpe_encoding"] == firsts - {36} and all(r["n_tokens"] == len(r["ids"]) for r in left["bpe_encoding"])
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0


def test_run_over_the_tables(spark):
    df = corpus_pipeline.run(spark, DATA)
    assert df.columns[:2] == ["doc_id", "n_tokens"] and df.count() > 0
