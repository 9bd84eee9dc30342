import bz2
import json

import pytest
from pyspark.sql import functions as F

from claimlake.operators import evaluation as evl
from claimlake.operators.documents import corpus_from_documents
from claimlake.plans.corpus import dump_to_documents, dump_to_index
from claimlake.session import cut_lineage, scratch_path, use_all_cores
from claimlake.sources import records, sinks
from claimlake.sources.dumps import read_wiki_dump
from claimlake.streaming import metrics as sm

ARTICLE = {
    "id": "7", "url": "u", "title": "red Mill", "text": ["Red Mill is a mill.", " It is in Arden."],
    "text_with_links": ['<a href="Mill">Red Mill</a> is a mill.', ' It is in <a href="Arden%20Town">Arden</a>.'], "charoffset": [[[0, 3]]],
}


def write(path, lines, opener=open):
    path.parent.mkdir(parents=True, exist_ok=True)
    with opener(path, "wt", encoding="utf-8") as f:
        f.write("\n".join(line if isinstance(line, str) else json.dumps(line) for line in lines))


def test_intro_dump(spark, tmp_path):
    again = {**ARTICLE, "id": "8", "text": ["Newer."]}
    write(tmp_path / "AA" / "wiki_00.bz2", [ARTICLE], bz2.open)
    write(tmp_path / "AB" / "wiki_01.bz2", [again], bz2.open)
    write(tmp_path / "AB" / "notes.txt", ["x"])
    docs = read_wiki_dump(spark, str(tmp_path))
    row = docs.where("wiki_id = '7'").first()
    assert (row.id, row.text, row.links) == ("Red Mill_0", "Red Mill is a mill. It is in Arden.", ["Mill", "Arden Town"])
    kept = dump_to_documents(spark, str(tmp_path)).collect()
    assert [(r.id, r.wiki_id) for r in kept] == [("Red Mill_0", "8")]
    only = read_wiki_dump(spark, str(tmp_path), preprocess=lambda raw: raw.where("id = '8'"))
    assert only.count() == 1
    index = dump_to_index(spark, str(tmp_path), str(tmp_path / "out"))
    assert [(r.term, r.df) for r in index.terms.collect()] == [("newer", 1)]


def test_full_dump(spark, tmp_path):
    write(tmp_path / "wiki_00", [{"id": "1", "url": "u", "title": "Éa", "text": 'A\n\n<a href="B">b</a>'}])
    row = read_wiki_dump(spark, str(tmp_path), "full").first()
    assert row.text == 'A\n\n<a href="B">b</a>' and row.links == [] and row.original_title == "Éa"
    assert row.id == "Éa_0"
    with pytest.raises(ValueError):
        read_wiki_dump(spark, str(tmp_path), "other")


def test_annotations_skip_header_and_broken_lines(spark, tmp_path):
    good = {"id": 5, "claim": "c", "label": "SUPPORTS", "evidence": [{"content": ["A_sentence_0"], "context": {"A_sentence_0": ["A_title"]}}]}
    write(tmp_path / "a.jsonl", [{"id": "", "claim": "", "evidence": [{"content": [], "context": {}}]}, good, '{"id": 6, "claim": "bro'])
    rows = records.read_annotations(spark, str(tmp_path)).collect()
    assert [(r.id, r.evidence[0].context) for r in rows] == [(5, {"A_sentence_0": ["A_title"]})]


def test_pages_from_lines(spark, tmp_path):
    write(tmp_path / "sub" / "p.jsonl", [{"title": "A", "order": []}, "broken"])
    rows = records.read_pages(spark, str(tmp_path)).collect()
    assert [r.page_id for r in rows] == ["A"]


def test_result_files(spark, tmp_path):
    result = {"average_results": {"m": {"rouge1": 0.5}}, "detailed_results": {"m": {"rouge1": [0.25, 0.75], "sari": [1.0]}}}
    (tmp_path / "r.json").write_text(json.dumps(result, indent=2))
    rows = records.read_result_arrays(spark, str(tmp_path / "r.json"))
    assert {(r.model, r.metric, r.seq): r.score for r in rows.collect()} == {("m", "rouge1", 0): 0.25, ("m", "rouge1", 1): 0.75, ("m", "sari", 0): 1.0}
    stored = records.read_results(spark, str(tmp_path / "r.json")).select(F.explode("average_results").alias("model", "x")).select("model", F.explode("x").alias("metric", "stored"))
    assert {r.metric: r.difference for r in evl.audit_means(stored, rows).collect()} == {"rouge1": 0.0, "sari": None}
    (tmp_path / "p.json").write_text(json.dumps([{"id": "1", "gold": "supports", "prediction": "refutes"}, {"id": "2"}], indent=1))
    assert records.read_predictions(spark, str(tmp_path / "p.json")).count() == 2
    (tmp_path / "c.json").write_text(json.dumps([{"id": "1", "num_hops": 3}]))
    assert records.read_claims(spark, str(tmp_path / "c.json")).first().num_hops == 3


def test_corpus_is_written_once(spark, tmp_path):
    docs = spark.createDataFrame([("A_0", "x"), ("B_0b_0", "y")], "id string, text string")
    path = str(tmp_path / "corpus")
    sinks.write_corpus(corpus_from_documents(docs), path)
    sinks.write_corpus(corpus_from_documents(docs.limit(1)), path)
    assert {(r.id, r.contents) for r in spark.read.json(path).collect()} == {("A", "x"), ("B_0b", "y")}


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 9)], "id string, v int")
    new = spark.createDataFrame([("b", 2), ("b", 3), ("c", 4)], "id string, v int")
    plan = sinks.upsert_documents(old, new, "id", ["v"])
    assert {(r.id, r.v) for r in plan.collect()} == {("a", 1), ("b", 3), ("c", 4)}
    # copies of a key are dropped before the shuffle
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"m{i % 3}", float(i), float(i % 5)) for i in range(100)]
    df = spark.createDataFrame(rows, "model string, rouge1 double, sari double")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "ck")
    for _ in range(2):  # the second run finds nothing new and must not change the table
        sm.publish_metrics(sm.stream_metrics(stream, ["rouge1", "sari"]), out, checkpoint).awaitTermination()
    got = {r.model: (r.n, r.rouge1, r.sari) for r in sm.latest_metrics(spark, out).collect()}
    means = {(r.model, r.metric): (r.n, r["mean"]) for r in evl.mean_metrics(df, ["rouge1", "sari"]).collect()}
    assert got == {m: (means[(m, "rouge1")][0], pytest.approx(means[(m, "rouge1")][1]), pytest.approx(means[(m, "sari")][1])) for m in ("m0", "m1", "m2")}


def test_scratch_space(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    df = spark.range(5).withColumn("a", F.array(F.struct(F.col("id").alias("b"))))
    cut = cut_lineage(df, "test")
    assert cut.schema.simpleString() == df.schema.simpleString() and sorted(cut.collect()) == sorted(df.collect())
    assert use_all_cores(spark.range(10).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_broken_lines_are_no_rows(spark, tmp_path):
    lines = ['{"id": "1", "mutated": "a", "title": "t one", "text": ["x"]}', '{"id": "2", "muta', "no json", "{}", '{"id": "3"}']
    (tmp_path / "wiki_0").write_text("\n".join(lines) + "\n")
    pairs = records.read_pairs(spark, str(tmp_path))
    assert [(r.id, r.mutated) for r in pairs.orderBy("id").collect()] == [("1", "a"), ("3", None)] and pairs.count() == 2
    assert sorted(r.value for r in records.broken_lines(spark, str(tmp_path), records.PAIR_SCHEMA).collect()) == ["no json", '{"id": "2", "muta']
    assert [r.id for r in read_wiki_dump(spark, str(tmp_path)).collect()] == ["T one_0"]
    (tmp_path / "claims").mkdir()
    (tmp_path / "claims" / "a.json").write_text('[{"id": "1", "claim": "c"}, {"id": "2", "claim": "d"}]')
    (tmp_path / "claims" / "b.json").write_text('[{"id": "3", "cl')
    assert {r.id for r in records.read_claims(spark, str(tmp_path / "claims")).collect()} == {"1", "2"}


def test_upsert_into_rewrites_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "store")
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "store" / "data").rglob("*.parquet")}
    state = lambda: {r["id"]: r["v"] for r in sinks.read_documents(spark, path).collect()}
    with pytest.raises(FileNotFoundError):
        sinks.read_documents(spark, path)
    first = [(f"k{i}", 1) for i in range(500)] + [("k0", 0), (None, 5)]
    sinks.upsert_into(spark.createDataFrame(first, "id string, v int"), path, "id", ["v"], buckets=16)
    before = files()
    want = {f"k{i}": 1 for i in range(500)} | {None: 5}
    assert state() == want
    sinks.upsert_into(spark.createDataFrame([("k7", 2), ("k7", 3), ("fresh", 1)], "id string, v int"), path, "id", ["v"], buckets=16)
    want |= {"k7": 3, "fresh": 1}
    assert state() == want
    after = files()
    assert before.items() <= after.items() and 1 <= len({p.parent for p in after} - {p.parent for p in before}) <= 2
    # an empty batch changes nothing, and one that breaks off before its manifest leaves the documents readable
    sinks.upsert_into(spark.createDataFrame([], "id string, v int"), path, "id", ["v"], buckets=16)
    assert files() == after
    broken = spark.createDataFrame([("k8", 9)], "id string, v int").withColumn("v", F.raise_error(F.lit("broken")).cast("int"))
    with pytest.raises(Exception):
        sinks.upsert_into(broken, path, "id", ["v"], buckets=16)
    assert state() == want
