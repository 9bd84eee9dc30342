import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from claimlake.operators import evaluation as evl
from claimlake.operators import overlap


def lcs(a, b):
    prev = [0] * (len(a) + 1)
    for y in b:
        row = [0]
        for i, x in enumerate(a):
            row.append(prev[i] + 1 if x == y else max(prev[i + 1], row[i]))
        prev = row
    return prev[-1]


def test_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 90))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 90))]
        assert overlap._common(a, b) == lcs(a, b)


def grams(tokens, n):
    return Counter(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))


def f1(p, r):
    return 2 * p * r / (p + r) if p + r else 0.0


def brute_rouge(pred, ref, n):
    a, b = grams(pred.lower().split(), n), grams(ref.lower().split(), n)
    same = sum((a & b).values())
    p, r = same / max(sum(a.values()), 1), same / max(sum(b.values()), 1)
    return p, r, f1(p, r)


def brute_sari(source, pred, refs):
    total = 0.0
    for n in range(1, 5):
        s = Counter({g: c * len(refs) for g, c in grams(source.lower().split(), n).items()})
        p = Counter({g: c * len(refs) for g, c in grams(pred.lower().split(), n).items()})
        r = sum((grams(ref.lower().split(), n) for ref in refs), Counter())
        keep, keep_ok, keep_all = s & p, s & p & r, s & r
        kp = sum(keep_ok[g] / keep[g] for g in keep) / len(keep) if keep else 1
        kr = sum(keep_ok.values()) / sum(keep_all.values()) if keep_all else 1
        gone = s - p
        dp = sum((gone - r)[g] / gone[g] for g in gone) / len(gone) if gone else 1
        new, wanted = set(p) - set(s), set(r) - set(s)
        ap = len(new & set(r)) / len(new) if new else 1
        ar = len(new & set(r)) / len(wanted) if wanted else 1
        total += (f1(kp, kr) + dp + f1(ap, ar)) / 3
    return total / 4 * 100


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    word = lambda: rng.choice("the red mill stands near a town of old".split())
    text = lambda: " ".join(word() for _ in range(rng.randint(0, 12)))
    return [(i, text(), text(), text(), text()) for i in range(60)] + [(60, "", "", "", ""), (61, "a b c d e", "a b c d e", "a b c d e", "a b c d e")]


def frame(spark, texts):
    return spark.createDataFrame(texts, "id int, source string, pred string, ref string, other string")


def test_rouge_n(spark, texts):
    got = {r.id: r for r in overlap.rouge_n(frame(spark, texts), ["id"], "pred", "ref").collect()}
    assert len(got) == len(texts)
    for i, _, pred, ref, _ in texts:
        for n in (1, 2):
            assert [got[i][f"rouge{n}_{m}"] for m in "prf"] == pytest.approx(brute_rouge(pred, ref, n))
    assert got[61].rouge2_f == 1.0


def test_sari(spark, texts):
    one = {r.id: r.sari for r in overlap.sari(frame(spark, texts), ["id"], "source", "pred", ["ref"]).collect()}
    two = {r.id: r.sari for r in overlap.sari(frame(spark, texts), ["id"], "source", "pred", ["ref", "other"]).collect()}
    for i, source, pred, ref, other in texts:
        assert one[i] == pytest.approx(brute_sari(source, pred, [ref]))
        assert two[i] == pytest.approx(brute_sari(source, pred, [ref, other]))


def test_rouge_l_and_stems(spark):
    df = spark.createDataFrame([("the mills are running", "the mill was running"), ("", "x"), (None, "x")], "a string, b string")
    rows = df.select(overlap.rouge_l("a", "b")["f"].alias("f"), overlap.rouge_l("a", "b", stem=True)["f"].alias("s")).collect()
    assert [r.f for r in rows[:2]] == pytest.approx([0.5, 0.0])
    assert rows[0].s == pytest.approx(0.75)


def test_score_pairs_choose_reference(spark):
    rows = spark.createDataFrame([(1, "a b", "a c", "a c"), (2, "a", "a", None)], "id int, mutated string, original string, prediction string")
    against_ref = overlap.score_pairs(rows, ["id"]).collect()
    against_source = overlap.score_pairs(rows, ["id"], reference_col="mutated").collect()
    assert [(r.id, r.rouge1) for r in against_ref] == [(1, 1.0)]
    assert [(r.id, r.rouge1) for r in against_source] == [(1, 0.5)]
    assert [r.id for r in overlap.skipped_pairs(rows, ["id"]).collect()] == [2]


PREDICTIONS = [("a", " supports", "supports"), ("b", "supports", "refutes "), ("c", "refutes", "refutes"), ("d", "refutes", "refutes"), ("e", "supports", "supports")]


def test_reports(spark):
    pred = spark.createDataFrame(PREDICTIONS, "id string, gold string, prediction string")
    matrix = {(r.gold, r.prediction): r.n for r in evl.confusion_matrix(pred, evl.LABELS[3]).collect()}
    assert len(matrix) == 16 and sum(matrix.values()) == 5
    assert matrix[("supports", "refutes")] == 1 and matrix[("not enough info", "refutes")] == 0
    report = {r.label: r for r in evl.classification_report(pred, evl.LABELS[2]).collect()}
    assert (report["supports"].precision, report["supports"].recall) == pytest.approx((1.0, 2 / 3))
    assert report["refutes"].f1 == pytest.approx(0.8) and report["accuracy"].f1 == pytest.approx(0.8)
    assert report["macro avg"].recall == pytest.approx((2 / 3 + 1) / 2)
    assert report["weighted avg"].precision == pytest.approx((1.0 * 3 + 2 / 3 * 2) / 5)
    hops = spark.createDataFrame([("a", 2), ("b", 2), ("c", 3), ("d", 3)], "id string, num_hops int")
    by_hops = {(r.num_hops, r.label): r.support for r in evl.report_by(pred, hops, evl.LABELS[2]).collect()}
    assert by_hops[(2, "supports")] == 2 and by_hops[(3, "supports")] == 0
    assert [r.id for r in evl.unmatched_ids(pred, hops).collect()] == ["e"]


def test_running_means_end_at_the_mean(spark):
    rows = [("m", i, float(i % 7), None if i % 3 else 1.0) for i in range(250)] + [("k", i * 1000, 1.0, 2.0) for i in range(40)]
    scores = spark.createDataFrame(rows, "model string, seq long, a double, b double")
    got = evl.running_means(scores, ["a", "b"]).collect()
    assert sorted(r.n for r in got if r.model == "m") == list(range(10, 251, 10))
    values = [r[2] for r in rows if r[0] == "m"]
    for r in got:
        if r.model == "m":
            assert r.a == pytest.approx(sum(values[: r.n]) / r.n) and r.b == pytest.approx(1.0)
    means = {(r.model, r.metric): r["mean"] for r in evl.mean_metrics(scores, ["a", "b"]).collect()}
    assert {r.model: r.a for r in got if r.n in (250, 40) and (r.model, r.n) != ("m", 40)} == {
        "m": pytest.approx(means[("m", "a")]),
        "k": pytest.approx(means[("k", "a")]),
    }


def test_compare_and_audit(spark):
    scores = spark.createDataFrame([("x", 1.0), ("x", 3.0), ("y", 2.5)], "model string, rouge1 double")
    row = evl.compare_models(scores, ["rouge1"], "x", "y").first()
    assert (row.diff, row.verdict) == (0.5, "better")
    assert evl.compare_models(scores, ["rouge1"], "x", "x").first().verdict == "worse"
    stored = spark.createDataFrame([("x", "rouge1", 1.5)], "model string, metric string, stored double")
    audit = {r.model: r.difference for r in evl.audit_means(stored, evl.long_scores(scores, ["model"], ["rouge1"])).collect()}
    assert audit == {"x": 0.5, "y": None}


def test_unknown_labels_are_counted(spark):
    rows = [("supports", "supports"), ("supports", "none"), ("supports", None), ("refutes", "refutes"), ("unclear", "supports"), (None, "refutes")]
    pred = spark.createDataFrame(rows, "gold string, prediction string")
    got = {r.label: r for r in evl.classification_report(pred, evl.LABELS[2]).collect()}
    assert (got["supports"].recall, got["supports"].precision, got["supports"].support) == (pytest.approx(1 / 3), 1.0, 3)
    assert (got["accuracy"].f1, got["accuracy"].support, got["unknown gold"].support) == (0.5, 4, 2)
    cells = {(r.gold, r.prediction): r.n for r in evl.confusion_matrix(pred, evl.LABELS[2]).collect()}
    assert sum(cells.values()) == len(rows) and cells["supports", "other"] == 2 and cells["other", "supports"] == 1


def test_running_means_of_sparse_orders(spark):
    prime = 1_000_000_007
    scores = spark.createDataFrame([("m", i * prime, float(i)) for i in range(200)], "model string, seq long, a double").repartition(7)
    got = {r.n: r.a for r in evl.running_means(scores, ["a"], every=50).collect()}
    assert got == {n: (n - 1) / 2 for n in (50, 100, 150, 200)}
