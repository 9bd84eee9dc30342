"""Personal data and secrets against Python's own regular expressions."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from claimlake.llm.blob_ledger import commit, findings, ledger, scan_documents
from claimlake.llm.pii import KINDS, contexts, disclosing_terms, keyed_texts, pii_spans, sanitise, span_digests
from claimlake.llm.spans import matches, running_totals
from tests.llm.conftest import documents


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute_pii(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return sorted(out)


def brute_secrets(text):
    text, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            out.append((m.start(), 1, m.end(), "access"))
    for m in re.finditer("[0-9a-f]+", text):
        if len(m[0]) >= 24:
            out.append((m.start(), 2, m.end(), "hex"))
    return sorted(out)


def listed(spans):
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)


def digest(spans):
    return hashlib.sha256(listed(spans).encode()).hexdigest()


PIECES = (
    "a@b.c _d@e.f 1.2.3.4 .5 300.1.1.1 0001.2.3.4 4111111111111111 4111-1111-1111-1111 +1(555)123-4567 + 5 - x @ .co é 🙂 token= secret:\" "
    "abcdef API_KEY = ' AKIA ABCDEFGHIJKLMNOP deadbeef0123456789abcdef token apikey PassWd Token=abc"
).split() + [" ", "\n"]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    out = [(k, "".join(r.choice("aB1 .@-+()0599é🙂_=:\"'") for _ in range(r.randint(0, 60)))) for k in range(1500)]
    out += [(5000 + k, "".join(r.choice(PIECES) for _ in range(r.randint(0, 14)))) for k in range(2500)]
    long = ["a" * 50_000, "1" * 50_000, "a." * 20_000 + "@", "a@b.c " * 5_000, "+1" * 20_000, "1 " * 20_000, "a@a" + ".a" * 20_000, "token " * 9_000, "+" + "1(" * 9_000]
    return out + [(None, None), (9000, "")] + list(enumerate(long, 9001))


def test_base_spans_match_brute_force(spark, rows):
    got = span_digests(pii_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))).collect()
    want = {i: brute_pii(t) for i, t in rows}
    assert len(got) == len(rows) and sum(map(len, want.values())) > 1000
    for g in got:
        spans = want[g["doc_id"]]
        assert g["base_sha256"] == digest(spans)
        assert [g[f"n_{k}"] for k in KINDS] == [sum(s[3] == k for s in spans) for k in KINDS]
        assert set(listed(spans).split(",")) - {""} <= set(g["spans"].split(","))


def test_secrets_match_brute_force(spark, rows, tmp_path):
    got = scan_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), str(tmp_path)).collect()
    want = {i: brute_secrets(t) for i, t in rows}
    assert len(got) == len(rows)
    for g in got:
        assert g["base_sha256"] == digest(want[g["doc_id"]])
        assert [g[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[3] == k for s in want[g["doc_id"]]) for k in ("assign", "access", "hex")]


def test_awkward_rows(docs, no_docs, tmp_path):
    assert pii_spans(docs).count() == docs.count() and pii_spans(no_docs).count() == 0
    assert scan_documents(docs, str(tmp_path / "a")).count() == docs.count()
    assert scan_documents(no_docs, str(tmp_path / "b")).count() == 0


def test_places_over_many_matches(spark):
    text = "é1 " * 1000
    got = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(matches(F.col("t"), "[0-9]").alias("m")).collect()
    assert [(s["start"], s["end"]) for s in got[0]["m"]] == [(3 * k + 1, 3 * k + 2) for k in range(1000)]
    assert got[1]["m"] == [] and not got[2]["m"]
    sums = spark.range(1).select(running_totals(F.sequence(F.lit(1), F.lit(400))).alias("x")).first()["x"]
    assert sums == [n * (n + 1) // 2 for n in range(1, 401)]


def disclosure_rows():
    r = random.Random(9)
    rows = [(k, " ".join(f"word{r.randrange(300)}" for _ in range(30))) for k in range(400)]
    for k in range(6):  # the nickname stands by one address only, "write" by all of them
        rows.append((1000 + k, f"please write zorblax {k} at ann{'' if k < 4 else k}@example.org about word{k} today"))
        rows.append((2000 + k, f"please write someone{k} at bob{k}@example.org about word{k + 9} today"))
    rows += [(3000 + k, "copied qwertz text ted@example.org") for k in range(9)]
    return rows


def brute_terms(rows):
    import math

    seen, docs_with = {}, {}
    for _, text in rows:
        for t in set(re.findall(r"[^\W\d_][^\W_]{1,}", text.lower())):
            docs_with[t] = docs_with.get(t, 0) + 1
        for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
            around = (text[: m.start()] + " " + text[m.end() :]).lower()
            seen.setdefault(m[0].lower(), {})[around] = set(re.findall(r"[^\W\d_][^\W_]{1,}", around))
    out = set()
    for e, contexts in seen.items():
        own = math.log2(len(rows) / len(contexts))
        for t in set().union(*contexts.values()):
            both = sum(t in c for c in contexts.values())
            if both >= 3 and own >= 1 and math.log2(len(rows) * both / (max(docs_with[t], both) * len(contexts))) / own >= 0.8:
                out.add((e, t))
    return out


def test_disclosing_terms_match_brute_force(spark):
    rows = disclosure_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = keyed_texts(df)
    found = disclosing_terms(texts, contexts(texts))
    names = {spark.range(1).select(F.xxhash64(F.lit("email"), F.lit(e))).first()[0]: e for e, _ in brute_terms(rows) | {("ann@example.org", "")}}
    got = {(names.get(r["entity"]), r["term"]) for r in found.collect()}
    assert got == brute_terms(rows) and ("ann@example.org", "zorblax") in got


def test_copies_of_a_text_do_not_hide_a_term(spark):
    r = random.Random(4)
    rows = [(k, " ".join(f"word{r.randrange(300)}" for _ in range(30))) for k in range(1000)]
    texts = [f"{n} times wrote zorblax at ann@example.org on day{n}" for n in ("one", "two", "three")]
    rows += list(enumerate(texts, 2000)) + [(3000 + k, texts[0]) for k in range(200)]
    rows.append((4000, " ".join(f"entry{k} by quuxy at bob@example.org since{k}" for k in range(700))))  # more contexts than half the texts
    got = {x["doc_id"]: {s["piece"] for s in x["term"]} for x in pii_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("zorblax" in got[k] for k in (2000, 2001, 2002, 3000, 3199))
    assert "quuxy" in got[4000] and got[1] == set()


def test_terms_are_marked_and_taken_out(spark):
    df = spark.createDataFrame(disclosure_rows(), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii_spans(df).collect()}
    assert [s["piece"] for s in got[1000]["term"]] == ["zorblax"]
    assert got[2000]["term"] == [] and got[3000]["term"] == [] and got[1]["term"] == []
    clean = {r["doc_id"]: r["text"] for r in sanitise(df).collect()}
    assert clean[1000] == "please write [term] 0 at [email] about word0 today"
    assert clean[2000] == "please write someone0 at [email] about word9 today"


def test_all_kinds_are_put_in_general_words(spark):
    df = spark.createDataFrame([(1, "a@b.co, 10.0.0.1 or 4111 1111 1111 1111; +49 170 1234567 not 1.2.3.999"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in sanitise(df, general={"ip": ""}).collect()}
    assert got == {1: "[email],  or [card]; [phone] not 1.2.3.999", 2: ""}


def test_ledger_scans_each_blob_and_version_once(spark, tmp_path):
    store = str(tmp_path / "ledger")
    first = spark.createDataFrame([("a.txt", 1, "token=abcdef"), ("b.txt", 1, "token=abcdef"), ("c.txt", 1, None)], "path string, version int, text string")
    assert commit(first, store, "1", "1").count() == 2
    assert commit(first, store, "1", "1").count() == 2  # sent again
    second = spark.createDataFrame([("a.txt", 2, "nothing"), ("d.txt", 1, "token=abcdef"), ("d.txt", 2, "ghp_" + "z" * 36)], "path string, version int, text string")
    assert commit(second, store, "2", "1").count() == 4
    assert ledger(spark, store, "2").count() == 0
    every = first.unionByName(second)
    assert commit(every, store, "3", "2").count() == 4
    hits = {(r["path"], r["blob"][:6]): [s["kind"] for s in r["kind_spans"]] for r in findings(every, ledger(spark, store, "2"), "path").collect()}
    assert sorted(k[0] for k, v in hits.items() if v == ["assign"]) == ["a.txt", "b.txt", "d.txt"]
    assert [v for k, v in hits.items() if k[0] == "c.txt"] == [[]] and ["forge"] in hits.values()


def test_documents_helper_has_clashing_names(spark):
    assert "email" in documents(spark).columns
