import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from claimlake.llm import collocations as C
from tests.llm.conftest import TEXTS, documents

LOWER = {i: i + 32 for i in range(65, 91)}


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
        yield [w for w in re.split(r"[\x20\x09]+", piece) if w]


def brute_counts(rows):
    """f of every phrase of up to four words and n, by language."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    return f, n


def brute(rows, least, top):
    f, n = brute_counts(rows)
    found = defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        inside = lambda q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if any(100 * b >= 80 * a for (other, q), b in f.items() if other == lang and inside(q)):
            continue
        score, _, l, r = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        found[lang].append((-score, -a, " ".join(p).encode(), l, r))
    out = []
    for lang, phrases in found.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(phrases)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    words = ["the", "THE", "of", "red", "Haus", "Über", "é\x00", "a b", "x\t\ty", "end.", "no,", "\n", "\x0b", "\xa0", "😀"]
    out = [(r.choice(["en", "de", None, "und", ""]), " ".join(r.choice(words) for _ in range(r.randint(0, 30)))) for _ in range(250)]
    return out + [("en", t) for t in TEXTS[:9]] + [("en", "of the " * 500), ("en", "same row of text")] + [("fr", "la vie en rose")] * 40 + [(None, None)] * 3


@pytest.mark.parametrize("least,top", [(30, 2000), (3, 2000), (5, 7)])
def test_collocations_match_brute_force(spark, rows, least, top):
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = sorted(tuple(r) for r in C.collocations(df, least=least, top=top).collect())
    assert got and got == brute(rows, least, top)


def test_many_ranges_and_shards(spark, rows):
    """Bounds inside words, pairs and whole paths: sums that cross them are added up."""
    f, n = brute_counts(rows)
    bounds = sorted({(lang, p + ("",) * (4 - len(p))) for lang, p in list(f)[:: max(len(f) // 60, 1)]} | {("en", ("of", "the", "of", "the")), ("en", ("of", "", "", ""))})
    bounds = [(lang, tuple(w.encode() for w in p)) for lang, p in bounds]
    bounds.sort()
    df = spark.createDataFrame([(lang if lang is not None else "und", t or "") for lang, t in rows], "lang string, text string").repartition(5)
    got = {(r["lang"], r["phrase"]): r["f"] for r in C.range_counts(C.shard_transducers(df, bounds), len(bounds) + 1, 4).collect()}
    want = {(lang, " ".join(p)): a for (lang, p), a in f.items() if a >= 4} | {(lang, ""): a for lang, a in n.items()}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_transducer_round_trip_and_union():
    r = random.Random(1)
    texts = [" ".join(r.choice("abcdefgh") * r.randint(1, 2) for _ in range(r.randint(1, 40))).encode() for _ in range(60)]
    parts = []
    for some in (texts[:20], texts[20:21], texts[21:]):
        words, ids = C.word_ids(some)
        (labels, weights), = C.paths_of(ids, len(words))
        names, levels, counts = C.read_transducer(*C.transducer(words, labels, weights))
        spell = lambda ws, ls: [tuple(ws[x - 1] if x else b"" for x in path) for path in zip(*(level.tolist() for level in ls))]
        assert spell(names, levels) == spell(words, labels) == sorted(spell(words, labels))
        assert counts.tolist() == weights.tolist()
        parts.append((names, levels, counts))
    words, ids = C.word_ids(texts)
    (labels, weights), = C.paths_of(ids, len(words))
    got = C.united(parts)
    assert got[0] == words and all(np.array_equal(a, b) for a, b in zip(got[1], labels)) and got[2].tolist() == weights.tolist()


def test_last_states_are_stored_once():
    words, ids = C.word_ids([b"a b c end; d e f end; g h i end; a b c other"])
    (labels, weights), = C.paths_of(ids, len(words))
    _, body = C.transducer(words, labels, weights)
    sizes = np.frombuffer(body, np.int32)[:9]
    assert sizes[5] > sizes[6]


def test_awkward_rows_and_empty_tables(spark):
    df = documents(spark)
    rows = [(r["lang"], r["text"]) for r in df.select("lang", "text").collect()]
    clash = df.selectExpr("*", "'own' as phrase", "1 as rank", "'x' as words", "2 as range", "3 as f", "4 as size")
    assert sorted(tuple(r) for r in C.collocations(clash, least=6).collect()) == brute(rows, 6, 2000)
    assert C.collocations(df.limit(0)).collect() == []
    assert C.collocations(df.where("text is null")).collect() == []


def test_a_range_is_a_partition_of_its_own(spark):
    """Dealt by hash, some partitions held several ranges at once and others none."""
    docs = spark.createDataFrame([(f"w{i} x y w{i + 1}", "en") for i in range(40)], "text string, lang string")
    bounds = [("en", (f"w{i}".encode(), b"", b"", b"")) for i in range(10, 30)]
    shards = C.shard_transducers(docs, bounds)
    counts = C.range_counts(shards, len(bounds) + 1, 1)
    assert "hashpartitioning(range" not in counts._jdf.queryExecution().executedPlan().toString()
    assert {(r.phrase, r.f) for r in counts.where("length = 1").collect()} >= {("x", 40), ("y", 40), ("w0", 1), ("w20", 2), ("w40", 1)}
