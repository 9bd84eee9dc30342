import random
from collections import Counter

import numpy as np
import pytest

from claimlake.llm.decontam import BlockIndex, contaminated, keep_uncontaminated, plain_words, window_prints


def shingle_list(words, n):
    return [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def brute(docs, items, least=0.8):
    """Best weighted Jaccard similarity over all item-sized windows."""
    out = {}
    for doc, text in docs:
        words = plain_words(text)
        for item, other in items:
            own = plain_words(other)
            n = min(5, len(own))
            if not n or len(words) < n:
                continue
            a, b = shingle_list(words, n), Counter(shingle_list(own, n))
            size = sum(b.values())
            for start in range(max(1, len(a) - size + 1)):
                w = Counter(a[start : start + size])
                both = sum(min(k, b[s]) * len(s) for s, k in w.items())
                sim = both / (sum(k * len(s) for s, k in w.items()) + sum(k * len(s) for s, k in b.items()) - both)
                if sim >= least and sim > out.get((doc, item), (0,))[0]:
                    out[doc, item] = (sim, start)
    return out


@pytest.fixture(scope="module")
def tables():
    r = random.Random(8)
    text = lambda n: " ".join(f"w{r.randrange(400)}" for _ in range(n))
    items = [(k, text(r.randint(8, 60))) for k in range(25)] + [(100, "just two"), (101, ""), (102, None), (103, "same same same same same same same same"), (None, text(20))]
    docs = []
    for k in range(120):
        parts = [text(r.randint(0, 80))]
        if k % 3 == 0:
            words = items[k % 25][1].split()
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                words[r.randrange(len(words))] = "other"
            parts += [" ".join(words).upper() + ".", text(10)]
        docs.append((k, "\n".join(parts)))
    docs += [(500, None), (501, ""), (502, "just two"), (503, "same " * 40), (None, items[0][1]), (504, items[1][1]), (504, items[1][1])]
    return docs, items


def test_matches_brute_force(spark, tables):
    docs, items = tables
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for chars in (16_000_000, 700):  # one slice of the benchmark, and several
        got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start_word"]) for r in contaminated(d, b, radius=32, slice_chars=chars).collect()}
        assert got.keys() == want.keys()
        for k, (sim, start) in want.items():
            assert got[k] == (pytest.approx(sim), start)
    assert contaminated(d, b).where("doc_id = 504").count() == 2 * sum(k[0] == 504 for k in want)
    # at the production radius nothing is found that is not so, and close copies are all found
    close = {k for k, v in want.items() if v[0] >= 0.9}
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(d, b).collect()}
    assert close <= got <= want.keys()


def test_production_radius_loses_nothing(spark, tables):
    r = random.Random(21)
    text = lambda n: [f"w{r.randrange(900):03d}" for _ in range(n)]
    items, docs = [], []
    for k in range(60):  # the differing part is a shingle that comes four times, and some single words
        words, size = text(80), r.randint(13, 90)
        items += [(k, " ".join(words + ["same"] * 8)), (100 + k, " ".join(text(size)))]
        copy = items[-1][1].split()
        copy[r.choice([0, 1, size - 1, r.randrange(size)])] = "other"
        docs += [(k, " ".join(text(20) + words + ["else"] * 8)), (100 + k, " ".join(copy + text(9)))]
    for some, own in ((docs, items), tables):
        d, b = spark.createDataFrame(some, "doc_id long, text string"), spark.createDataFrame(own, "item_id long, text string")
        rows = contaminated(d, b).collect()
        want = brute(some, own)
        assert {(x["doc_id"], x["item_id"]): (x["similarity"], x["start_word"]) for x in rows} == {k: (pytest.approx(v[0]), v[1]) for k, v in want.items()}
        if some is docs:
            assert len(want) > 60 and sum(x["distance"] > 16 for x in rows) > 0


def test_blocks_find_all_within_the_radius():
    r = np.random.default_rng(3)
    prints = r.integers(0, 2**63, 50, dtype=np.uint64)
    asked = np.concatenate([prints ^ (np.uint64(1) << r.integers(0, 64, 50, dtype=np.uint64)) for _ in range(3)] + [r.integers(0, 2**63, 100, dtype=np.uint64)])
    for radius in (0, 3, 16):
        a, b, far = BlockIndex(prints, radius).near(asked)
        d = np.bitwise_count(asked[:, None] ^ prints[None, :])
        assert sorted(zip(a.tolist(), b.tolist())) == sorted(zip(*(x.tolist() for x in np.nonzero(d <= radius))))
        assert (far == d[a, b]).all()


def test_window_prints_are_signs_of_weighted_sums():
    found = [b"a b", b"bb c", b"c ddd", b"ddd e"]
    import xxhash

    for start in (0, 1, 2):
        part = found[start : start + 2]
        want = sum(1 << k for k in range(64) if sum(len(s) * (1 if xxhash.xxh64_intdigest(s) >> k & 1 else -1) for s in part) > 0)
        assert int(window_prints(found, 2, np.array([start]))[0]) == want


def test_filter_and_empty_tables(spark, docs, no_docs):
    b = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog near the river bank")], "item_id long, text string")
    kept = keep_uncontaminated(docs, b)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(
        d["doc_id"] for d in docs.collect() if "quick brown fox" not in (d["text"] or "").lower()
    )
    assert contaminated(no_docs, b).count() == 0 and contaminated(docs, b.limit(0)).count() == 0
    assert keep_uncontaminated(docs, b.limit(0)).count() == docs.count()
