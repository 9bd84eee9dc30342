import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from claimlake.llm.components import components
from claimlake.llm.simhash import fingerprints, forest, keep_one, links, near_groups, pivots


#: Near copies at a Jaccard similarity of 0.8: five-word shingles, candidates within a wide radius.
WIDE = {"words": 5, "bits": 512, "radius": 160, "wide": True}


def brute_print(text, words=3):
    found = (text or "").encode().lower().split()
    parts = [b" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or ([b" ".join(found)] if found else [])
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints, radius):
    """Smallest id reachable, from all pairs."""
    rows = list(prints)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(rows))]


def test_groups_match_all_pairs(docs, no_docs):
    rows = [(d["doc_id"], brute_print(d["text"])) for d in docs.collect()]
    want = Counter((i, f"{p:016x}", c) for (i, p), c in zip(rows, brute_groups(rows, 3)))
    assert Counter(map(tuple, near_groups(docs).collect())) == want
    assert near_groups(no_docs).count() == 0


@pytest.mark.parametrize("radius", [1, 3, 5])
def test_links_lose_nothing(spark, radius):
    r = random.Random(radius)
    prints = {0}
    for _ in range(40):
        x = r.getrandbits(64)
        for _ in range(12):  # chains: each a few bits from the one before
            prints.add(x)
            for _ in range(r.randint(0, radius + 1)):
                x ^= 1 << r.randrange(64)
    prints = sorted(prints)
    from claimlake.llm.simhash import block_keys

    nodes = spark.createDataFrame([(f"{p:016x}",) for p in prints], "fingerprint string").withColumn("keys", block_keys("fingerprint", radius))
    for chunk in (2048, 3):  # the small chunk deals every key out as pairs of chunks
        roots = {x["node"]: x["root"] for x in components(links(nodes, 64, radius, chunk=chunk)).collect()}
        got = [roots.get(f"{p:016x}", f"{p:016x}") for p in prints]
        want = brute_groups(enumerate(prints), radius)
        assert [sorted(i for i, g in enumerate(got) if g == x) for x in sorted(set(got))] == [
            sorted(i for i, g in enumerate(want) if g == x) for x in sorted(set(want))
        ]


def test_forest_within_a_key():
    r = np.random.default_rng(2)
    base = r.integers(0, 2**63, 5, dtype=np.uint64)
    fp = np.unique(np.concatenate([base ^ np.uint64(1 << k) ^ np.uint64(1 << j) for k in range(20) for j in range(3)]))[:, None]
    root = forest(fp, pivots(64), 3)
    want = brute_groups([(i, int(x)) for i, x in enumerate(fp[:, 0])], 3)
    assert len(set(root)) == len(set(want)) and all((root[i] == root[j]) == (want[i] == want[j]) for i in range(len(fp)) for j in range(i))


def test_pivots_bound_distances():
    r = np.random.default_rng(1)
    from claimlake.llm.simhash import distances

    x = r.integers(0, 2**63, (200, 1), dtype=np.uint64)
    y = x ^ (np.uint64(1) << r.integers(0, 64, (200, 1), dtype=np.uint64))
    d = np.abs(distances(x, pivots(64)) - distances(y, pivots(64)))
    assert d.max() <= 1


def test_components_of_long_chains_and_stars(spark):
    edges = [(f"{i:04d}", f"{i + 1:04d}") for i in range(60)] + [("s0", f"s{i}") for i in range(1, 50)] + [("x", "x"), (None, "y"), ("z", "w"), ("w", "z")]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {f"{i:04d}": "0000" for i in range(61)} | {f"s{i}": "s0" for i in range(50)} | {"z": "w", "w": "w"}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def near_copies(n, words, edits, seed):
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(edits):
            own[r.randrange(words)] = f"e{r.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_wide_radius_finds_near_copies_and_leaves_others(spark):
    texts = [t for g in range(6) for t in near_copies(8, 300, 3, g)] + [t for g in range(40) for t in near_copies(1, 200, 0, 100 + g)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_groups(df, **WIDE).collect()}
    assert got == {i: (i // 8 * 8 if i < 48 else i) for i in range(len(texts))}


def test_one_row_of_each_group_stays(docs, no_docs):
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    groups = near_groups(docs).select("doc_id", "component_id").distinct().collect()
    rows = kept.collect()
    assert Counter(r["doc_id"] for r in rows if r["doc_id"] not in (None, 6)) == Counter({g["doc_id"] for g in groups if g["doc_id"] == g["component_id"] and g["doc_id"] not in (None, 6)})
    assert sum(r["doc_id"] is None for r in rows) == 1
    assert len({r["text"] for r in rows}) == len(rows)
    assert keep_one(no_docs).count() == 0


def test_fingerprint_of_long_text(spark):
    text = " ".join(f"w{i % 1013}" for i in range(150_000))
    got = fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(F.col("fingerprint")).first()[0]
    h = np.array([xxhash.xxh64_intdigest(b" ".join(p), 42) for p in zip(*(text.encode().split()[i:] for i in range(3)))], np.uint64)
    assert int(got, 16) == sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))


def test_repeated_phrases_neither_part_nor_join_texts(spark):
    text, phrase = near_copies(1, 304, 0, 31)[0], "one two three four five"
    one, other = (near_copies(1, 700, 0, k)[0] for k in (32, 33))
    texts = [text, f"{text} {' '.join([phrase] * 8)}", f"{text} {' '.join([phrase] * 30)}"]
    texts += [f"{t} {' '.join([phrase] * 30)}" for t in (one, other)]
    got = {r["doc_id"]: r["component_id"] for r in near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **WIDE).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}


def test_wide_groups_match_brute_force_around_the_threshold(spark):
    r, texts = random.Random(17), []
    # n shingles, the last k of them others: similarity (n - k) / (n + k), so 0.7, just under 0.8, 0.8 and 0.85
    for n, k in [(170, 30), (17, 3), (90, 11), (180, 21), (900, 101), (1800, 201), (9, 1), (90, 10), (450, 50), (900, 100), (185, 15)]:
        for _ in range(6):
            base = [f"w{r.randrange(10**6)}" for _ in range(n + 4)]
            texts += [" ".join(base), " ".join([*base[:-k], *(f"e{r.randrange(10**6)}" for _ in range(k))])]
    for edits in (1, 2, 3, 4, 5, 6, 7, 8):  # chains and groups
        texts += near_copies(5, 200, edits, 300 + edits)
    sets = [set(zip(*(t.split()[i:] for i in range(5)))) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    assert len(set(root)) < len(texts) - 30 and sum(root[2 * i + 1] == 2 * i for i in range(66)) == 30
    got = {x["doc_id"]: x["component_id"] for x in near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **WIDE).collect()}
    assert got == dict(enumerate(root))


def test_chunks_of_a_crowded_key_are_spread(spark):
    """Without broadcasts the pairs of chunks move once more after the join on the key."""
    from claimlake.llm.simhash import block_keys

    prints = sorted({0} | {1 << i | 1 << j for i in range(40) for j in range(40)})
    nodes = spark.createDataFrame([(f"{p:016x}",) for p in prints], "fingerprint string").withColumn("keys", block_keys("fingerprint", 3))
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = links(nodes, 64, 3, chunk=16)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
        for k, v in old.items():
            spark.conf.set(k, v)
    assert re.search(r"hashpartitioning\(at#\d+L?, key#\d+L?, x#\d+, y#\d+", plan) and "SortMergeJoin [at#" in plan
