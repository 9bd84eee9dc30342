import random
from collections import Counter, defaultdict

import pytest

from claimlake.llm.lines import drop_repeated, dropped_lines, line_bitmaps
from tests.llm.conftest import TEXTS

WHITE = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def brute(rows, least_docs=3):
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[key_of(line)].add(float("-inf") if doc is None else doc)
    out = Counter()
    for doc, text in rows:
        lines = (text or "").split("\n")
        own = float("-inf") if doc is None else doc
        kept = [x for x in lines if len(key_of(x)) < 20 or len(holders[key_of(x)]) < least_docs or max(holders[key_of(x)]) == own]
        out[doc, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    parts = ["  This is a REPEATED line of text", "This is a repeated line of text", "short", "", "another quite long line here", "ÀÉ a line that is not ascii at all"]
    out = [(k, "\n".join(r.choice([*parts, f"third long line of some text {r.randint(0, 3)}"]) for _ in range(r.randint(0, 7)))) for k in range(300)]
    return out + list(enumerate(TEXTS, 1000)) + out[:20] + [(5, "another text of id five\nthis is a repeated line of text"), (None, parts[0]), (None, parts[1] + "\n" + parts[4])]


@pytest.mark.parametrize("least_docs,lanes", [(3, 64), (3, 1), (2, 3), (5, 2)])
def test_bitmaps_match_brute_force(spark, rows, least_docs, lanes):
    got = line_bitmaps(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), least_docs=least_docs, lanes=lanes).collect()
    assert Counter((g["doc_id"], g["n_lines"], g["n_dropped"], g["text"]) for g in got) == brute(rows, least_docs)
    for g in got:
        assert sum(g["keep"]) == g["n_lines"] and sum(g["keep"][1::2]) == g["n_dropped"]


def test_filter_leaves_other_columns(docs, no_docs):
    got = drop_repeated(docs)
    assert got.columns == docs.columns
    want = brute([(d["doc_id"], d["text"]) for d in docs.collect()])
    assert Counter((r["doc_id"], r["text"] or "") for r in got.collect()) == Counter({(k[0], k[3]): 0 for k in want}) + sum(
        (Counter({(k[0], k[3]): n}) for k, n in want.items()), Counter()
    )
    assert drop_repeated(no_docs).count() == 0


def test_one_document_is_not_enough(docs):
    with pytest.raises(ValueError):
        dropped_lines(docs, least_docs=1)
