import hashlib
import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from claimlake.llm.bpe import Automaton, WordBpe, compile_merges, decode_documents, encode_documents
from claimlake.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def coder():
    return WordBpe(tokenizer_path())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def test_encoding_is_the_librarys(coder, library):
    r = random.Random(1)
    pool = "aAbB éÉßİΣσςñ\t\n\u0085 \x1c漢字🙂'’sd0123½²éÅǅﬁK<|endoftext|>-!?"
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(1, 14))) for _ in range(4000)]
    some = [chr(c) for c in (*range(1, 0x250), *range(0x300, 0x400), *range(0x1E00, 0x2100)) if unicodedata.category(chr(c)) != "Cn"]
    texts += ["".join(r.choice(some) for _ in range(8)) for _ in range(2000)]
    texts += ["", "<|endoftext|>", " <|startoftext|>a<|endoftext|>b", "a" * 5000, "ha" * 900, "!" * 1000, "ΟΔΟΣ ΣΑΣ", "don't we'll I'm"]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert coder.encode(text) == ids, text
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def merge_loop(word, ranks):
    """Byte pair encoding as it is defined: the first of the best pairs, again and again."""
    parts = list(word)
    while pairs := [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]:
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def test_automaton_has_one_path_for_each_string():
    r = random.Random(4)
    for _ in range(60):
        merges, tokens = [], list("abc")
        while len(merges) < 12:  # proper merge lists: each merge makes a new token of known ones
            u, v = r.choice(tokens), r.choice(tokens)
            if u + v not in tokens and len(u + v) < 9:
                merges.append((u, v))
                tokens.append(u + v)
        ids = {t: i for i, t in enumerate(tokens)}
        made = compile_merges(ids, merges, list("abc"))
        ranks = {m: i for i, m in enumerate(merges)}
        for _ in range(60):
            word = "".join(r.choice("abc") for _ in range(r.randint(1, 9)))
            paths = [[]]
            for end in range(1, len(word) + 1):
                paths.append([])
                for start in range(end):
                    token = ids.get(word[start:end])
                    if token in made.born:
                        before = paths[start] if start else [[]]
                        paths[end] += [p + [token] for p in before if not p or made.has_arc(p[-1], token)]
                assert len(paths[end]) == 1
            assert [tokens[t] for t in paths[-1][0]] == merge_loop(word, ranks)


def test_first_gadget_takes_an_arc_away():
    made = Automaton([0, 1])
    assert made.has_arc(0, 1)
    made.add(0, 1, 2, 0)
    assert not made.has_arc(0, 1) and made.has_arc(2, 2) and made.has_arc(1, 2) and made.has_arc(0, 2) is True


def test_documents(docs, no_docs, library):
    want = Counter()
    for d in docs.collect():
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        raw = np.array(ids, "<u4").tobytes()
        want[d["doc_id"], len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter(map(tuple, encode_documents(docs, tokenizer_path()).collect())) == want
    assert encode_documents(no_docs, tokenizer_path()).count() == 0


def test_round_trip_through_ids(docs):
    coded = encode_documents(docs, tokenizer_path(), ids=True)
    texts = decode_documents(coded, tokenizer_path()).collect()
    want = Counter((r["doc_id"], r["decoded_sha256"]) for r in coded.collect())
    assert Counter((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in texts) == want
