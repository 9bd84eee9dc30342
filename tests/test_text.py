import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimlake.functions import hashing, prompts, text, titles
from claimlake.functions.stemming import stem_tokens, stem_word


def test_normalize_title(column):
    values = ["éa", "red Mill", "", None, "Ångström"]
    want = [None if v is None else (lambda t: t[:1].upper() + t[1:])(unicodedata.normalize("NFD", v)) for v in values]
    assert column(values, titles.normalize_title) == want
    assert column(["éa"], lambda c: titles.normalize_title(c, capitalize=False)) == [unicodedata.normalize("NFD", "éa")]


def test_title_of_keeps_inner_suffix_unless_compat(column):
    assert column(["a_0b_0", "a"], titles.title_of) == ["a_0b", "a"]
    assert column(["a_0b_0"], lambda c: titles.title_of(c, compat=True)) == ["a"]


def test_links_decode_percent_but_not_plus(column):
    html = """<a href="b%20c">x</a> <a href='d+e'>y</a> <a href=%zz>z</a> <a href="%C3%A9t">q</a>"""
    assert column([html], text.extract_links) == [["B c", "D+e", "%zz", "Ét"]]


def test_strip_trims_unicode_whitespace(column):
    values = ["　 a b \x1f", "\n", "x"]
    assert column(values, text.strip) == [v.strip() for v in values]
    assert column([" a\nb\t c "], text.squeeze) == ["a b c"]


def test_stop_tokens_and_ngrams(column):
    assert column(["The", "'s", "mill", "...", "«»", "n't"], text.is_stop_token) == [True, True, False, True, True, True]
    grams = [["the", "mill"], ["red", "mill"], ["of", "the"], ["red", "the", "mill"]]
    for mode, want in (("any", [True, False, True, True]), ("all", [False, False, True, False]), ("ends", [True, False, True, False])):
        assert column(grams, lambda c: text.drop_ngram(c, mode), "c array<string>") == want
    with pytest.raises(ValueError):
        text.drop_ngram("g", "none")


def test_number_text(column):
    assert column(["12.5", "1.2.3", ".", "7", "a1", ".5"], text.is_number_text) == [True, False, False, True, False, True]


def test_extract_tag_uses_first_or_last_pair(column):
    value = "<answer></answer> x <answer> good </answer>"
    assert column([value], text.extract_tag) == [""]
    assert column([value], lambda c: text.extract_tag(c, which="last")) == ["good"]
    assert column(["no tags", "</answer>a<answer>"], text.extract_tag) == ["no tags", ""]


def test_answer_from_rationale(column):
    values = ["So the answer is 4.", "final answer: a. the final answer is b", "none", "the answer is x the answer is y.."]
    assert column(values, text.answer_from_rationale) == ["4", "b", None, "y."]


def test_truncate_tokens_leaves_short_text_alone(column):
    assert column(["a  b", "a  b c"], lambda c: text.truncate_tokens(c, 2)) == ["a  b", "a b"]


def test_evidence_ids(column):
    ids = ["My_list_of_x_sentence_3", "T_header_cell_0_1_2", "T_cell_0_1_2", "T_item_0_4", "T_table_caption_1", "T_title", "odd"]
    got = column(ids, lambda c: titles.parse_evidence_id(c))
    assert [(r.page, r.kind, r.local_id, r.i1, r.i2, r.i3) for r in got] == [
        ("My_list_of_x", "sentence", "sentence_3", 3, None, None),
        ("T", "header_cell", "header_cell_0_1_2", 0, 1, 2),
        ("T", "cell", "cell_0_1_2", 0, 1, 2),
        ("T", "item", "item_0_4", 0, 4, None),
        ("T", "table_caption", "table_caption_1", 1, None, None),
        ("T", "title", "title", None, None, None),
        ("odd", None, None, None, None, None),
    ]
    assert column(ids[:1], lambda c: titles.page_of(c, compat=True)) == ["My"]


def _murmur3(data):
    """MurmurHash3 byte by byte, for comparison."""
    low = 0xFFFFFFFF

    def mix(k):
        k = k * 0xCC9E2D51 & low
        return (k << 15 | k >> 17) * 0x1B873593 & low

    h, whole = 0, len(data) // 4 * 4
    for i in range(0, whole, 4):
        h ^= mix(int.from_bytes(data[i : i + 4], "little"))
        h = ((h << 13 | h >> 19) & low) * 5 + 0xE6546B64 & low
    h ^= mix(int.from_bytes(data[whole:], "little")) ^ len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & low
    return h ^ h >> 16


def test_murmur3_known_values(column):
    values = ["", "hello", "hello, world", "The quick brown fox jumps over the lazy dog"]
    want = [0, 0x248BFA47, 0x149BBB7F, 0x2E4FF723]
    assert column(values, hashing.murmur3) == want
    # rests of one to three bytes, signs of two to four bytes
    assert column(["a", "ab", "abc", "abcd", "Stra\u00dfe", "\U0001F600\U0001F600x", None], hashing.murmur3) == [
        *[_murmur3(v.encode()) for v in ("a", "ab", "abc", "abcd", "Stra\u00dfe", "\U0001F600\U0001F600x")], None
    ]
    assert column(values, lambda c: hashing.token_bucket(c, 1000)) == [w % 1000 for w in want]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(hashing.cosine_similarity("a", "b")).collect()]
    assert got == pytest.approx([0.5**0.5, 0.0])


def test_stems(column):
    words = (
        "caresses caress ponies poni ties tie cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat "
        "hopping hop falling fall hissing hiss filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit "
        "operator oper triplicate triplic formative form electrical electr hopeful hope goodness good revival reviv adjustment adjust adoption adopt "
        "probate probat rate rate controll control roll roll generalizations gener by by say say dying die"
    ).split()
    assert [stem_word(w) for w in words[::2]] == words[1::2]
    assert column([["running", "was"]], lambda c: stem_tokens(c, 3), "c array<string>") == [["run", "was"]]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("ab {}.é", min_size=1), st.text("cd ,{claim}", min_size=1)), min_size=1, max_size=5))
def test_prompt_round_trip(spark, rows):
    df = spark.createDataFrame(rows, "claim string, evidence string")
    for style in prompts.CORRECTION_TEMPLATES:
        made = df.select("claim", "evidence", prompts.correction_prompt("claim", "evidence", style).alias("p"))
        for r in made.select("claim", "evidence", prompts.parse_prompt("p", style).alias("b")).collect():
            assert (r.b.claim, r.b.evidence) == (r.claim.strip(), r.evidence.strip())


def test_question_prompts(spark):
    df = spark.createDataFrame([("It rains.", "Wet {claim}.")], "claim string, evidence string")
    assert df.select(prompts.verify_prompt("claim", claim_only=True)).first()[0] == "Is it true that It rains? True or false? The answer is: "
    assert df.select(prompts.question_prompt("claim", "evidence")).first()[0] == "Wet {claim}.\nQuestion: It rains.\nThe answer is:"


def test_clean_title(column):
    assert column([" see%20http://a.b/c x "], titles.clean_title) == ["see <URL> x"]


def test_nested_field(spark):
    df = spark.sql("select named_struct('file', named_struct('name', 'a')) as s, '{\"file\": {\"name\": \"b\"}}' as j")
    assert tuple(df.select(text.get_field("s", ["file", "name"]), text.get_path("j", ["file", "name"])).first()) == ("a", "b")


@pytest.mark.parametrize("style", ["expert", "tagged", "brief"])
def test_prompts_keep_whole_evidence(spark, style):
    df = spark.createDataFrame([("a claim\nof two lines", "line one\nline two\n\nline four")], "c string, e string")
    got = df.select(prompts.parse_prompt(prompts.correction_prompt("c", "e", style), style).alias("p")).first().p
    assert (got.claim, got.evidence) == ("a claim\nof two lines", "line one\nline two\n\nline four")
    cut = df.select(prompts.parse_prompt(prompts.correction_prompt("c", "e", "expert"), "expert", compat=True).alias("p")).first().p
    assert (cut.claim, cut.evidence) == ("a claim", "line one")
