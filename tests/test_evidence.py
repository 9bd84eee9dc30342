import json

import pytest
from pyspark.sql import functions as F

from claimlake.operators import evidence as ev
from claimlake.operators.pages import parse_pages
from claimlake.sources.records import ANNOTATION_SCHEMA
from tests.test_pages import MILL, cell

TOWN = {
    "title": "Arden_Town",
    "order": ["section_0", "sentence_0", "sentence_1", "table_0"],
    "section_0": {"value": "History", "level": 1},
    "sentence_0": "It is old.",
    "sentence_1": "It is small.",
    "table_0": {
        "type": "table",
        "table": [
            [cell("header_cell_0_0_0", "Name", True), cell("header_cell_0_0_1", "Size", True)],
            [cell("cell_0_1_0", "Arden"), cell("cell_0_1_1", "12")],
            [cell("cell_0_2_0", "Oss"), cell("cell_0_2_1", "9.5")],
        ],
    },
}


def annotation(id_, label, *sets, **extra):
    evidence = [{"content": list(s), "context": {e: [f"{e}_c1", f"{e}_c2"] for e in s}} for s in sets]
    return {"id": id_, "claim": f"claim {id_}", "label": label, "challenge": "none", "evidence": evidence, **extra}


ROWS = [
    annotation(1, "SUPPORTS", ["Red Mill_sentence_0", "Arden_Town_sentence_1", "Red Mill_sentence_0"]),
    annotation(2, "REFUTES", ["Arden_Town_cell_0_1_1", "Arden_Town_cell_0_2_1", "Arden_Town_header_cell_0_0_0", "Red Mill_table_caption_0"]),
    annotation(3, "SUPPORTS", ["Red Mill_sentence_0", "Red Mill_item_0_1"], ["Arden_Town_sentence_0"]),
    annotation(4, "NOT ENOUGH INFO", ["Arden_Town_sentence_9"]),
    annotation(5, "REFUTES"),
    annotation(6, "REFUTES", ["Arden_Town_sentence_9"], ["Red Mill_section_0"]),
]


@pytest.fixture(scope="module")
def ann(spark):
    return spark.createDataFrame([(json.dumps(r),) for r in ROWS], "j string").select(F.from_json("j", ANNOTATION_SCHEMA).alias("a")).select("a.*")


@pytest.fixture(scope="module")
def parsed(spark):
    return parse_pages(spark.createDataFrame([(p["title"], json.dumps(p)) for p in (MILL, TOWN)], "page_id string, data string"))


def test_flatten_and_types(ann):
    rows = {(r.id, r.set_no, r.pos): r for r in ev.flatten_evidence(ann).collect()}
    assert rows[(1, 0, 1)].page_id == "Arden_Town" and rows[(1, 0, 1)].kind == "sentence"
    assert rows[(5, None, None)].has_evidence is False and rows[(3, 1, 0)].n_sets == 2
    types = {(r.id, r.set_no): (r.set_type, r.claim_type) for r in ev.evidence_type(ann).collect()}
    assert types == {
        (1, 0): ("SENTENCE", "SENTENCE"), (2, 0): ("TABLE", "TABLE"), (3, 0): ("JOINT", "JOINT"), (3, 1): ("SENTENCE", "JOINT"),
        (4, 0): ("SENTENCE", "SENTENCE"), (6, 0): ("SENTENCE", "JOINT"), (6, 1): (None, "JOINT"),
    }


def test_groups(ann):
    pages = ev.evidence_by_page(ann).where("id = 1").orderBy("page_no").collect()
    assert [(r.page_id, r.ids) for r in pages] == [
        ("Red Mill", ["Red Mill_sentence_0", "Red Mill_sentence_0"]),
        ("Arden_Town", ["Arden_Town_sentence_1"]),
    ]
    tables = ev.evidence_by_table(ev.evidence_by_page(ann)).where("id = 2").orderBy("page_no").collect()
    assert [(r.page_id, r.table_no, len(r.ids)) for r in tables] == [("Arden_Town", 0, 3), ("Red Mill", 0, 1)]


def test_headers_and_lines(ann, parsed):
    by_table = ev.evidence_by_table(ev.evidence_by_page(ann))
    groups = ev.header_type(ev.evidence_by_header(by_table, parsed)).collect()
    assert [(r.header_id, r.header_text, r.texts, r.header_type) for r in groups] == [("header_cell_0_0_1", "[H] Size", ["12", "9.5"], "real")]
    lines = {(r.id, r.page_id): r.parts for r in ev.linearize_table_evidence(by_table, parsed).collect()}
    assert lines == {(2, "Arden_Town"): ["Arden_Town", "Size is 12 ; Size is 9.5."], (2, "Red Mill"): ["Red Mill", "Flour"]}


def test_model_input(ann, parsed):
    texts = {r.id: r.text for r in ev.model_input(ann, parsed).collect()}
    assert texts[1] == "claim 1 </s>  Red Mill is a mill. </s>  Red Mill is a mill. </s> History It is small."
    assert texts[2] == "claim 2 </s> Arden_Town </s> Size is 12 ; Size is 9.5. </s> Red Mill </s> Flour"
    assert texts[5] == "claim 5"
    guessed = ann.where("id = 5").withColumn("predicted_evidence", F.array(F.lit("Arden_Town_sentence_0")))
    assert ev.model_input(guessed, parsed, gold=False).first().text == "claim 5 </s> History It is old."


def test_model_input_moves_evidence_once(spark, ann, parsed):
    """Wanted ids by page, pages, ids and what was found for them, claims: five exchanges where nothing is broadcast."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = ev.model_input(ann, parsed)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange hashpartitioning") <= 5


def test_claims_asked_twice_and_unknown_ids(ann, parsed):
    twice = ann.where("id = 2")
    assert [r.text for r in ev.model_input(twice, parsed).collect()] == ["claim 2 </s> Arden_Town </s> Size is 12 ; Size is 9.5. </s> Red Mill </s> Flour"]
    other = twice.withColumn("predicted_evidence", F.array(F.lit("Nowhere_sentence_0"), F.lit("Red Mill_cell_9_9_9"), F.lit("Red Mill_table_caption_7")))
    assert ev.model_input(other, parsed, gold=False).first().text == "claim 2 </s>   </s> Red Mill </s> Red Mill </s> "


def test_gold_evidence_and_claims(ann, parsed):
    gold = {r.id: r.evidence for r in ev.gold_evidence(ann, parsed).collect()}
    assert gold[1] == "Red Mill\tRed Mill is a mill.\nArden_Town\tIt is small.\nRed Mill\tRed Mill is a mill."
    assert gold[4] == "Arden_Town\tNone"
    claims = {r.id: (r.label, r.evidence) for r in ev.prepare_claims(ann, parsed).collect()}
    assert claims == {1: ("supports", gold[1]), 5: ("refutes", "")}


def test_maps(spark, ann):
    twice = annotation(7, "SUPPORTS", ["A_sentence_0"], ["A_sentence_0", "A_sentence_1"])
    twice["evidence"][1]["context"]["A_sentence_0"] = ["later"]
    for s, texts in zip(twice["evidence"], (["x"], ["y", "z"])):
        s["text"] = texts
        s["context_text"] = {e: [f"text of {c}" for c in cs] for e, cs in s["context"].items()}
    short = annotation(8, "SUPPORTS", ["A_sentence_0"])
    short["evidence"][0]["text"] = []
    rows = spark.createDataFrame([(json.dumps(r),) for r in (twice, short)], "j string").select(F.from_json("j", ANNOTATION_SCHEMA).alias("a")).select("a.*")
    contexts = {(r.id, r.evidence_id): r.context for r in ev.context_map(rows).collect()}
    assert contexts[(7, "A_sentence_0")] == ["later"] and len(contexts) == 3
    texts = {(r.id, r.evidence_id): r.text for r in ev.evidence_text_map(rows).collect()}
    assert texts == {(7, "A_sentence_0"): "y", (7, "A_sentence_1"): "z"}
    back = {r.context_id: r.text for r in ev.context_text_map(rows).where("id = 7").collect()}
    assert back == {"later": "text of later", "A_sentence_1_c1": "text of A_sentence_1_c1", "A_sentence_1_c2": "text of A_sentence_1_c2"}
    everything = ev.annotation_universe(rows).groupBy("what").count().collect()
    assert {r.what: r["count"] for r in everything} == {"evidence": 4, "title": 4, "context": 3}
