import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimlake.functions.text import JVM_SPACE, SPACE
from claimlake.operators import context, documents, filters, lists, pages, tables


def cell(id_, value, header=False, cols=1, rows=1):
    return {"id": id_, "value": value, "is_header": header, "column_span": str(cols), "row_span": rows}


def section(level, value="S"):
    return {"value": value, "level": level}


MILL = {
    "title": "Red Mill",
    "order": ["sentence_0", "section_0", "table_0", "section_1", "list_0"],
    "sentence_0": "Red Mill is\na mill.",
    "section_0": section(2, "Output"),
    "section_1": section(3, "Parts"),
    "table_0": {
        "type": "table",
        "caption": "Flour",
        "table": [
            [cell("header_cell_0_0_0", "Year", True), cell("header_cell_0_0_1", "Tons", True)],
            [cell("cell_0_1_0", "1901"), cell("cell_0_1_1", "12.5")],
        ],
    },
    "list_0": {
        "type": "unordered_list",
        "list": [{"id": "item_0_0", "value": "Wheel", "level": 0, "type": "ordered_list"}, {"id": "item_0_1", "value": "Axle", "level": 1}],
    },
    "sentence_7": "Not shown.",
}


def parse(spark, *data):
    rows = [(d.get("title", "p"), json.dumps(d)) for d in data]
    return pages.parse_pages(spark.createDataFrame(rows, "page_id string, data string"))


def table_page(rows, title="T"):
    return {"title": title, "order": ["table_0"], "table_0": {"type": "table", "table": rows}}


def test_elements_and_texts(spark):
    parsed = parse(spark, MILL)
    got = {r.key: (r.pos, r.kind, r.text, r.level) for r in pages.elements(parsed).collect()}
    assert got == {
        "sentence_0": (0, "sentence", "Red Mill is a mill.", None),
        "section_0": (1, "section", "Output", 2),
        "table_0": (2, "table", "[H] Year | [H] Tons\n1901 | 12.5", None),
        "section_1": (3, "section", "Parts", 3),
        "list_0": (4, "list", "- Wheel [SUB] 1. Axle", None),
        "sentence_7": (None, "sentence", "Not shown.", None),
    }
    assert [r.line for r in lists.list_lines(parsed).orderBy("line_no").collect()] == ["- Wheel", "[SUB] 1. Axle"]
    assert pages.page_text(parsed).first().text.startswith("Red Mill is a mill.\nOutput\n[H] Year")


def test_intro_mode(spark):
    parsed = parse(spark, MILL)
    assert [r.key for r in pages.elements(parsed, intro=True).collect()] == ["sentence_0"]
    starts = {"title": "A", "order": ["section_0", "sentence_0"], "section_0": section(1), "sentence_0": "x"}
    assert len(pages.elements(parse(spark, starts), intro=True).collect()) == 2
    corpus = pages.corpus_from_pages(spark.createDataFrame([("Red Mill", json.dumps(MILL)), ("A", json.dumps(starts))], "page_id string, data string"))
    assert {r.id: r.contents for r in corpus.collect()} == {"Red Mill": "Red Mill\tRed Mill is a mill.", "A": "A\tx"}


def test_broken_page_has_no_elements(spark):
    rows = spark.createDataFrame([("x", '{"title": "x"'), ("y", None)], "page_id string, data string")
    assert [r.elements for r in pages.parse_pages(rows).collect()] == [[], []]


def test_section_walk(spark):
    levels = [1, 2, 3, 2]
    page = {"title": "P", "order": [f"section_{i}" for i in range(4)] + ["sentence_0"], "sentence_0": "x"}
    page.update({f"section_{i}": section(lv, f"S{i}") for i, lv in enumerate(levels)})
    chain = pages.section_context(parse(spark, page)).where("key = 'sentence_0'").orderBy("depth").collect()
    # going back: S3 (2), then S2 is deeper and ends the walk
    assert [r.section_key for r in chain] == ["section_3"]
    page.update(section_2=section(2, "S2"))
    chain = pages.section_context(parse(spark, page)).where("key = 'sentence_0'").orderBy("depth").collect()
    # equal levels are passed over
    assert [r.section_key for r in chain] == ["section_3", "section_0"]


def walk(levels, n):
    """The section walk, section by section."""
    chain = []
    for i in range(n, -1, -1):
        if not chain or levels[i] < levels[chain[-1]]:
            chain.append(i)
        elif levels[i] > levels[chain[-1]]:
            break
    return chain


def outlined(spark, levels):
    from pyspark.sql import functions as F

    from claimlake.functions.binding import let
    from claimlake.operators.outline import outline, section_chain

    kind = "array<struct<kind:string,pos:int,level:int,key:string,text:string>>"
    rows = [{"kind": "section", "pos": i, "level": v, "key": str(i), "text": ""} for i, v in enumerate(levels)]
    df = spark.createDataFrame([(rows,)], f"elements {kind}")
    keys = lambda o, e: F.transform(section_chain(o, e["pos"] + 1), lambda s: s["key"].cast("int"))
    return df.select(let(outline(), F.col("elements"), lambda o, es: F.transform(es, lambda e: keys(o, e))).alias("c")).first()["c"]


def test_outline_matches_the_walk(spark):
    import random

    r = random.Random(4)
    for _ in range(15):
        levels = [r.randint(1, 4) for _ in range(r.randint(1, 30))]
        # the walk from an element after section i; the last section has none after it
        assert outlined(spark, levels)[:-1] == [walk(levels, i) for i in range(len(levels) - 1)]


def test_outlines_of_long_pages_grow_in_proportion(spark):
    import time

    took = {}
    for n in (4_000, 4_000, 16_000):
        levels = [1 + (i * 7) % 5 for i in range(n)]
        began = time.time()
        got = outlined(spark, levels)
        took[n] = time.time() - began
        assert got[n - 2] == walk(levels, n - 2)
    assert took[16_000] < 10 * took[4_000] + 2


def test_neighbours(spark):
    parsed = parse(spark, MILL)
    before = pages.previous_k(parsed, 3).where("key = 'table_0'").orderBy("distance").collect()
    assert [r.near_key for r in before] == ["section_0", "sentence_0"]
    after = pages.next_k(parsed, 2).where("key = 'table_0'").orderBy("distance").collect()
    assert [r.near_key for r in after] == ["section_1", "list_0"]
    assert after[0].near_text == "Parts"


def test_spans(spark):
    rows = [
        [cell("a", "A", True, cols=2), cell("b", "B", True)],
        [cell("c", "C", rows=2), cell("d", "D"), cell("e", "E")],
        [cell("f", "F"), cell("g", "G")],
    ]
    parsed = parse(spark, table_page(rows))
    grid = tables.table_grid(parsed).orderBy("row", "col").collect()
    assert [r.cell_id for r in grid] == ["a", "a", "b", "c", "d", "e", "c", "f", "g"]
    where = {r.cell_id: (r.row, r.col) for r in tables.cells(tables.table_grid(parsed)).collect()}
    # a cell over several slots stands at the last one
    assert where == {"a": (0, 1), "b": (0, 2), "c": (2, 0), "d": (1, 1), "e": (1, 2), "f": (2, 1), "g": (2, 2)}
    assert [r.is_header_row for r in tables.table_rows(parsed).orderBy("row").collect()] == [True, False, False]


def brute_grid(rows):
    """Span rules read off the specification, cell by cell."""
    width = sum(c["column_span"] for c in rows[0])
    grid = [[None] * width for _ in rows]
    for i, row in enumerate(rows):
        for c in row:
            free = 0
            while free < width and grid[i][free] is not None:
                free += 1
            if free == width:
                return None
            for j in range(free, min(free + c["column_span"], width)):
                grid[i][j] = c["id"]
            for k in range(i, min(i + c["row_span"], len(rows))):
                grid[k][free] = c["id"]
    return grid if all(x is not None for row in grid for x in row) else None


def test_spans_against_brute_force():
    import random

    rng = random.Random(3)
    outcomes = set()
    for _ in range(400):
        rows, n = [], 0
        for _ in range(rng.randint(1, 4)):
            row = []
            for _ in range(rng.randint(1, 4)):
                row.append({"id": n, "column_span": rng.choice([1, 1, 2, 3]), "row_span": rng.choice([1, 1, 2, 5])})
                n += 1
            rows.append(row)
        layout = ";".join(",".join(f"{c['column_span']}x{c['row_span']}" for c in r) for r in rows)
        got = tables._expand(layout)
        want = brute_grid(rows)
        assert (None if got is None else [[s["cell"] for s in r] for r in got]) == want
        outcomes.add(want is None)
    assert outcomes == {True, False}


def test_quality_counters(spark):
    no_room = table_page([[cell("a", "A")], [cell("b", "B"), cell("c", "C")]], "bad")
    empty = table_page([], "empty")
    blank = {"title": "blank", "order": [], "list_0": {"type": "unordered_list", "list": [{"id": "i", "value": "", "level": 0}]}}
    deep = {"title": "deep", "order": [], "list_0": {"type": "unordered_list", "list": [{"id": "i", "value": "x", "level": -1}]}}
    got = {r.page_id: tuple(r)[1:] for r in pages.page_quality(parse(spark, no_room, empty, blank, deep, MILL)).collect()}
    assert got == {"bad": (0, 1, 0, 0), "empty": (1, 0, 0, 0), "blank": (0, 0, 1, 0), "deep": (0, 0, 0, 1), "Red Mill": (0, 0, 0, 0)}


def test_list_numbering(spark):
    entries = [("a", 0, None), ("b", 0, "ordered_list"), ("c", 1, None), ("d", 1, None), ("e", 0, "ordered_list"), ("f", 1, None), ("", 0, None), ("g", 0, None)]
    items = [{"id": f"item_0_{i}", "value": v, "level": lv, **({"type": t} if t else {})} for i, (v, lv, t) in enumerate(entries)]
    page = {"title": "L", "order": ["list_0"], "list_0": {"type": "ordered_list", "list": items}}
    parsed = parse(spark, page)
    lines = [r.line for r in lists.list_lines(parsed).orderBy("line_no").collect()]
    # the counter of the deeper level starts again after going up; an empty entry counts but is not shown
    assert lines == ["1. a", "2. b", "[SUB] 1. c", "[SUB] 2. d", "3. e", "[SUB] 1. f", "5. g"]
    levels = {r.level: r.contents for r in lists.list_by_level(parsed).collect()}
    assert levels == {0: ["1. a", "2. b", "3. e", "5. g"], 1: ["1. c", "2. d", "1. f"]}


def test_cell_headers(spark):
    rows = [
        [cell("h0", "x", True), cell("h1", "y", True), cell("h2", "z", True)],
        [cell("h3", "r", True), cell("c1", "1"), cell("c2", "2")],
        [cell("c3", "3"), cell("h4", "s", True), cell("c4", "4")],
        [cell("c5", "5"), cell("c6", "6"), cell("c7", "7")],
    ]
    got = {r.cell_id: ([h.id for h in r.row_headers], [h.id for h in r.col_headers]) for r in tables.cell_context(parse(spark, table_page(rows))).collect()}
    assert got["c1"] == (["h3"], ["h1"])
    assert got["c2"] == (["h3"], ["h2"])
    assert got["c4"] == (["h4"], ["h2"])
    # the nearest run only: h4 hides h1; h3 and h0 touch and form one run
    assert got["c6"] == ([], ["h4"])
    assert got["c5"] == ([], ["h3", "h0"])


def test_headers_of_a_long_table(spark):
    # each cell of the first column has all those above it as headers: 12.5 million, of which no row may hold more than its own
    rows = [[cell(f"header_cell_0_{i}_0", str(i), True), cell(f"cell_0_{i}_1", "x")] for i in range(5000)]
    found = tables.cell_context(parse(spark, table_page(rows))).agg(F.sum(F.size("col_headers")).alias("n"), F.sum(F.size("row_headers")).alias("m")).first()
    assert (found.n, found.m) == (5000 * 4999 // 2, 5000)


def test_content_and_context(spark):
    parsed = parse(spark, MILL)
    wanted = ["sentence_0", "cell_0_1_1", "header_cell_0_0_0", "item_0_1", "table_caption_0", "section_1", "cell_9_9_9"]
    ids = spark.createDataFrame([("Red Mill", i) for i in wanted], "page_id string, local_id string")
    texts = {r.local_id: (r.text, r.found) for r in context.content(parsed, ids).collect()}
    assert texts == {
        "sentence_0": ("Red Mill is a mill.", True), "cell_0_1_1": ("12.5", True), "header_cell_0_0_0": ("[H] Year", True),
        "item_0_1": ("Axle", True), "table_caption_0": ("Flour", True), "section_1": ("Parts", True), "cell_9_9_9": ("", False),
    }
    around = {r.local_id: [c.id for c in r.context] for r in context.context(parsed, ids).collect()}
    assert around["cell_0_1_1"] == ["section_0", "header_cell_0_0_1"]
    assert around["header_cell_0_0_0"] == ["_title", "section_0"]
    # section_1 is deeper than section_0, so the walk goes on to it
    assert around["item_0_1"] == ["_title", "section_1", "section_0"]
    assert around["sentence_0"] == ["_title"] and around["cell_9_9_9"] == []
    known = tables.table_of_cell(tables.cells(tables.table_grid(parsed)), ids)
    assert {r.local_id: r.table_key for r in known.collect()}["cell_0_1_1"] == "table_0"
    assert pages.element_ids(parsed).count() == 1 + 1 + 1 + 2 + 5 + 1


def test_valid_pages_keeps_first(spark):
    rows = [("t", 2, '{"title":"t","a":1,"b":2}'), ("t", 1, '{"title":"t","a":1,"b":3}'), ("u", 1, '{"title":"u","a":1}')]
    got = filters.valid_pages(spark.createDataFrame(rows, "title string, n int, data string"), "title", ["n"]).collect()
    assert [(r.title, r.n) for r in got] == [("t", 1)]


SUMO = (
    "Tatsu\n\nTatsu is a wrestler.\n\nHe is tall.\n\nSection::::Career.\nSection::::Early years.\nHe began young and won.\n\nshort\n\n"
    "Then he moved to the capital.\n\nSection::::Honours.\n"
)


def test_sections(spark):
    docs = spark.createDataFrame([("Tatsu_0", SUMO), ("Plain_0", "only one line")], "id string, text string")
    got = [tuple(r)[2:] for r in documents.sections(docs).where("id = 'Tatsu_0'").orderBy("pos").collect()]
    assert got == [
        ("Introduction", "intro", "Introduction", ["Tatsu is a wrestler.", "He is tall.", ""]),
        ("Career.", "parent", None, []),
        ("Early years.", "child", "Career.", ["He began young and won.", "Then he moved to the capital."]),
        ("Honours.", "parent", None, []),
    ]
    every = documents.sections(docs, least_paragraph=1).where("section_name = 'Early years.'").first().paragraphs
    assert every == ["He began young and won.", "short", "Then he moved to the capital."]


def test_paragraphs_and_links(spark):
    text = 'Red Mill\n\nIt is in <a href="%C3%A9sk">Esk</a>.'
    docs = spark.createDataFrame([("Red Mill_0", text, ["Esk", "Nowhere"]), ("Esk_0", "Esk", [])], "id string, text string, links array<string>")
    rows = documents.paragraph_table(docs).orderBy("id").collect()
    assert [(r.paragraph_id, r.text, r.links) for r in rows] == [("Red Mill_0", "It is in Esk.", ["Ésk"])]
    linked = documents.linked_documents(docs, documents.link_edges(docs)).collect()
    assert {(r.dst_title, r.dst_id) for r in linked} == {("Esk", "Esk_0"), ("Nowhere", None)}
    ids = spark.createDataFrame([("Esk",), ("Gone",)], "id string")
    assert [r.id for r in documents.missing_documents(docs, ids).collect()] == ["Gone_0"]
    found = documents.lookup(docs, spark.createDataFrame([("Esk_0",), ("Gone_0",)], "id string"), ["text"]).collect()
    assert {(r.id, r.text, r.found) for r in found} == {("Esk_0", "Esk", True), ("Gone_0", None, False)}


def test_lists_have_no_deepest_level(spark):
    items = [{"id": f"item_0_{i}", "value": f"v{i}", "level": lv, "type": "ordered_list"} for i, lv in enumerate([*range(13), 1000, 0])]
    page = {"title": "L", "order": ["list_0"], "list_0": {"type": "ordered_list", "list": items}}
    parsed = parse(spark, page)
    assert lists.list_items(parsed).count() == 15
    lines = [r.line for r in lists.list_lines(parsed).orderBy("line_no").collect()]
    # nothing gave a type for level 1000, so that entry has no mark and does not show
    assert lines == ["[SUB] " * i + f"1. v{i}" for i in range(13)] + ["2. v14"]


def test_long_lists_grow_in_proportion(spark):
    import time

    from pyspark.sql import functions as F

    from claimlake.operators.lists import lines_of

    took = {}
    for n in (5_000, 5_000, 20_000):
        rows = [{"id": f"i{k}", "value": f"v{k}", "level": (k % 7) // 4, "type": "ordered_list" if k % 7 == 0 else None} for k in range(n)]
        df = spark.createDataFrame([(rows,)], "entries array<struct<id:string,value:string,level:int,type:string>>")
        began = time.time()
        got = df.select(F.transform(lines_of(F.lit("unordered_list"), F.col("entries")), lambda l: F.concat(l["mark"], l["text"])).alias("l")).first()["l"]
        took[n] = time.time() - began
        # levels 0 and 1 in turn; the deeper one counts anew each time
        want = [f"- v{k}" if k % 7 < 4 else f"{k % 7 - 3}. v{k}" for k in range(n)]
        assert got == want
    assert took[20_000] < 12 * took[5_000] + 2


def test_grids_of_many_pages_at_once():
    layouts = [["1x1,1x1;2x1", None], None, [], ["3x1;1x1,1x1,1x1", "1x2,1x1;1x1"], ["1x1;1x1,1x1", "0x1,1x1;1x1", "2x1,2x1;3x1,5x1", "?x1", "1x1x1", "1x1;"]]
    batches = [pa.array(part, pa.list_(pa.string())) for part in (layouts[:2], layouts[2:])]
    got = [page for batch in tables._grids_of(iter(batches)) for page in batch.to_pylist()]
    wide = lambda t: None if t is None or t == "1x1x1" else tables._expand(t)
    assert got == [None if page is None else [wide(t) for t in page] for page in layouts]


def test_parsing_sorts_no_elements(spark):
    """Elements hold whole tables; what is sorted and numbered is their keys."""
    rows = parse(spark, MILL).select(pages._rows(F.col("elements"), F.array(F.lit("sentence_0"))).alias("rows"))
    assert rows.schema["rows"].dataType.elementType.names == ["key", "own", "at", "i", "ok"]
    listed_twice = MILL | {"order": ["table_0", "sentence_0", "gone", "table_0", "list_0"]}
    got = [(e.key, e.pos) for e in parse(spark, listed_twice).first().elements]
    assert got[:3] == [("table_0", 0), ("sentence_0", 1), ("list_0", 2)] and all(pos is None for _, pos in got[3:]) and len(got) == 6


def test_spaces_of_the_jvm_are_the_same(spark):
    points = spark.createDataFrame([(chr(i),) for i in range(1, 0x3100)], "c string")
    assert points.where(F.col("c").rlike(SPACE) != F.col("c").rlike(JVM_SPACE)).count() == 0
