"""Page elements, tables, lists, neighbours and context."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.registry import query
from claimlake.operators import context, lists, pages, tables

_PAGE = f"WITH {fx.SQL_PAGE}"
_CHAIN = f"WITH RECURSIVE {fx.SQL_PAGE}, {fx.SQL_CHAIN}"


@query(
    "C7_corpus_from_pages",
    f"""{_PAGE} SELECT page_id AS id, page_id || chr(9) || string_agg(text, ' ' ORDER BY pos) AS contents FROM lines_el WHERE n < 4 GROUP BY page_id""",
)
def _(spark, d):
    return pages.corpus_from_pages(fx.pages(spark, d))


_STATUS = """SELECT doc_id, page_id, 'table_0' AS key, 'table' AS kind, CAST(NULL AS BIGINT) AS pos, CAST(NULL AS VARCHAR) AS text, CAST(NULL AS BIGINT) AS level,
        CASE WHEN doc_id % 7 = 3 THEN 'format_error' ELSE 'empty' END AS status FROM sizes WHERE doc_id % 7 IN (3, 5)
    UNION ALL
    SELECT doc_id, page_id, 'list_0', 'list', NULL, NULL, NULL, CASE WHEN doc_id % 7 = 6 OR blank THEN 'empty' ELSE 'format_error' END
    FROM sizes JOIN (SELECT doc_id, bool_and(line = '') AS blank FROM lines GROUP BY doc_id) USING (doc_id) WHERE doc_id % 7 IN (1, 6) OR blank
    UNION ALL
    SELECT doc_id, page_id, 'sentence_unlisted', 'sentence', NULL, lang, NULL, 'ok' FROM lines WHERE n = 0"""


@query("W1_elements", f"{_PAGE} SELECT page_id, page_id AS title, key, kind, pos, text, level, 'ok' AS status FROM el UNION ALL SELECT page_id, page_id, key, kind, pos, text, level, status FROM ({_STATUS})")
def _(spark, d):
    return pages.elements(fx.parsed(spark, d))


@query(
    "F7_select_elements",
    f"""{_PAGE} SELECT page_id, key, pos FROM lines_el WHERE n < 4 AND n_max >= 4 AND kind = 'sentence'
        UNION ALL SELECT page_id, key, pos FROM lines_el WHERE n_max < 4 AND kind = 'sentence'
        UNION ALL SELECT page_id, 'sentence_unlisted', NULL FROM sizes WHERE n_lines < 5""".replace(
        "lines_el WHERE", "(SELECT *, max(n) OVER (PARTITION BY doc_id) AS n_max FROM lines_el) WHERE"
    ),
)
def _(spark, d):
    return pages.elements(fx.parsed(spark, d), intro=True, contains="sentence_").select("page_id", "key", "pos")


@query(
    "W2_page_quality",
    f"""{_PAGE} SELECT s.page_id, CAST(doc_id % 7 = 5 AS BIGINT) AS tables_empty, CAST(doc_id % 7 = 3 AS BIGINT) AS tables_formatting_errors,
          CAST(doc_id % 7 = 6 OR blank AS BIGINT) AS list_empty, CAST(doc_id % 7 = 1 AND NOT blank AS BIGINT) AS list_formatting_errors
        FROM sizes s JOIN (SELECT doc_id, bool_and(line = '') AS blank FROM lines GROUP BY doc_id) USING (doc_id)""",
)
def _(spark, d):
    return pages.page_quality(fx.parsed(spark, d))


@query("W3_table_grid", f"{_PAGE} SELECT page_id, 'table_0' AS table_key, row, col, cell_id, value, is_header, is_last FROM tab", whole=["col"])
def _(spark, d):
    return tables.table_grid(fx.parsed(spark, d))


@query("W4_cells", f"{_PAGE} SELECT page_id, 'table_0' AS table_key, cell_id, row, col, is_header, text FROM tab WHERE is_last", whole=["col"])
def _(spark, d):
    return tables.cells(tables.table_grid(fx.parsed(spark, d)))


@query(
    "W5_table_rows",
    f"""{_PAGE} SELECT page_id, 'table_0' AS table_key, row, string_agg(text, ' | ' ORDER BY col) AS text, string_agg(cell_id, ' | ' ORDER BY col) AS ids,
          string_agg(cell_id || ';;;' || value, ' | ' ORDER BY col) AS joint, bool_and(is_header) AS is_header_row FROM tab GROUP BY doc_id, page_id, row""",
)
def _(spark, d):
    return tables.table_rows(fx.parsed(spark, d))


@query(
    "W5_table_text",
    f"""{_PAGE} SELECT page_id, 'table_0' AS table_key, source AS caption, text FROM table_text JOIN (SELECT doc_id, source FROM documents) USING (doc_id)""",
)
def _(spark, d):
    return tables.table_text(fx.parsed(spark, d))


@query(
    "W6_list_lines",
    f"{_PAGE} SELECT page_id, 'list_0' AS list_key, line_no, level, repeat('[SUB] ', level) || mark || value AS line FROM shown_items",
    whole=["level"],
)
def _(spark, d):
    return lists.list_lines(fx.parsed(spark, d))


@query("W7_list_items", f"{_PAGE} SELECT page_id, 'list_0' AS list_key, item_id, value AS text FROM items")
def _(spark, d):
    return lists.list_items(fx.parsed(spark, d))


@query(
    "W7_list_by_level",
    f"""{_PAGE} SELECT page_id, 'list_0' AS list_key, level, string_agg(CASE WHEN mark = '- ' THEN value ELSE mark || value END, '|' ORDER BY n) AS contents
        FROM shown_items GROUP BY page_id, level""",
    whole=["level"],
)
def _(spark, d):
    return lists.list_by_level(fx.parsed(spark, d)).withColumn("contents", F.array_join("contents", "|"))


@query(
    "W8_previous_k",
    f"""{_PAGE} SELECT a.page_id, a.key, a.pos, a.pos - b.pos AS distance, b.key AS near_key, b.text AS near_text
        FROM el a JOIN el b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos - 2 AND a.pos - 1""",
)
def _(spark, d):
    return pages.previous_k(fx.parsed(spark, d), 2)


@query(
    "W8_next_k",
    f"""{_PAGE} SELECT a.page_id, a.key, a.pos, b.pos - a.pos AS distance, b.key AS near_key, b.text AS near_text
        FROM el a JOIN el b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 2""",
)
def _(spark, d):
    return pages.next_k(fx.parsed(spark, d), 2)


@query("W9_section_context", f"{_CHAIN} SELECT page_id, key, depth, section_key, section_text, level FROM chain", whole=["depth"])
def _(spark, d):
    return pages.section_context(fx.parsed(spark, d))


# Headers of a cell: the nearest run of header cells to the left and above. Runs of neighbouring headers share
# the difference of position and rank.
_HEADERS = f"""row_h AS (SELECT *, col - row_number() OVER (PARTITION BY doc_id, row ORDER BY col) AS run FROM tab WHERE is_header),
col_h AS (SELECT *, row - row_number() OVER (PARTITION BY doc_id, col ORDER BY row) AS run FROM tab WHERE is_header),
cl AS (SELECT * FROM tab WHERE is_last),
left_run AS (SELECT c.doc_id, c.cell_id, max(h.run) AS run FROM cl c JOIN row_h h ON h.doc_id = c.doc_id AND h.row = c.row AND h.col < c.col GROUP BY ALL),
up_run AS (SELECT c.doc_id, c.cell_id, max(h.run) AS run FROM cl c JOIN col_h h ON h.doc_id = c.doc_id AND h.col = c.col AND h.row < c.row GROUP BY ALL),
lefts AS (
    SELECT c.doc_id, c.cell_id, string_agg(h.cell_id || '=' || h.text, '|' ORDER BY h.col DESC) AS row_headers
    FROM cl c JOIN left_run r USING (doc_id, cell_id) JOIN row_h h ON h.doc_id = c.doc_id AND h.row = c.row AND h.run = r.run AND h.col < c.col GROUP BY ALL),
ups AS (
    SELECT c.doc_id, c.cell_id, string_agg(h.cell_id || '=' || h.text, '|' ORDER BY h.row DESC) AS col_headers
    FROM cl c JOIN up_run r USING (doc_id, cell_id) JOIN col_h h ON h.doc_id = c.doc_id AND h.col = c.col AND h.run = r.run AND h.row < c.row GROUP BY ALL),
chains AS (SELECT doc_id, key, string_agg(section_key || '=' || section_text, '|' ORDER BY depth) AS sections FROM chain GROUP BY ALL)"""


def _joined(c):
    return F.array_join(F.transform(c, lambda h: F.concat_ws("=", h["id"], h["text"])), "|")


@query(
    "W10_cell_context",
    f"""{_CHAIN}, {_HEADERS}
        SELECT c.page_id, 'table_0' AS table_key, c.cell_id, c.row, c.col, c.is_header, c.text,
               coalesce(row_headers, '') AS row_headers, coalesce(col_headers, '') AS col_headers, coalesce(sections, '') AS sections
        FROM cl c LEFT JOIN lefts USING (doc_id, cell_id) LEFT JOIN ups USING (doc_id, cell_id) LEFT JOIN chains s ON s.doc_id = c.doc_id AND s.key = 'table_0'""",
    whole=["col"],
)
def _(spark, d):
    rows = tables.cell_context(fx.parsed(spark, d)).drop("title")
    return rows.withColumns({c: _joined(c) for c in ("sections", "row_headers", "col_headers")})


def _asked(spark, d):
    """Ids asked for: what the annotations cite."""
    from claimlake.operators.evidence import flatten_evidence

    return flatten_evidence(fx.annotations(spark, d)).where("local_id is not null").select("id", "set_no", "pos", "page_id", "local_id")


@query(
    "W11_context",
    f"""{_CHAIN}, {_HEADERS}, {fx.SQL_ANNOTATIONS},
        whole AS (
            SELECT doc_id, page_id, key AS local_id, concat_ws('|', '_title=' || page_id, sections) AS context
            FROM el LEFT JOIN chains USING (doc_id, key) WHERE kind = 'sentence'
            UNION ALL
            SELECT doc_id, page_id, 'table_caption_0', concat_ws('|', '_title=' || page_id, sections) FROM el LEFT JOIN chains USING (doc_id, key) WHERE kind = 'table'
            UNION ALL
            SELECT i.doc_id, i.page_id, item_id, concat_ws('|', '_title=' || i.page_id, sections) FROM items i LEFT JOIN chains s ON s.doc_id = i.doc_id AND s.key = 'list_0'
            UNION ALL
            SELECT c.doc_id, c.page_id, cell_id, CASE WHEN starts_with(cell_id, 'header_cell_') THEN concat_ws('|', '_title=' || c.page_id, sections)
                   ELSE concat_ws('|', sections, row_headers, col_headers) END
            FROM cl c LEFT JOIN lefts USING (doc_id, cell_id) LEFT JOIN ups USING (doc_id, cell_id) LEFT JOIN chains s ON s.doc_id = c.doc_id AND s.key = 'table_0')
        SELECT e.id, e.set_no, e.pos, e.page_id, e.local_id, coalesce(w.context, '') AS context
        FROM ev e LEFT JOIN whole w USING (page_id, local_id)""",
    whole=["set_no"],
)
def _(spark, d):
    rows = context.context(fx.pages(spark, d), _asked(spark, d))
    return rows.withColumn("context", _joined("context"))


_CONTENT = """content AS (
    SELECT page_id, key AS local_id, text FROM el
    UNION ALL SELECT page_id, 'sentence_unlisted', lang FROM lines WHERE n = 0
    UNION ALL SELECT page_id, cell_id, text FROM tab WHERE is_last
    UNION ALL SELECT page_id, 'table_caption_0', source FROM lines WHERE n = 0 AND doc_id % 7 NOT IN (3, 5)
    UNION ALL SELECT page_id, item_id, value FROM items)"""


@query("W12_contents", f"{_PAGE}, {_CONTENT} SELECT page_id, local_id, text FROM content")
def _(spark, d):
    return context.contents(fx.parsed(spark, d)).drop("kind")


@query(
    "W12_content",
    f"""{_PAGE}, {fx.SQL_ANNOTATIONS}, {_CONTENT}
        SELECT e.id, e.set_no, e.pos, e.page_id, e.local_id, coalesce(c.text, '') AS text, c.text IS NOT NULL AS found
        FROM ev e LEFT JOIN content c USING (page_id, local_id)""",
    whole=["set_no"],
)
def _(spark, d):
    return context.content(fx.pages(spark, d), _asked(spark, d))


@query(
    "W13_table_of_cell",
    f"""{_PAGE}, {fx.SQL_ANNOTATIONS}, known AS (SELECT page_id, cell_id AS local_id FROM tab WHERE is_last)
        SELECT e.id, e.set_no, e.pos, e.page_id, e.local_id, CASE WHEN k.local_id IS NOT NULL THEN 'table_0' END AS table_key,
               CASE WHEN kind IN ('cell', 'table_caption') THEN 'table_0' END AS table_by_number
        FROM ev e LEFT JOIN known k USING (page_id, local_id)""",
    whole=["set_no"],
)
def _(spark, d):
    cells = tables.cells(tables.table_grid(fx.parsed(spark, d)))
    return tables.table_of_cell(cells, _asked(spark, d))


@query("W14_page_text", f"{_PAGE} SELECT page_id, string_agg(text, chr(10) ORDER BY pos) AS text FROM el GROUP BY page_id")
def _(spark, d):
    return pages.page_text(fx.parsed(spark, d))


@query(
    "W14_element_ids",
    f"""{_PAGE} SELECT page_id, key AS local_id FROM lines_el UNION ALL SELECT page_id, 'sentence_unlisted' FROM sizes UNION ALL SELECT page_id, cell_id FROM tab
        UNION ALL SELECT page_id, 'table_caption_0' FROM sizes WHERE doc_id % 7 NOT IN (3, 5) UNION ALL SELECT page_id, item_id FROM items""",
)
def _(spark, d):
    return pages.element_ids(fx.parsed(spark, d))
