"""Evidence of annotations: groups, texts, table lines and model input."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.pages import _CONTENT, _HEADERS
from catalog.registry import query
from claimlake.operators import evidence as ev

_ANN = f"WITH {fx.SQL_LINES}, {fx.SQL_ANNOTATIONS}"
_PAGE = f"WITH {fx.SQL_PAGE}, {fx.SQL_ANNOTATIONS}, {_CONTENT}"
_CHAIN = f"WITH RECURSIVE {fx.SQL_PAGE}, {fx.SQL_CHAIN}, {_HEADERS}, {fx.SQL_ANNOTATIONS}, {_CONTENT}"


@query(
    "E1_flatten_evidence",
    f"""{_ANN}, sets AS (SELECT id, label AS verdict, CASE WHEN id % 4 = 2 THEN 2 ELSE 1 END AS n_sets, unnest(CASE WHEN id % 4 = 2 THEN [0, 1] ELSE [0] END) AS set_no FROM ann)
        SELECT s.id, s.verdict, 'search,open' AS operations, s.n_sets, count(e.local_id) OVER (PARTITION BY s.id) > 0 AS has_evidence, s.set_no, e.pos,
               e.page_id || '_' || e.local_id AS evidence_id, e.page_id, e.local_id, e.kind
        FROM sets s LEFT JOIN ev e ON e.id = s.id AND e.set_no = s.set_no""",
    whole=["n_sets", "set_no"],
)
def _(spark, d):
    rows = ev.flatten_evidence(fx.annotations(spark, d))
    return rows.withColumn("operations", F.array_join("operations", ","))


@query(
    "E2_evidence_type",
    f"""{_ANN}, sets AS (SELECT id, unnest(CASE WHEN id % 4 = 2 THEN [0, 1] ELSE [0] END) AS set_no FROM ann),
        kinds AS (
            SELECT s.id, s.set_no, list_distinct(list(CASE kind WHEN 'sentence' THEN 'SENTENCE' WHEN 'item' THEN 'LIST' WHEN 'cell' THEN 'TABLE' WHEN 'table_caption' THEN 'TABLE' END)) AS k
            FROM sets s LEFT JOIN ev e ON e.id = s.id AND e.set_no = s.set_no GROUP BY s.id, s.set_no)
        SELECT id, set_no, CASE WHEN len(k) > 1 THEN 'JOINT' ELSE k[1] END AS set_type,
               CASE WHEN id % 4 = 2 THEN 'JOINT' WHEN len(k) > 1 THEN 'JOINT' ELSE k[1] END AS claim_type FROM kinds""",
    whole=["set_no"],
)
def _(spark, d):
    return ev.evidence_type(fx.annotations(spark, d))


_GROUPS = """flat AS (SELECT id, page_id, page_id || '_' || local_id AS evidence_id, local_id, kind, set_no * 1000000 + pos AS ord FROM ev),
by_page AS (SELECT id, page_id, string_agg(evidence_id, '|' ORDER BY ord) AS ids, min(ord) AS first_at FROM flat GROUP BY id, page_id),
page_nos AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY first_at) - 1 AS page_no FROM by_page)"""


@query("E3_evidence_by_page", f"{_ANN}, {_GROUPS} SELECT id, page_no, page_id, ids FROM page_nos")
def _(spark, d):
    return ev.evidence_by_page(fx.annotations(spark, d)).withColumn("ids", F.array_join("ids", "|"))


@query(
    "E4_evidence_by_table",
    f"""{_ANN}, {_GROUPS} SELECT f.id, p.page_no, f.page_id, 0 AS table_pos, 0 AS table_no, string_agg(f.evidence_id, '|' ORDER BY f.ord) AS ids
        FROM flat f JOIN page_nos p USING (id, page_id) WHERE f.kind IN ('cell', 'table_caption') GROUP BY ALL""",
    whole=["table_pos", "table_no"],
)
def _(spark, d):
    groups = ev.evidence_by_table(ev.evidence_by_page(fx.annotations(spark, d)))
    return groups.withColumn("ids", F.array_join("ids", "|"))


# Evidence cells are in the second column, whose headers are the row's first cell and what stands above.
_MET = """cell_heads AS (
    SELECT c.doc_id, c.page_id, c.cell_id, c.text, h.cell_id AS header_id, h.text AS header_text, 0 AS header_group, h.col AS ord
    FROM cl c JOIN left_run r USING (doc_id, cell_id) JOIN row_h h ON h.doc_id = c.doc_id AND h.row = c.row AND h.run = r.run AND h.col < c.col
    UNION ALL
    SELECT c.doc_id, c.page_id, c.cell_id, c.text, h.cell_id, h.text, 1, -h.row
    FROM cl c JOIN up_run r USING (doc_id, cell_id) JOIN col_h h ON h.doc_id = c.doc_id AND h.col = c.col AND h.run = r.run AND h.row < c.row),
met AS (
    SELECT e.id, e.page_id, e.pos, h.header_id, h.header_text, h.text, h.header_group, h.ord
    FROM ev e JOIN cell_heads h ON h.page_id = e.page_id AND h.cell_id = e.local_id WHERE e.kind = 'cell'),
grouped AS (
    SELECT id, page_id, header_id, header_text, list_sort(list_distinct(list(text))) AS texts, min(pos * 1000000 + header_group * 100000 + ord) AS first_at
    FROM met GROUP BY id, page_id, header_id, header_text)"""


@query(
    "E5_evidence_by_header",
    f"{_CHAIN}, {_MET} SELECT id, 0 AS page_no, page_id, 0 AS table_pos, 0 AS table_no, header_id, header_text, array_to_string(texts, '|') AS texts FROM grouped",
    whole=["page_no", "table_pos", "table_no"],
)
def _(spark, d):
    by_table = ev.evidence_by_table(ev.evidence_by_page(fx.annotations(spark, d)))
    groups = ev.evidence_by_header(by_table, fx.pages(spark, d))
    return groups.drop("header_no").withColumn("texts", F.array_join("texts", "|"))


@query(
    "E6_header_type",
    f"""{_CHAIN}, {_MET} SELECT id, page_id, header_id,
          CASE WHEN 2 * len(list_filter(texts, lambda t: regexp_matches(t, '^[0-9]*\\.?[0-9]*$') AND regexp_matches(t, '[0-9]'))) >= len(texts) THEN 'real' ELSE 'text' END AS header_type
        FROM grouped""",
)
def _(spark, d):
    by_table = ev.evidence_by_table(ev.evidence_by_page(fx.annotations(spark, d)))
    groups = ev.header_type(ev.evidence_by_header(by_table, fx.pages(spark, d)))
    return groups.select("id", "page_id", "header_id", "header_type")


_PARTS = """heads AS (
    SELECT id, page_id, string_agg(array_to_string(list_transform(texts, lambda t: trim(substr(header_text, 5)) || ' is ' || t), ' ; ') || '.',
           chr(31) ORDER BY first_at) AS lines
    FROM grouped GROUP BY id, page_id),
cited_tables AS (SELECT DISTINCT id, page_id FROM ev WHERE kind IN ('cell', 'table_caption')),
linear AS (
    SELECT t.id, t.page_id, concat_ws(chr(31), t.page_id, coalesce(c.text, ''), h.lines) AS parts
    FROM cited_tables t LEFT JOIN heads h USING (id, page_id) LEFT JOIN content c ON c.page_id = t.page_id AND c.local_id = 'table_caption_0')"""


@query(
    "E7_linearize_table_evidence",
    f"{_CHAIN}, {_MET}, {_PARTS} SELECT id, 0 AS page_no, page_id, 0 AS table_pos, 0 AS table_no, parts FROM linear",
    whole=["page_no", "table_pos", "table_no"],
)
def _(spark, d):
    by_table = ev.evidence_by_table(ev.evidence_by_page(fx.annotations(spark, d)))
    return ev.linearize_table_evidence(by_table, fx.pages(spark, d)).withColumn("parts", F.array_join("parts", "\x1f"))


@query(
    "E8_model_input",
    f"""{_CHAIN}, {_MET}, {_PARTS}, {_GROUPS},
        said AS (
            SELECT f.id, p.page_no, f.ord,
                   coalesce((SELECT string_agg(section_text, '. ' ORDER BY depth) FROM chain c WHERE c.page_id = f.page_id AND c.key = f.local_id), '') || ' ' || coalesce(t.text, '') AS part
            FROM flat f JOIN page_nos p USING (id, page_id) LEFT JOIN content t ON t.page_id = f.page_id AND t.local_id = f.local_id WHERE f.kind = 'sentence'),
        by_claim AS (SELECT id, string_agg(part, ' </s> ' ORDER BY page_no, ord) AS sentences FROM said GROUP BY id)
        SELECT a.id, concat_ws(' </s> ', a.claim, b.sentences, replace(l.parts, chr(31), ' </s> ')) AS text
        FROM ann a LEFT JOIN by_claim b USING (id) LEFT JOIN linear l USING (id)""",
)
def _(spark, d):
    return ev.model_input(fx.annotations(spark, d), fx.pages(spark, d))


@query(
    "E8_model_input_predicted",
    f"""{_CHAIN}, {_GROUPS},
        first_at AS (SELECT id, page_id, min(-ord) AS first FROM flat WHERE kind = 'sentence' GROUP BY ALL),
        said AS (
            SELECT f.id, p.first, f.ord,
                   coalesce((SELECT string_agg(section_text, '. ' ORDER BY depth) FROM chain c WHERE c.page_id = f.page_id AND c.key = f.local_id), '') || ' ' || coalesce(t.text, '') AS part
            FROM flat f JOIN first_at p USING (id, page_id) LEFT JOIN content t ON t.page_id = f.page_id AND t.local_id = f.local_id WHERE f.kind = 'sentence'),
        by_claim AS (SELECT id, string_agg(part, ' </s> ' ORDER BY first, ord DESC) AS sentences FROM said GROUP BY id)
        SELECT a.id, concat_ws(' </s> ', a.claim, b.sentences) AS text FROM ann a LEFT JOIN by_claim b USING (id)""",
)
def _(spark, d):
    """Predicted evidence: the cited sentences, last one first."""
    ann = fx.annotations(spark, d)
    predicted = F.reverse(F.filter(ev.flat_ids(), lambda e: F.contains(e, F.lit("_sentence_"))))
    return ev.model_input(ann.withColumn("predicted_evidence", predicted), fx.pages(spark, d), gold=False)


_GOLD = """gold AS (
    SELECT e.id, string_agg(e.page_id || chr(9) || coalesce(c.text, 'None'), chr(10) ORDER BY e.set_no, e.pos) AS evidence
    FROM ev e LEFT JOIN content c USING (page_id, local_id) WHERE e.kind = 'sentence' GROUP BY e.id)"""


@query("E9_gold_evidence", f"{_PAGE}, {_GOLD} SELECT id, evidence FROM gold")
def _(spark, d):
    return ev.gold_evidence(fx.annotations(spark, d), fx.pages(spark, d))


@query(
    "E10_prepare_claims",
    f"""{_PAGE}, {_GOLD} SELECT a.id, a.claim, lower(a.label) AS label, a.challenge, coalesce(g.evidence, '') AS evidence
        FROM ann a LEFT JOIN gold g USING (id) WHERE a.label IN ('SUPPORTS', 'REFUTES') AND a.id % 4 IN (0, 3)""",
)
def _(spark, d):
    return ev.prepare_claims(fx.annotations(spark, d), fx.pages(spark, d))


@query(
    "E11_context_map",
    f"{_ANN} SELECT id, page_id || '_' || local_id AS evidence_id, 'Page ' || id || '_title|Page ' || id || '_section_0' AS context FROM ev",
)
def _(spark, d):
    return ev.context_map(fx.annotations(spark, d)).withColumn("context", F.array_join("context", "|"))


@query(
    "E11_evidence_text_map",
    f"{_ANN} SELECT id, page_id || '_' || local_id AS evidence_id, 'text of ' || page_id || '_' || local_id AS text FROM ev",
)
def _(spark, d):
    return ev.evidence_text_map(fx.annotations(spark, d))


@query(
    "E11_context_text_map",
    f"""{_ANN}, last AS (SELECT id, arg_max(page_id || '_' || local_id, set_no * 1000000 + pos) AS evidence_id FROM ev GROUP BY id)
        SELECT id, 'Page ' || id || '_title' AS context_id, 'title for ' || evidence_id AS text FROM last
        UNION ALL SELECT id, 'Page ' || id || '_section_0', 'section for ' || evidence_id FROM last""",
)
def _(spark, d):
    return ev.context_text_map(fx.annotations(spark, d))


@query(
    "E12_annotation_universe",
    f"""{_ANN}, u AS (SELECT 'evidence' AS what, page_id || '_' || local_id AS value FROM ev UNION ALL SELECT 'title', page_id FROM ev
        UNION ALL SELECT 'context', page_id || '_' || local_id FROM ev) SELECT what, value, count(*) AS n FROM u GROUP BY ALL""",
)
def _(spark, d):
    return ev.annotation_universe(fx.annotations(spark, d)).groupBy("what", "value").agg(F.count(F.lit(1)).alias("n"))
