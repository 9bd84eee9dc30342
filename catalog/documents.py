"""Paragraphs, sections, links and corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.registry import query
from claimlake.operators import documents as docs_ops

# Texts of the given documents have single line breaks, so paragraphs are made by doubling them.
_PARAS = f"""WITH {fx.SQL_DOCUMENTS}, parts AS (
    SELECT id, unnest(range(len(p))) AS pos, unnest(p) AS raw
    FROM (SELECT id, string_split(replace(text, chr(10), chr(10) || chr(10)) || '<a href="/x%20' || length(text) || '">link</a>', chr(10) || chr(10)) AS p FROM docs))"""


def _with_paragraphs(spark, d):
    text = F.concat(
        F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit('<a href="/x%20'), F.length("text").cast("string"), F.lit('">link</a>')
    )
    return fx.documents(spark, d).withColumn("text", text)


_LINKS = """array_to_string(list_transform(regexp_extract_all(raw, 'href=[''"]?([^''" >]+)', 1),
    lambda x: upper(substr(url_decode(x), 1, 1)) || substr(url_decode(x), 2)), '|')"""


@query("C1_paragraphs", f"{_PARAS} SELECT id, pos, regexp_replace(raw, '<[^>]+>', '', 'g') AS text, {_LINKS} AS links FROM parts")
def _(spark, d):
    rows = docs_ops.paragraphs(_with_paragraphs(spark, d))
    return rows.withColumn("links", F.array_join("links", "|"))


@query(
    "C2_paragraph_table",
    f"""{_PARAS} SELECT id, regexp_replace(id, '_0$', '') || '_' || (pos - 1) AS paragraph_id, pos - 1 AS pos,
            regexp_replace(raw, '<[^>]+>', '', 'g') AS text, {_LINKS} AS links
        FROM parts WHERE pos > 0 AND regexp_replace(id, '_0$', '') IN (SELECT 'Page ' || item_id FROM benchmark UNION ALL SELECT 'Page ' || c_custkey FROM customer)""",
)
def _(spark, d):
    wanted = fx.table(spark, d, "benchmark").select(F.col("item_id").alias("n")).union(fx.table(spark, d, "customer").select("c_custkey"))
    ids = wanted.select(F.concat(F.lit("Page "), F.col("n").cast("string")).alias("id"))
    return docs_ops.paragraph_table(_with_paragraphs(spark, d), ids).withColumn("links", F.array_join("links", "|"))


@query(
    "C2_missing_documents",
    f"""WITH {fx.SQL_DOCUMENTS} SELECT 'Page ' || c_custkey || '_0' AS id FROM customer WHERE 'Page ' || c_custkey || '_0' NOT IN (SELECT id FROM docs)""",
)
def _(spark, d):
    ids = fx.table(spark, d, "customer").select(F.concat(F.lit("Page "), F.col("c_custkey").cast("string")).alias("id"))
    return docs_ops.missing_documents(fx.documents(spark, d), ids)


# Sectioned texts: line n starts a section when n % 4 = 2; every other such section has a name only.
_SECTIONED = f"""WITH {fx.SQL_LINES}, marked AS (
    SELECT doc_id, n, CASE WHEN n % 8 = 2 THEN 'Section::::Part ' || n || '.' || chr(10) || line || chr(10) || chr(10)
                           WHEN n % 8 = 6 THEN 'Section::::Head ' || n || '.' || chr(10) ELSE line || chr(10) || chr(10) END AS t
    FROM (SELECT doc_id, n, line FROM lines) WHERE true),
full_text AS (SELECT doc_id, string_agg(t, '' ORDER BY n) AS text FROM marked GROUP BY doc_id),
secs AS (SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS sec FROM (SELECT doc_id, string_split(text, 'Section::::') AS s FROM full_text)),
kinds AS (
    SELECT *, string_split(sec, chr(10) || chr(10)) AS paras, strpos(sec, chr(10)) AS nl FROM secs),
typed AS (
    SELECT *, substr(sec, nl + 1) AS body,
           CASE WHEN pos = 0 AND len(paras) > 1 AND length(paras[2]) > 0 THEN 'intro' WHEN length(substr(sec, nl + 1)) = 0 THEN 'parent' ELSE 'child' END AS type
    FROM kinds),
named AS (
    SELECT *, CASE WHEN type = 'intro' THEN 'Introduction' ELSE substr(sec, 1, nl - 1) END AS section_name FROM typed),
par AS (
    SELECT *, last_value(CASE WHEN type <> 'child' THEN section_name END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS up FROM named)"""


@query(
    "C3_sections",
    f"""{_SECTIONED} SELECT doc_id AS id, pos, section_name, type,
          CASE type WHEN 'intro' THEN section_name WHEN 'child' THEN coalesce(up, '') END AS parent_section_name,
          array_to_string(CASE type WHEN 'intro' THEN paras[2:] WHEN 'parent' THEN []
              ELSE list_filter(string_split(body, chr(10) || chr(10)), lambda p: length(p) > 10) END, '|') AS paragraphs FROM par""",
)
def _(spark, d):
    lines = F.split("text", "\n")
    mark = lambda line, n: (
        F.when(n % 8 == 2, F.concat(F.lit("Section::::Part "), n.cast("string"), F.lit(".\n"), line, F.lit("\n\n")))
        .when(n % 8 == 6, F.concat(F.lit("Section::::Head "), n.cast("string"), F.lit(".\n")))
        .otherwise(F.concat(line, F.lit("\n\n")))
    )
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array_join(F.transform(lines, mark), "").alias("text"))
    return docs_ops.sections(docs).withColumn("paragraphs", F.array_join("paragraphs", "|"))


@query(
    "C4_link_edges",
    f"""WITH {fx.SQL_DOCUMENTS} SELECT id AS src_id, unnest([0, 1]) AS pos, unnest(links) AS dst_title FROM docs""",
    whole=["pos"],
)
def _(spark, d):
    return docs_ops.link_edges(fx.documents(spark, d))


@query(
    "C4_linked_documents",
    f"""WITH {fx.SQL_DOCUMENTS}, edges AS (SELECT id AS src_id, unnest([0, 1]) AS pos, unnest(links) AS dst_title FROM docs)
        SELECT e.src_id, e.pos, e.dst_title, t.id AS dst_id FROM edges e LEFT JOIN docs t ON e.dst_title = regexp_replace(t.id, '_0$', '')""",
    whole=["pos"],
)
def _(spark, d):
    docs = fx.documents(spark, d)
    return docs_ops.linked_documents(docs, docs_ops.link_edges(docs))


@query(
    "C5_lookup",
    f"""WITH {fx.SQL_DOCUMENTS}, ids AS (SELECT 'Page ' || c_custkey || '_0' AS id, c_name FROM customer)
        SELECT i.id, i.c_name, t.text, t.original_title, array_to_string(t.links, '|') AS links, t.id IS NOT NULL AS found
        FROM ids i LEFT JOIN docs t ON i.id = t.id""",
)
def _(spark, d):
    ids = fx.table(spark, d, "customer").select(F.concat(F.lit("Page "), F.col("c_custkey").cast("string"), F.lit("_0")).alias("id"), "c_name")
    found = docs_ops.lookup(fx.documents(spark, d), ids, ["text", "original_title", "links"])
    return found.withColumn("links", F.array_join("links", "|"))


@query("C6_corpus_from_documents", f"WITH {fx.SQL_DOCUMENTS} SELECT regexp_replace(id, '_0$', '') AS id, text AS contents FROM docs")
def _(spark, d):
    return docs_ops.corpus_from_documents(fx.documents(spark, d))
