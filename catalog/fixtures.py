"""Inputs of the operators, shaped from the given tables, and the same inputs as SQL.

Pages, annotations, programs and the rest are made row by row from whole tables, so their size follows the
tables. The SQL pieces rebuild the same rows for DuckDB. ``cache`` keeps the unevaluated DataFrame of a session,
not its rows.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.functions.text import JVM_SPACE, SPACE
from claimlake.operators.pages import parse_pages
from claimlake.session import use_all_cores


@cache
def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/{name}.parquet")
    return use_all_cores(rows) if name == "documents" else rows


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '\\A{SPACE}+|{SPACE}+\\z', '', 'g')"


def sql_text(x: str) -> str:
    return sql_strip(f"replace({x}, chr(10), ' ')")


def sql_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{SPACE}+'), lambda t: t <> '')"


def sql_terms(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def sql_murmur3(hexed: str, n: str, seed: int = 0, signed_rest: bool = False) -> str:
    """MurmurHash3 of bytes in hex ``hexed``, ``n`` of them. With ``signed_rest`` the bytes of a rest are stirred in one by
    one as signed numbers, as Spark's own hash does; else the rest is mixed in as one number."""
    digit = lambda at: f"(strpos('0123456789ABCDEF', substr({hexed}, {at}, 1)) - 1)"
    byte = lambda i: f"(CASE WHEN {i} < {n} THEN {digit(f'2 * ({i}) + 1')} * 16 + {digit(f'2 * ({i}) + 2')} ELSE 0 END)"
    word = lambda i: " + ".join(f"{byte(f'4 * {i} + {k}')} * {256**k}" for k in range(4))
    low = "4294967296"
    turned = lambda x, by: f"((({x}) << {by}) % {low} | (({x}) >> {32 - by}))"
    scaled = lambda x, f: f"((({x})::UHUGEINT * {f}) % {low})::UBIGINT"
    mixed = lambda k: scaled(turned(scaled(k, 0xCC9E2D51), 15), 0x1B873593)
    stirred = lambda h, k: scaled(turned(f"xor({h}, {mixed(k)})", 13), 5) + f" + {0xE6546B64}"
    words = f"list_transform(range(0, {n} // 4), lambda i: ({word('i')})::UBIGINT)"
    if signed_rest:
        byte_value = byte("i")
        rest = f"list_transform(range({n} // 4 * 4, {n}), lambda i: (CASE WHEN {byte_value} > 127 THEN {byte_value} + {0xFFFFFF00} ELSE {byte_value} END)::UBIGINT)"
        words = f"list_concat({words}, {rest})"
    body = f"list_reduce(list_prepend({seed}::UBIGINT, {words}), lambda h, k: (({stirred('h', 'k')}) % {low})::UBIGINT)"
    if not signed_rest:
        body = f"xor({body}, {mixed(f'({word(f'({n} // 4)')})::UBIGINT')})"
    h = f"xor({body}, {n}::UBIGINT)"
    steps = f"list_reduce([{h}, 16, 13, 0], lambda h, k: CASE k WHEN 16 THEN {scaled('xor(h, h >> 16)', 0x85EBCA6B)} WHEN 13 THEN {scaled('xor(h, h >> 13)', 0xC2B2AE35)} ELSE xor(h, h >> 16) END)"
    return steps


def sql_coin(*parts: str) -> str:
    return f"(strpos('02468ace', substr(md5(concat_ws(':', {', '.join(parts)})), 1, 1)) > 0)"


# ---------------------------------------------------------------- documents and claims


@cache
def documents(spark: SparkSession, d: str) -> DataFrame:
    """``(id, text, links, original_title)``; links are the language and the source of the text."""
    return table(spark, d, "documents").select(
        F.concat(F.lit("Page "), F.col("doc_id").cast("string"), F.lit("_0")).alias("id"),
        "text",
        F.array(F.concat(F.lit("Page "), F.pmod(F.col("doc_id") * 7, F.lit(1200)).cast("string")), F.initcap("source")).alias("links"),
        F.concat(F.lit("page "), F.col("doc_id").cast("string")).alias("original_title"),
    )


SQL_DOCUMENTS = """docs AS (
    SELECT 'Page ' || doc_id || '_0' AS id, text,
           ['Page ' || ((doc_id * 7) % 1200), upper(substr(source, 1, 1)) || substr(source, 2)] AS links,
           'page ' || doc_id AS original_title
    FROM documents)"""


@cache
def corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("contents"))


@cache
def claims(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# ---------------------------------------------------------------- pages

# Every 5th line of a document is a section, the others are sentences. A table lists the lines with their
# word counts (sections span its three columns), a list has them as items on two levels. Some pages have an
# empty or a malformed table or list.


def _json_text(c: Column) -> Column:
    quoted = F.to_json(F.array(c))
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def _is_section(n: Column) -> Column:
    return n % 5 == 4


def _key(n: Column) -> Column:
    return F.when(_is_section(n), F.concat(F.lit("section_"), F.floor(n / 5).cast("string"))).otherwise(
        F.concat(F.lit("sentence_"), n.cast("string"))
    )


@cache
def pages(spark: SparkSession, d: str) -> DataFrame:
    """Page table ``(page_id, data)`` of all documents."""
    doc = table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("Page "), F.col("doc_id").cast("string")).alias("page_id"), "source", "lang", F.split("text", "\n").alias("lines")
    )
    rule = F.col("doc_id") % 7
    name = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    cell = lambda id_, value, header, cols: F.struct(
        id_.alias("id"), value.alias("value"), F.lit(header).alias("is_header"), F.lit(cols).alias("column_span"), F.lit("1").alias("row_span")
    )
    head = F.array(*[cell(F.lit(f"header_cell_0_0_{j}"), F.lit(v), True, "1") for j, v in enumerate(("line", "words", "text"))])
    count = lambda line: F.size(F.filter(F.split(line, f"{JVM_SPACE}+"), lambda t: t != "")).cast("string")
    row = lambda line, n: F.when(_is_section(n), F.array(cell(name("header_cell_0_", n + 1, "_0"), line, True, "3"))).otherwise(
        F.array(
            cell(name("header_cell_0_", n + 1, "_0"), n.cast("string"), True, "1"),
            cell(name("cell_0_", n + 1, "_1"), count(line), False, "1"),
            cell(name("cell_0_", n + 1, "_2"), line, False, "1"),
        )
    )
    good = F.concat(F.array(head), F.transform("lines", row))
    extra = F.array(F.array(*[cell(F.lit(f"cell_0_x_{j}"), F.lit("x"), False, "1") for j in range(4)]))
    rows = F.when(rule == 3, F.concat(good, extra)).when(rule == 5, F.slice(good, 1, 0)).otherwise(good)
    tab = F.to_json(F.struct(F.lit("table").alias("type"), F.col("source").alias("caption"), rows.alias("table")))
    entry = lambda line, n: F.struct(
        name("item_0_", n).alias("id"),
        line.alias("value"),
        F.when(rule == 1, -1).when(n % 3 == 2, 1).otherwise(0).alias("level"),
        F.when(n % 3 != 2, "unordered_list").alias("type"),
    )
    entries = F.transform("lines", entry)
    kind = F.when(F.col("doc_id") % 2 == 0, "unordered_list").otherwise("ordered_list")
    lst = F.to_json(F.struct(kind.alias("type"), F.when(rule == 6, F.slice(entries, 1, 0)).otherwise(entries).alias("list")))
    body = F.transform(
        "lines",
        lambda line, n: F.concat(
            F.lit('"'),
            _key(n),
            F.lit('":'),
            F.when(_is_section(n), name('{"value":', _json_text(line), ',"level":', 1 + n % 3, "}")).otherwise(_json_text(line)),
        ),
    )
    order = F.to_json(F.concat(F.transform("lines", lambda line, n: _key(n)), F.array(F.lit("table_0"), F.lit("list_0"))))
    members = F.concat_ws(
        ",",
        F.concat(F.lit('"title":'), _json_text(F.col("page_id"))),
        F.concat(F.lit('"order":'), order),
        F.array_join(body, ","),
        F.concat(F.lit('"table_0":'), tab),
        F.concat(F.lit('"list_0":'), lst),
        F.concat(F.lit('"sentence_unlisted":'), _json_text(F.col("lang"))),
    )
    return doc.select("page_id", F.concat(F.lit("{"), members, F.lit("}")).alias("data"))


@cache
def parsed(spark: SparkSession, d: str) -> DataFrame:
    return parse_pages(pages(spark, d))


SQL_LINES = """lines AS (
    SELECT doc_id, 'Page ' || doc_id AS page_id, source, lang, unnest(l) AS line, unnest(range(len(l))) AS n, len(l) AS n_lines
    FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents))"""

# el: page elements of the order; tab: grid slots; items: list entries
SQL_PAGE = (
    SQL_LINES
    + f""", lines_el AS (
    SELECT doc_id, page_id, n AS pos, line, n,
           CASE WHEN n % 5 = 4 THEN 'section_' || (n // 5) ELSE 'sentence_' || n END AS key,
           CASE WHEN n % 5 = 4 THEN 'section' ELSE 'sentence' END AS kind,
           CASE WHEN n % 5 = 4 THEN line ELSE {sql_text('line')} END AS text,
           CASE WHEN n % 5 = 4 THEN 1 + n % 3 END AS level
    FROM lines),
slots AS (
    SELECT doc_id, page_id, 0 AS row, unnest([0, 1, 2]) AS col, unnest(['line', 'words', 'text']) AS value, true AS is_header,
           'header_cell_0_0_' || unnest([0, 1, 2]) AS cell_id, true AS is_last
    FROM lines WHERE n = 0
    UNION ALL
    SELECT doc_id, page_id, n + 1, unnest([0, 1, 2]), {sql_text('line')}, true, 'header_cell_0_' || (n + 1) || '_0', unnest([false, false, true])
    FROM lines WHERE n % 5 = 4
    UNION ALL
    SELECT doc_id, page_id, n + 1, unnest([0, 1, 2]),
           unnest([CAST(n AS VARCHAR), CAST(len({sql_words('line')}) AS VARCHAR), {sql_text('line')}]), unnest([true, false, false]),
           unnest(['header_cell_0_' || (n + 1) || '_0', 'cell_0_' || (n + 1) || '_1', 'cell_0_' || (n + 1) || '_2']), true
    FROM lines WHERE n % 5 <> 4),
tab AS (SELECT *, CASE WHEN is_header THEN '[H] ' || value ELSE value END AS text FROM slots WHERE doc_id % 7 NOT IN (3, 5)),
items AS (
    SELECT *, CASE WHEN n % 3 = 2 THEN 1 ELSE 0 END AS level, 'item_0_' || n AS item_id, {sql_text('line')} AS value
    FROM lines
    WHERE doc_id % 7 NOT IN (1, 6)
      AND doc_id IN (SELECT doc_id FROM lines GROUP BY doc_id HAVING bool_or(line <> ''))),
marked AS (
    SELECT *, CASE WHEN level = 1 OR doc_id % 2 = 0 THEN '- '
              ELSE row_number() OVER (PARTITION BY doc_id, level ORDER BY n) || '. ' END AS mark
    FROM items),
shown_items AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS line_no FROM marked WHERE line <> ''),
table_text AS (
    SELECT doc_id, page_id, string_agg(text, chr(10) ORDER BY row) AS text
    FROM (SELECT doc_id, page_id, row, string_agg(text, ' | ' ORDER BY col) AS text FROM tab GROUP BY ALL) GROUP BY ALL),
list_text AS (
    SELECT doc_id, page_id, string_agg(repeat('[SUB] ', level) || mark || value, chr(10) ORDER BY n) AS text
    FROM shown_items GROUP BY ALL),
sizes AS (SELECT doc_id, page_id, count(*) AS n_lines FROM lines GROUP BY ALL),
el AS (
    SELECT doc_id, page_id, key, kind, pos, text, level FROM lines_el
    UNION ALL
    SELECT s.doc_id, s.page_id, 'table_0', 'table', s.n_lines, t.text, NULL FROM sizes s JOIN table_text t USING (doc_id)
    UNION ALL
    SELECT s.doc_id, s.page_id, 'list_0', 'list', s.n_lines + CASE WHEN t.doc_id IS NULL THEN 0 ELSE 1 END, {sql_text('l.text')}, NULL
    FROM sizes s JOIN list_text l USING (doc_id) LEFT JOIN table_text t USING (doc_id))"""
)

# Sections around a position: going back, the nearest one, then each that is less deep than the last taken,
# until a deeper one comes. Written as a recursion over the sections of a page.
SQL_CHAIN = """secs AS (
    SELECT doc_id, key, pos, text, level, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM lines_el WHERE kind = 'section'),
places AS (SELECT e.doc_id, e.page_id, e.key, e.pos, (SELECT max(s.k) FROM secs s WHERE s.doc_id = e.doc_id AND s.pos < e.pos) AS k FROM el e),
walk AS (
    SELECT p.doc_id, p.page_id, p.key, s.k, s.level AS last_level, true AS taken, 0 AS depth, s.key AS section_key, s.text AS section_text
    FROM places p JOIN secs s ON s.doc_id = p.doc_id AND s.k = p.k
    UNION ALL
    SELECT w.doc_id, w.page_id, w.key, s.k, least(w.last_level, s.level), s.level < w.last_level,
           w.depth + CASE WHEN s.level < w.last_level THEN 1 ELSE 0 END, s.key, s.text
    FROM walk w JOIN secs s ON s.doc_id = w.doc_id AND s.k = w.k - 1 AND s.level <= w.last_level),
chain AS (SELECT doc_id, page_id, key, depth, section_key, section_text, last_level AS level FROM walk WHERE taken)"""


# ---------------------------------------------------------------- annotations


@cache
def annotations(spark: SparkSession, d: str) -> DataFrame:
    """One annotation per document: its sentences, its table cells, two mixed sets over two pages, or none."""
    doc = table(spark, d, "documents").select("doc_id", "source", "lang", F.split("text", "\n").alias("lines"))
    own = F.concat(F.lit("Page "), F.col("doc_id").cast("string"))
    other = F.concat(F.lit("Page "), (F.col("doc_id") + 1).cast("string"))
    numbers = F.filter(F.transform("lines", lambda line, n: n), lambda n: ~_is_section(n))
    ids = lambda page, part, add=0, end="": F.transform(
        numbers, lambda n: F.concat(page, F.lit(part), (n + add).cast("string"), F.lit(end))
    )
    sentences = ids(own, "_sentence_")
    cells = F.concat(ids(own, "_cell_0_", 1, "_1"), F.array(F.concat(own, F.lit("_table_caption_0"))))
    mixed = F.concat(sentences, ids(other, "_sentence_"))
    items = ids(own, "_item_0_")

    def one_set(content: Column) -> Column:
        context_ids = F.array(F.concat(own, F.lit("_title")), F.concat(own, F.lit("_section_0")))
        return F.struct(
            content.alias("content"),
            F.map_from_entries(F.transform(content, lambda e: F.struct(e, context_ids))).alias("context"),
            F.transform(content, lambda e: F.concat(F.lit("text of "), e)).alias("text"),
            F.map_from_entries(
                F.transform(content, lambda e: F.struct(e, F.array(F.concat(F.lit("title for "), e), F.concat(F.lit("section for "), e))))
            ).alias("context_text"),
        )

    rule = F.col("doc_id") % 4
    evidence = (
        F.when(rule == 0, F.array(one_set(sentences)))
        .when(rule == 1, F.array(one_set(cells)))
        .when(rule == 2, F.array(one_set(mixed), one_set(items)))
        .otherwise(F.array(one_set(F.array().cast("array<string>"))))
    )
    label = F.element_at(F.array(F.lit("SUPPORTS"), F.lit("REFUTES"), F.lit("NOT ENOUGH INFO")), (F.col("doc_id") % 3 + 1).cast("int"))
    return doc.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("Text "), F.col("doc_id").cast("string"), F.lit(" comes from "), F.col("source"), F.lit(".")).alias("claim"),
        label.alias("label"),
        F.col("lang").alias("challenge"),
        evidence.alias("evidence"),
        sentences.alias("predicted_evidence"),
        F.array(*[F.struct(F.lit(op).alias("operation"), value.alias("value"), F.lit("1").alias("time")) for op, value in (("search", F.col("lang")), ("open", own))]).alias(
            "annotator_operations"
        ),
    )


SQL_ANNOTATIONS = """ann AS (
    SELECT doc_id AS id, 'Text ' || doc_id || ' comes from ' || source || '.' AS claim,
           ['SUPPORTS', 'REFUTES', 'NOT ENOUGH INFO'][doc_id % 3 + 1] AS label, lang AS challenge
    FROM documents),
nums AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS m FROM lines WHERE n % 5 <> 4),
ev AS (
    SELECT doc_id AS id, 0 AS set_no, k AS pos, page_id, 'sentence_' || n AS local_id, 'sentence' AS kind FROM nums WHERE doc_id % 4 IN (0, 2)
    UNION ALL
    SELECT doc_id, 0, k, page_id, 'cell_0_' || (n + 1) || '_1', 'cell' FROM nums WHERE doc_id % 4 = 1
    UNION ALL
    SELECT doc_id, 0, any_value(m), page_id, 'table_caption_0', 'table_caption' FROM nums WHERE doc_id % 4 = 1 GROUP BY doc_id, page_id
    UNION ALL
    SELECT doc_id, 0, m + k, 'Page ' || (doc_id + 1), 'sentence_' || n, 'sentence' FROM nums WHERE doc_id % 4 = 2
    UNION ALL
    SELECT doc_id, 1, k, page_id, 'item_0_' || n, 'item' FROM nums WHERE doc_id % 4 = 2)"""


# ---------------------------------------------------------------- programs

# Four shapes of program: two facts; a question whose answer goes into a fact; a prediction that is not last;
# a truth value put into a text together with an unknown name.


@cache
def samples(spark: SparkSession, d: str) -> DataFrame:
    """Program samples ``(id, claim, gold, predicted_programs, evidence)``, one to three programs each."""
    doc = table(spark, d, "documents")
    name = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    i, source, lang = F.col("doc_id"), F.col("source"), F.col("lang")
    shapes = F.array(
        F.array(
            name('fact_1 = Verify("Text ', i, " comes from ", source, '.")'),
            name('fact_2 = Verify("Text ', i, " is written in ", lang, '.")'),
            F.lit("label = Predict(fact_1 and fact_2)"),
        ),
        F.array(
            name('answer_1 = Question("Where does text ', i, ' come from?")'),
            name('fact_1 = Verify(f"Text ', i, ' comes from {answer_1}.")'),
            F.lit("label = Predict(fact_1 and answer_1)"),
        ),
        F.array(
            name('fact_1 = Verify("Text ', i, " comes from ", source, '.")'),
            F.lit("label = Predict(fact_1)"),
            name('fact_2 = Verify("Text ', i, ' comes late.")'),
        ),
        F.array(
            name('fact_1 = Verify("Text ', i, ' exists.")'),
            F.lit('fact_2 = Verify(f"It is {fact_1} that it exists.")'),
            F.lit("label = Predict(fact_1 and nobody)"),
        ),
    )
    numbers = F.sequence(F.lit(0), (i % 3).cast("int"))
    programs = F.transform(numbers, lambda p: F.get(shapes, F.pmod(i + p, F.lit(4)).cast("int")))
    return doc.select(
        i.alias("id"),
        name("Text ", i, " comes from ", source, ".").alias("claim"),
        F.when(i % 2 == 0, "supports").otherwise("refutes").alias("gold"),
        programs.alias("predicted_programs"),
        F.col("text").alias("evidence"),
    )


@cache
def answers(spark: SparkSession, d: str) -> DataFrame:
    """An answer for every step of every program, a few of them unusable."""
    doc = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source")
    rows = doc.select("id", "source", F.explode(F.sequence(F.lit(0), (F.col("id") % 3).cast("int"))).alias("program"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("step"))
    words = F.array(*[F.lit(w) for w in ("true", "False", "Yes, sure", "no", "It's impossible to say", " TRUE ")])
    word = F.element_at(words, ((F.col("id") * 7 + F.col("program") * 3 + F.col("step")) % 6 + 1).cast("int"))
    asked = ((F.col("id") + F.col("program")) % 4 == 1) & (F.col("step") == 0)
    return rows.select("id", "program", "step", F.when(asked, F.col("source")).otherwise(word).alias("answer_text"))


SQL_PROGRAMS = f"""prog AS (
    SELECT doc_id AS id, source, lang, unnest(range(doc_id % 3 + 1)) AS program FROM documents),
shaped AS (SELECT *, (id + program) % 4 AS shape FROM prog),
said AS (
    SELECT *, unnest([0, 1, 2]) AS step FROM shaped),
answers AS (
    SELECT id, source, program, shape, step,
           CASE WHEN shape = 1 AND step = 0 THEN source
                ELSE ['true', 'False', 'Yes, sure', 'no', 'It''s impossible to say', ' TRUE '][(id * 7 + program * 3 + step) % 6 + 1] END AS answer_text
    FROM said),
truths AS (
    SELECT *, CASE lower(trim(answer_text)) WHEN 'true' THEN true WHEN 'yes' THEN true WHEN 'false' THEN false WHEN 'no' THEN false
              WHEN 'it''s impossible to say' THEN false ELSE {sql_coin("'0'", "id", "program", "step")} END AS b
    FROM answers),
verdicts AS (
    SELECT id, program, shape,
           CASE shape WHEN 0 THEN bool_and(b) FILTER (step IN (0, 1)) WHEN 1 THEN bool_and(b) FILTER (step = 1)
                      WHEN 3 THEN {sql_coin("'0'", "id", "program", "'run'")} END AS verdict
    FROM truths GROUP BY id, program, shape),
votes AS (
    SELECT id, CASE WHEN count_if(verdict) > count_if(NOT verdict) THEN 'supports' ELSE 'refutes' END AS prediction
    FROM verdicts GROUP BY id)"""


# ---------------------------------------------------------------- labels, pairs, scores


@cache
def predictions(spark: SparkSession, d: str) -> DataFrame:
    """``(id, gold, prediction)`` from the labels: quality is gold, toxicity says otherwise; some labels are unknown."""
    return table(spark, d, "labels").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("doc_id") % 11 == 5, "unclear").when(F.col("quality") == 1, " supports").otherwise("refutes ").alias("gold"),
        F.when(F.col("doc_id") % 7 == 3, "none").when((F.col("toxic") == 0) != (F.col("doc_id") % 5 == 0), "supports ").otherwise("refutes").alias("prediction"),
    )


@cache
def hops(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), (2 + F.col("doc_id") % 3).alias("num_hops"))


SQL_PREDICTIONS = """pred AS (
    SELECT doc_id AS id, CASE WHEN doc_id % 11 = 5 THEN 'unclear' WHEN quality = 1 THEN 'supports' ELSE 'refutes' END AS gold,
           CASE WHEN doc_id % 7 = 3 THEN 'none' WHEN (toxic = 0) <> (doc_id % 5 = 0) THEN 'supports' ELSE 'refutes' END AS prediction
    FROM labels)"""


@cache
def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Correction pairs: a user turn is the mutated text, the assistant's next turn the original one, the
    first turn of the conversation the evidence."""
    turns = table(spark, d, "conversations")
    user = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("mutated"))
    reply = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("original"))
    first = turns.where("turn = 0").select("conv_id", F.col("text").alias("gold_evidence"))
    rows = user.join(reply, ["conv_id", "turn"]).join(first, "conv_id")
    return rows.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), "conv_id", "turn", "mutated", "original", "gold_evidence",
        F.replace("original", F.lit("e "), F.lit("es ")).alias("prediction"),
    )


SQL_PAIRS = """pairs AS (
    SELECT u.conv_id || '-' || u.turn AS id, u.conv_id, u.turn, u.text AS mutated, a.text AS original, f.text AS gold_evidence,
           replace(a.text, 'e ', 'es ') AS prediction
    FROM conversations u
    JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
    JOIN conversations f ON f.conv_id = u.conv_id AND f.turn = 0
    WHERE u.role = 'user')"""


@cache
def completions(spark: SparkSession, d: str) -> DataFrame:
    """Model outputs for the mutated texts: good ones and every kind of bad one."""
    rows = pairs(spark, d)
    fixed = F.replace("mutated", F.lit("e "), F.lit("es "))
    half = F.substring(F.col("mutated"), F.lit(1), F.floor(F.length("mutated") / 2).cast("int"))
    think, wrap = F.lit("<think>why</think>"), lambda c: F.concat(F.lit("<answer>"), c, F.lit("</answer>"))
    variants = [
        F.concat(think, wrap(fixed)),
        F.concat(wrap(fixed), think),
        F.concat(think, wrap(fixed), wrap(fixed)),
        F.concat(F.lit("So "), think, wrap(fixed)),
        F.concat(think, wrap(F.concat(F.lit("<b>"), fixed, F.lit("</b>")))),
        F.concat(think, wrap(F.col("mutated"))),
        F.concat(think, wrap(half)),
        F.concat(think, F.lit("\n"), wrap(F.concat(F.regexp_replace("mutated", "[aeiou] ", " "), F.lit(" indeed")))),
    ]
    which = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(variants)))
    out = F.lit(None).cast("string")
    for i, v in enumerate(variants):
        out = F.when(which == i, v).otherwise(out)
    return rows.select("id", F.col("mutated").alias("claim"), F.col("gold_evidence").alias("evidence"), out.alias("completion"))


SQL_COMPLETIONS = (
    SQL_PAIRS
    + """, completions AS (
    SELECT id, mutated AS claim, gold_evidence AS evidence,
           CASE (conv_id + turn) % 8
             WHEN 0 THEN '<think>why</think><answer>' || replace(mutated, 'e ', 'es ') || '</answer>'
             WHEN 1 THEN '<answer>' || replace(mutated, 'e ', 'es ') || '</answer><think>why</think>'
             WHEN 2 THEN '<think>why</think><answer>' || replace(mutated, 'e ', 'es ') || '</answer><answer>' || replace(mutated, 'e ', 'es ') || '</answer>'
             WHEN 3 THEN 'So <think>why</think><answer>' || replace(mutated, 'e ', 'es ') || '</answer>'
             WHEN 4 THEN '<think>why</think><answer><b>' || replace(mutated, 'e ', 'es ') || '</b></answer>'
             WHEN 5 THEN '<think>why</think><answer>' || mutated || '</answer>'
             WHEN 6 THEN '<think>why</think><answer>' || substr(mutated, 1, length(mutated) // 2) || '</answer>'
             ELSE '<think>why</think>' || chr(10) || '<answer>' || regexp_replace(mutated, '[aeiou] ', ' ', 'g') || ' indeed</answer>' END AS completion
    FROM pairs),
checked AS (
    SELECT *, CASE (SELECT (id_.a + id_.b) % 8 FROM (SELECT CAST(split_part(id, '-', 1) AS BIGINT) AS a, CAST(split_part(id, '-', 2) AS BIGINT) AS b) id_)
             WHEN 1 THEN 'tags missing or in wrong order' WHEN 2 THEN 'tag not exactly once' WHEN 3 THEN 'text outside tags'
             WHEN 4 THEN 'markup in answer' END AS reason
    FROM completions),
answered AS (
    SELECT *, CASE WHEN reason IS NULL THEN """
    + sql_strip("split_part(split_part(completion, '<answer>', 2), '</answer>', 1)")
    + """ END AS answer FROM checked)"""
)


@cache
def scores(spark: SparkSession, d: str) -> DataFrame:
    """Metric rows: the event type is the model, the value its score, the event id the order."""
    return table(spark, d, "events").select(
        F.col("event_type").alias("model"), F.col("event_id").alias("seq"), F.col("value").alias("score"),
        F.get_json_object("props", "$.k").cast("double").alias("rank_score"),
    )


SQL_SCORES = """scores AS (
    SELECT event_type AS model, event_id AS seq, value AS score, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS rank_score FROM events)"""
