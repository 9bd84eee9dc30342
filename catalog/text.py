"""Filters, sampling and scalar text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.registry import query
from claimlake.functions import hashing, prompts, text, titles
from claimlake.functions.text import SPACE
from claimlake.functions.words import STOP_WORDS
from claimlake.operators import filters

_ANN = f"WITH {fx.SQL_LINES}, {fx.SQL_ANNOTATIONS}"
_STOPS = "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS) + ")"

# ---------------------------------------------------------------- filters


@query("F1_filter_label", "SELECT doc_id, quality, toxic FROM labels WHERE quality = 1", whole=["quality", "toxic"])
def _(spark, d):
    return filters.filter_label(fx.table(spark, d, "labels"), 1, "quality")


@query("F2_map_labels", f"{_ANN} SELECT id, lower(label) AS label FROM ann WHERE label IN ('SUPPORTS', 'REFUTES')")
def _(spark, d):
    return filters.map_labels(fx.annotations(spark, d).select("id", "label"))


@query("F3_filter_evidence_kind", "SELECT doc_id AS id FROM documents WHERE doc_id % 4 IN (0, 3)")
def _(spark, d):
    return filters.filter_evidence_kind(fx.annotations(spark, d)).select("id")


@query("F4_non_empty_pages", "SELECT page_id, length(html) AS size FROM pages WHERE length(trim(html)) > 0")
def _(spark, d):
    kept = filters.non_empty_pages(fx.table(spark, d, "pages"), "html")
    return kept.select("page_id", F.length("html").alias("size"))


@query(
    "F5_restrict_titles",
    "SELECT doc_id, source FROM documents WHERE source IN (SELECT 'src' || n_nationkey FROM nation WHERE n_regionkey <> 0)",
)
def _(spark, d):
    wanted = fx.table(spark, d, "nation").where("n_regionkey <> 0").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("source"))
    return filters.restrict_titles(fx.table(spark, d, "documents").select("doc_id", "source"), wanted, "source")


@query(
    "F6_valid_pages",
    """SELECT source AS title, min(doc_id) AS first_id FROM documents WHERE doc_id % 9 <> 8 GROUP BY source""",
)
def _(spark, d):
    docs = fx.table(spark, d, "documents")
    # every ninth page has two keys only; the source serves as a title that many pages share
    body = F.when(F.col("doc_id") % 9 == 8, F.to_json(F.struct("source", "text"))).otherwise(F.to_json(F.struct("source", "text", "lang")))
    pages = docs.select("doc_id", F.col("source").alias("title"), body.alias("data"))
    return filters.valid_pages(pages, "title", ["doc_id"]).select("title", F.col("doc_id").alias("first_id"))


@query("F8_drop_incomplete", "SELECT doc_id FROM documents WHERE length(trim(lang)) > 0 AND length(" + fx.sql_strip("text") + ") > 0")
def _(spark, d):
    return filters.drop_incomplete(fx.table(spark, d, "documents"), ["lang", "text"]).select("doc_id")


@query("F9_keep_columns", "SELECT c_custkey, c_name FROM customer")
def _(spark, d):
    return filters.keep_columns(fx.table(spark, d, "customer"), ["c_custkey", "c_name", "evidence"])


@query("F10_head", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100")
def _(spark, d):
    return filters.head(fx.table(spark, d, "documents").select("doc_id", "source"), 100, ["doc_id"])


@query("F11_sample_fewshot", "SELECT doc_id AS id FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 8")
def _(spark, d):
    return filters.sample_fewshot(fx.table(spark, d, "documents").select(F.col("doc_id").alias("id")), 8, 7)


# ---------------------------------------------------------------- text functions


@query("T1_normalize_title")
def _(spark, d):
    docs = fx.table(spark, d, "documents")
    return docs.select("doc_id", titles.normalize_title("text").alias("title"), titles.normalize_title("text", False).alias("plain"))


@query(
    "T1_normalize_title_ascii",
    "SELECT o_orderkey, upper(substr(lower(o_orderpriority), 1, 1)) || substr(lower(o_orderpriority), 2) AS title FROM orders",
)
def _(spark, d):
    return fx.table(spark, d, "orders").select("o_orderkey", titles.normalize_title(F.lower("o_orderpriority")).alias("title"))


@query(
    "T2_wiki_id",
    f"""WITH {fx.SQL_DOCUMENTS} SELECT id, regexp_replace(id, '_0$', '') AS title, split_part('a_0b' || id, '_0', 1) AS first_cut,
              'x_' || original_title AS made FROM docs""",
)
def _(spark, d):
    return fx.documents(spark, d).select(
        "id",
        titles.title_of("id").alias("title"),
        titles.title_of(F.concat(F.lit("a_0b"), F.col("id")), compat=True).alias("first_cut"),
        titles.wiki_id(F.lit("x"), F.col("original_title")).alias("made"),
    )


@query(
    "T3_extract_links",
    """SELECT page_id, unnest(range(len(l))) AS pos, unnest(list_transform(l, lambda x: upper(substr(url_decode(x), 1, 1)) || substr(url_decode(x), 2))) AS link
       FROM (SELECT page_id, regexp_extract_all(html, 'href=[''"]?([^''" >]+)', 1) AS l FROM pages)""",
)
def _(spark, d):
    pages = fx.table(spark, d, "pages")
    return pages.select("page_id", F.posexplode(text.extract_links("html")).alias("pos", "link"))


@query("T4_strip_tags", "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS text FROM pages")
def _(spark, d):
    return fx.table(spark, d, "pages").select("page_id", text.strip_tags("html").alias("text"))


@query(
    "T5_clean_title",
    "SELECT page_id, regexp_replace(trim(url_decode('see ' || url)), '(?:https?://|www\\.)[^\\s<>]+', '<URL>', 'g') AS title FROM pages",
)
def _(spark, d):
    return fx.table(spark, d, "pages").select("page_id", titles.clean_title(F.concat(F.lit("see "), F.col("url"))).alias("title"))


@query("T6_process_text", f"SELECT doc_id, {fx.sql_text('text')} AS text FROM documents")
def _(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", text.process_text("text").alias("text"))


@query(
    "T7_is_stop_token",
    f"""SELECT doc_id, count(*) AS n, CAST(sum(CASE WHEN regexp_matches(t, '\\A\\p{{P}}+\\z') OR lower(t) IN {_STOPS} THEN 1 ELSE 0 END) AS BIGINT) AS stops
        FROM (SELECT doc_id, unnest({fx.sql_words('text')}) AS t FROM documents) GROUP BY doc_id
        UNION ALL SELECT doc_id, 0, 0 FROM documents WHERE len({fx.sql_words('text')}) = 0""",
)
def _(spark, d):
    tokens = fx.table(spark, d, "documents").select("doc_id", text.words("text").alias("w"))
    stops = F.size(F.filter("w", text.is_stop_token))
    return tokens.select("doc_id", F.size("w").alias("n"), stops.alias("stops"))


_STOP = f"regexp_matches(t, '\\A\\p{{P}}+\\z') OR lower(t) IN {_STOPS}"


@query(
    "T8_drop_ngram",
    f"""WITH g AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS gram FROM (
            SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT doc_id, {fx.sql_words('text')} AS w FROM documents))),
        f AS (SELECT doc_id, list_transform(gram, lambda t: {_STOP}) AS s FROM g)
        SELECT doc_id, count(*) AS n, count_if(s[1] OR s[2] OR s[3]) AS any_stop, count_if(s[1] AND s[2] AND s[3]) AS all_stop,
               count_if(s[1] OR s[3]) AS end_stop FROM f GROUP BY doc_id
        UNION ALL SELECT doc_id, 0, 0, 0, 0 FROM documents WHERE len({fx.sql_words('text')}) < 3""",
    whole=["any_stop", "all_stop", "end_stop"],
)
def _(spark, d):
    w = fx.table(spark, d, "documents").select("doc_id", text.words("text").alias("w"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: F.slice("w", i, F.lit(3)))
    g = w.select("doc_id", F.explode_outer(F.filter(grams, lambda g: F.size(g) == 3)).alias("g"))
    return g.groupBy("doc_id").agg(
        F.count("g").alias("n"),
        *[F.count_if(text.drop_ngram("g", mode)).alias(name) for mode, name in (("any", "any_stop"), ("all", "all_stop"), ("ends", "end_stop"))],
    )


@query(
    "T9_token_bucket",
    f"""WITH w AS (SELECT unnest({fx.sql_words('text')}) AS token FROM documents), g AS (SELECT token, count(*) AS n, hex(token) AS h FROM w GROUP BY token)
        SELECT token, n, CAST({fx.sql_murmur3('h', '(length(h) // 2)')} % 1048576 AS INTEGER) AS bucket FROM g""",
)
def _(spark, d):
    words = fx.table(spark, d, "documents").select(F.explode(text.words("text")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return words.select("token", "n", hashing.token_bucket("token", 2**20).alias("bucket"))


@query("T10_get_path", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(spark, d):
    return fx.table(spark, d, "events").select("event_id", text.get_path("props", ["k"]).alias("k"))


_ONE_BLANK = f"regexp_replace(text, '{SPACE}+', ' ', 'g')"


@query("T11_squeeze", f"SELECT doc_id, {fx.sql_strip(_ONE_BLANK)} AS text FROM documents")
def _(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", text.squeeze("text").alias("text"))


@query(
    "T12_is_number_text",
    """SELECT event_id, regexp_matches(v, '\\A[0-9]*\\.?[0-9]*\\z') AND regexp_matches(v, '[0-9]') AS number
       FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(event_id AS VARCHAR) || '.5' WHEN 1 THEN event_type ELSE '.' || user_id || '.' END AS v FROM events)""",
)
def _(spark, d):
    e = fx.table(spark, d, "events")
    v = F.when(F.col("event_id") % 3 == 0, F.concat(F.col("event_id").cast("string"), F.lit(".5")))
    v = v.when(F.col("event_id") % 3 == 1, F.col("event_type")).otherwise(F.concat(F.lit("."), F.col("user_id").cast("string"), F.lit(".")))
    return e.select("event_id", text.is_number_text(v).alias("number"))


def _sql_tag(c: str) -> str:
    start, end = f"strpos({c}, '<answer>')", f"strpos({c}, '</answer>')"
    inner = f"substr({c}, {start} + 8, greatest({end} - {start} - 8, 0))"
    return f"CASE WHEN {start} > 0 AND {end} > 0 THEN {fx.sql_strip(inner)} ELSE {c} END"


@query("T13_extract_tag", f"WITH {fx.SQL_COMPLETIONS} SELECT id, {_sql_tag('completion')} AS answer FROM completions")
def _(spark, d):
    return fx.completions(spark, d).select("id", text.extract_tag("completion").alias("answer"))


_RATIONALE = """CASE conv_id % 4 WHEN 0 THEN text || ' The final answer: ' || role || '. final answer: x.' WHEN 1 THEN 'So the answer is ' || text || '.'
    WHEN 2 THEN 'the final answer is ' || role || '. ' ELSE text END"""


@query(
    "T14_answer_from_rationale",
    f"""WITH r AS (SELECT conv_id, turn, {_RATIONALE} AS t FROM conversations),
        cut AS (SELECT *, CASE WHEN contains(t, 'the final answer is') THEN 'the final answer is' WHEN contains(t, 'the answer is') THEN 'the answer is'
                WHEN contains(t, 'final answer:') THEN 'final answer:' END AS cue FROM r)
        SELECT conv_id, turn, CASE WHEN cue IS NOT NULL THEN regexp_replace({fx.sql_strip("string_split(t, cue)[-1]")}, '\\.\\z', '') END AS answer FROM cut""",
)
def _(spark, d):
    c = fx.table(spark, d, "conversations")
    name = lambda *p: F.concat(*[F.lit(x[1:]) if x.startswith("=") else F.col(x) for x in p])
    rationale = (
        F.when(F.col("conv_id") % 4 == 0, name("text", "= The final answer: ", "role", "=. final answer: x."))
        .when(F.col("conv_id") % 4 == 1, name("=So the answer is ", "text", "=."))
        .when(F.col("conv_id") % 4 == 2, name("=the final answer is ", "role", "=. "))
        .otherwise(F.col("text"))
    )
    return c.select("conv_id", "turn", text.answer_from_rationale(rationale).alias("answer"))


@query(
    "T15_parse_evidence_id",
    f"""{_ANN} SELECT id, set_no, pos, page_id AS page, kind, local_id,
           CAST(regexp_extract(local_id, '([0-9]+)', 1) AS BIGINT) AS i1,
           CAST(nullif(regexp_extract(local_id, '[0-9]+_([0-9]+)', 1), '') AS BIGINT) AS i2 FROM ev""",
    whole=["set_no"],
)
def _(spark, d):
    sets = fx.annotations(spark, d).select("id", F.posexplode("evidence").alias("set_no", "s"))
    ids = sets.select("id", "set_no", F.posexplode("s.content").alias("pos", "e"))
    return ids.select("id", "set_no", "pos", titles.parse_evidence_id("e").alias("p")).select(
        "id", "set_no", "pos", "p.page", "p.kind", "p.local_id", "p.i1", "p.i2"
    )


@query(
    "T16_truncate_tokens",
    f"""SELECT doc_id, CASE WHEN len(w) > 50 THEN array_to_string(w[1:50], ' ') ELSE text END AS text
        FROM (SELECT doc_id, text, {fx.sql_words('text')} AS w FROM documents)""",
)
def _(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", text.truncate_tokens("text", 50).alias("text"))


@query(
    "T17_answer_to_bool",
    f"""WITH {fx.SQL_PROGRAMS} SELECT id, program, step, CASE lower(trim(answer_text)) WHEN 'true' THEN true WHEN 'yes' THEN true WHEN 'false' THEN false
        WHEN 'no' THEN false WHEN 'it''s impossible to say' THEN false END AS truth FROM answers""",
    whole=["step"],
)
def _(spark, d):
    return fx.answers(spark, d).select("id", "program", "step", text.answer_to_bool("answer_text").alias("truth"))


@query(
    "T18_question_prompts",
    f"""WITH {fx.SQL_PAIRS} SELECT id,
          gold_evidence || chr(10) || 'Based on the above information, is it true that ' || regexp_replace(mutated, '\\.\\z', '') || '? True or false? The answer is: ' AS verify,
          'Is it true that ' || regexp_replace(mutated, '\\.\\z', '') || '? True or false? The answer is: ' AS verify_closed,
          gold_evidence || chr(10) || 'Question: ' || mutated || chr(10) || 'The answer is:' AS question,
          'Question: ' || mutated || chr(10) || 'The answer is:' AS question_closed,
          'Answer the following question by reasoning step-by-step.' || chr(10) || 'Q: ' || mutated AS rationale FROM pairs""",
)
def _(spark, d):
    return fx.pairs(spark, d).select(
        "id",
        prompts.verify_prompt("mutated", "gold_evidence").alias("verify"),
        prompts.verify_prompt("mutated", claim_only=True).alias("verify_closed"),
        prompts.question_prompt("mutated", "gold_evidence").alias("question"),
        prompts.question_prompt("mutated", claim_only=True).alias("question_closed"),
        prompts.rationale_prompt("mutated").alias("rationale"),
    )


@query(
    "T19_correction_prompt",
    f"WITH {fx.SQL_PAIRS} SELECT id, {fx.sql_strip('mutated')} AS claim, {fx.sql_strip('gold_evidence')} AS evidence FROM pairs",
)
def _(spark, d):
    rows = fx.pairs(spark, d)
    back = rows.select("id", prompts.parse_prompt(prompts.correction_prompt("mutated", "gold_evidence", "tagged"), "tagged").alias("p"))
    return back.select("id", "p.claim", "p.evidence")


@query(
    "T19_correction_prompt_expert",
    f"WITH {fx.SQL_PAIRS} SELECT id, {fx.sql_strip('mutated')} AS claim, {fx.sql_strip('gold_evidence')} AS evidence FROM pairs",
)
def _(spark, d):
    rows = fx.pairs(spark, d)
    back = rows.select("id", prompts.parse_prompt(prompts.correction_prompt("mutated", "gold_evidence", "expert"), "expert").alias("p"))
    return back.select("id", "p.claim", "p.evidence")


@query(
    "T19_correction_prompt_brief",
    f"""WITH {fx.SQL_PAIRS} SELECT id, 'mutation:''' || mutated || '''' || chr(10) || chr(10) || 'evidence:''' || gold_evidence || '''' || chr(10) || chr(10) AS prompt
        FROM pairs""",
)
def _(spark, d):
    return fx.pairs(spark, d).select("id", prompts.correction_prompt("mutated", "gold_evidence", "brief").alias("prompt"))
