"""Reasoning programs: prompts, parsing, execution in waves, votes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.registry import query
from catalog.retrieval import _ranked
from claimlake.functions.rows import rows_of
from claimlake.operators import programs as pg
from claimlake.plans.verification import verify_claims

_PROG = f"WITH {fx.SQL_PROGRAMS}"

# The commands of the four program shapes, as the fixtures write them.
_STEPS = """cmds AS (
    SELECT id, program, shape, source, lang, step, CASE shape * 10 + step
        WHEN 0 THEN 'fact_1 = Verify("Text ' || id || ' comes from ' || source || '.")'
        WHEN 1 THEN 'fact_2 = Verify("Text ' || id || ' is written in ' || lang || '.")'
        WHEN 2 THEN 'label = Predict(fact_1 and fact_2)'
        WHEN 10 THEN 'answer_1 = Question("Where does text ' || id || ' come from?")'
        WHEN 11 THEN 'fact_1 = Verify(f"Text ' || id || ' comes from {answer_1}.")'
        WHEN 12 THEN 'label = Predict(fact_1 and answer_1)'
        WHEN 20 THEN 'fact_1 = Verify("Text ' || id || ' comes from ' || source || '.")'
        WHEN 21 THEN 'label = Predict(fact_1)'
        WHEN 22 THEN 'fact_2 = Verify("Text ' || id || ' comes late.")'
        WHEN 30 THEN 'fact_1 = Verify("Text ' || id || ' exists.")'
        WHEN 31 THEN 'fact_2 = Verify(f"It is {fact_1} that it exists.")'
        WHEN 32 THEN 'label = Predict(fact_1 and nobody)' END AS command
    FROM said)"""


@query(
    "G1_program_prompts",
    f"""WITH {fx.SQL_LINES}, {fx.SQL_ANNOTATIONS}
        SELECT id, replace('{pg.PROGRAM_TEMPLATES["multi-hop"].replace("'", "''")}', '[[CLAIM]]', claim) AS prompt FROM ann""",
)
def _(spark, d):
    return pg.program_prompts(fx.annotations(spark, d).select("id", "claim"), "multi-hop").select("id", "prompt")


@query(
    "G2_program_lines",
    f"""SELECT doc_id, unnest(range(len(l))) AS n, unnest(l) AS line FROM (
          SELECT doc_id, list_filter(list_transform(string_split(text || chr(10) || '  ', chr(10)), lambda x: {fx.sql_strip('x')}), lambda x: x <> '') AS l FROM documents)""",
)
def _(spark, d):
    text = F.concat("text", F.lit("\n  "))
    return fx.table(spark, d, "documents").select("doc_id", F.posexplode(pg.program_lines(text)).alias("n", "line"))


@query("G3_explode_programs", f"{_PROG}, {_STEPS} SELECT id, program, step, command FROM cmds", whole=["step"])
def _(spark, d):
    return pg.explode_programs(fx.samples(spark, d))


@query(
    "G4_parse_commands",
    f"""{_PROG}, {_STEPS},
        typed AS (SELECT *, CASE WHEN contains(command, 'label = ') THEN 'FINAL' WHEN contains(command, '= Verify') THEN 'VERIFY'
                  WHEN contains(command, '= Question') THEN 'QUESTION' ELSE 'UNKNOWN' END AS type FROM cmds)
        SELECT id, program, step, type, CASE WHEN type <> 'FINAL' THEN trim(split_part(command, ' = ', 1)) END AS var,
               CASE WHEN type <> 'FINAL' THEN regexp_extract(command, '(?s)(?:Verify|Question)\\(f?"(.*)"\\)', 1) END AS text,
               CASE WHEN type = 'FINAL' THEN replace(regexp_extract(command, 'Predict\\((.*)\\)', 1), ' and ', '|') END AS names, CAST(NULL AS VARCHAR) AS alert FROM typed""",
    whole=["step"],
)
def _(spark, d):
    rows = pg.parse_commands(pg.explode_programs(fx.samples(spark, d))).drop("command")
    return rows.withColumn("names", F.array_join("names", "|"))


def _run(spark, d, **options):
    samples = fx.samples(spark, d)
    programs = rows_of(samples, ["id", "evidence"], pg.programs_of(samples), "commands", "program")
    return pg.execute_programs(programs, pg.AnswerTable(fx.answers(spark, d)), **options).verdicts


@query("G5_execute_programs", f"{_PROG} SELECT id, program, verdict FROM verdicts")
def _(spark, d):
    return _run(spark, d).drop("alerts")


@query(
    "G5_alerts",
    f"""{_PROG}, unknown AS (SELECT id, program, step, shape FROM truths
            WHERE lower(trim(answer_text)) NOT IN ('true', 'yes', 'false', 'no', 'it''s impossible to say') AND NOT (shape = 1 AND step = 0)
              AND (shape IN (0, 1) AND step < 2 OR shape = 2 AND step IN (0, 2) OR shape = 3 AND step = 0))
        SELECT v.id, v.program, concat_ws('|', string_agg(CASE WHEN u.step IS NOT NULL THEN 'unknown answer' END, '|'), CASE WHEN v.shape = 3 THEN 'truth value in text' END) AS alerts
        FROM verdicts v LEFT JOIN unknown u USING (id, program) GROUP BY v.id, v.program, v.shape""",
)
def _(spark, d):
    return _run(spark, d).select("id", "program", F.array_join("alerts", "|").alias("alerts"))


@query(
    "G6_final_verdict",
    f"""{_PROG}, facts AS (SELECT id, program, bool_and(b) FILTER (step IN (0, 1)) AS verdict FROM truths GROUP BY ALL)
        SELECT id, program, verdict, 'nobody' AS unknown FROM facts""",
)
def _(spark, d):
    answers = fx.answers(spark, d).where("step < 2")
    truth = F.coalesce(pg.answer_to_bool("answer_text"), pg.parity("0", F.col("id"), F.col("program"), F.col("step")))
    entry = F.struct(F.concat(F.lit("fact_"), (F.col("step") + 1).cast("string")).alias("k"), F.struct(truth.alias("b"), F.lit(None).cast("string").alias("t")).alias("v"))
    rows = answers.groupBy("id", "program").agg(F.map_from_entries(F.collect_list(entry)).alias("vars"))
    names = F.array(F.lit("fact_1"), F.lit("nobody"), F.lit("fact_2"))
    return rows.select(
        "id", "program", pg.final_verdict(names, F.col("vars")).alias("verdict"), F.array_join(pg.unknown_names(names, F.col("vars")), "|").alias("unknown")
    )


@query("G7_vote", f"{_PROG} SELECT id, prediction FROM votes")
def _(spark, d):
    return pg.vote(_run(spark, d))


@query(
    "G8_verify_claims",
    f"""{_PROG} SELECT v.id, 'Text ' || d.doc_id || ' comes from ' || d.source || '.' AS claim,
          CASE WHEN d.doc_id % 2 = 0 THEN 'supports' ELSE 'refutes' END AS gold, v.prediction FROM votes v JOIN documents d ON d.doc_id = v.id""",
)
def _(spark, d):
    return verify_claims(fx.samples(spark, d), pg.AnswerTable(fx.answers(spark, d)), "gold").predictions


# Claims of the benchmark, checked by two programs each with documents found on the way.
def _claim_samples(spark, d):
    claims = fx.table(spark, d, "benchmark")
    fact = lambda c: F.concat(F.lit('fact_1 = Verify("'), c, F.lit('")'))
    simple = F.array(fact(F.col("text")), F.lit("label = Predict(fact_1)"))
    asked = F.array(
        F.concat(F.lit('answer_1 = Question("'), F.col("text"), F.lit('")')), F.lit('fact_1 = Verify(f"{answer_1}")'), F.lit("label = Predict(fact_1)")
    )
    return claims.select(
        F.col("item_id").cast("string").alias("id"), F.col("text").alias("claim"), F.lit("supports").alias("gold"),
        F.array(simple, asked).alias("predicted_programs"),
    )


@query("G8_open_book")
def _(spark, d):
    run = verify_claims(_claim_samples(spark, d), pg.LexicalAnswerer(), "open-book", corpus=fx.corpus(spark, d), analyzer="simple", num_retrieved=3)
    found = run.retrieved.select("id", "program", "step", F.size("log").alias("hits"), F.get("log", F.lit(0))["id"].alias("best"))
    return run.predictions.join(found, "id", "left").select("id", "prediction", "program", "step", "hits", "best")


@query(
    "G8_open_book_log",
    f"""WITH {_ranked(3)} SELECT CAST(query_id AS VARCHAR) AS id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS found,
            round(max(score), 6) AS best_score FROM hits GROUP BY query_id""",
)
def _(spark, d):
    """What the first wave of the open-book run retrieves for the claims themselves."""
    run = verify_claims(_claim_samples(spark, d), pg.LexicalAnswerer(), "open-book", corpus=fx.corpus(spark, d), analyzer="simple", num_retrieved=3)
    first = run.retrieved.where("step = 0 and program = 0")
    return first.select("id", F.array_join(F.transform("log", lambda h: h["id"].cast("string")), ",").alias("found"), F.round(F.get("log", F.lit(0))["score"], 6).alias("best_score"))


_WORDS = f"list_distinct({fx.sql_terms('claim')})"


@query(
    "X3_lexical_answerer",
    f"""WITH c AS (SELECT doc_id AS id, 'Text ' || doc_id || ' comes from ' || source || '.' AS claim, text AS evidence FROM documents),
        s AS (SELECT *, {_WORDS} AS terms, list_filter(list_transform(regexp_split_to_array(evidence, '[.!?\\n]+'), lambda x: {fx.sql_strip('x')}), lambda x: x <> '') AS sents FROM c),
        r AS (SELECT id, terms, evidence, unnest(sents) AS sent, unnest(range(len(sents))) AS i FROM s),
        b AS (SELECT id, arg_min(sent, (1000000 - len(list_intersect(terms, {fx.sql_terms('sent')}))) * 1000000 + i) AS best FROM r GROUP BY id)
        SELECT s.id, CASE WHEN len(list_intersect(terms, {fx.sql_terms('evidence')})) >= 0.6 * len(terms) THEN 'true' ELSE 'false' END AS verdict, coalesce(b.best, '') AS answer
        FROM s LEFT JOIN b USING (id)""",
)
def _(spark, d):
    asked = fx.samples(spark, d).select("id", F.col("claim").alias("text"), "evidence")
    answerer = pg.LexicalAnswerer()
    verify = answerer.answer(asked.withColumn("kind", F.lit("VERIFY")), 0).select("id", F.col("answer_text").alias("verdict"))
    ask = answerer.answer(asked.withColumn("kind", F.lit("QUESTION")), 0).select("id", F.col("answer_text").alias("answer"))
    return verify.join(ask, "id")


def _length_model(frames):
    """A batch function in place of a model: a statement holds when its prompt has an even length."""
    for frame in frames:
        prompt = frame["prompt"].fillna("")
        frame["answer_text"] = pd.Series(["true" if len(p) % 2 == 0 else "false" for p in prompt], index=frame.index)
        yield frame


@query("X3_mapped_answerer")
def _(spark, d):
    return verify_claims(fx.samples(spark, d), pg.MappedAnswerer(_length_model), "close-book").predictions
