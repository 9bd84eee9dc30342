"""Output checks, rewards and training tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.metrics import sql_lcs, sql_rouge
from catalog.registry import query
from claimlake.operators import rewards as rw
from claimlake.operators import training as tr
from claimlake.operators.filters import sample_fewshot

_DONE = f"WITH RECURSIVE {fx.SQL_COMPLETIONS}"


@query("D1_check_format", f"{_DONE} SELECT id, reason, answer FROM answered")
def _(spark, d):
    return rw.check_format(fx.completions(spark, d)).select("id", "reason", "answer")


@query(
    "D2_length_band",
    f"{_DONE} SELECT id, answer FROM answered WHERE length(answer) / length(claim) BETWEEN 0.8 AND 1.5",
)
def _(spark, d):
    return rw.length_band(rw.check_format(fx.completions(spark, d))).select("id", "answer")


def _spread_letters(text):
    """Squared letter counts without the four commonest letters, a vector that tells texts apart better."""
    rare = [a for a in "abcdefghijklmnopqrstuvwxyz" if a not in "enat"]
    counts = [F.length(text) - F.length(F.replace(text, F.lit(a), F.lit(""))) for a in rare]
    places = [F.instr(text, a) for a in rare]
    return F.array(*[(c * p).cast("double") for c, p in zip(counts, places)])


def _sql_spread(x: str) -> str:
    return f"list_transform(string_split('bcdfghijklmopqrsuvwxyz', ''), lambda a: CAST((length({x}) - length(replace({x}, a, ''))) * strpos({x}, a) AS DOUBLE))"


_SPREAD_COSINE = f"""(list_dot_product({_sql_spread('claim')}, {_sql_spread('answer')})
    / nullif(sqrt(list_dot_product({_sql_spread('claim')}, {_sql_spread('claim')})) * sqrt(list_dot_product({_sql_spread('answer')}, {_sql_spread('answer')})), 0))"""
_SIMILAR = f"""banded AS (SELECT *, coalesce({_SPREAD_COSINE}, 0) AS cosine FROM answered WHERE reason IS NULL AND length(answer) / length(claim) BETWEEN 0.8 AND 1.5),
{sql_rouge('banded', 1, 'answer', 'claim', 'r1')}, {sql_rouge('banded', 2, 'answer', 'claim', 'r2')}, {sql_lcs('banded', 'answer', 'claim', 'rl')},
alike AS (
    SELECT b.*, r1.f AS rouge1, (r1.f + r2.f + rl.f) / 3 AS rouge,
           {fx.sql_strip("regexp_replace(b.answer, '" + fx.SPACE + "+', ' ', 'g')")} = {fx.sql_strip("regexp_replace(b.claim, '" + fx.SPACE + "+', ' ', 'g')")} AS same
    FROM banded b JOIN r1 USING (id) JOIN r2 USING (id) JOIN rl USING (id)),
judged AS (SELECT *, same OR (rouge > 0.8 AND cosine > 0.8) OR cosine > 0.9 AS copied FROM alike)"""


def _shaped(spark, d):
    return rw.length_band(rw.check_format(fx.completions(spark, d)))


@query("D3_similarity", f"{_DONE}, {_SIMILAR} SELECT id, round(rouge1, 6) AS rouge1, round(rouge, 6) AS rouge, round(cosine, 6) AS cosine FROM judged")
def _(spark, d):
    scores = rw.similarity(_shaped(spark, d), ["id"], "answer", "claim", _spread_letters, stem=False)
    return scores.select("id", *[F.round(c, 6).alias(c) for c in ("rouge1", "rouge", "cosine")])


@query("D3_copy_guard", f"{_DONE}, {_SIMILAR} SELECT id FROM judged WHERE NOT copied")
def _(spark, d):
    rows = _shaped(spark, d)
    return rw.copy_guard(rw.with_similarity(rows, "answer", "claim", _spread_letters, stem=False)).select("id")



def _by_length(df):
    """Verifier of the examples: an answer holds when its length is even."""
    return df.select("id", (F.length("answer") % 2 == 0).alias("verified"))


@query(
    "D4_tiered_reward",
    f"""{_DONE}, {_SIMILAR}
        SELECT id, round(CASE WHEN copied THEN CAST(0 AS DOUBLE) WHEN rouge1 * 0.5 < 0.3 THEN rouge1 * 0.5 WHEN length(answer) % 2 = 0 THEN 1.0 ELSE 0.4 END, 6) AS reward,
               CASE WHEN copied THEN 'answer repeats the claim' END AS reason FROM judged
        UNION ALL
        SELECT id, 0.0, coalesce(reason, 'answer too short or too long') FROM answered WHERE id NOT IN (SELECT id FROM banded)""",
)
def _(spark, d):
    rewards = rw.tiered_reward(fx.completions(spark, d), ["id"], _by_length, _spread_letters, stem=False)
    return rewards.withColumn("reward", F.round("reward", 6))


@query("D4_tiered_reward_stemmed")
def _(spark, d):
    rewards = rw.tiered_reward(fx.completions(spark, d), ["id"], _by_length)
    return rewards.withColumn("reward", F.round("reward", 6))


_GATE = f"WITH {fx.SQL_PAIRS}, p AS (SELECT id, original AS claim, prediction AS answer FROM pairs)"


@query(
    "D5_gated_reward",
    f"{_GATE} SELECT id, CASE WHEN coalesce({_SPREAD_COSINE}, 0) >= 0.7 AND length(answer) % 2 = 0 THEN CAST(1 AS DOUBLE) ELSE 0 END AS reward FROM p",
)
def _(spark, d):
    rows = fx.pairs(spark, d).select("id", F.col("original").alias("claim"), F.col("prediction").alias("completion"))
    return rw.gated_reward(rows, ["id"], _by_length, _spread_letters)


@query(
    "X4_weighted_rewards",
    f"""{_GATE}, a AS (SELECT id, CASE WHEN coalesce({_SPREAD_COSINE}, 0) >= 0.7 AND length(answer) % 2 = 0 THEN 1.0 ELSE 0.0 END AS r FROM p),
        b AS (SELECT id, CASE WHEN length(answer) / length(claim) BETWEEN 0.8 AND 1.5 THEN 1.0 ELSE 0.0 END AS r FROM p)
        SELECT id, CAST(round(0.7 * a.r + 0.3 * b.r, 6) AS DOUBLE) AS reward FROM a JOIN b USING (id)""",
)
def _(spark, d):
    rows = fx.pairs(spark, d).select("id", F.col("original").alias("claim"), F.col("prediction").alias("completion"))
    gated = rw.gated_reward(rows, ["id"], _by_length, _spread_letters)
    banded = rows.select("id", rw.in_length_band("completion", "claim").cast("double").alias("reward"))
    return rw.combine_rewards([(gated, 0.7), (banded, 0.3)], ["id"]).withColumn("reward", F.round("reward", 6))


# ---------------------------------------------------------------- training tables


@query(
    "D6_training_pairs",
    f"""WITH {fx.SQL_PAIRS}, w AS (SELECT *, {fx.sql_words('gold_evidence')} AS ew, {fx.sql_words('original')} AS tw FROM pairs)
        SELECT id, 'mutation:''' || mutated || '''' || chr(10) || chr(10) || 'evidence:''' ||
                   CASE WHEN len(ew) > 20 THEN array_to_string(ew[1:20], ' ') ELSE gold_evidence END || '''' || chr(10) || chr(10) AS prompt,
               '<answer>' || CASE WHEN len(tw) > 40 THEN array_to_string(tw[1:40], ' ') ELSE original END || '</answer>' AS target FROM w""",
)
def _(spark, d):
    return tr.training_pairs(fx.pairs(spark, d), "brief", True, 20, 40).select("id", "prompt", "target")


@query(
    "D6_training_pairs_whole",
    f"""WITH {fx.SQL_PAIRS} SELECT id, 'mutation:''' || mutated || '''' || chr(10) || chr(10) || 'evidence:''' || gold_evidence || '''' || chr(10) || chr(10) AS prompt,
               original AS target FROM pairs""",
)
def _(spark, d):
    return tr.training_pairs(fx.pairs(spark, d), "brief").select("id", "prompt", "target")


@query(
    "D7_mask_boundary",
    f"""WITH {fx.SQL_PAIRS}, p AS (SELECT id, 'mutation:''' || mutated || '''' || chr(10) || chr(10) || 'evidence:''' || gold_evidence || ''' <sep> ' AS prompt,
            '<answer>' || original || '</answer> <eos>' AS response FROM pairs)
        SELECT id, prompt || response AS full_text, len({fx.sql_words('prompt')}) AS prompt_len, len({fx.sql_words('response')}) AS learned FROM p""",
)
def _(spark, d):
    rows = tr.mask_boundary(fx.pairs(spark, d))
    learned = F.aggregate("loss_mask", F.lit(0), lambda s, x: s + x)
    return rows.select("id", "full_text", "prompt_len", learned.alias("learned"))


@query(
    "D8_fewshot_prompts",
    f"""WITH {fx.SQL_PAIRS}, ex AS (SELECT * FROM pairs ORDER BY md5('3:' || id), id LIMIT 8),
        head AS (SELECT 'You repair statements that contain a mistake. Here are ' || count(*) || ' examples:' || chr(10)
            || string_agg('Statement: ' || mutated || chr(10) || 'Evidence: ' || gold_evidence || chr(10) || 'Correction: ' || original || chr(10) || chr(10), '' ORDER BY id) AS h FROM ex)
        SELECT id, (SELECT h FROM head) || 'Now repair this case:' || chr(10) || 'Statement: ' || mutated || chr(10) || 'Evidence: ' || gold_evidence || chr(10) || 'Correction:' AS prompt
        FROM pairs""",
)
def _(spark, d):
    rows = fx.pairs(spark, d)
    return tr.fewshot_prompts(rows, sample_fewshot(rows, 8, 3)).select("id", "prompt")


@query(
    "D9_rl_prompts",
    f"""SELECT doc_id AS id, claim, text AS evidence FROM (SELECT doc_id, text, quality, 'Text ' || doc_id || ' comes from ' || source || '.' AS claim
        FROM documents JOIN labels USING (doc_id)) WHERE quality = 0 AND length({fx.sql_strip('text')}) > 0""",
)
def _(spark, d):
    label = F.when(F.col("quality") == 1, "supports").otherwise("refutes")
    labels = fx.table(spark, d, "labels").select(F.col("doc_id").alias("id"), label.alias("label"))
    rows = fx.samples(spark, d).select("id", "claim", "evidence").join(labels, "id")
    prompts = tr.rl_prompts(rows)
    # the prompt has to give claim and evidence back
    from claimlake.functions.prompts import parse_prompt

    back = prompts.select("id", "claim", "evidence", parse_prompt("prompt").alias("p"))
    return back.select("id", F.col("p.claim").alias("claim"), "evidence")
