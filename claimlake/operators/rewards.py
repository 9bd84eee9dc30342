"""Checks and rewards for corrected claims, cheap checks first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlake.functions.binding import let
from claimlake.functions.hashing import cosine_similarity, hashed_vector
from claimlake.functions.text import _col, count_of, squeeze, strip, words
from claimlake.operators.overlap import rouge_grams, rouge_l
from claimlake.session import cut_lineage

# Thresholds and reward steps.
LENGTH_LOW, LENGTH_HIGH = 0.8, 1.5
COPY_ROUGE, COPY_COSINE, COPY_COSINE_ALONE = 0.8, 0.8, 0.9
ROUGE_WEIGHT, ROUGE_FLOOR = 0.5, 0.3
VERIFIED, UNVERIFIED = 1.0, 0.4
MIN_COSINE = 0.7
TAGS = ["<think>", "</think>", "<answer>", "</answer>"]

Embedder = Callable[[Column], Column]
Verifier = Callable[[DataFrame], DataFrame]


def bag_of_words(dims: int = 64) -> Embedder:
    """Embedder that counts hashed lower-case words."""
    return lambda text: hashed_vector(words(F.lower(text)), dims)


def checked_output(c: Column | str) -> Column:
    """``struct(reason, answer)`` of a model output.

    ``reason`` says why it is malformed (the first failing check counts) and is null if it is fine; then
    ``answer`` is the text between the answer tags.
    """
    return let(_col(c), lambda text: let(text, *[F.instr(text, tag) for tag in TAGS], _checked))


def _checked(text: Column, think: Column, think_end: Column, answer: Column, answer_end: Column) -> Column:
    missing = (think == 0) | (think_end == 0) | (answer == 0) | (answer_end == 0)
    order = (think > think_end) | (answer > answer_end) | (think_end > answer)
    repeated = F.lit(False)
    for tag in TAGS:
        repeated = repeated | (count_of(text, tag) != 1)
    before = F.substr(text, F.lit(1), think - 1)
    gap = think_end + len(TAGS[1])
    between = F.substr(text, gap, F.greatest(answer - gap, F.lit(0)))
    after = F.substr(text, answer_end + len(TAGS[3]))
    outside = F.length(strip(F.concat(before, between, after))) > 0
    start = answer + len(TAGS[2])
    inner = strip(F.substr(text, start, F.greatest(answer_end - start, F.lit(0))))
    return let(
        inner,
        F.when(missing | order, "tags missing or in wrong order").when(repeated, "tag not exactly once").when(outside, "text outside tags"),
        _with_markup,
    )


def _with_markup(inner: Column, reason: Column) -> Column:
    markup = F.contains(inner, F.lit("<")) & F.contains(inner, F.lit(">"))
    why = F.coalesce(reason, F.when(markup, F.lit("markup in answer")))
    return F.struct(why.alias("reason"), F.when(why.isNull(), inner).alias("answer"))


def check_format(df: DataFrame, column: str = "completion") -> DataFrame:
    """Adds ``reason`` (null if well formed) and ``answer`` (null if not)."""
    out = df.withColumn("_checked", checked_output(column))
    return out.withColumns({"reason": F.col("_checked.reason"), "answer": F.col("_checked.answer")}).drop("_checked")


def in_length_band(text: Column | str, base: Column | str, low: float = LENGTH_LOW, high: float = LENGTH_HIGH) -> Column:
    """Whether the character ratio of two texts lies in the band; false for an empty base."""
    ratio = F.length(_col(text)) / F.nullif(F.length(_col(base)), F.lit(0))
    return F.coalesce(ratio.between(low, high), F.lit(False))


def length_band(df: DataFrame, text: str = "answer", base: str = "claim", low: float = LENGTH_LOW, high: float = LENGTH_HIGH) -> DataFrame:
    """Rows whose length ratio lies in the band."""
    return df.where(in_length_band(text, base, low, high))


def with_similarity(df: DataFrame, text: str, base: str, embed: Embedder, stem: bool = True) -> DataFrame:
    """Adds ``rouge1`` (ROUGE-1 F1), ``rouge`` (mean F1 of ROUGE-1/2/L) and ``cosine`` (of the vectors) to each row."""
    scored = df.withColumns({
        "_g": rouge_grams(text, base, (1, 2), stem),
        "_l": rouge_l(text, base, stem)["f"],
        "cosine": cosine_similarity(embed(F.col(text)), embed(F.col(base))),
    })
    one, two = F.col("_g.rouge1_f"), F.col("_g.rouge2_f")
    return scored.withColumns({"rouge1": one, "rouge": (one + two + F.col("_l")) / 3}).drop("_g", "_l")


def similarity(df: DataFrame, key: list[str], text: str, base: str, embed: Embedder, stem: bool = True) -> DataFrame:
    """``key, rouge1, rouge, cosine`` of each row."""
    return with_similarity(df, text, base, embed, stem).select(*key, "rouge1", "rouge", "cosine")


def is_copy(text: Column | str, base: Column | str, rouge: Column | str = "rouge", cosine: Column | str = "cosine") -> Column:
    """Whether a text repeats its base: the same words, or too similar."""
    rouge, cosine = _col(rouge), _col(cosine)
    return (
        (squeeze(text) == squeeze(base))
        | ((rouge > COPY_ROUGE) & (cosine > COPY_COSINE))
        | (cosine > COPY_COSINE_ALONE)
    )


def copy_guard(df: DataFrame, text: str = "answer", base: str = "claim") -> DataFrame:
    """Rows that are no copies; needs ``rouge`` and ``cosine``."""
    return df.where(~is_copy(text, base))


def tiered_reward(
    df: DataFrame, key: list[str], verify: Verifier, embed: Embedder | None = None,
    claim: str = "claim", completion: str = "completion", stem: bool = True,
) -> DataFrame:
    """``key, reward, reason`` of ``df(key, claim, completion, ...)``.

    0 with a reason for a malformed, too short or long, or copied answer; half of ROUGE-1 while that is
    under the floor; else 1.0 or 0.4 by verification. Only rows that pass a stage enter the next one, and
    ``verify`` (survivors with ``answer`` -> ``key, verified``) sees the last ones only.
    """
    embed = embed or bag_of_words()
    checked = check_format(df, completion)
    reason = F.when(F.col("reason").isNull() & ~in_length_band("answer", claim), F.lit("answer too short or too long"))
    checked = checked.withColumn("reason", F.coalesce("reason", reason))
    # outputs may come from a costly step and are read by every stage below
    checked = cut_lineage(checked, "checked-outputs")
    shaped = checked.where("reason is null")
    scored = with_similarity(shaped, "answer", claim, embed, stem)
    scored = scored.withColumn("_copy", is_copy("answer", claim)).withColumn("_soft", F.col("rouge1") * ROUGE_WEIGHT)
    scored = cut_lineage(scored, "scored-outputs")
    verified = verify(scored.where(~F.col("_copy") & (F.col("_soft") >= ROUGE_FLOOR)))
    judged = scored.join(verified.select(*key, "verified"), key, "left")
    reward = (
        F.when(F.col("_copy"), F.lit(0.0))
        .when(F.col("_soft") < ROUGE_FLOOR, F.col("_soft"))
        .when(F.coalesce("verified", F.lit(False)), F.lit(VERIFIED))
        .otherwise(F.lit(UNVERIFIED))
    )
    passed = judged.select(*key, reward.alias("reward"), F.when(F.col("_copy"), F.lit("answer repeats the claim")).alias("reason"))
    failed = checked.where("reason is not null").select(*key, F.lit(0.0).alias("reward"), "reason")
    return passed.unionByName(failed)


def gated_reward(
    df: DataFrame, key: list[str], verify: Verifier, embed: Embedder | None = None,
    claim: str = "claim", completion: str = "completion", min_cosine: float = MIN_COSINE,
) -> DataFrame:
    """``key, reward``: 0 below the similarity gate, else 1 or 0 by verification."""
    embed = embed or bag_of_words()
    scored = df.withColumn("cosine", cosine_similarity(embed(F.col(completion)), embed(F.col(claim))))
    scored = cut_lineage(scored.withColumn("answer", F.col(completion)), "gated-outputs")
    verified = verify(scored.where(F.col("cosine") >= min_cosine)).select(*key, "verified")
    judged = scored.join(verified, key, "left")
    good = (F.col("cosine") >= min_cosine) & F.coalesce("verified", F.lit(False))
    return judged.select(*key, F.when(good, F.lit(1.0)).otherwise(F.lit(0.0)).alias("reward"))


def combine_rewards(rewards: list[tuple[DataFrame, float]], key: list[str]) -> DataFrame:
    """``key, reward``: weighted sum of several reward tables ``(key, reward)``; a missing reward counts 0."""
    parts = [r.select(*key, (F.col("reward") * weight).alias("reward")) for r, weight in rewards]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.groupBy(*key).agg(F.sum("reward").alias("reward"))
