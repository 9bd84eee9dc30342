"""Tables for training a corrector: prompts, targets, masks and few-shot cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlake.functions.binding import let
from claimlake.functions.prompts import correction_prompt, fill
from claimlake.functions.text import truncate_tokens, words
from claimlake.operators.filters import drop_incomplete, fill_empty_prompt, filter_label

FEWSHOT_CASE = "Statement: {mutated}\nEvidence: {gold_evidence}\nCorrection: {original}\n\n"
FEWSHOT_HEAD = "You repair statements that contain a mistake. Here are {n} examples:\n"
FEWSHOT_ASK = "Now repair this case:\nStatement: {mutated}\nEvidence: {gold_evidence}\nCorrection:"
MASK_PROMPT = "mutation:'{mutated}'\n\nevidence:'{gold_evidence}'"


def training_pairs(
    df: DataFrame, style: str = "expert", tagged_target: bool = False,
    evidence_limit: int | None = None, target_limit: int | None = None,
) -> DataFrame:
    """Adds ``prompt`` and ``target`` to correction pairs; the target may be wrapped in answer tags.

    Nothing is cut unless a limit in words is given. Limits cut the evidence and the corrected text, so markers
    and tags stay whole and the prompt can be read back.
    """
    cut = lambda name, limit: F.col(name) if limit is None else truncate_tokens(name, limit)
    original = cut("original", target_limit)
    target = fill("<answer>{original}</answer>", original=original) if tagged_target else original
    return df.withColumns({"prompt": correction_prompt("mutated", cut("gold_evidence", evidence_limit), style), "target": target})


def mask_boundary(df: DataFrame, separator: str = " <sep> ", end: str = " <eos>") -> DataFrame:
    """Adds ``full_text``, ``prompt_len`` (its leading words that carry no loss) and the 0/1 ``loss_mask``."""
    prompt = F.concat(fill(MASK_PROMPT, mutated="mutated", gold_evidence="gold_evidence"), F.lit(separator))
    response = F.concat(fill("<answer>{original}</answer>", original="original"), F.lit(end))
    out = df.withColumn("_prompt", prompt).withColumn("full_text", F.concat(prompt, response))
    out = out.withColumn("prompt_len", F.size(words("_prompt"))).drop("_prompt")
    mask = let(
        F.col("prompt_len"), words("full_text"), lambda n, toks: F.transform(toks, lambda t, i: F.when(i < n, 0).otherwise(1))
    )
    return out.withColumn("loss_mask", mask)


#: Examples that a few-shot prompt takes at most; every prompt repeats all of them.
MOST_EXAMPLES = 1000


def fewshot_prompts(df: DataFrame, examples: DataFrame, order: str = "id", most: int = MOST_EXAMPLES) -> DataFrame:
    """Adds ``prompt``: the examples rendered once as a scalar, then the case. More than ``most`` examples are an error."""
    if len(examples.select(F.lit(1)).take(most + 1)) > most:
        raise ValueError(f"more than {most} examples")
    case = fill(FEWSHOT_CASE, mutated="mutated", gold_evidence="gold_evidence", original="original")
    rendered = examples.agg(
        F.count(F.lit(1)).alias("_n"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, case.alias("t")))), lambda e: e["t"]), "").alias("_cases"),
    )
    head = rendered.select(F.concat(fill(FEWSHOT_HEAD, n=F.col("_n").cast("string")), "_cases").alias("_head")).scalar()
    ask = fill(FEWSHOT_ASK, mutated="mutated", gold_evidence="gold_evidence")
    return df.withColumn("_head", head).withColumn("prompt", F.concat("_head", ask)).drop("_head")


def rl_prompts(df: DataFrame, style: str = "tagged", label: str = "refutes") -> DataFrame:
    """``(id, claim, evidence, prompt)`` of complete rows with the label."""
    kept = drop_incomplete(filter_label(df, label), ["evidence", "claim"])
    prompt = fill_empty_prompt(correction_prompt("claim", "evidence", style))
    return kept.select("id", "claim", "evidence", prompt.alias("prompt"))
