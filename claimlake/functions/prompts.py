"""Prompt texts and their inverse. Instruction wording is our own; marker formats are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimlake.functions.text import _col, drop_final_dot, strip

# How a checking question is put to the answering model.
VERIFY_WITH_EVIDENCE = "{evidence}\nBased on the above information, is it true that {claim}? True or false? The answer is: "
VERIFY_CLAIM_ONLY = "Is it true that {claim}? True or false? The answer is: "
QUESTION_WITH_EVIDENCE = "{evidence}\nQuestion: {question}\nThe answer is:"
QUESTION_ONLY = "Question: {question}\nThe answer is:"
RATIONALE = "Answer the following question by reasoning step-by-step.\nQ: {question}"

_TAGGED_RULES = (
    "You repair statements that contain a factual mistake. Use only the evidence given. Change the wrong part, "
    "leave everything else as it is, and do not return the statement unchanged.\n"
    "Write your reasoning inside <think></think> and then the repaired statement inside <answer></answer>. "
    "Use each pair of tags exactly once and write nothing outside of them.\n"
)

# Correction prompts by style. The labels around {claim} and {evidence} are fixed values.
CORRECTION_TEMPLATES = {
    "expert": (
        "You correct statements. Use the evidence to find and fix the mistakes in the original statement, and keep "
        "its meaning and structure.\n\nEvidence: {evidence}\n\nOriginal statement: {claim}\n\nCorrected statement: "
    ),
    "tagged": _TAGGED_RULES + "User:'{claim}'.Evidence:'{evidence}' Assistant:",
    "brief": "mutation:'{claim}'\n\nevidence:'{evidence}'\n\n",
}

# Start and end markers of the claim and of the evidence in each style; the text between them is trimmed.
_MARKERS = {
    "expert": (("\n\nOriginal statement: ", "\n\nCorrected statement: "), ("\n\nEvidence: ", "\n\nOriginal statement: ")),
    "tagged": (("User:'", "'.Evidence:"), ("'.Evidence:'", "' Assistant:")),
    "brief": (("mutation:'", "'\n\nevidence:'"), ("'\n\nevidence:'", "'\n\n")),
}


def fill(template: str, **fields: Column | str) -> Column:
    """Put columns into the ``{name}`` places of a template. Braces inside the data are left alone."""
    parts, rest = [], template
    while rest:
        places = [(rest.find("{" + name + "}"), name) for name in fields]
        places = [p for p in places if p[0] >= 0]
        if not places:
            parts.append(F.lit(rest))
            break
        at, name = min(places)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(_col(fields[name]))
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def verify_prompt(claim: Column | str, evidence: Column | str | None = None, claim_only: bool = False) -> Column:
    """Yes/no prompt for a claim, whose final dot is dropped."""
    claim = drop_final_dot(claim)
    if claim_only:
        return fill(VERIFY_CLAIM_ONLY, claim=claim)
    return fill(VERIFY_WITH_EVIDENCE, claim=claim, evidence=evidence)


def question_prompt(question: Column | str, evidence: Column | str | None = None, claim_only: bool = False) -> Column:
    """Open question prompt."""
    if claim_only:
        return fill(QUESTION_ONLY, question=question)
    return fill(QUESTION_WITH_EVIDENCE, question=question, evidence=evidence)


def rationale_prompt(question: Column | str) -> Column:
    """Prompt that asks for step-by-step reasoning."""
    return fill(RATIONALE, question=question)


def correction_prompt(
    claim: Column | str, evidence: Column | str, style: str = "tagged", template: str | None = None
) -> Column:
    """Prompt that asks to repair ``claim`` from ``evidence``."""
    return fill(template or CORRECTION_TEMPLATES[style], claim=claim, evidence=evidence)


# The reading of expert prompts that ends claim and evidence at the first line break.
_COMPAT_EXPERT = (("Original statement: ", "\n"), ("Evidence: ", "\n"))


def parse_prompt(c: Column | str, style: str = "tagged", compat: bool = False) -> Column:
    """``struct(claim, evidence)`` recovered from a correction prompt; null fields if a marker is missing.

    ``compat`` reads expert prompts only up to the first line break of each part.
    """
    c = _col(c)

    def between(start: str, end: str) -> Column:
        after = F.substring(c, F.instr(c, start) + len(start), F.length(c))
        return F.when(F.contains(c, F.lit(start)), strip(F.substring_index(after, end, 1)))

    claim, evidence = _COMPAT_EXPERT if compat and style == "expert" else _MARKERS[style]
    return F.struct(between(*claim).alias("claim"), between(*evidence).alias("evidence"))
