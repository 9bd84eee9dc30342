"""Reasoning programs, run for all samples at once in waves.

A program is a short list of commands: ``name = Verify("...")``, ``name = Question("...")`` and
``label = Predict(name and name)``. One row holds one program. Wave ``i`` runs command ``i`` of every
program: put earlier answers into its text, fetch evidence, ask, store the answer under the name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlake.functions.rows import rows_of
from claimlake.functions.binding import let
from claimlake.functions.hashing import parity
from claimlake.functions.prompts import question_prompt, verify_prompt
from claimlake.functions.text import _col, answer_to_bool, count_of, strip
from claimlake.operators.retrieval import Retriever, analyze, retrieve_evidence
from claimlake.session import cut_lineage

# What marks the kind of a command.
FINAL_MARK, VERIFY_MARK, QUESTION_MARK = "label = ", "= Verify", "= Question"
SETTINGS = ("gold", "open-book", "close-book")
_VALUE = "struct<b:boolean,t:string>"

# Few-shot prompts for writing programs; {claims} differ by data set, the layout is shared.
_RULES = (
    "Write a small program that checks a claim step by step. Verify() tells whether a simple statement is true, "
    "Question() answers a question, Predict() combines the checks.\n\n"
)
_MULTI_HOP = '''# The claim is that The mill on the river Aun is older than the town hall that Ida Berg designed.
def program():
    answer_1 = Question("Which town hall was designed by Ida Berg?")
    fact_1 = Verify(f"The mill on the river Aun is older than {answer_1}.")
    label = Predict(fact_1)

# The claim is that The painter of Red Field was born in Oss and taught at the school that Jan Roos founded.
def program():
    answer_1 = Question("Who painted Red Field?")
    answer_2 = Question("Which school was founded by Jan Roos?")
    fact_1 = Verify(f"{answer_1} was born in Oss.")
    fact_2 = Verify(f"{answer_1} taught at {answer_2}.")
    label = Predict(fact_1 and fact_2)

'''
_SINGLE_PAGE = '''# The claim is that Harbour Line opened in 1901 and has nine stations.
def program():
    fact_1 = Verify("Harbour Line opened in 1901.")
    fact_2 = Verify("Harbour Line has nine stations.")
    label = Predict(fact_1 and fact_2)

# The claim is that In the 1990 cup final, the home team won after extra time.
def program():
    fact_1 = Verify("The home team won the 1990 cup final.")
    fact_2 = Verify("The 1990 cup final was decided after extra time.")
    label = Predict(fact_1 and fact_2)

'''
CLAIM_PLACE = "[[CLAIM]]"
_ASK = f"# The claim is that {CLAIM_PLACE}\ndef program():"
PROGRAM_TEMPLATES = {"multi-hop": _RULES + _MULTI_HOP + _ASK, "single-page": _RULES + _SINGLE_PAGE + _ASK}


def program_prompts(claims: DataFrame, dataset: str, template: str | None = None) -> DataFrame:
    """Adds ``prompt``: the few-shot text of a data set with the claim put in."""
    if template is None and dataset not in PROGRAM_TEMPLATES:
        raise NotImplementedError(dataset)
    text = template or PROGRAM_TEMPLATES[dataset]
    return claims.withColumn("prompt", F.replace(F.lit(text), F.lit(CLAIM_PLACE), F.col("claim")))


def temperature(n_programs: int) -> float:
    """Sampling temperature for one or for several programs per claim."""
    return 0.0 if n_programs == 1 else 0.7


def program_lines(text: Column | str) -> Column:
    """Model output to its trimmed, non-empty lines."""
    return F.filter(F.transform(F.split(_col(text), "\n"), strip), lambda line: line != "")


def programs_of(samples: DataFrame, column: str = "predicted_programs") -> Column:
    """``array<array<string>>`` of programs, also when the table nests them one level deeper."""
    if samples.schema[column].dataType.simpleString().startswith("array<array<array<"):
        return F.flatten(F.col(column))
    return F.col(column)


def explode_programs(samples: DataFrame) -> DataFrame:
    """``(id, program, step, command)``."""
    programs = samples.transform(rows_of, ["id"], programs_of(samples), "_steps", "program")
    return programs.transform(rows_of, ["id", "program"], "_steps", "command", "step")


def parse_command(command: Column | str) -> Column:
    """``struct(type, var, text, names, alert)`` of a command.

    ``text`` is what stands in the quotes, or all that follows the mark when the quotes are not closed.
    ``names`` are the variables of ``Predict(...)``, null if there is none to be found.
    """
    c = _col(command)
    has = lambda part: F.contains(c, F.lit(part))
    kind = (
        F.when(has(FINAL_MARK), "FINAL").when(has(VERIFY_MARK), "VERIFY").when(has(QUESTION_MARK), "QUESTION").otherwise("UNKNOWN")
    )
    asks = kind.isin("VERIFY", "QUESTION")
    mark = F.when(kind == "VERIFY", VERIFY_MARK).otherwise(QUESTION_MARK)
    marks = F.when(kind == "VERIFY", count_of(c, VERIFY_MARK)).otherwise(count_of(c, QUESTION_MARK))
    at = F.position(mark, c)
    rest = F.substr(c, at + F.length(mark))
    quoted = r'(?s){}\(f?"(.*)"\)'
    verify, question = quoted.format("Verify"), quoted.format("Question")
    text = (
        F.when((kind == "VERIFY") & c.rlike(verify), F.regexp_extract(c, verify, 1))
        .when((kind == "QUESTION") & c.rlike(question), F.regexp_extract(c, question, 1))
        .when(asks, rest)
    )
    listed = r"(?s)Predict\((.*?)\)"
    names = F.transform(F.split(F.regexp_extract(c, listed, 1), " and "), strip)
    names = F.when((kind == "FINAL") & c.rlike(listed), names)
    alert = (
        F.when(asks & (marks > 1), "ambiguous command")
        .when((kind == "VERIFY") & ~c.rlike(verify), "unclosed quotes")
        .when((kind == "QUESTION") & ~c.rlike(question), "unclosed quotes")
        .when((kind == "FINAL") & names.isNull(), "no prediction")
        .when(kind == "UNKNOWN", "unknown command")
    )
    var = F.when(asks, strip(F.substr(c, F.lit(1), at - 1)))
    return F.struct(kind.alias("type"), var.alias("var"), text.alias("text"), names.alias("names"), alert.alias("alert"))


def parse_commands(steps: DataFrame, case_insensitive: bool = False) -> DataFrame:
    """Adds the parsed fields to ``(id, program, step, command)``.

    ``case_insensitive`` also reads ``predict(``, ``verify(`` and ``question(``.
    """
    return steps.select("*", parse_command(_spelled(F.col("command"), case_insensitive)).alias("c")).select(*steps.columns, "c.*")


def _spelled(command: Column, case_insensitive: bool) -> Column:
    if case_insensitive:
        for name in ("Predict", "Verify", "Question"):
            command = F.regexp_replace(command, rf"(?i)\b{name}\(", rf"{name}(")
    return command


def substitute(text: Column, variables: Column) -> Column:
    """``struct(text, bad)``: ``{name}`` places filled in; ``bad`` when a truth value would have to be put in."""
    step = lambda s, e: F.struct(
        F.when(
            F.contains(s["text"], F.concat(F.lit("{"), e["key"], F.lit("}"))) & e["value"]["t"].isNotNull(),
            F.replace(s["text"], F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]["t"]),
        )
        .otherwise(s["text"])
        .alias("text"),
        (s["bad"] | (F.contains(s["text"], F.concat(F.lit("{"), e["key"], F.lit("}"))) & e["value"]["b"].isNotNull())).alias("bad"),
    )
    return F.aggregate(F.map_entries(variables), F.struct(text.alias("text"), F.lit(False).alias("bad")), step)


def final_verdict(names: Column, variables: Column) -> Column:
    """AND over the named variables; unknown names are ignored and texts count by being non-empty.

    The last variable that does not hold decides: a false truth value gives false, an empty text null.
    """
    known = F.filter(F.transform(names, lambda n: F.try_element_at(variables, n)), lambda v: v.isNotNull())
    falsy = F.filter(known, lambda v: F.coalesce(~v["b"], F.coalesce(v["t"], F.lit("")) == ""))
    last = F.get(falsy, F.size(falsy) - 1)
    return F.when(F.size(falsy) == 0, F.lit(True)).when(last["b"].isNotNull(), F.lit(False))


def unknown_names(names: Column, variables: Column) -> Column:
    return F.filter(names, lambda n: ~F.array_contains(F.map_keys(variables), n))


class Answerer(Protocol):
    """Answers a wave of questions."""

    def answer(self, asked: DataFrame, step: int) -> DataFrame:
        """Adds ``answer_text`` to the rows of one step with ``id, program, step, kind, text, evidence, prompt``.

        ``kind`` is ``VERIFY``, ``QUESTION`` or null; rows with a null kind need no answer. Other columns
        must be handed on unchanged; ``evidence`` and ``prompt`` may be dropped, and are there again in the next step.
        """


@dataclass
class AnswerTable:
    """Answers that are known already: ``answers(id, program, step, answer_text)``.

    Each wave reads the answers of its own step and joins on (id, program). Evidence and prompts are not needed for
    that, so they are not moved.
    """

    answers: DataFrame

    def answer(self, asked: DataFrame, step: int) -> DataFrame:
        wave = self.answers.where(F.col("step") == step).select("id", "program", "answer_text")
        return asked.drop("evidence", "prompt").join(wave, ["id", "program"], "left")


@dataclass
class LexicalAnswerer:
    """A simple stand-in for a model: a statement holds if enough of its words are in the evidence, and a
    question is answered by the sentence that shares most words with it."""

    threshold: float = 0.6

    def answer(self, asked: DataFrame, step: int) -> DataFrame:
        terms = F.array_distinct(analyze("text", "simple"))
        evidence = F.coalesce("evidence", F.lit(""))
        share = F.size(F.array_intersect(terms, analyze(evidence, "simple"))) / F.greatest(F.size(terms), F.lit(1))
        verdict = F.when(share >= self.threshold, F.lit("true")).otherwise(F.lit("false"))
        sentences = F.filter(F.transform(F.split(evidence, r"[.!?\n]+"), strip), lambda s: s != "")
        ranked = lambda t, said: F.transform(
            said, lambda s, i: F.struct(F.size(F.array_intersect(t, analyze(s, "simple"))).alias("shared"), (-i).alias("order"), s.alias("text"))
        )
        best = F.coalesce(let(terms, sentences, lambda t, said: F.array_max(ranked(t, said))["text"]), F.lit(""))
        return asked.withColumn("answer_text", F.when(F.col("kind") == "VERIFY", verdict).when(F.col("kind") == "QUESTION", best))


@dataclass
class MappedAnswerer:
    """Answers from a user's batch function, for example a model: ``pandas frames -> pandas frames``.

    The function gets the columns of ``Answerer.answer`` of the rows that need an answer and adds ``answer_text``.
    Only those columns go through Python; programs and variables stay behind and are joined by (id, program).
    """

    function: Callable

    def answer(self, asked: DataFrame, step: int) -> DataFrame:
        sent = asked.where("kind is not null").select("id", "program", "step", "kind", "text", "evidence", "prompt")
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sent.schema)
        answers = sent.mapInPandas(self.function, fields + ", answer_text string").select("id", "program", "answer_text")
        return asked.join(answers, ["id", "program"], "left")


@dataclass
class Execution:
    """``verdicts(id, program, verdict, alerts)`` and, for open-book runs, ``retrieved(id, program, step, query, log)``."""

    verdicts: DataFrame
    retrieved: DataFrame | None


def execute_programs(
    programs: DataFrame,
    answerer: Answerer,
    setting: str = "gold",
    retriever: Retriever | None = None,
    num_retrieved: int = 5,
    max_tokens: int | None = None,
    seed: int = 0,
    case_insensitive: bool = False,
) -> Execution:
    """Run ``programs(id, program, commands, evidence)``; the driver only loops over step numbers.

    Unknown answers and failed runs get a repeatable coin toss and an alert. Only a prediction in last
    place counts, otherwise the verdict is null.
    """
    if setting not in SETTINGS:
        raise ValueError(f"unknown setting: {setting}")
    if setting == "open-book" and retriever is None:
        raise ValueError("open-book needs a retriever")
    parsed = F.transform("commands", lambda c: parse_command(_spelled(c, case_insensitive)))
    state = programs.select(
        "id",
        "program",
        parsed.alias("commands"),
        F.col("evidence").cast("string").alias("evidence"),
        F.create_map().cast(f"map<string,{_VALUE}>").alias("vars"),
        F.lit(False).alias("failed"),
        F.lit(None).cast("boolean").alias("final"),
        F.array().cast("array<string>").alias("alerts"),
    )
    # what an answerer leaves out of the state; where nothing reads it either, the optimizer drops this join as well
    given = programs.groupBy("id", "program").agg(F.max(F.col("evidence").cast("string")).alias("evidence"))
    waves = programs.agg(F.max(F.size("commands"))).first()[0] or 0
    logs: list[DataFrame] = []
    for step in range(waves):
        if "evidence" not in state.columns:
            state = state.join(given, ["id", "program"], "left")
        asked = _ask(state, step, setting)
        if setting == "open-book":
            # the questions feed both the search and the answers
            asked = cut_lineage(asked.drop("evidence", "prompt"), f"questions-{step}")
            found = _search(asked, retriever, num_retrieved, max_tokens)
            found = cut_lineage(found, f"evidence-{step}")
            logs.append(found.select("id", "program", F.lit(step).alias("step"), "query", "log"))
            asked = asked.join(found.drop("query", "log"), ["id", "program"], "left")
            asked = asked.withColumn("prompt", _prompt(setting))
        # each wave is written once, so that whatever reads the outcome later asks nothing again
        answered = answerer.answer(asked, step)
        if setting == "open-book":
            # found for this step only
            answered = answered.drop("evidence")
        state = cut_lineage(_store(answered, seed), f"state-{step}")
    verdict = F.when(F.col("failed"), parity(str(seed), F.col("id"), F.col("program"), "run")).otherwise(F.col("final"))
    verdicts = state.select("id", "program", verdict.alias("verdict"), "alerts")
    retrieved = None
    for log in logs:
        retrieved = log if retrieved is None else retrieved.unionByName(log)
    return Execution(verdicts, retrieved)


def _prompt(setting: str) -> Column:
    """Prompt of a step; without evidence the claim or question is asked alone."""
    closed = setting == "close-book"
    verify = F.coalesce(verify_prompt("text", "evidence", closed), verify_prompt("text", claim_only=True))
    question = F.coalesce(question_prompt("text", "evidence", closed), question_prompt("text", claim_only=True))
    return F.when(F.col("kind") == "VERIFY", verify).when(F.col("kind") == "QUESTION", question)


def _ask(state: DataFrame, step: int, setting: str) -> DataFrame:
    asked = state.withColumn("step", F.lit(step)).withColumn("_cmd", F.get("commands", F.lit(step)))
    asks = ~F.col("failed") & F.col("_cmd.type").isin("VERIFY", "QUESTION")
    asked = asked.withColumn("_filled", F.when(asks, substitute(F.col("_cmd.text"), F.col("vars"))))
    broken = (F.col("_cmd.alert") == "ambiguous command") | F.col("_filled.bad")
    asked = asked.withColumn("_broken", F.coalesce(asks & broken, F.lit(False)))
    ready = asks & ~F.col("_broken")
    asked = asked.withColumn("kind", F.when(ready, F.col("_cmd.type"))).withColumn("text", F.when(ready, F.col("_filled.text")))
    return asked.withColumn("prompt", _prompt(setting)).drop("_filled")


def _search(asked: DataFrame, retriever: Retriever, top_k: int, max_tokens: int | None) -> DataFrame:
    queries = asked.where("kind is not null").select("id", "program", F.col("text").alias("query"))
    queries = queries.withColumn("query_id", F.concat_ws("#", F.col("id").cast("string"), "program"))
    # a text that several programs ask is searched once
    asked_for = queries.groupBy("query").agg(F.min("query_id").alias("query_id"))
    hits = retriever.retrieve(asked_for.select("query_id", F.col("query").alias("text")), top_k)
    found = asked_for.join(retrieve_evidence(hits, max_tokens), "query_id").drop("query_id")
    return queries.join(found, "query", "left").select("id", "program", "query", "evidence", "log")


def _store(answered: DataFrame, seed: int) -> DataFrame:
    kind, cmd = F.col("kind"), F.col("_cmd")
    known = answer_to_bool("answer_text")
    truth = F.coalesce(known, parity(str(seed), F.col("id"), F.col("program"), F.col("step")))
    value = F.struct(
        F.when(kind == "VERIFY", truth).alias("b"), F.when(kind == "QUESTION", F.coalesce("answer_text", F.lit(""))).alias("t")
    )
    # a name that exists keeps its place in the order of substitution
    replaced = F.transform_values("vars", lambda k, v: F.when(k == cmd["var"], value).otherwise(v))
    added = F.map_concat("vars", F.create_map(F.coalesce(cmd["var"], F.lit("")), value))
    new_vars = (
        F.when(kind.isNull(), F.col("vars")).when(F.array_contains(F.map_keys("vars"), cmd["var"]), replaced).otherwise(added)
    )
    active = ~F.col("failed") & cmd.isNotNull()
    decided = F.when(
        cmd["type"] == "FINAL",
        F.when(cmd["names"].isNull(), parity(str(seed), F.col("id"), F.col("program"), F.col("step"))).otherwise(
            final_verdict(cmd["names"], F.col("vars"))
        ),
    )
    unknown = F.size(unknown_names(cmd["names"], F.col("vars"))) > 0
    raised = F.array_compact(
        F.array(
            F.when(active, cmd["alert"]),
            F.when(F.col("_broken") & ~F.coalesce(cmd["alert"] == "ambiguous command", F.lit(False)), F.lit("truth value in text")),
            F.when((kind == "VERIFY") & known.isNull(), F.lit("unknown answer")),
            F.when((kind == "QUESTION") & F.col("answer_text").isNull(), F.lit("no answer")),
            F.when(active & (cmd["type"] == "FINAL") & unknown, F.lit("unknown name")),
        )
    )
    return answered.select(
        "id",
        "program",
        "commands",
        *[c for c in answered.columns if c == "evidence"],
        new_vars.alias("vars"),
        (F.col("failed") | F.col("_broken")).alias("failed"),
        F.when(active, decided).otherwise(F.col("final")).alias("final"),
        F.concat("alerts", raised).alias("alerts"),
    )


def vote(verdicts: DataFrame) -> DataFrame:
    """``(id, prediction)``: majority over the programs of a sample; a tie refutes, null verdicts abstain."""
    counts = verdicts.groupBy("id").agg(F.count_if(F.col("verdict")).alias("_yes"), F.count_if(~F.col("verdict")).alias("_no"))
    return counts.select("id", F.when(F.col("_yes") > F.col("_no"), "supports").otherwise("refutes").alias("prediction"))
