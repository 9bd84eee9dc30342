import hashlib

import pytest
from pyspark.sql import functions as F

from claimlake.operators import programs as pg
from claimlake.plans.verification import verify_claims


def coin(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[0], 16) % 2 == 0


def parse(spark, *commands, **options):
    rows = spark.createDataFrame([("s", 0, i, c) for i, c in enumerate(commands)], "id string, program int, step int, command string")
    return pg.parse_commands(rows, **options).orderBy("step").collect()


def test_command_shapes(spark):
    got = parse(
        spark,
        'fact_1 = Verify("A "quoted" mill.")',
        'answer_1 = Question(f"Who is\n{answer_0}?")',
        "label = Predict(fact_1 and fact_2)",
        'fact_2 = Verify(f"open',
        'label = Verify("x")',
        "nothing",
        "label = predict(fact_1)",
        'a = Verify("x") = Verify("y")',
    )
    assert [(r.type, r["var"], r.text, r["names"], r.alert) for r in got] == [
        ("VERIFY", "fact_1", 'A "quoted" mill.', None, None),
        ("QUESTION", "answer_1", "Who is\n{answer_0}?", None, None),
        ("FINAL", None, None, ["fact_1", "fact_2"], None),
        ("VERIFY", "fact_2", '(f"open', None, "unclosed quotes"),
        # the final mark is looked for first
        ("FINAL", None, None, None, "no prediction"),
        ("UNKNOWN", None, None, None, "unknown command"),
        ("FINAL", None, None, None, "no prediction"),
        ("VERIFY", "a", 'x") = Verify("y', None, "ambiguous command"),
    ]
    assert parse(spark, "label = predict(a and b)", case_insensitive=True)[0]["names"] == ["a", "b"]


class Recorder(pg.AnswerTable):
    """Answer table that keeps the questions it saw."""

    def answer(self, asked, step):
        self.seen = getattr(self, "seen", []) + [
            (r.id, r.program, step, r.kind, r.text, r.prompt) for r in asked.where("kind is not null").select("id", "program", "kind", "text", "prompt").collect()
        ]
        return super().answer(asked, step)


def run(spark, programs, answers, setting="gold", **options):
    rows = spark.createDataFrame(
        [(i, p, cmds, "Some evidence.") for (i, p), cmds in programs.items()], "id string, program int, commands array<string>, evidence string"
    )
    table = spark.createDataFrame([(*k, v) for k, v in answers.items()] or [("-", 0, 0, "")], "id string, program int, step int, answer_text string")
    answerer = Recorder(table)
    done = pg.execute_programs(rows, answerer, setting, **options)
    return {(r.id, r.program): (r.verdict, r.alerts) for r in done.verdicts.collect()}, answerer.seen


def test_execution(spark):
    programs = {
        ("two", 0): ['f1 = Verify("A.")', 'f2 = Verify("B.")', "label = Predict(f1 and f2)"],
        ("asks", 0): ['a1 = Question("Who?")', 'f1 = Verify(f"{a1} is {a1}.")', "label = Predict(f1)"],
        ("early", 0): ['f1 = Verify("A.")', "label = Predict(f1)", 'f2 = Verify("B.")'],
        ("bool", 0): ['f1 = Verify("A.")', 'f2 = Verify("It is {f1}.")', "label = Predict(f1)"],
        ("names", 0): ['f1 = Verify("A.")', "label = Predict(f1 and nobody)"],
        ("texts", 0): ['a1 = Question("Who?")', 'a2 = Question("What?")', "label = Predict(a1)"],
        ("empty", 0): ['a1 = Question("Who?")', 'f1 = Verify("A.")', "label = Predict(f1 and a1)"],
        ("order", 0): ['a1 = Question("Who?")', 'f1 = Verify("A.")', "label = Predict(a1 and f1)"],
        ("noise", 0): ['f1 = Verify("A.")', "label = Predict[f1]"],
        ("maybe", 0): ['f1 = Verify("A.")', "label = Predict(f1)"],
        ("twice", 0): ['f1 = Verify("a") = Verify("b")', "label = Predict(f1)"],
    }
    answers = {
        ("two", 0, 0): " True ", ("two", 0, 1): "it's impossible to say",
        ("asks", 0, 0): "Ida", ("asks", 0, 1): "yes",
        ("early", 0, 0): "true", ("early", 0, 2): "true",
        ("bool", 0, 0): "true", ("bool", 0, 1): "true",
        ("names", 0, 0): "true",
        ("texts", 0, 0): "Ida", ("texts", 0, 1): "x",
        ("empty", 0, 0): "", ("empty", 0, 1): "false",
        ("order", 0, 0): "", ("order", 0, 1): "false",
        ("noise", 0, 0): "true", ("maybe", 0, 0): "perhaps", ("twice", 0, 0): "true",
    }
    got, seen = run(spark, programs, answers, seed=5)
    assert got[("two", 0)] == (False, [])
    assert got[("asks", 0)] == (True, [])
    # only a prediction in last place counts
    assert got[("early", 0)] == (None, [])
    assert got[("bool", 0)] == (coin(5, "bool", 0, "run"), ["truth value in text"])
    assert got[("names", 0)] == (True, ["unknown name"])
    assert got[("texts", 0)] == (True, [])
    # the last falsy value decides: an empty text is neither true nor false
    assert got[("empty", 0)] == (None, []) and got[("order", 0)] == (False, [])
    assert got[("noise", 0)] == (coin(5, "noise", 0, 1), ["no prediction"])
    assert got[("maybe", 0)] == (coin(5, "maybe", 0, 0), ["unknown answer"])
    assert got[("twice", 0)] == (coin(5, "twice", 0, "run"), ["ambiguous command"])
    texts = {(s[0], s[2]): s[4] for s in seen}
    assert texts[("asks", 1)] == "Ida is Ida."
    prompts = {(s[0], s[2]): s[5] for s in seen}
    assert prompts[("two", 0)] == "Some evidence.\nBased on the above information, is it true that A? True or false? The answer is: "


def test_placeholder_without_f_is_filled(spark):
    got, seen = run(spark, {("s", 0): ['a1 = Question("Who?")', 'f1 = Verify("{a1} sings.")', "label = Predict(f1)"]}, {("s", 0, 0): "Ida", ("s", 0, 1): "no"})
    assert ("s", 0, 1, "VERIFY", "Ida sings.") in [s[:5] for s in seen]
    assert got[("s", 0)][0] is False


def test_vote(spark):
    rows = [("most", True), ("most", True), ("most", False), ("tie", True), ("tie", False), ("none", None), ("one", True), ("one", None)]
    got = {r.id: r.prediction for r in pg.vote(spark.createDataFrame(rows, "id string, verdict boolean")).collect()}
    assert got == {"most": "supports", "tie": "refutes", "none": "refutes", "one": "supports"}


def test_equal_texts_are_searched_once(spark):
    """Two programs of two claims ask the same text; each gets what one search found."""

    class Counting:
        def retrieve(self, queries, top_k=10):
            asked.append(sorted(r.text for r in queries.collect()))
            return queries.select("query_id", F.lit(0).alias("rank"), F.lit(7).alias("doc_id"), F.lit(1.0).alias("score"), F.concat(F.lit("on "), "text").alias("text"))

    asked = []
    programs = [['f1 = Verify("red mill")', "label = Predict(f1)"], ['f1 = Verify("red mill")'], ['f1 = Verify("blue sky")']]
    samples = spark.createDataFrame([(i, "c", "supports", [programs]) for i in ("s", "t")], "id string, claim string, gold string, predicted_programs array<array<array<string>>>")
    found = verify_claims(samples, pg.LexicalAnswerer(), "open-book", retriever=Counting()).retrieved.where("step = 0").collect()
    assert asked[0] == ["blue sky", "red mill"]
    want = {(i, p, "blue sky" if p == 2 else "red mill") for i in ("s", "t") for p in range(3)}
    assert {(r.id, r.program, r["query"]) for r in found} == want and len(found) == 6 and all([h.id for h in r.log] == [7] for r in found)


def test_open_book_fetches_for_each_text(spark):
    corpus = spark.createDataFrame([(1, "Ida painted the red mill."), (2, "Ida was born in Oss."), (3, "The town hall is tall.")], "id long, contents string")
    program = ['a1 = Question("Who painted the red mill?")', 'f1 = Verify(f"{a1} was born in Oss.")', "label = Predict(f1)"]
    samples = spark.createDataFrame([("s", "c", "supports", [[program]])], "id string, claim string, gold string, predicted_programs array<array<array<string>>>")
    run_ = verify_claims(samples, pg.LexicalAnswerer(), "open-book", corpus=corpus, num_retrieved=1)
    log = {r.step: (r["query"], [h.id for h in r.log]) for r in run_.retrieved.collect()}
    assert log[0] == ("Who painted the red mill?", [1])
    assert log[1][0] == "Ida painted the red mill was born in Oss." and len(log[1][1]) == 1
    assert [tuple(r) for r in run_.predictions.select("id", "gold", "prediction").collect()] == [("s", "supports", "refutes")]
    with pytest.raises(ValueError):
        pg.execute_programs(samples.select("id", F.lit(0).alias("program"), F.array(F.lit("x")).alias("commands"), F.lit("").alias("evidence")), pg.LexicalAnswerer(), "open-book")


def test_model_function_and_missing_programs(spark):
    def model(frames):
        for frame in frames:
            yield frame.assign(answer_text="true")

    samples = spark.createDataFrame([("s", "c", "supports", [['f = Verify("A.")', "label = Predict(f)"]]), ("t", "c", "refutes", [])], "id string, claim string, gold string, predicted_programs array<array<string>>")
    evidence = spark.createDataFrame([("s", "e")], "id string, evidence string")
    got = verify_claims(samples, pg.MappedAnswerer(model), "gold", evidence).predictions
    assert {r.id: r.prediction for r in got.collect()} == {"s": "supports", "t": "refutes"}


def test_prompts(spark):
    claims = spark.createDataFrame([("It rains.",)], "claim string")
    assert pg.program_prompts(claims, "single-page").first().prompt.endswith("# The claim is that It rains.\ndef program():")
    with pytest.raises(NotImplementedError):
        pg.program_prompts(claims, "other")
    assert (pg.temperature(1), pg.temperature(3)) == (0.0, 0.7)
    assert claims.select(pg.program_lines(F.lit(" a\n\n b "))).first()[0] == ["a", "b"]


def test_each_question_is_asked_once_and_alone_without_evidence(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def model(batches):
        import uuid

        for pdf in batches:
            for prompt in pdf["prompt"]:
                (asked / uuid.uuid4().hex).write_text(prompt)
            yield pdf.assign(answer_text="true")

    programs = [['fact_1 = Verify("It rains.")', "label = Predict(fact_1)"]]
    samples = spark.createDataFrame([("s", "It rains.", "supports", programs, "It rained."), ("t", "It rains.", "supports", programs, None)], "id string, claim string, gold string, predicted_programs array<array<string>>, evidence string")
    run = verify_claims(samples, pg.MappedAnswerer(model), "gold")
    assert {r.id: r.prediction for r in run.predictions.collect()} == {"s": "supports", "t": "supports"}
    run.verdicts.collect()
    prompts = sorted(p.read_text() for p in asked.iterdir())
    assert len(prompts) == 2 and prompts[0].startswith("Is it true that It rains?") and prompts[1].startswith("It rained.")


def test_known_answers_move_no_evidence(spark, monkeypatch):
    written, write = [], pg.cut_lineage
    monkeypatch.setattr(pg, "cut_lineage", lambda df, label: written.append(df) or write(df, label))
    commands = ['f1 = Verify("A.")', 'f2 = Verify("B.")', "label = Predict(f1 and f2)"]
    rows = spark.createDataFrame([("s", 0, commands, "Some evidence.")], "id string, program int, commands array<string>, evidence string")
    answers = spark.createDataFrame([("s", 0, 0, "true"), ("s", 0, 1, "yes")], "id string, program int, step int, answer_text string")
    assert pg.execute_programs(rows, pg.AnswerTable(answers)).verdicts.first().verdict is True
    assert len(written) == 3 and all("evidence" not in df.columns for df in written)
    # the answers of the step are all that the state is joined to
    assert [df._jdf.queryExecution().optimizedPlan().toString().count("Join ") for df in written] == [1, 1, 1]


def test_prompts_of_later_steps_have_the_evidence(spark):
    programs = {("s", 0): ['f1 = Verify("A.")', 'f2 = Verify("B.")', "label = Predict(f1 and f2)"]}
    _, seen = run(spark, programs, {("s", 0, 0): "true", ("s", 0, 1): "true"})
    assert [s[5].startswith("Some evidence.") for s in seen] == [True, True]
