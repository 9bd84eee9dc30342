import pytest
from pyspark.sql import functions as F

from claimlake.operators import rewards as rw
from claimlake.operators import training as tr
from claimlake.operators.filters import sample_fewshot

CLAIM = "The red mill stands near the old town."
OUTPUTS = {
    "good": "<think>t</think><answer>The blue barn stands by a new village.</answer>",
    "order": "<answer>a</answer><think>t</think>",
    "missing": "<think>t</think><answer>a",
    "twice": "<think>t</think><answer>a</answer><answer>b</answer>",
    "outside": "<think>t</think> so <answer>a</answer>",
    "after": "<think>t</think><answer>a</answer> end",
    "markup": "<think>t</think><answer>a <b>c</b></answer>",
    "short": f"<think>t</think><answer>{CLAIM[: int(len(CLAIM) * 0.7)]}</answer>",
    "long": f"<think>t</think><answer>{CLAIM + CLAIM[: int(len(CLAIM) * 0.6)]}</answer>",
    "copy": f"<think>t</think>\n<answer> {CLAIM.replace(' ', '  ')} </answer>\n",
    "near": "<think>t</think><answer>The red mill stands far from the old town.</answer>",
}


@pytest.fixture(scope="module")
def outputs(spark):
    return spark.createDataFrame([(k, CLAIM, v) for k, v in OUTPUTS.items()], "id string, claim string, completion string")


def test_format(outputs):
    got = {r.id: (r.reason, r.answer) for r in rw.check_format(outputs).collect()}
    reasons = {k: v[0] for k, v in got.items() if v[0]}
    assert reasons == {
        "order": "tags missing or in wrong order", "missing": "tags missing or in wrong order", "twice": "tag not exactly once",
        "outside": "text outside tags", "after": "text outside tags", "markup": "markup in answer",
    }
    assert got["good"][1] == "The blue barn stands by a new village." and got["order"][1] is None


def test_length_band(outputs):
    kept = {r.id for r in rw.length_band(rw.check_format(outputs)).collect()}
    assert kept == {"good", "copy", "near"}


def test_tiered_reward(outputs):
    asked = []

    def verify(df):
        asked.extend(r.id for r in df.select("id").collect())
        return df.select("id", F.lit(False).alias("verified"))

    # a vector that keeps the two sentences apart, so that the copy guard looks at the words
    embed = lambda text: F.array(F.instr(text, "far").cast("double"), F.lit(1.0))
    got = {r.id: (r.reward, r.reason) for r in rw.tiered_reward(outputs, ["id"], verify, embed).collect()}
    assert asked == ["near"]
    assert got["near"] == (0.4, None)
    # the vectors cannot tell these two apart
    assert got["good"] == (0.0, "answer repeats the claim")
    assert got["copy"] == (0.0, "answer repeats the claim") and got["short"] == (0.0, "answer too short or too long")
    assert len(got) == len(OUTPUTS) and got["markup"][1] == "markup in answer"


def test_soft_reward_under_the_floor(outputs):
    none = lambda df: df.select("id", F.lit(True).alias("verified"))
    embed = lambda text: F.array(F.instr(text, "blue").cast("double"), F.instr(text, "red").cast("double"), F.instr(text, "far").cast("double"))
    got = {r.id: r.reward for r in rw.tiered_reward(outputs, ["id"], none, embed, stem=False).collect()}
    assert got["good"] == pytest.approx(0.5 * 2 * (2 / 8) * (2 / 8) / (4 / 8))
    assert got["near"] == 1.0


def test_gated_and_combined(spark):
    rows = spark.createDataFrame([("a", "x y", "x y"), ("b", "x y", "p q"), ("c", "x y", "y x")], "id string, claim string, completion string")
    verify = lambda df: df.select("id", (F.col("id") == "a").alias("verified"))
    gated = rw.gated_reward(rows, ["id"], verify)
    assert {r.id: r.reward for r in gated.collect()} == {"a": 1.0, "b": 0.0, "c": 0.0}
    flat = rows.select("id", F.lit(0.5).alias("reward"))
    both = {r.id: r.reward for r in rw.combine_rewards([(gated, 0.8), (flat, 0.2)], ["id"]).collect()}
    assert both == {"a": pytest.approx(0.9), "b": pytest.approx(0.1), "c": pytest.approx(0.1)}


PAIRS = [("1", "m one", "o one", "e one"), ("2", "m two", "o two", "e two"), ("3", "m three", "o three", "e three")]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(PAIRS, "id string, mutated string, original string, gold_evidence string")


def test_training_tables(pairs):
    row = tr.training_pairs(pairs, "brief", tagged_target=True).where("id = '1'").first()
    assert row.prompt == "mutation:'m one'\n\nevidence:'e one'\n\n" and row.target == "<answer>o one</answer>"
    masked = tr.mask_boundary(pairs).where("id = '1'").first()
    assert masked.full_text == "mutation:'m one'\n\nevidence:'e one' <sep> <answer>o one</answer> <eos>"
    assert masked.prompt_len == 5 and masked.loss_mask == [0] * 5 + [1] * 3


def test_fewshot(pairs):
    examples = sample_fewshot(pairs, 2, seed=1)
    assert examples.count() == 2 and examples.collect() == sample_fewshot(pairs.repartition(3), 2, seed=1).collect()
    prompts = [r.prompt for r in tr.fewshot_prompts(pairs, examples).collect()]
    assert len({p.split("Now repair")[0] for p in prompts}) == 1
    assert prompts[0].count("Correction: o ") == 2 and prompts[0].endswith("Correction:")


def test_rl_prompts(spark):
    rows = [("1", "c", "e", "refutes"), ("2", "c", " ", "refutes"), ("3", "c", "e", "supports")]
    got = tr.rl_prompts(spark.createDataFrame(rows, "id string, claim string, evidence string, label string")).collect()
    assert [r.id for r in got] == ["1"] and got[0].prompt.endswith("User:'c'.Evidence:'e' Assistant:")


def test_too_many_examples_are_an_error(spark):
    from claimlake.operators.training import fewshot_prompts

    rows = spark.createDataFrame([(str(i), "m", "o", "e") for i in range(5)], "id string, mutated string, original string, gold_evidence string")
    assert fewshot_prompts(rows, rows.limit(3), most=3).count() == 5
    with pytest.raises(ValueError):
        fewshot_prompts(rows, rows, most=4)
