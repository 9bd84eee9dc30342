import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from claimlake.llm.chat_tree import format_conversations, formatted_turn, prefix_tree, read_turn

MARKS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "\\", "\\\\", "\n", " ", "a", "é🙂", "[", "<"]


def brute(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        said = "".join(t for *_, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "own", 7) for r in rows], "conv_id long, turn long, role string, text string, node string, depth int").repartition(3)


def conversations(seed=1, n=80):
    r = random.Random(seed)
    text = lambda: "".join(r.choice(MARKS) for _ in range(r.randint(0, 8)))
    first = [("user", text() + str(k)) for k in range(3)]
    rows = []
    for conv in range(n):  # many share their first turns; some end where others go on
        rows.append((conv, 0, *first[0 if conv % 3 else conv % 2 + 1]))
        for t in range(1, r.randint(1, 5)):
            rows.append((conv, t, "assistant" if t % 2 else "user", r.choice(["yes", "no"])))
        if conv % 4 == 0:
            rows.append((conv, 9, r.choice(["tool", "a\nb", "[INST]", "x\\n<s>", "", None]), text()))
    return rows


def test_turns_are_read_back(spark):
    r = random.Random(3)
    roles = ["assistant", "user", "", "a\nb", "[INST]", "<s>", "\\", "assistant\n", "x\\l\\("]
    turns = [(r.choice(roles), "".join(r.choice(MARKS) for _ in range(r.randint(0, 12)))) for _ in range(3000)] + [("user", "\\" * 30_000), ("assistant", "<s>" * 10_000)]
    df = spark.createDataFrame(turns, "role string, text string").select("role", "text", formatted_turn(F.col("role"), F.col("text")).alias("t"))
    for row in df.collect():
        assert read_turn(row["t"]) == (row["role"], row["text"], row["role"] == "assistant")


def test_conversations_are_read_back(spark):
    rows = conversations() + [(None, 0, "user", "no id"), (None, 1, "assistant", None), (500, None, None, None), (501, 0, "user", "tie"), (501, 0, "assistant", "tie"), (501, 0, "user", "tie")]
    rows += [(600, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(400)] + [(601, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(250)]
    got = {r["conv_id"]: tuple(r)[1:5] for r in format_conversations(frame(spark, rows)).collect()}
    assert got == brute(rows)
    assert format_conversations(frame(spark, rows[:1]).limit(0)).count() == 0


def test_stream_shares_turns_and_masks_others(spark):
    rows = conversations(2) + [(700, 0, "user", "alone")]
    stream, leaves = prefix_tree(frame(spark, rows))
    nodes = {r["node"]: r for r in stream.collect()}
    by = {}
    for conv, turn, role, text in sorted(rows, key=lambda x: (x[0], x[1])):
        by.setdefault(conv, []).append((role or "", text or ""))
    prefixes = {tuple(t[: k + 1]) for t in by.values() for k in range(len(t))}
    assert len(nodes) == len(prefixes)  # every shared beginning is there once
    order = sorted(nodes.values(), key=lambda r: r["start"])
    assert order[0]["start"] == 0 and all(a["end"] == b["start"] for a, b in zip(order, order[1:]))
    text = "".join(r["text"] for r in order)
    parents = Counter()
    for leaf in leaves.collect():
        n = nodes[leaf["leaf"]]
        seen = "".join(text[i["start"] : i["end"]] for i in n["ancestors"])
        assert n["position"] == len(seen)  # positions go on along the path, whatever lies between in the stream
        path = by[leaf["conv_id"]]
        turns = [read_turn(x + "\n") for x in (seen + n["text"]).replace(" [/INST]\n", " [/INST]\n\0").replace(" </s>\n", " </s>\n\0").split("\n\0") if x]
        assert [(r, t) for r, t, _ in turns] == path
        parents[leaf["leaf"]] += 1
    for n in nodes.values():
        said = text[n["loss_start"] : n["loss_end"]]
        assert (read_turn(n["text"])[0] == "assistant") == (n["loss_start"] < n["end"])
        assert all(i["end"] <= n["start"] for i in n["ancestors"]) and len(said) <= n["end"] - n["start"]
    # depth first: a node's descendants follow it without a gap
    for a in order:
        below = [b for b in order if any(i["start"] <= a["start"] and a["end"] <= i["end"] for i in b["ancestors"])]
        assert not below or [b["start"] for b in below] == [b["start"] for b in order if a["end"] <= b["start"] < max(x["end"] for x in below)]
