import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from claimlake.llm import dialogue_repair as R
from claimlake.llm.queries import damaged, op12_conversation_repair

WHITE = " \t\n\x0b\x0c\r"


def best_audit(rows):
    """Cheapest edits, by states: the best (cost, audit) of each state after each row, inserts tried between all."""
    best = {"": (0, "")}
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserts(best):
        for _ in range(4):
            for state, (cost, audit) in list(best.items()):
                for c in "ua":
                    to = step.get((state, c))
                    if to:
                        best[to] = min(best.get(to, (1e9, "")), (cost + 2, audit + "I"))
        return best

    best = inserts(best)
    for role, fault in rows:
        new = {}
        def offer(state, value):
            new[state] = min(new.get(state, (1e9, "")), value)
        extra = fault == "truncated"
        for state, (cost, audit) in best.items():
            offer(state, (cost + 3, audit + "D"))
            if fault in ("blank", "duplicate"):
                continue
            if (state, role[:1]) in step:
                offer(step[state, role[:1]], (cost + extra, audit + "K"))
            for c in "ua":
                if (state, c) in step:
                    offer(step[state, c], (cost + 2 + extra, audit + "R"))
        best = inserts(new)
    return min(best[s] for s in ("", "a") if s in best)


def every_edit(rows, most_inserts=3):
    """Best of all edit strings, tried one by one."""
    best = None
    for inserts in range(most_inserts + 1):
        for gaps in itertools.combinations_with_replacement(range(len(rows) + 1), inserts):
            for kinds in itertools.product("DKua", repeat=len(rows)):
                for signs in itertools.product("ua", repeat=inserts):
                    out, audit, cost, sign = "", "", 0, iter(signs)
                    for i in range(len(rows) + 1):
                        for _ in range(gaps.count(i)):
                            out, audit, cost = out + next(sign), audit + "I", cost + 2
                        if i == len(rows):
                            break
                        role, fault = rows[i]
                        if kinds[i] == "D":
                            audit, cost = audit + "D", cost + 3
                            continue
                        if fault in ("blank", "duplicate"):
                            break
                        cost += (kinds[i] != "K") * 2 + (fault == "truncated")
                        audit += "K" if kinds[i] == "K" else "R"
                        out += role[:1] if kinds[i] == "K" else kinds[i]
                    else:
                        continue
                    if len(audit) == len(rows) + inserts and re.fullmatch("(s?(ua)+)?", out) and (best is None or (cost, audit) < best):
                        best = cost, audit
    return best


def brute(turns):
    """The contract, conversation by conversation, on rows that are damaged already."""
    groups = defaultdict(list)
    for conv, turn, role, text in turns:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        seen, faults = set(), []
        for _, role, text in rows:
            body = text.strip(WHITE)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        numbers = [t for t, _, _ in rows if t is not None]
        cost, audit = best_audit([(r[1], f) for r, f in zip(rows, faults)])
        lines, state, at = [], "", 0
        for c in audit:
            if c == "D":
                at += 1
                continue
            role, text = ("", "") if c == "I" else rows[at][1:]
            at += c != "I"
            if c == "K" and role[:1] == "s":
                state = "s"
            else:
                state = "a" if state == "u" else "u"
                role = role if c == "K" else {"u": "user", "a": "assistant"}[state]
            lines.append(f"{role}:{text}")
        initials = [r[1][:1] for r in rows]
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
            faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def run(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    if extra:
        df = df.withColumns({n: F.lit("own") for n in ("conv", "no", "place", "items", "a", "b", "fault", "copies", "edges", "total")})
    report, fixed = R.repair(df)
    digests = {r[0]: r[1] for r in R.conversation_digests(fixed).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {r[0]: (*r[1:], digests.get(r[0], empty)) for r in report.collect()}


def conversations(seed, count, longest):
    r = random.Random(seed)
    rows = []
    for conv in range(count):
        for turn in range(r.randint(1, longest)):
            role = r.choice(["user", "assistant"]) if r.random() < 0.9 else r.choice(["system", "user", "tool", "", None, "usher"])
            if turn == 0 and r.random() < 0.4:
                role = "system"
            text = r.choice([f"Text {r.randint(0, 9)}.", f"No end {r.random()}", "Yes!", "", " \n", None, f"Whole {conv} {turn}?\t"])
            rows += [(conv, None if r.random() < 0.05 else turn, role, text)] * (1 if r.random() < 0.9 else r.randint(2, 4))
    # rows of one turn and role are told apart by a hash, so brute force has none with different texts
    seen = {}
    return [x for x in rows if seen.setdefault(x[:3], x[3]) == x[3]]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_states_match_every_edit_string(seed):
    r = random.Random(seed)
    for _ in range(25):
        rows = [(r.choice(["user", "assistant", "system", "tool"]), r.choice(["", "", "truncated", "blank", "duplicate"])) for _ in range(r.randint(1, 3))]
        want = every_edit(rows)
        assert best_audit(rows) == want
        own = [(None, 0, 1) if f in ("blank", "duplicate") else (role[:1], int(f == "truncated"), 1) for role, f in rows]
        found = R.edges(own, R.NOTHING, (R.NOTHING, R.ASSISTANT))
        assert min(found.values()) == want


def test_repair_matches_brute_force(spark):
    rows = conversations(7, 300, 12) + [(None, 0, "user", "No id."), (None, 1, "assistant", "None."), (900, None, None, None), (901, 5, "user", "Only one")]
    assert run(spark, rows) == brute(rows)


def test_long_conversations_are_cut_into_chunks(spark):
    rows = conversations(8, 3, 400) + [(50 + conv, turn, role, text) for conv, turn, role, text in conversations(9, 2, 6000)] + conversations(10, 40, 3)
    assert run(spark, rows, extra=False) == brute(rows)


def test_chunks_of_any_size_give_the_same():
    r = random.Random(4)
    for _ in range(20):
        rows = [(r.choice(["u", "a", "s", "t", None]), r.randint(0, 1), 1) for _ in range(r.randint(2, 9))]
        whole = R.edges(rows, R.NOTHING, (R.NOTHING, R.ASSISTANT))
        cut = r.randint(1, len(rows) - 1)
        joined = {}
        for (p, q), x in R.edges(rows[:cut], R.NOTHING, tuple(range(4))).items():
            ends = tuple(range(4)) if q == R.NOTHING else tuple({q, R.USER, R.ASSISTANT})
            for (_, end), y in R.edges(rows[cut:], q, ends).items():
                joined[end] = min(joined.get(end, (R.NEVER, "")), (x[0] + y[0], x[1] + y[1]))
        assert {q: joined[q] for _, q in whole} == {q: x for (_, q), x in whole.items()}


def test_one_row_many_times_and_one_text_everywhere(spark):
    rows = [(1, 1, "user", "Same.")] * 3000 + [(1, 2, "assistant", "Fine.")] + [(2, t, "assistant", "Always this.") for t in range(300)] + [(3, 1, "user", "long " * 50_000 + "."), (3, 2, "assistant", "Ok.")]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    report, fixed = R.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert report.collect() == [] and fixed.collect() == [] and R.conversation_digests(fixed).collect() == []


def damage(turns):
    for conv, turn, role, text in turns:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        for _ in range(2 if fault == 3 else 1):
            yield conv, turn, "user" if fault == 4 else role, text


def test_query_matches_brute_force_over_the_table(spark):
    sf = "/root/testdata/sf0.01"
    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute(damage(turns))
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = {r[0]: tuple(r)[1:] for r in op12_conversation_repair(spark, sf).collect()}
    assert got == {conv: want.get(conv, none) for conv, *_ in turns}
    some = spark.createDataFrame([(None, None, None, None), (1, None, "user", "A.")], "conv_id long, turn long, role string, text string")
    assert sorted(map(repr, map(tuple, damaged(some).collect()))) == sorted(map(repr, damage([(None, None, None, None), (1, None, "user", "A.")])))
