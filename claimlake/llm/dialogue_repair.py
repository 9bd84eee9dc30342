"""Conversations brought back to alternating turns by the cheapest edits.

A conversation is right if its role initials are ``(s?(ua)+)?``. Keeping a row costs nothing, giving it the role user or
assistant 2, deleting it 3, inserting an empty row 2; blank and repeated rows have to go, and a truncated row that stays
costs 1 more. The rows are aligned to the alternating string of each feasible length (Wagner-Fischer), each time only in
the band that can still reach the best cost so far (Ukkonen), and the letters of the edits, read back from the table, are
compared: of equal costs the ASCII-least audit wins.

A conversation is cut into chunks of a few dozen rows by a range partitioning. A chunk is aligned once for each state
in which the turns before can leave it (nothing yet, after a system, user or assistant turn), chunks are joined level by
level, some dozens at a time, and the way back tells each chunk its edits. Costs add up, and an audit that is the start of
another one costs less than that, so the best of the whole is made of the best of the parts: cutting changes no result.
However long a conversation is, no task holds more than some dozens of its rows or its audit.

Null roles and texts are one space, null turns come first, rows of one turn are ordered by role and by a hash of the
text, rows that are the same are stored once with their number. Ids may be null. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlake.llm.rowkeys import WHITE, kept_table

#: Different rows in a chunk, and chunks joined at a time.
CHUNK, FAN = 48, 64
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
NEVER = 1 << 60
#: States between turns: nothing yet, after a system turn, after a user turn, after an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"u": "user", "a": "assistant"}

ITEM = "struct<turn:long,role:string,a:long,b:long,fault:string,copies:long>"
EDGES = "array<struct<p:int,q:int,cost:long,audit:string,way:array<int>>>"
#: Turns as the aligner sees them: the initial a row can be kept with (none: it has to go), what keeping costs, how many.
Row = tuple[str | None, int, int]
Edges = dict[tuple[int, int], tuple[int, str]]


def target(state: int, size: int, system: bool = False) -> str:
    """The alternating string of ``size`` initials that goes on after ``state``."""
    if system:
        return "s" + target(SYSTEM, size - 1) if size else ""
    return ("au" if state == USER else "ua") * (size // 2) + ("au" if state == USER else "ua")[: size % 2]


def align(rows: list[Row], wanted: str, limit: int) -> tuple[int, str] | None:
    """Cheapest edits of ``rows`` to the initials ``wanted`` within ``limit``, ASCII-least audit; else None."""
    kept = [r[0] is not None for r in rows]
    forced = sum(DELETE * r[2] for r, k in zip(rows, kept) if not k)
    surplus, size = sum(kept) - len(wanted), len(wanted)
    slack = limit - forced
    if DELETE * max(surplus, 0) + INSERT * max(-surplus, 0) > slack:
        return None
    # the band: so many more (or fewer) rows than initials may have gone by at any place
    most = (slack + INSERT * surplus) // (DELETE + INSERT)
    least = -((slack - DELETE * surplus) // (DELETE + INSERT))
    seen = [0]
    for k in kept:
        seen.append(seen[-1] + k)
    table = [[NEVER] * (size + 2) for _ in range(len(rows) + 1)]
    for i in range(len(rows), -1, -1):
        line = table[i]
        low, high = max(seen[i] - most, 0), min(seen[i] - least, size)
        below = table[i + 1] if i < len(rows) else None
        for j in range(high, low - 1, -1):
            best = NEVER if below or j < size else 0
            if j < size and wanted[j] != "s":
                best = line[j + 1] + INSERT
            if below:
                initial, extra, copies = rows[i]
                best = min(best, below[j] + DELETE * copies)
                if initial is not None and j < size:
                    if initial == wanted[j]:
                        best = min(best, below[j + 1] + KEEP + extra)
                    elif wanted[j] != "s":
                        best = min(best, below[j + 1] + REROLE + extra)
            line[j] = best
    if table[0][0] > limit:
        return None
    i = j = 0
    letters = []
    while i < len(rows) or j < size:
        here = table[i][j]
        initial, extra, copies = rows[i] if i < len(rows) else (None, 0, 0)
        if i < len(rows) and here == table[i + 1][j] + DELETE * copies:
            letters.append("D" * copies)
            i += 1
        elif j < size and wanted[j] != "s" and here == table[i][j + 1] + INSERT:
            letters.append("I")
            j += 1
        else:
            letters.append("K" if initial == wanted[j] else "R")
            i, j = i + 1, j + 1
    return table[0][0], "".join(letters)


def edges(rows: list[Row], start: int, ends: tuple[int, ...]) -> Edges:
    """Cheapest edits that lead from state ``start`` to each of the states ``ends``, over all feasible lengths."""
    forced = sum(DELETE * r[2] for r in rows if r[0] is None)
    keepable = sum(r[0] is not None for r in rows)
    most = forced + (DELETE + TRUNCATED) * keepable
    found: Edges = {}

    def better(end: int, wanted: str) -> None:
        best = found.get((start, end))
        got = align(rows, wanted, best[0] if best else most + INSERT * len(wanted))
        if got and (best is None or got < best):
            found[start, end] = got

    if start in ends:
        better(start, "")
    if start == NOTHING and SYSTEM in ends and any(r[0] == "s" for r in rows):
        better(SYSTEM, "s")
    for away in range(keepable + most + 2):
        costs = {forced + INSERT * away: keepable + away, forced + DELETE * away: keepable - away} if away else {forced: keepable}
        open_ends = [found[start, e][0] if (start, e) in found else NEVER for e in ends if e in (USER, ASSISTANT)]
        if forced + INSERT * away > max(open_ends):
            break
        for cost, size in costs.items():
            for system in (False, True) if start == NOTHING else (False,):
                if size < 1 + system:
                    continue
                wanted = target(start, size, system)
                end = USER if wanted[-1] == "u" else ASSISTANT
                if end not in ends or (system and not any(r[0] == "s" for r in rows)):
                    continue
                best = found.get((start, end))
                if best is None or cost <= best[0]:
                    better(end, wanted)
    return found


def rows_of_items(items: list[dict]) -> list[Row]:
    """Turns of a chunk; the second and later copies of a row are repeated rows."""
    out: list[Row] = []
    for x in items:
        if x["fault"] in ("blank", "duplicate"):
            out.append((None, 0, int(x["copies"])))
        else:
            out.append((x["role"][:1], TRUNCATED if x["fault"] == "truncated" else 0, 1))
            if x["copies"] > 1:
                out.append((None, 0, int(x["copies"]) - 1))
    return out


def illegal_steps(items: list[dict]) -> int:
    initials = [x["role"][:1] for x in items]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])) + sum(int(x["copies"]) - 1 for x in items)


def faulty_rows(turns: DataFrame) -> DataFrame:
    """``conv, conv_id, turn, role, a, b, fault, copies``: different rows, their hash and their first fault."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = turns.select(
        conversation(), F.col("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), role, text).alias("b"),
        F.rtrim(text, F.lit(WHITE)).alias("body"),
    ).withColumn("mark", F.when(F.col("body") == "", "blank").when(~F.substring("body", -1, 1).isin(".", "!", "?"), "truncated").otherwise("")).drop("body")
    rows = kept_table(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies")), "turns")
    # only texts that come at several turns; written, so that the join can split the copies of one text
    again = kept_table(rows.groupBy("conv", "a", "b").agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "first-turns")
    later = F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    fault = F.when(F.col("mark") == "blank", "blank").when(later, "duplicate").otherwise(F.col("mark"))
    return kept_table(rows.join(again, ["conv", "a", "b"], "left").withColumn("fault", fault).drop("mark", "first"), "faulty-turns")


def conversation():
    """The id as a text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv")


def fault_counts(rows: DataFrame) -> DataFrame:
    """``conv, conv_id, gaps, blank, duplicate, truncated`` of each conversation."""
    count = lambda name, value: F.sum(F.when(F.col("fault") == name, value).otherwise(0))
    copies = F.col("copies")
    second = F.sum(F.when(F.col("fault").isin("blank", "duplicate"), 0).otherwise(copies - 1))
    return rows.groupBy("conv", "conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        count("blank", copies).alias("blank"),
        (count("duplicate", copies) + second).alias("duplicate"),
        count("truncated", F.lit(1)).alias("truncated"),
    )


def turn_chunks(rows: DataFrame) -> DataFrame:
    """``conv, no, total, items``: the rows in order, cut into chunks."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        conv, seq, items = None, 0, []
        for batch in batches:
            out = []
            turns = batch["turn"].tolist()
            for key, turn, role, a, b, fault, copies in zip(batch["conv"], turns, batch["role"], batch["a"], batch["b"], batch["fault"], batch["copies"]):
                if items and (key != conv or len(items) == CHUNK):
                    out.append((conv, part, seq, items))
                    items, seq = [], seq + 1
                if key != conv:
                    conv, seq = key, 0
                items.append({"turn": None if turn == "" else int(turn), "role": role, "a": a, "b": b, "fault": fault, "copies": copies})
            yield pd.DataFrame(out, columns=["conv", "part", "seq", "items"])
        if items:
            yield pd.DataFrame([(conv, part, seq, items)], columns=["conv", "part", "seq", "items"])

    keys = ["conv", "turn", "role", "a", "b"]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*keys, "fault", "copies")
    # whole numbers with nulls would become fractions in pandas
    ordered = ordered.withColumn("turn", F.coalesce(F.col("turn").cast("string"), F.lit("")))
    chunks = kept_table(ordered.mapInPandas(cut, f"conv string, part int, seq int, items array<{ITEM}>"), "turn-chunks")
    # a conversation lies in one task, or in a few that follow each other: a row for each of them
    sizes = chunks.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("conv").orderBy("part")
    before = sizes.withColumns({
        "before": F.sum("n").over(order) - F.col("n"),
        "total": F.sum("n").over(Window.partitionBy("conv")),
    }).drop("n")
    return chunks.join(before, ["conv", "part"]).select("conv", (F.col("seq") + F.col("before")).alias("no"), "total", "items")


def aligned_chunks(chunks: DataFrame) -> DataFrame:
    """``conv, no, total, items, edges, first, last, illegal``: cheapest edits between any two states."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for no, total, items in zip(batch["no"], batch["total"], batch["items"]):
                rows = rows_of_items(list(items))
                starts = (NOTHING,) if no == 0 else (NOTHING, SYSTEM, USER, ASSISTANT)
                ends = (NOTHING, ASSISTANT) if total == 1 else None
                found: Edges = {}
                for s in starts:
                    found |= edges(rows, s, ends or ((NOTHING, SYSTEM, USER, ASSISTANT) if s == NOTHING else tuple({s, USER, ASSISTANT})))
                out.append(([{"p": p, "q": q, "cost": c, "audit": x, "way": []} for (p, q), (c, x) in sorted(found.items())], items[0]["role"][:1], items[-1]["role"][:1], illegal_steps(items)))
            yield pd.concat([batch, pd.DataFrame(out, columns=["edges", "first", "last", "illegal"])], axis=1)

    schema = f"conv string, no long, total long, items array<{ITEM}>, edges {EDGES}, first string, last string, illegal long"
    return kept_table(chunks.mapInPandas(work, schema), "aligned-chunks")


def joined_nodes(nodes: DataFrame) -> DataFrame:
    """``FAN`` neighbours as one node; ``way`` holds the states that its best edits pass."""

    def join(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("no")
        best = {(p, p): (0, "", ()) for p in range(4)}
        last, illegal = None, 0
        for parts, first, end, inner in zip(group["edges"], group["first"], group["last"], group["illegal"]):
            new: dict = {}
            for (p, q), (cost, audit, way) in best.items():
                for e in parts:
                    if e["p"] == q:
                        got = (cost + e["cost"], audit + e["audit"], (*way, e["q"]))
                        if (p, e["q"]) not in new or got < new[p, e["q"]]:
                            new[p, e["q"]] = got
            best = new
            illegal += inner + (last is not None and last + first not in ("su", "ua", "au"))
            last = end
        found = [{"p": p, "q": q, "cost": c, "audit": x, "way": list(w)} for (p, q), (c, x, w) in sorted(best.items())]
        return pd.DataFrame({"conv": [key[0]], "no": [key[1]], "edges": [found], "first": [group["first"].iloc[0]], "last": [last], "illegal": [illegal]})

    grouped = nodes.withColumn("up", F.floor(F.col("no") / FAN)).groupBy("conv", "up")
    return kept_table(grouped.applyInPandas(join, f"conv string, no long, edges {EDGES}, first string, last string, illegal long"), "joined-chunks")


def best_edits(aligned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv, illegal, cost, audit`` of conversations, and ``conv, no, items, p, audit`` of their chunks."""
    right = F.filter("edges", lambda e: (e["p"] == NOTHING) & e["q"].isin(NOTHING, ASSISTANT))
    pick = F.array_min(F.transform(right, lambda e: F.struct(e["cost"], e["audit"], e["p"], e["q"], e["way"])))
    parts = ["conv", "illegal", "best.cost", "best.audit"]
    short = aligned.where("total = 1").withColumn("best", pick)
    levels = [aligned.where("total > 1").select("conv", "no", "edges", "first", "last", "illegal")]
    size = aligned.agg(F.max("total")).first()[0] or 1
    while size > 1:
        levels.append(joined_nodes(levels[-1]))
        size = -(-size // FAN)
    whole, edits = short.select(*parts), short.select("conv", "no", "items", F.lit(NOTHING).alias("p"), "best.audit")
    if len(levels) == 1:
        return whole, edits
    top = levels[-1].withColumn("best", pick)
    here = top.select("conv", "no", F.col("best.p").alias("p"), F.col("best.q").alias("q"))
    for level in levels[:0:-1]:
        way = F.filter("edges", lambda e: (e["p"] == F.col("p")) & (e["q"] == F.col("q")))[0]["way"]
        step = here.join(level.select("conv", "no", "edges"), ["conv", "no"]).withColumn("way", way)
        here = step.select("conv", F.col("no").alias("up"), F.posexplode(F.transform("way", lambda q, i: F.struct(F.when(i == 0, F.col("p")).otherwise(F.get("way", i - 1)).alias("p"), q.alias("q")))).alias("i", "e"))
        here = here.select("conv", (F.col("up") * FAN + F.col("i")).alias("no"), "e.p", "e.q")
    own = F.filter("edges", lambda e: (e["p"] == F.col("p")) & (e["q"] == F.col("q")))[0]["audit"]
    long = aligned.where("total > 1").join(here, ["conv", "no"]).select("conv", "no", "items", "p", own.alias("audit"))
    return whole.unionByName(top.select(*parts)), edits.unionByName(long)


def edited_rows(edits: DataFrame) -> DataFrame:
    """``conv, no, place, edit, role, turn, a, b`` of the rows that are kept, renamed or inserted."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["conv", "no", "place", "edit", "role", "turn", "a", "b"]
        for batch in batches:
            out = []
            for conv, no, items, state, audit in zip(batch["conv"], batch["no"], batch["items"], batch["p"], batch["audit"]):
                rows = iter([x for x in items for _ in range(int(x["copies"]))])
                for place, edit in enumerate(audit):
                    row = next(rows) if edit != "I" else None
                    if edit == "D":
                        continue
                    if edit == "K" and row["role"][:1] == "s":
                        state, role = SYSTEM, row["role"]
                    else:
                        state = ASSISTANT if state == USER else USER
                        role = row["role"] if edit == "K" else ROLES["ua"[state - USER]]
                    turn = row["turn"] if row else None
                    out.append((conv, no, place, edit, role, None if turn is None or turn != turn else str(int(turn)), row and str(row["a"]), row and str(row["b"])))
            yield pd.DataFrame(out, columns=columns)

    whole = lambda name: F.col(name).cast("long").alias(name)
    out = edits.mapInPandas(work, "conv string, no long, place int, edit string, role string, turn string, a string, b string")
    return out.select("conv", "no", "place", "edit", "role", whole("turn"), whole("a"), whole("b"))


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The report of each conversation, ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``, and the
    repaired rows, ``conv_id, no, place, edit, turn, role, text``, ordered by ``no`` and ``place``."""
    rows = faulty_rows(turns)
    whole, edits = best_edits(aligned_chunks(turn_chunks(rows)))
    report = fault_counts(rows).join(whole, "conv").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    texts = turns.select(
        conversation(), F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), role, text).alias("b"), text.alias("text")
    ).groupBy("conv", "conv_id", "turn", "a", "b").agg(F.first("text").alias("text"))
    left, right = edited_rows(edits).alias("l"), texts.alias("r")
    same = (F.col("l.conv") == F.col("r.conv")) & F.col("l.turn").eqNullSafe(F.col("r.turn")) & (F.col("l.a") == F.col("r.a")) & (F.col("l.b") == F.col("r.b"))
    fixed = left.join(right, same, "left").select(
        F.when(F.col("l.conv") != "", F.substring("l.conv", 2, 1 << 30)).alias("conv_id"), "no", "place", "edit", "l.turn", "l.role", F.coalesce("r.text", F.lit("")).alias("text")
    )
    return report, fixed.withColumn("conv_id", F.col("conv_id").cast(turns.schema["conv_id"].dataType))


def conversation_digests(fixed: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of the repaired ``role:text``, newline-joined, read in order batch by batch.

    A digest is sequential, so the rows of one conversation pass one task; it holds a batch of them at a time.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, digest = None, None
        for batch in batches:
            out = []
            for key, role, text in zip(batch["conv"], batch["role"], batch["text"]):
                if key != conv:
                    if digest:
                        out.append((conv, digest.hexdigest()))
                    conv, digest = key, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            yield pd.DataFrame(out, columns=["conv", "repaired_sha256"])
        if digest:
            yield pd.DataFrame([(conv, digest.hexdigest())], columns=["conv", "repaired_sha256"])

    rows = fixed.select(conversation(), "no", "place", "role", "text").repartition("conv").sortWithinPartitions("conv", "no", "place")
    found = rows.select("conv", "role", "text").mapInPandas(work, "conv string, repaired_sha256 string")
    return found.select(F.when(F.col("conv") != "", F.substring("conv", 2, 1 << 30)).cast(fixed.schema["conv_id"].dataType).alias("conv_id"), "repaired_sha256")
