"""Chat formatting over a prefix tree.

Conversations that begin with the same turns share those turns: a node is a sequence of turns, told by a running
128-bit sum of the digests of turns and their places. Nodes are laid out depth first as one stream of text, every
shared turn once. A run is a piece of a path without a branch; its nodes follow each other in the stream. So the
ancestors of a node are one interval per run on its path, however long the conversation, and position ids are the
places on the path instead of the places in the stream.

The layout is a range partitioning by path and running sums in two levels (within and over partitions), so a first
turn that a third of all conversations share still lies in many partitions.

Template: ``[INST] role\\ntext [/INST]\\n``, and ``<s> text </s>\\n`` for the assistant. Control strings inside texts and
roles, with any backslashes before them, get one backslash more; reading takes it off again. A space parts text from
the marks, so the end of a text never joins one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlake.llm.rowkeys import id_number, id_text, kept_table

ASSISTANT = "assistant"
CONTROL = r"<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>"


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?<!\\)(\\*+)({CONTROL})", r"\\$1$2")


def unescaped(text: str) -> str:
    return re.sub(rf"(?<!\\)\\(\\*(?:{CONTROL}))", r"\1", text)


def formatted_turn(role: Column, text: Column) -> Column:
    """A turn under the template. A line break in a role is put as ``\\n``, a backslash as two."""
    name = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    name = F.replace(F.replace(name, F.lit("["), F.lit("\\(")), F.lit("<"), F.lit("\\l"))
    other = F.concat(F.lit("[INST] "), name, F.lit("\n"), escaped(text), F.lit(" [/INST]\n"))
    return F.when(role == ASSISTANT, F.concat(F.lit("<s> "), escaped(text), F.lit(" </s>\n"))).otherwise(other)


def read_turn(turn: str) -> tuple[str, str, bool]:
    """Role, text and whether the text is under the loss mask, from a formatted turn."""
    if turn.startswith("<s> ") and turn.endswith(" </s>\n"):
        return ASSISTANT, unescaped(turn[4:-6]), True
    if not turn.startswith("[INST] ") or not turn.endswith(" [/INST]\n"):
        raise ValueError("not a formatted turn")
    name, text = turn[7:-9].split("\n", 1)
    marks = {"\\\\": "\\", "\\n": "\n", "\\(": "[", "\\l": "<"}
    return re.sub(r"\\[\\n(l]", lambda m: marks[m[0]], name), unescaped(text), False


def _half(digest: Column, at: int) -> Column:
    """15 hex digits of a digest as a number."""
    return F.conv(F.substring(digest, at, 15), 16, 10).cast("long")


def path_nodes(turns: DataFrame) -> DataFrame:
    """Every turn with its place, formatted text and the key of its path: conversations as paths of nodes.

    ``conv_id, depth, role, text, turn_text, p1, p2`` and the parent's ``q1, q2``. Turns are ordered by ``turn``, ties
    by role and text; null roles and texts are empty.
    """
    whole = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    w = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    placed = whole.withColumn("depth", F.row_number().over(w)).withColumn("turn_text", formatted_turn(F.col("role"), F.col("text")))
    digest = F.sha2(F.concat_ws("\n", F.col("depth").cast("string"), "turn_text"), 256)
    hashed = placed.withColumn("digest", digest).withColumn("d1", _half(F.col("digest"), 1)).withColumn("d2", _half(F.col("digest"), 17))
    along = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        hashed.withColumn("p1", F.bit_xor("d1").over(along))
        .withColumn("p2", F.bit_xor("d2").over(along))
        .withColumn("q1", F.col("p1").bitwiseXOR(F.col("d1")))
        .withColumn("q2", F.col("p2").bitwiseXOR(F.col("d2")))
        .select("conv_id", "depth", "turn_text", "p1", "p2", "q1", "q2")
    )


def prefix_tree(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stream and the conversations in it.

    Stream: a row per node: ``node, depth, run, start, end`` (places in the stream, in code points), ``position`` (id of
    the first code point, counted along the path), ``loss_start, loss_end`` (the assistant's text, else empty at
    ``end``), ``ancestors`` (array of ``start, end``: what the node may attend to before itself), ``text``.
    Conversations: ``conv_id, leaf`` (node), ``depth``; repeated conversations share a leaf.
    """
    paths = kept_table(path_nodes(turns), "chat-paths")
    # a node with its first conversation; all conversations of a node have one path up to it
    nodes = kept_table(paths.groupBy("depth", "p1", "p2", "q1", "q2").agg(F.min("conv_id").alias("owner")), "chat-nodes")
    children = nodes.groupBy("q1", "q2", "depth").agg(F.count(F.lit(1)).alias("n_children"))
    # written, so that the join shuffles both sides itself and Spark can split the children of one node
    children = kept_table(children.withColumnsRenamed({"q1": "c1", "q2": "c2", "depth": "c_depth"}), "chat-children")
    # a node begins a run if it has no parent or is one of several children
    on_parent = (F.col("q1") == F.col("c1")) & (F.col("q2") == F.col("c2")) & (F.col("depth") == F.col("c_depth"))
    head = (F.col("depth") == 1) | (F.col("n_children") > 1)
    marked = nodes.join(children, on_parent).select(F.col("depth").alias("m_depth"), F.col("p1").alias("m1"), F.col("p2").alias("m2"), "owner", head.alias("head"))
    on_node = (F.col("p1") == F.col("m1")) & (F.col("p2") == F.col("m2")) & (F.col("depth") == F.col("m_depth"))
    rows = paths.join(marked, on_node).select("conv_id", "depth", "p1", "p2", "owner", "head", "turn_text", F.length("turn_text").cast("long").alias("size"))
    along = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.when(F.col("head"), F.concat(F.lpad(F.hex("p1"), 16, "0"), F.lpad(F.hex("p2"), 16, "0")))
    rows = rows.withColumn("route", F.collect_list(mark).over(along)).withColumn("position", F.sum("size").over(along) - F.col("size"))
    rows = kept_table(rows, "chat-rows")
    node = F.concat_ws("-", F.col("depth").cast("string"), F.hex("p1"), F.hex("p2"))
    own = rows.where(F.col("conv_id").eqNullSafe(F.col("owner"))).withColumn("node", node)
    # depth first: routes in order, and down each run
    spread = own.withColumn("path_key", F.array_join("route", "")).repartitionByRange("path_key", "depth").withColumn("part", F.spark_partition_id())
    laid = kept_table(spread.drop("conv_id", "owner", "head", "p1", "p2"), "chat-laid")
    sums = laid.groupBy("part").agg(F.sum("size").alias("total"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("part").alias("o_part"), F.coalesce(F.sum("total").over(over), F.lit(0)).alias("offset"))
    within = Window.partitionBy("part").orderBy("path_key", "depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = laid.join(offsets, laid["part"] == offsets["o_part"]).withColumn("end", F.col("offset") + F.sum("size").over(within))
    starts = starts.withColumn("start", F.col("end") - F.col("size")).withColumn("run", F.element_at("route", -1))
    starts = kept_table(starts.select("node", "depth", "run", "route", "start", "end", "position", F.col("turn_text").alias("text")), "chat-starts")
    runs = kept_table(starts.groupBy("run").agg(F.min("start").alias("run_start"), F.max("end").alias("run_end")), "chat-runs")
    above = starts.select("node", "start", F.col("run").alias("own_run"), F.explode_outer("route").alias("run")).join(runs, "run")
    # of its own run a node sees what comes before it; of the others, all
    seen = above.select("node", F.col("run_start").alias("s"), F.when(F.col("run") == F.col("own_run"), F.col("start")).otherwise(F.col("run_end")).alias("e"))
    reach = seen.where("s < e").groupBy("node").agg(F.sort_array(F.collect_list(F.struct(F.col("s").alias("start"), F.col("e").alias("end")))).alias("ancestors"))
    lead, tail = len("<s> "), len(" </s>\n")
    loss = F.startswith("text", F.lit("<s> "))
    stream = starts.drop("route").join(reach, "node", "left").select(
        "node", "depth", "run", "start", "end", "position",
        F.when(loss, F.col("start") + lead).otherwise(F.col("end")).alias("loss_start"),
        F.when(loss, F.col("end") - tail).otherwise(F.col("end")).alias("loss_end"),
        F.coalesce("ancestors", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("ancestors"),
        "text",
    )
    last = rows.groupBy("conv_id").agg(F.max(F.struct("depth", node.alias("leaf"))).alias("x"))
    return stream, last.select("conv_id", F.col("x.leaf").alias("leaf"), F.col("x.depth").alias("depth"))


def read_paths(stream: DataFrame, conversations: DataFrame) -> DataFrame:
    """``conv_id, start, text, loss`` of every turn of every conversation, found by the leaf's attention intervals.

    Intervals are joined to the nodes by run: the runs are those whose first node lies in an interval.
    """
    leaves = stream.select(F.col("node").alias("leaf"), F.col("start").alias("leaf_start"), F.col("end").alias("leaf_end"), F.col("run").alias("leaf_run"), "ancestors")
    found = conversations.join(leaves, "leaf").select("conv_id", "leaf_start", "leaf_end", "leaf_run", "ancestors")
    itself = F.array(F.struct(F.col("leaf_start").alias("start"), F.col("leaf_end").alias("end")))
    # neighbouring intervals of one run are one: the leaf continues the last interval if that ends where it begins
    spans = found.select("conv_id", F.explode(F.concat("ancestors", itself)).alias("i")).select("conv_id", F.col("i.start").alias("s"), F.col("i.end").alias("e"))
    heads = stream.select(F.col("start").alias("s"), F.col("run").alias("s_run"))
    by_run = spans.join(heads, "s").select("conv_id", "s_run", "s", "e")
    nodes = stream.select(F.col("run").alias("s_run"), "start", "end", "text", (F.col("loss_start") < F.col("end")).alias("loss"))
    return by_run.join(nodes, "s_run").where("start >= s and end <= e").select("conv_id", "start", "text", "loss")


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per conversation from its turns in order. A conversation may go over batches; only digests are held."""
    now, state = None, None
    done: list[tuple] = []

    def close() -> None:
        if state is not None:
            n, turns, chars, loss, size = state
            done.append((None if now == "" else now, n, turns.hexdigest(), chars, loss.hexdigest(), size))

    for pdf in batches:
        for conv, turn, in_loss in zip(pdf["conv_id"], pdf["text"], pdf["loss"]):
            key = "" if conv is None else conv
            if key != now:
                close()
                now, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text, masked = read_turn(turn)
            if masked != in_loss:
                raise ValueError("the loss mask is not where the assistant's text is")
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if masked:
                state[2] += len(text)
                state[3].update(text.encode("utf-8", "surrogatepass"))
            state[4] += len(turn)
        if done:
            yield _frame(done)
            done.clear()
    close()
    if done:
        yield _frame(done)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(stream: DataFrame, conversations: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` as the stream has them."""
    turns = read_paths(stream, conversations)
    rows = turns.select(id_text("conv_id"), "start", "text", "loss").repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "start")
    schema = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.select("conv_id", "text", "loss").mapInPandas(_digests, schema).withColumn("conv_id", id_number("conv_id"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """Lay out ``turns`` (``conv_id, turn, role, text``; others are not read) and read every conversation back.

    Null texts and roles are empty; rows without a ``conv_id`` are one conversation. Repeated rows are repeated turns.
    An empty table gives no rows.
    """
    stream, conversations = prefix_tree(turns)
    return read_back(kept_table(stream, "chat-stream"), conversations)
