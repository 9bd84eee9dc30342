"""Phrases whose words belong together, scored by exact counts of the phrase and of its two parts.

Every word starts a path: itself and up to three following words of its piece. A task turns the sorted paths of its
texts into a count transducer, an acyclic automaton whose arcs are words and whose last states carry weights; equal
last states are stored once. Transducers are cut at the bounds of prefix ranges, moved to their range and united by
adding weights. The weight of a phrase is the sum below its prefix, so one set of paths counts the phrases of every
length, and a range may end anywhere inside a prefix: the sums of the few prefixes that cross a bound are added up
afterwards. No word, pair or language gathers in one task, because bounds are whole paths.

Nulls: text is empty, language is ``und``. Empty or missing texts have no words. Repeated rows count again. Ties are
broken by ``score``, ``a`` and the bytes of the phrase. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlake.llm.rowkeys import kept_table

#: Bytes of text whose paths are sorted together in a task, and bytes of text per prefix range.
SHARD_BYTES, RANGE_BYTES = 6_000_000, 8_000_000
#: Paths sorted at a time, and paths a range gathers before it adds them up.
PATHS, PENDING = 1_500_000, 3_000_000
#: The bounds of the ranges are quantiles of the paths of about so many documents. They decide who counts what, not the counts.
SAMPLE_DOCS, SAMPLE_STEP = 2_000, 50
DEPTH = 4

SEPARATORS = b".,;:!?\n\x0b\x0c\r"
SPACES = bytes.maketrans(SEPARATORS + b"\t", b"\n" * len(SEPARATORS) + b" ")

Paths = tuple[list[bytes], list[np.ndarray], np.ndarray]


def word_ids(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The different words in byte order, and the words of the texts as places in it from 1 on; 0 ends a piece."""
    whole = b"\n".join(texts).lower().translate(SPACES).replace(b"\n", b" \n ")
    found = pc.split_pattern(pa.array([whole], pa.large_binary()), b" ").flatten().dictionary_encode()
    words = found.dictionary.to_pylist()
    order = [i for i in pc.sort_indices(found.dictionary).to_pylist() if words[i] not in (b"", b"\n")]
    rank = np.zeros(len(words), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    rank[[i for i, w in enumerate(words) if w == b""]] = -1
    ids = rank[found.indices.to_numpy(zero_copy_only=False)]
    return [words[i] for i in order], ids[ids >= 0]


def added(size: int, labels: list[np.ndarray], weights: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Paths in order and without repeats, their weights added. ``size`` is the number of words."""
    base = size + 1
    heads, head = np.unique(labels[0] * base + labels[1], return_inverse=True)
    tails, tail = np.unique(labels[2] * base + labels[3], return_inverse=True)
    key = head * len(tails) + tail
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(weights[order], first) if len(key) else weights
    head, tail = heads[key[first] // max(len(tails), 1)], tails[key[first] % max(len(tails), 1)]
    return [head // base, head % base, tail // base, tail % base], total


def paths_of(ids: np.ndarray, size: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Sorted paths of the words ``ids``, some positions at a time; a path ends with its piece and is filled with 0."""
    ids = np.r_[ids, np.zeros(DEPTH, np.int64)]
    for start in range(0, len(ids) - DEPTH, PATHS):
        at = start + np.flatnonzero(ids[start : min(start + PATHS, len(ids) - DEPTH)])
        labels = [ids[at]]
        for step in range(1, DEPTH):
            labels.append(np.where(labels[-1] > 0, ids[at + step], 0))
        if len(at):
            yield added(size, labels, np.ones(len(at), np.int64))


def starts(labels: list[np.ndarray]) -> list[np.ndarray]:
    """For each depth, where a new prefix begins among sorted paths."""
    out, new = [], np.zeros(len(labels[0]), bool)
    new[:1] = True
    for level in labels:
        new = new | np.r_[True, level[1:] != level[:-1]][: len(level)]
        out.append(np.flatnonzero(new))
    return out


def transducer(words: list[bytes], labels: list[np.ndarray], weights: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted paths as an automaton: its words, and for each state the arcs in order.

    The states after three words are registered by their arcs: those with one arc, nearly all, are stored once each.
    """
    used = np.unique(np.concatenate(labels))
    used = used[used > 0]
    local = [np.where(level > 0, np.searchsorted(used, level) + 1, 0) for level in labels]
    at = starts(labels)
    size = len(weights)
    arcs = np.diff(np.r_[at[2], size])
    single = arcs == 1
    code = local[3][at[2][single]] * (int(weights.max()) + 1) + weights[at[2][single]]
    kinds, target = np.unique(code, return_inverse=True)
    targets = np.empty(len(arcs), np.int64)
    targets[single] = target
    targets[~single] = len(kinds) + np.arange(int((~single).sum()))
    many = np.repeat(~single, arcs)
    degree = np.r_[np.ones(len(kinds), np.int64), arcs[~single]]
    label = np.r_[kinds // (int(weights.max()) + 1), local[3][many]]
    weight = np.r_[kinds % (int(weights.max()) + 1), weights[many]]
    below = lambda upper, lower: np.diff(np.searchsorted(lower, np.r_[upper, size]))
    parts = [local[0][at[0]], below(at[0], at[1]), local[1][at[1]], below(at[1], at[2]), local[2][at[2]], targets, degree, label, weight]
    body = np.concatenate([[len(p) for p in parts], *parts]).astype(np.int32)
    return b"\n".join(words[i - 1] for i in used), body.tobytes()


def read_transducer(words: bytes, body: bytes) -> Paths:
    """The sorted paths of an automaton and their weights."""
    whole = np.frombuffer(body, np.int32).astype(np.int64)
    cut = np.cumsum(np.r_[9, whole[:9]])
    one, n1, two, n2, three, targets, degree, label, weight = (whole[a:b] for a, b in zip(cut[:-1], cut[1:]))
    first = np.cumsum(degree) - degree
    n3 = degree[targets]
    arcs = np.repeat(first[targets] - (np.cumsum(n3) - n3), n3) + np.arange(int(n3.sum()))
    level2 = np.repeat(one, n1)
    level3 = np.repeat(np.arange(len(two)), n2)
    up = lambda values: np.repeat(values, n3)
    return words.split(b"\n"), [up(level2[level3]), up(two[level3]), up(three), label[arcs]], weight[arcs]


def united(parts: list[Paths]) -> Paths:
    """One set of sorted paths from several, weights added."""
    found = pa.array([w for words, _, _ in parts for w in words], pa.large_binary()).dictionary_encode()
    order = pc.sort_indices(found.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(1, len(order) + 1)
    ids = rank[found.indices.to_numpy(zero_copy_only=False)]
    labels: list[list[np.ndarray]] = [[] for _ in range(DEPTH)]
    at = 0
    for words, levels, _ in parts:
        own = np.r_[0, ids[at : at + len(words)]]
        at += len(words)
        for whole, level in zip(labels, levels):
            whole.append(own[level])
    total, weights = added(len(order), [np.concatenate(x) for x in labels], np.concatenate([w for _, _, w in parts]))
    return found.dictionary.take(order).to_pylist(), total, weights


def place(bound: tuple[bytes, ...], words: list[bytes], labels: list[np.ndarray]) -> int:
    """How many of the sorted paths are less than ``bound``."""
    low, high = 0, len(labels[0])
    for word, level in zip(bound, labels):
        rank = bisect.bisect_left(words, word) + 1 if word else 0
        cut = low + int(np.searchsorted(level[low:high], rank, "left"))
        if word and (rank > len(words) or words[rank - 1] != word):
            return cut
        low, high = cut, low + int(np.searchsorted(level[low:high], rank, "right"))
    return low


def language_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts by language, some megabytes at a time."""
    waiting: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for lang, text in zip(batch.column("lang").to_pylist(), texts):
            text = text.as_py()
            waiting.setdefault(lang, []).append(text)
            size += len(text) + 1
            if size >= SHARD_BYTES:
                yield from waiting.items()
                waiting, size = {}, 0
    yield from waiting.items()


def path_bounds(docs: DataFrame) -> list[tuple[str, tuple[bytes, ...]]]:
    """Bounds of the prefix ranges as (language, path), from paths of a bounded number of documents."""
    total = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(total, 1))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in language_texts(batches):
            words, ids = word_ids(texts)
            ids = np.r_[ids, np.zeros(DEPTH, np.int64)]
            seen = []
            for i in np.flatnonzero(ids)[::SAMPLE_STEP]:
                path = ids[i : i + DEPTH].tolist()
                path = path[: path.index(0)] if 0 in path else path
                seen.append(b" ".join(words[x - 1] for x in path))
            size = sum(map(len, texts))
            yield pa.RecordBatch.from_pydict(
                {"lang": [lang] * (len(seen) + 1), "path": pa.array([*seen, None], pa.binary()), "size": [0] * len(seen) + [size]}
            )

    seen = docs.sample(share, seed=7).mapInArrow(look, "lang string, path binary, size long").collect()
    size = sum(r["size"] for r in seen) / share
    paths = sorted((r["lang"], tuple(bytes(r["path"]).split(b" "))) for r in seen if r["path"] is not None)
    ranges = max(1, math.ceil(size / RANGE_BYTES))
    bounds = {paths[len(paths) * i // ranges] for i in range(1, ranges)} if paths else set()
    return [(lang, path + (b"",) * (DEPTH - len(path))) for lang, path in sorted(bounds)]


def shard_transducers(docs: DataFrame, bounds: list[tuple[str, tuple[bytes, ...]]]) -> DataFrame:
    """``lang, range, words, arcs``: the transducers of each task's texts, cut at the bounds of the ranges."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in language_texts(batches):
            low = bisect.bisect_left(bounds, (lang,))
            high = bisect.bisect_left(bounds, (lang + "\0",))
            words, ids = word_ids(texts)
            for labels, weights in paths_of(ids, len(words)):
                cuts = [0, *(place(path, words, labels) for _, path in bounds[low:high]), len(weights)]
                for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    if a < b:
                        names, arcs = transducer(words, [level[a:b] for level in labels], weights[a:b])
                        yield pa.RecordBatch.from_pydict(
                            {"lang": [lang], "range": pa.array([low + i], pa.int32()), "words": pa.array([names], pa.binary()), "arcs": pa.array([arcs], pa.binary())}
                        )

    return docs.mapInArrow(build, "lang string, range int, words binary, arcs binary")


def range_counts(shards: DataFrame, ranges: int, least: int) -> DataFrame:
    """``lang, phrase, length, f`` of phrases counted ``least`` times and more, and all words of a language as the
    empty phrase."""

    def phrases(lang: str, parts: list[Paths]) -> pa.RecordBatch:
        words, labels, weights = united(parts)
        out: dict[str, list] = {"lang": [lang], "phrase": [b""], "length": [0], "f": [int(weights.sum())]}
        for depth, at in enumerate(starts(labels)):
            total = np.add.reduceat(weights, at)
            # the first and the last prefix may go on in the ranges beside this one
            wanted = total >= least
            wanted[[0, -1]] = True
            wanted &= labels[depth][at] > 0
            for i, n in zip(at[wanted].tolist(), total[wanted].tolist()):
                out["phrase"].append(b" ".join(words[level[i] - 1] for level in labels[: depth + 1]))
                out["f"].append(n)
                out["length"].append(depth + 1)
        out["lang"] *= len(out["f"])
        return pa.RecordBatch.from_arrays(
            [pa.array(out["lang"]), pa.array(out["phrase"], pa.binary()).cast(pa.string()), pa.array(out["length"], pa.int32()), pa.array(out["f"], pa.int64())],
            ["lang", "phrase", "length", "f"],
        )

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, size = None, [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                # one row at a time: all automata of a batch are large
                row = batch.slice(i, 1).to_pylist()[0]
                here = (row["range"], row["lang"])
                if key is not None and here != key:
                    yield phrases(key[1], parts)
                    parts, size = [], 0
                key = here
                parts.append(read_transducer(row["words"], row["arcs"]))
                size += len(parts[-1][2])
                if size > PENDING:
                    parts, size = [united(parts)], 0
        if key is not None:
            yield phrases(key[1], parts)

    # a range is a partition of its own; dealt by hash, several of them would meet in a task while others had none
    moved = shards.repartitionById(ranges, "range").sortWithinPartitions("range", "lang")
    partial = moved.mapInArrow(unite, "lang string, phrase string, length int, f long")
    return partial.groupBy("lang", "phrase", "length").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("length") == 0))


def phrase_counts(docs: DataFrame, least: int = 30) -> DataFrame:
    """Counts of all phrases of one to four words that occur ``least`` times in their language."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = path_bounds(texts)
    return range_counts(shard_transducers(texts, bounds), len(bounds) + 1, least)


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, share: int = 80) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the ``top`` phrases of each language.

    ``a`` counts the phrase, ``l`` and ``r`` the parts of its worst cut, ``n`` all words. A phrase goes if a longer one
    that contains it has ``share`` percent of its count.
    """
    counts = kept_table(phrase_counts(docs, least), "phrase-counts")
    part = lambda first, size: F.array_join(F.slice("words", first, size), " ")
    found = counts.where("length >= 2").select("lang", "phrase", F.col("length").alias("size"), F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    of = lambda name, value: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(value))

    # a phrase composed with the counts, cut after each of its words; parts are at least as frequent as the phrase
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"head": part(1, F.col("k")), "rest": part(F.col("k") + 1, F.col("size") - F.col("k"))}).drop("words")
    cuts = kept_table(cuts.join(of("head", "l"), ["lang", "head"]), "phrase-heads")
    cuts = kept_table(cuts.join(of("rest", "r"), ["lang", "rest"]), "phrase-parts")
    exact = lambda name: f"cast({name} as decimal(20, 0))"
    score = F.expr(f"({exact('a')} * 2000000) div ({exact('l')} + {exact('r')})")
    worst = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = F.flatten(
        F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " ")))
    )
    longer = found.where("size > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longest")).groupBy("lang", "phrase").agg(F.max("longest").alias("longest"))
    kept = worst.join(longer, ["lang", "phrase"], "left").where(F.expr("longest is null or cast(longest as decimal(20, 0)) * 100 < cast(a as decimal(20, 0)) * %d" % share))

    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    words = counts.where("length = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
