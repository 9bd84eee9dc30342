"""SimHash near-duplicates: fingerprints, pivot distance tables, links and their components.

1. A fingerprint per document (Arrow batches, numpy).
2. Documents with equal fingerprints are one node from here on.
3. Nodes that can be near each other share a key. For a small radius r the bits are cut into r + 2 blocks; a pair
   within r agrees on two blocks at least, so each pair of blocks is a key and no pair is missed. For a wide
   radius no block survives; keys are then the smallest shingle hashes under several seeds, and a pair with
   Jaccard similarity s shares none of m of them with probability (1 - s) ** m. Each shingle counts once then,
   whatever a text repeats.
4. Nodes of a key are compared through their table of Hamming distances to reference fingerprints (pivots). Two
   nodes within r differ by r at most in every distance, so a greater difference discards the pair; what is left
   is verified on the fingerprints. A key emits a spanning forest of its links, never the links themselves, and a
   crowded key is dealt out as pairs of chunks, so a task holds ``2 * CHUNK`` nodes however large the key.
5. Components by large and small stars. With a wide radius these are candidates only: inside each the sets of
   shingle hashes are compared, pairs at the least Jaccard similarity are links, and their components are the groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlake.llm.components import components
from claimlake.llm.rowkeys import id_number, id_text, kept_table, text_key

SEED = 42
PIVOTS = 16
CHUNK = 2048
MINIMA = 16
SIMILARITY = 0.8
#: Shingles per chunk of a crowded candidate group, which bounds what a task holds of it.
SET_CHUNK = 1 << 20


def shingles(text: str | None, words: int) -> list[bytes]:
    """Runs of ``words`` words (ASCII white space, A-Z lower-cased), repeats included; fewer words: all of them."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(found) <= words:
        return [b" ".join(found)] if found else []
    return list(map(b" ".join, zip(*(found[i:] for i in range(words)))))


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every shingle."""
    found = shingles(text, words)
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), np.uint64, len(found))


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """Another 64-bit hash of a hash."""
    x = h ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def fold(h: np.ndarray, lanes: int = 1) -> np.ndarray:
    """Fingerprint of ``lanes`` 64-bit numbers: a bit is one if set in over half the hashes; no hash: zero."""
    out = np.zeros(lanes, np.uint64)
    for lane in range(lanes if len(h) else 0):
        of = h if lane == 0 else _mixed(h, lane)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(of), 1 << 16):  # the bits of a long text need not all be there at once
            part = np.ascontiguousarray(of[at : at + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[lane] = np.packbits(ones * 2 > len(of), bitorder="little").view("<u8")[0]
    return out


def _as_hex(fp: np.ndarray) -> str:
    return "".join(f"{int(x):016x}" for x in fp)


def _fingerprinter(words: int, lanes: int, minima: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            prints, keys = [], []
            for text in pdf.pop("text"):
                h = shingle_hashes(text, words)
                if minima:
                    h = np.unique(h)
                prints.append(_as_hex(fold(h, lanes)))
                keys.append([int(_mixed(h, 100 + i).min().view(np.int64)) for i in range(minima)] if len(h) else [])
            yield pdf.assign(fingerprint=prints, minima=keys)

    return run


def fingerprints(docs: DataFrame, words: int = 3, bits: int = 64, minima: int = 0) -> DataFrame:
    """``doc_id, key_a, key_b, fingerprint`` (lower-case hex) and ``minima`` for every row of ``docs``; null text: no words, zero.

    With minima the fingerprint is that of the set of shingles, otherwise repeats count.
    """
    key = text_key(F.col("text"))
    plain = docs.select(
        id_text(), key["a"].alias("key_a"), key["b"].alias("key_b"), F.col("text").cast("string").alias("text")
    )
    schema = "doc_id string, key_a long, key_b long, fingerprint string, minima array<long>"
    return plain.mapInPandas(_fingerprinter(words, bits // 64, minima), schema).withColumn("doc_id", id_number())


def pivots(bits: int, n: int = PIVOTS) -> np.ndarray:
    """``n`` reference fingerprints: rows of a Hadamard matrix, so any two of them are half the bits apart."""
    at = np.arange(bits)
    rows = [np.bitwise_count(at & (2 * i + 1)) & 1 for i in range(n)]
    return np.packbits(np.array(rows, np.uint8), axis=1, bitorder="little").view("<u8").reshape(n, bits // 64)


def _words_of(prints: list[str]) -> np.ndarray:
    """Hex fingerprints as rows of 64-bit numbers."""
    raw = np.frombuffer(bytes.fromhex("".join(prints)), ">u8").astype(np.uint64)
    return raw.reshape(len(prints), -1)


def distances(fp: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances of every fingerprint to every reference."""
    return np.bitwise_count(fp[:, None, :] ^ refs[None, :, :]).sum(2).astype(np.int16)


def similar(sets: list[np.ndarray], least: float) -> Callable[[int, np.ndarray], np.ndarray]:
    """Which of some sets (sorted hashes, none empty) have a Jaccard similarity of ``least`` or more with one of them."""
    sizes = np.array([len(s) for s in sets])

    def run(one: int, others: np.ndarray) -> np.ndarray:
        own, n = sets[one], sizes[others]
        out = np.minimum(n, len(own)) / np.maximum(n, len(own)) >= least
        if out.any():
            n = n[out]
            every = np.concatenate([sets[j] for j in others[out]])
            hit = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
            both = np.add.reduceat(hit, np.cumsum(n) - n, dtype=np.int64)
            out[out] = both / (n + len(own) - both) >= least
        return out

    return run


def forest(fp: np.ndarray, refs: np.ndarray, radius: int, confirm: Callable[[int, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """For each of some distinct fingerprints the first one of its component among them, within ``radius``.

    ``confirm`` has the last word on a place and others within the radius of it.
    """
    n = len(fp)
    table = distances(fp, refs)
    order = np.argsort(table[:, 0], kind="stable")
    fp, table = fp[order], table[order]
    root = np.arange(n)
    ends = np.searchsorted(table[:, 0], table[:, 0] + radius, side="right")
    for i in range(n - 1):
        if (end := ends[i]) > i + 1:
            far = np.abs(table[i + 1 : end, 1:] - table[i, 1:]).max(1) > radius
            left = i + 1 + np.flatnonzero(~far)
            left = left[root[left] != root[i]]
            if len(left):
                near = left[np.bitwise_count(fp[left] ^ fp[i]).sum(1) <= radius]
                if confirm and len(near):
                    near = near[confirm(order[i], order[near])]
                if len(near):
                    root[np.isin(root, root[near])] = root[i]
    out = np.empty(n, np.int64)
    out[order] = order[root]
    return out


def _forests(bits: int, radius: int, n_pivots: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        refs = pivots(bits, n_pivots)
        for pdf in batches:
            groups = [list(g) for g in pdf["members"]]
            a, b = [], []
            pairs = [g for g in groups if len(g) == 2]
            if pairs:
                x, y = (_words_of([g[k] for g in pairs]) for k in (0, 1))
                kept = np.abs(distances(x, refs) - distances(y, refs)).max(1) <= radius
                kept &= np.bitwise_count(x ^ y).sum(1) <= radius
                for k in np.flatnonzero(kept):
                    a.append(pairs[k][0])
                    b.append(pairs[k][1])
            for g in (g for g in groups if len(g) > 2):
                for i, r in enumerate(forest(_words_of(g), refs, radius)):
                    if i != r:
                        a.append(g[i])
                        b.append(g[r])
            yield pd.DataFrame({"a": a, "b": b}, dtype=object)

    return run


def block_keys(fingerprint: str, radius: int):
    """Keys of a 64-bit hex fingerprint: each pair of its ``radius + 2`` blocks, with the place of the pair."""
    blocks = radius + 2
    edges = [64 * i // blocks for i in range(blocks + 1)]
    number = F.conv(F.col(fingerprint), 16, -10).cast("long")
    cut = lambda i: (1 << edges[i + 1]) - (1 << edges[i])
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = [signed(cut(i) | cut(j)) for i in range(blocks) for j in range(i + 1, blocks)]
    return F.array(*[F.struct(F.lit(k).alias("at"), number.bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)])


def in_chunks(rows: DataFrame) -> DataFrame:
    """``rows`` dealt to all pairs ``x, y`` of the ``chunks`` of their group; one or two chunks are one pair."""
    own = F.when(F.col("chunks") <= 2, F.lit(0)).otherwise(F.pmod(F.xxhash64("fingerprint"), F.col("chunks")).cast("int"))
    every = F.when(F.col("chunks") <= 2, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(every))
    return dealt.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))


def links(nodes: DataFrame, bits: int, radius: int, n_pivots: int = PIVOTS, chunk: int = CHUNK) -> DataFrame:
    """Edges ``a, b`` whose components are those of all pairs within ``radius`` that share a key.

    ``nodes`` has distinct ``fingerprint`` and ``keys`` (array of ``at, key``).
    """
    rows = kept_table(nodes.select("fingerprint", F.explode("keys").alias("k")).select("k.at", "k.key", "fingerprint"), "simhash-keys")
    # written, so that the join shuffles both sides itself and Spark can split a crowded key
    sizes = kept_table(rows.groupBy("at", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-sizes")
    dealt = in_chunks(rows.join(sizes, ["at", "key"]).withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int")))
    # moved once more: the join's partitioning by key would leave all pairs of chunks of a crowded key in one task
    groups = dealt.repartition("at", "key", "x", "y").groupBy("at", "key", "x", "y").agg(F.collect_list("fingerprint").alias("members"))
    found = groups.where(F.size("members") > 1).select("members").mapInPandas(_forests(bits, radius, n_pivots), "a string, b string")
    return found.distinct()


def _sets(words: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [np.unique(shingle_hashes(text, words)) for text in pdf.pop("text")]
            yield pdf.assign(n=[len(h) for h in found], shingles=[h.astype("<u8").tobytes() for h in found])

    return run


def _confirmed(bits: int, radius: int, n_pivots: int, least: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        refs = pivots(bits, n_pivots)
        for pdf in batches:
            a, b = [], []
            for members in pdf["members"]:
                names = [m["fingerprint"] for m in members]
                sets = [np.frombuffer(m["shingles"], "<u8") for m in members]
                for i, r in enumerate(forest(_words_of(names), refs, radius, similar(sets, least))):
                    if i != r:
                        a.append(names[i])
                        b.append(names[r])
            yield pd.DataFrame({"a": a, "b": b}, dtype=object)

    return run


def confirmed_links(
    docs: DataFrame, nodes: DataFrame, near: DataFrame, words: int, bits: int, radius: int, least: float,
    n_pivots: int = PIVOTS, chunk: int = CHUNK, set_chunk: int = SET_CHUNK,
) -> DataFrame:
    """Edges ``a, b`` whose components are those of all pairs of ``near`` (``node, root``) within one root, within
    ``radius`` and with ``least`` Jaccard similarity of their shingles.

    ``nodes`` has ``fingerprint`` and the ``first`` row of ``docs`` that has it; only texts of ``near`` are read again.
    """
    wanted = nodes.join(kept_table(near, "simhash-near"), F.col("fingerprint") == F.col("node"))
    wanted = wanted.select("fingerprint", "root", F.col("first.doc_id").alias("__id"), F.col("first.key_a").alias("__a"), F.col("first.key_b").alias("__b"))
    key = text_key(F.col("text"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), key["a"].alias("a"), key["b"].alias("b"), F.col("text").cast("string").alias("text"))
    found = texts["id"].eqNullSafe(wanted["__id"]) & (texts["a"] == wanted["__a"]) & (texts["b"] == wanted["__b"])
    texts = texts.join(wanted.hint("shuffle_hash"), found).dropDuplicates(["id", "a", "b"]).select("fingerprint", "root", "text")
    sets = kept_table(texts.mapInPandas(_sets(words), "fingerprint string, root string, n long, shingles binary"), "simhash-sets")
    chunks = F.greatest(F.ceil(F.sum("n") / set_chunk), F.ceil(F.count(F.lit(1)) / chunk)).cast("int")
    sizes = kept_table(sets.groupBy("root").agg(chunks.alias("chunks")), "simhash-set-sizes")
    dealt = in_chunks(sets.join(sizes, "root")).repartition("root", "x", "y")
    groups = dealt.groupBy("root", "x", "y").agg(F.collect_list(F.struct("fingerprint", "shingles")).alias("members"))
    return groups.select("members").mapInPandas(_confirmed(bits, radius, n_pivots, least), "a string, b string").distinct()


def grouped(
    docs: DataFrame, words: int = 3, bits: int = 64, radius: int = 3, wide: bool = False, n_pivots: int = PIVOTS, least: float = SIMILARITY
) -> DataFrame:
    """``doc_id, key_a, key_b, fingerprint, root, component_id`` of every row; ``root`` names the component."""
    if not wide and bits != 64:
        raise ValueError("blocks are cut from 64 bits")
    rows = kept_table(fingerprints(docs, words, bits, MINIMA if wide else 0), "simhash-prints")
    keep = [F.min("doc_id").alias("first_id")] + ([F.max("minima").alias("minima"), F.min(F.struct("doc_id", "key_a", "key_b")).alias("first")] if wide else [])
    nodes = kept_table(rows.groupBy("fingerprint").agg(*keep), "simhash-nodes")
    if wide:
        keyed = nodes.select("fingerprint", F.transform("minima", lambda v, i: F.struct(i.alias("at"), v.alias("key"))).alias("keys"))
    else:
        keyed = nodes.select("fingerprint", block_keys("fingerprint", radius).alias("keys"))
    roots = components(links(keyed, bits, radius, n_pivots))
    if wide:
        roots = components(confirmed_links(docs, nodes, roots, words, bits, radius, least, n_pivots))
    placed = nodes.select("fingerprint", "first_id").join(roots, nodes["fingerprint"] == roots["node"], "left")
    placed = kept_table(placed.select("fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root")), "simhash-placed")
    firsts = kept_table(placed.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-firsts")
    named = placed.join(firsts, "root").select("fingerprint", "root", "component_id")
    return rows.drop("minima").join(named, "fingerprint", "left")


def near_groups(docs: DataFrame, **how) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs`` (``doc_id, text``; others are not read).

    Documents whose fingerprints differ in ``radius`` bits or fewer are linked; ``component_id`` is the smallest
    ``doc_id`` of the component. ``wide`` takes smallest shingle hashes as keys, for a radius too wide for blocks, and
    of the documents within it links those whose sets of shingles have a Jaccard similarity of ``least`` or more.
    A null or empty text has the fingerprint zero and is linked like any other. Rows without an id take part; a
    component of such rows alone has a null id. Repeated rows stay repeated; an empty table gives no rows.
    """
    return grouped(docs, **how).select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """One row, all columns, of each component of ``docs``: the smallest ``doc_id``, rows without an id last.

    Of repeated rows of that id and text one stays.
    """
    groups = grouped(docs, **how)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key_a", "key_b")
    first = groups.groupBy("root").agg(F.min(order).alias("x"))
    first = first.select(F.col("x.doc_id").alias("__id"), F.col("x.key_a").alias("__a"), F.col("x.key_b").alias("__b"))
    key = text_key(F.col("text"))
    keyed = docs.withColumn("__key_a", key["a"]).withColumn("__key_b", key["b"])
    found = keyed["doc_id"].cast("long").eqNullSafe(first["__id"]) & (keyed["__key_a"] == first["__a"]) & (keyed["__key_b"] == first["__b"])
    chosen = keyed.join(first.hint("shuffle_hash"), found, "left_semi")
    return chosen.dropDuplicates(["doc_id", "__key_a", "__key_b"]).drop("__key_a", "__key_b")
