"""Benchmark decontamination.

Every window of a document as long as a benchmark item, and with a word shingle in common with it, gets a SimHash of
its weighted shingles. The items' fingerprints are cut into ``radius + 1`` blocks, each with a sorted index: a
fingerprint within the radius agrees on a block at least, so looking up all blocks finds all of them. A similar window
may lie beyond the radius; it shares so much shingle weight with the item that running sums over the common shingles
find it. Windows found either way are verified by the exact weighted Jaccard similarity of their shingles (multisets;
a shingle weighs its length), so the radius decides nothing.
Windows without a common shingle have similarity 0 and need no fingerprint.

Documents are read where they lie. The benchmark goes to the tasks in slices of bounded size; with more than one
slice the documents are read once per slice.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlake.llm.rowkeys import id_number, id_text, kept_table, text_key

WORDS = 5
RADIUS = 16
SIMILARITY = 0.8
#: Characters of benchmark text per slice, which bounds what a task holds of it.
SLICE_CHARS = 16_000_000
PUNCTUATION = b".,;:!?\"'()[]{}"
FOUND = "doc_id string, key_a long, key_b long, item_id long, start_word int, n_words int, distance int, similarity double"


def plain_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, without punctuation."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(None, PUNCTUATION).split()


def shingles(words: list[bytes], n: int) -> list[bytes]:
    return list(map(b" ".join, zip(*(words[i:] for i in range(n)))))


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """Rows of 64 numbers, 1 or -1."""
    raw = np.unpackbits(np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return raw.astype(np.int64) * 2 - 1


def window_prints(found: list[bytes], size: int, starts: np.ndarray) -> np.ndarray:
    """Fingerprints of the windows of ``size`` shingles that begin at ``starts``: the signs of the weighted bit sums."""
    hashes = np.fromiter((xxhash.xxh64_intdigest(s) for s in found), np.uint64, len(found))
    weights = np.fromiter(map(len, found), np.int64, len(found))
    sums = np.zeros((len(found) + 1, 64), np.int64)
    np.cumsum(bits_of(hashes) * weights[:, None], axis=0, out=sums[1:])
    ends = np.minimum(starts + size, len(found))
    return np.packbits(sums[ends] - sums[starts] > 0, axis=1, bitorder="little").view("<u8")[:, 0]


class BlockIndex:
    """Finds all of some fingerprints within ``radius`` of others."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        edges = [64 * i // (radius + 1) for i in range(radius + 2)]
        self.blocks = []
        for low, high in zip(edges, edges[1:]):
            values = self.cut(prints, low, high)
            order = np.argsort(values, kind="stable")
            self.blocks.append((low, high, values[order], order))

    @staticmethod
    def cut(prints: np.ndarray, low: int, high: int) -> np.ndarray:
        return (prints >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)

    def near(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in ``asked`` and in the index of all pairs within the radius, and their distances."""
        pairs = []
        for low, high, values, order in self.blocks:
            own = self.cut(asked, low, high)
            first, last = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
            n = last - first
            a = np.repeat(np.arange(len(asked)), n)
            b = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]
            pairs.append(a * len(self.prints) + b)
        both = np.unique(np.concatenate(pairs))
        a, b = both // len(self.prints), both % len(self.prints)
        far = np.bitwise_count(asked[a] ^ self.prints[b])
        keep = far <= self.radius
        return a[keep], b[keep], far[keep]


class Items:
    """Benchmark items whose shingles have the same number of words."""

    def __init__(self, items: list[tuple[int, list[bytes]]], words: int, radius: int):
        self.words = words
        self.ids = [i for i, _ in items]
        self.n_words = [len(w) for _, w in items]
        found = [shingles(w, words) for _, w in items]
        self.counts = [Counter(s) for s in found]
        self.weights = [sum(map(len, s)) for s in found]
        self.sizes = [len(s) for s in found]
        self.holders: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for at, s in enumerate(found):
            for place, x in enumerate(s):
                self.holders[x].append((at, place))
        self.vocab = {w for _, ws in items for w in ws}
        self.by_size = {}
        for size in set(self.sizes):
            own = [at for at, n in enumerate(self.sizes) if n == size]
            prints = np.concatenate([window_prints(found[at], size, np.array([0])) for at in own])
            self.by_size[size] = (np.array(own), BlockIndex(prints, radius))

    def hits(self, words: list[bytes]) -> list[int]:
        """Places of the shingles that some item has. Runs of words that no item has are passed over."""
        n, vocab = self.words, self.vocab
        known = np.fromiter(map(vocab.__contains__, words), bool, len(words))
        runs = np.convolve(known, np.ones(n, np.int64), "valid") == n
        return [p for p in np.flatnonzero(runs).tolist() if b" ".join(words[p : p + n]) in self.holders]

    def matches(self, words: list[bytes], least: float) -> dict[int, tuple[float, int, int, int]]:
        """For each item found in a document: similarity, distance, first word and words of its best window."""
        best: dict[int, tuple[float, int, int, int]] = {}
        if len(words) < self.words:
            return best
        places = self.hits(words)
        if not places:
            return best
        found = shingles(words, self.words)
        starts_of: dict[int, set[int]] = defaultdict(set)
        places_of: dict[int, list[int]] = defaultdict(list)
        for p in places:
            for at in {at for at, _ in self.holders[found[p]]}:
                places_of[at].append(p)
                size = self.sizes[at]
                last = max(0, len(found) - size)
                starts_of[size].update(range(min(max(0, p - size + 1), last), min(p, last) + 1))
        beyond: dict[int, list[tuple[int, int]]] = defaultdict(list)
        sums = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
        for at, own_places in places_of.items():
            beyond[self.sizes[at]] += [(at, start) for start in self.heavy(at, np.array(own_places), sums, least)]
        for size, wanted in starts_of.items():
            own, index = self.by_size[size]
            starts = np.array(sorted(wanted))
            low = int(starts[0])
            # only the part of the document that the windows cover
            part = found[low : int(starts[-1]) + size]
            prints = window_prints(part, size, starts - low)
            near = {(int(own[b]), int(starts[a])) for a, b, _ in zip(*index.near(prints))}
            for at, start in near.union(beyond[size]):
                sim = self.similarity(found[start : start + size], at)
                if sim >= least and (at not in best or (sim, -start) > (best[at][0], -best[at][2])):
                    far = np.bitwise_count(prints[np.searchsorted(starts, start)] ^ index.prints[np.searchsorted(own, at)])
                    best[at] = (sim, int(far), start, min(size, len(found) - start) + self.words - 1)
        return best

    def heavy(self, at: int, places: np.ndarray, sums: np.ndarray, least: float) -> list[int]:
        """Starts of all windows that can have a similarity of ``least`` with an item.

        ``places`` are those of the item's shingles in the document, ``sums`` running sums of all shingle weights. The
        common weight is at most that of the places in the window, and has to be ``least / (1 + least)`` of the
        weights of window and item.
        """
        held = np.concatenate([[0], np.cumsum(sums[places + 1] - sums[places])])
        if held[-1] < least * self.weights[at]:
            return []
        size, n = self.sizes[at], len(sums) - 1
        last = max(0, n - size)
        starts = np.arange(min(max(0, places[0] - size + 1), last), min(places[-1], last) + 1)
        ends = np.minimum(starts + size, n)
        common = held[np.searchsorted(places, ends)] - held[np.searchsorted(places, starts)]
        weights = sums[ends] - sums[starts] + self.weights[at]
        return starts[(common > 0) & (common * (1 + least) >= least * weights - 1e-6)].tolist()

    def similarity(self, window: list[bytes], at: int) -> float:
        """Weighted Jaccard similarity of a window and an item."""
        counts = self.counts[at]
        both = sum(min(n, counts[s]) * len(s) for s, n in Counter(window).items() if s in counts)
        return both / (sum(map(len, window)) + self.weights[at] - both)


def _searcher(sent, words: int, radius: int, least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_words = defaultdict(list)
        for item, text in sent.value:
            if found := plain_words(text):
                by_words[min(words, len(found))].append((item, found))
        indexes = [Items(items, n, radius) for n, items in by_words.items()]
        names = [x.split()[0] for x in FOUND.split(", ")]
        for pdf in batches:
            rows = []
            for doc, a, b, text in zip(pdf["doc_id"], pdf["key_a"], pdf["key_b"], pdf["text"]):
                found = plain_words(text)
                for index in indexes:
                    for at, (sim, far, start, n) in index.matches(found, least).items():
                        rows.append((doc, a, b, index.ids[at], start, n, far, sim))
            yield pd.DataFrame(rows, columns=names).astype({"item_id": "Int64"})

    return run


def contaminated(
    docs: DataFrame, benchmark: DataFrame, words: int = WORDS, radius: int = RADIUS, least: float = SIMILARITY, slice_chars: int = SLICE_CHARS
) -> DataFrame:
    """``doc_id, key_a, key_b, item_id, start_word, n_words, distance, similarity``: the best window per document and item.

    ``docs`` has ``doc_id, text``, ``benchmark`` ``item_id, text``; other columns are not read. An item with fewer
    than ``words`` words has one shingle, all its words. A document shorter than an item is one window. Of windows as
    similar the first counts. Texts without words, or null, match nothing. Repeated rows give rows each; an empty
    table on either side gives no rows.
    """
    spark = docs.sparkSession
    key = text_key(F.col("text"))
    plain = docs.select(id_text(), key["a"].alias("key_a"), key["b"].alias("key_b"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = 1 + int(chars) // slice_chars
    found = []
    for k in range(slices):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k)
        sent = spark.sparkContext.broadcast([tuple(r) for r in some.collect()])
        part = plain.mapInPandas(_searcher(sent, words, radius, least), FOUND).withColumn("doc_id", id_number())
        found.append(kept_table(part, "decontam-found") if slices > 1 else part)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item."""
    bad = kept_table(contaminated(docs, benchmark, **how).select("doc_id", "key_a", "key_b").distinct(), "decontam-rows")
    bad = bad.select(F.col("doc_id").alias("__id"), F.col("key_a").alias("__a"), F.col("key_b").alias("__b"))
    key = text_key(F.col("text"))
    found = docs["doc_id"].cast("long").eqNullSafe(bad["__id"]) & (key["a"] == bad["__a"]) & (key["b"] == bad["__b"])
    return docs.join(bad.hint("shuffle_hash"), found, "left_anti")
