"""BPE encoding with a deterministic automaton, and decoding by its arc labels.

The automaton reads tokens. It starts as one state with an arc for every symbol, and every merge ``u v -> w`` adds
a gadget, in order of priority: the state that ``u`` arcs lead to is copied without its ``v`` arc, ``u`` arcs lead
to the copy from then on, and every state with a ``u`` arc gets a ``w`` arc to where the ``v`` arc led. So after
``u`` no ``v`` can follow, because ``w`` would have been merged, and each string has exactly one path: its BPE
encoding.

All arcs of a token lead to one state, so a state is named by its token, and the table stays as small as the merge
list: the arcs that were lost with the time of the loss, and for each merged token its time and its two parts.
Whether a state has an arc follows from how it was copied: see ``has_arc``.

Words are spelled by the longest arc first, over a table of byte transitions.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlake.llm.rowkeys import id_number, id_text

#: Words whose encoding a task remembers; further words are encoded each time they come.
REMEMBERED = 400_000
#: A time after every merge.
END = 1 << 60


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where Latin-1 prints it, else one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Automaton:
    """States by token; times are places in the merge list, -1 for symbols, which are there from the start."""

    def __init__(self, symbols: list[int]):
        self.born = dict.fromkeys(symbols, -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.lost: dict[int, int] = {}

    def has_arc(self, state: int, token: int) -> bool:
        """Whether the state after the token ``state`` has an arc for ``token``.

        It has none if it lost it. Else go back in time: a state younger than the token is a copy of the state of
        its second part just before the merge; a token younger than the state was added where its first part had
        an arc. Losses after the time reached do not count.
        """
        born, lost, parts = self.born, self.lost, self.parts
        before = END
        while True:
            if lost.get(state << 20 | token, END) < before:
                return False
            s, t = born[state], born[token]
            if s < 0 and t < 0:
                return True
            if s >= t:
                state = parts[state][1]
                before = min(before, s)
            else:
                token = parts[token][0]
                before = min(before, t + 1)

    def add(self, u: int, v: int, w: int, when: int) -> None:
        """The gadget of one merge. A merge that can never apply adds nothing."""
        if u in self.born and v in self.born and self.has_arc(u, v):
            self.lost[u << 20 | v] = when
            self.born[w], self.parts[w] = when, (u, v)


def compile_merges(vocab: dict[str, int], merges: list[tuple[str, str]], symbols: list[str]) -> Automaton:
    """The automaton of a merge list over ``symbols`` (those that are no merge result)."""
    made = Automaton([vocab[s] for s in symbols if s in vocab])
    for when, (u, v) in enumerate(merges):
        made.add(vocab[u], vocab[v], vocab[u + v], when)
    return made


class WordBpe:
    """Encoder and decoder for a tokenizer file with word ends, byte symbols and a splitting pattern."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.bytes = byte_symbols()
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        symbols = self.bytes + [b + self.suffix for b in self.bytes]
        self.automaton = compile_merges(model["vocab"], merges, symbols)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")")
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        pattern = splits[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.words = regex.compile(pattern)
        self.labels = {i: t for t, i in (model["vocab"] | self.special).items()}
        self._spell(model["vocab"])
        self._memo: dict[str, bytes] = {}
        self._arcs: dict[int, bool] = {}

    def _spell(self, vocab: dict[str, int]) -> None:
        """Byte transitions: the next place by place and byte, and the tokens that end there, within and at the end of a word."""
        number = {c: b for b, c in enumerate(self.bytes)}
        self.step: dict[int, int] = {}
        self.inner, self.final = [-1], [-1]
        for text, token in vocab.items():
            if token not in self.automaton.born:
                continue
            ends = bool(self.suffix) and text.endswith(self.suffix)
            at = 0
            for c in text.removesuffix(self.suffix) if ends else text:
                key = at << 8 | number[c]
                if key not in self.step:
                    self.step[key] = len(self.inner)
                    self.inner.append(-1)
                    self.final.append(-1)
                at = self.step[key]
            (self.final if ends or not self.suffix else self.inner)[at] = token
            if not self.suffix:
                self.inner[at] = token

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-split word: the path that spells it.

        Takes the longest arc at each place and goes back where the path ends early. A place has one state at most,
        since a prefix has one path, so a place left once as a dead end is never tried again.
        """
        data = word.encode("utf-8", "surrogatepass")
        n, step, inner, known = len(data), self.step.get, self.inner, self._arcs
        state, at, path, waiting, dead = -1, 0, [], [], set()
        while True:
            node, arcs = 0, []  # all tokens that spell the bytes from here, with their ends, shortest first
            for i in range(at, n):
                node = step(node << 8 | data[i])
                if node is None:
                    break
                if i < n - 1:
                    if inner[node] >= 0:
                        arcs.append(i + 1 << 20 | inner[node])
                elif self.final[node] >= 0:
                    arcs.append(n << 20 | self.final[node])
            while True:
                if not arcs:
                    if not path:
                        raise ValueError(f"no path for {word!r}")
                    dead.add(path.pop() >> 20)
                    arcs = waiting.pop()
                    state = path[-1] & 0xFFFFF if path else -1
                    continue
                arc = arcs.pop()
                if state >= 0:
                    key = state << 20 | arc & 0xFFFFF
                    found = known.get(key)
                    if found is None:
                        if len(known) > 1_000_000:
                            known.clear()
                        found = known[key] = self.automaton.has_arc(state, arc & 0xFFFFF)
                    if not found:
                        continue
                if arc >> 20 not in dead:
                    break
            path.append(arc)
            at, state = arc >> 20, arc & 0xFFFFF
            if at == n:
                return [x & 0xFFFFF for x in path]
            waiting.append(arcs)

    def split(self, text: str) -> list[str]:
        """Normalised words: composed, lower case character by character, white space dropped.

        Which code points are letters is this Python's view; some that have no character yet may be seen otherwise
        by a library with other Unicode tables.
        """
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.words.findall(text.lower())

    def _raw(self, word: str) -> bytes:
        found = np.array(self.encode_word(word), "<u4").tobytes()
        if len(self._memo) < REMEMBERED and len(word) < 64:
            self._memo[word] = found
        return found

    def encode_raw(self, text: str) -> bytes:
        """Ids of a whole text as 32-bit numbers, low byte first; the special tokens' own strings become their ids."""
        known, raw, out = self._memo.get, self._raw, []
        for part in self.specials.split(text) if "<|" in text else (text,):
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            else:
                out += [known(w) or raw(w) for w in self.split(part)]
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_raw(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The labels of the ids' arcs, parted by spaces as the format has no decoder of its own."""
        return " ".join(map(self.labels.__getitem__, ids))


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One automaton per Python worker."""
    return WordBpe(path)


def _encoder(path: str, ids: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = word_bpe(path)
        for pdf in batches:
            n, digests, decoded, kept = [], [], [], []
            for text in pdf.pop("text"):
                raw = coder.encode_raw(text or "")
                found = np.frombuffer(raw, "<u4")
                n.append(len(found))
                digests.append(hashlib.sha256(raw).hexdigest())
                decoded.append(hashlib.sha256(coder.decode(found.tolist()).encode("utf-8", "surrogatepass")).hexdigest())
                if ids:
                    kept.append(found.astype(np.int32))
            out = pdf.assign(n_tokens=n, ids_sha256=digests, decoded_sha256=decoded)
            yield out.assign(ids=kept) if ids else out

    return run


def encode_documents(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row of ``docs`` (``doc_id, text``), with ``ids`` on demand.

    ``path`` is the tokenizer file, which has to be at that place on every machine. A null text is an empty one:
    no tokens. A row is encoded by itself, so repeated rows and rows without an id give a row each.
    """
    plain = docs.select(id_text(), F.col("text").cast("string").alias("text"))
    schema = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")
    return plain.mapInPandas(_encoder(path, ids), schema).withColumn("doc_id", id_number())


def _decoder(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = word_bpe(path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [coder.decode(list(x)) if x is not None else None for x in pdf["ids"]]})

    return run


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give a null text."""
    plain = encoded.select(id_text(), F.col("ids").cast("array<int>").alias("ids"))
    return plain.mapInPandas(_decoder(path), "doc_id string, text string").withColumn("doc_id", id_number())
