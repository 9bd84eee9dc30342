"""Word stemming after Porter (1980) with the usual later extensions, as an Arrow function."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlake.functions.text import _col

# Whole words with a stem of their own, and the suffix tables of the published algorithm.
_WHOLE = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning",
    "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
_PLURAL = [("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")]
_DERIVED = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
]
_ENDED = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_DROPPED = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """``c`` and ``v`` per letter; ``y`` is a vowel after a consonant."""
    out = ""
    for ch in word:
        vowel = ch in "aeiou" or (ch == "y" and out.endswith("c"))
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short(stem: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x, y (or is vowel, consonant)."""
    shape = _shape(stem)
    return (shape.endswith("cvc") and stem[-1] not in "wxy") or shape == "vc"


def _swap(word: str, table: list[tuple[str, str]], least: int) -> str:
    for end, new in table:
        if word.endswith(end):
            stem = word[: len(word) - len(end)]
            return stem + new if _measure(stem) > least else word
    return word


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for end in ("ed", "ing"):
        stem = word[: len(word) - len(end)]
        if word.endswith(end) and "v" in _shape(stem):
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c":
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _short(stem) else stem
    return word


def _derive(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _derive(word[:-2])
    if word.endswith("logi"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    return _swap(word, _DERIVED, 0)


def _drop(word: str) -> str:
    for end in _DROPPED:
        if word.endswith(end):
            stem = word[: len(word) - len(end)]
            fits = _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t")))
            return stem if fits else word
    return word


@lru_cache(maxsize=100_000)
def stem_word(word: str) -> str:
    """Stem of one lower-case word."""
    if word in _WHOLE:
        return _WHOLE[word]
    if len(word) <= 2:
        return word
    word = word[:-1] if word.endswith("ies") and len(word) == 4 else _swap(word, _PLURAL, -1)
    word = _past(word)
    if word.endswith("y") and len(word) > 2 and _shape(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    word = _drop(_swap(_derive(word), _ENDED, 0))
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stem_all(tokens: pd.Series, longer_than: pd.Series) -> pd.Series:
    least = int(longer_than.iloc[0]) if len(longer_than) else 0
    return tokens.map(lambda ts: None if ts is None else [stem_word(t) if len(t) > least else t for t in ts])


def stem_tokens(tokens: Column | str, longer_than: int = 0) -> Column:
    """Stems of an array of lower-case tokens; tokens of up to ``longer_than`` letters stay."""
    return _stem_all(_col(tokens), F.lit(longer_than))
