"""Scalar text functions, Column in and Column out, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimlake.functions.words import STOP_WORDS

# Whitespace as the source data defines it (Unicode, not only ASCII).
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# The same for the JVM, nested so that three comparisons decide for most characters instead of ten.
JVM_SPACE = r"[\t-\r\x1c-\x20[\x{85}-\x{3000}&&[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]]"

# The same characters one by one, for trimming without a pattern.
_SPACES = "".join(chr(i) for i in [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288])

# Cue phrases before an answer; when several occur the last of this list wins.
ANSWER_CUES = ["final answer:", "the answer is", "the final answer is"]

# How answer words map to a truth value.
TRUE_ANSWERS = ["true", "yes"]
FALSE_ANSWERS = ["false", "no", "it's impossible to say"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim Unicode whitespace on both sides."""
    return F.btrim(_col(c), F.lit(_SPACES))


def process_text(c: Column | str) -> Column:
    """Line breaks become blanks, then trim."""
    return strip(F.replace(_col(c), F.lit("\n"), F.lit(" ")))


def squeeze(c: Column | str) -> Column:
    """Trim and collapse whitespace runs to one blank."""
    return strip(F.regexp_replace(_col(c), f"{JVM_SPACE}+", " "))


def words(c: Column | str) -> Column:
    """Whitespace-separated tokens, no empty ones."""
    return F.filter(F.split(_col(c), f"{JVM_SPACE}+"), lambda t: t != "")


def truncate_tokens(c: Column | str, n: int | None) -> Column:
    """At most ``n`` tokens joined by one blank; text within the limit, or without one, stays as it is."""
    c = _col(c)
    if n is None:
        return c
    toks = words(c)
    return F.when(F.size(toks) > n, F.array_join(F.slice(toks, 1, n), " ")).otherwise(c)


def strip_tags(c: Column | str) -> Column:
    """Remove ``<...>`` markup."""
    return F.regexp_replace(_col(c), "<[^>]+>", "")


def percent_decode(c: Column | str) -> Column:
    """Decode percent escapes; ``+`` stays, and text with a broken escape is left alone."""
    c = _col(c)
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def capitalize_first(c: Column | str) -> Column:
    """Upper-case the first character, keep the rest."""
    c = _col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 2**31 - 1))


def extract_links(c: Column | str) -> Column:
    """All ``href`` targets, decoded, first letter upper-cased."""
    found = F.regexp_extract_all(_col(c), F.lit("""href=['"]?([^'" >]+)"""), F.lit(1))
    return F.transform(found, lambda t: capitalize_first(percent_decode(t)))


def is_stop_token(c: Column | str) -> Column:
    """True for all-punctuation tokens and for English stop words in any case."""
    c = _col(c)
    return c.rlike(r"\A\p{P}+\z") | F.lower(c).isin(STOP_WORDS)


def drop_ngram(gram: Column | str, mode: str = "any") -> Column:
    """Whether an n-gram (array of tokens) is to be dropped."""
    gram = _col(gram)
    if mode == "any":
        return F.exists(gram, is_stop_token)
    if mode == "all":
        return F.forall(gram, is_stop_token)
    if mode == "ends":
        return is_stop_token(F.get(gram, F.lit(0))) | is_stop_token(F.get(gram, F.size(gram) - 1))
    raise ValueError(f"invalid mode: {mode}")


def get_path(c: Column | str, path: str | list[str]) -> Column:
    """Field of a JSON text by name or by list of names."""
    names = [path] if isinstance(path, str) else path
    return F.get_json_object(_col(c), "$" + "".join(f"['{n}']" for n in names))


def get_field(c: Column | str, path: str | list[str]) -> Column:
    """Field of a struct or map column by name or by list of names."""
    out = _col(c)
    for name in [path] if isinstance(path, str) else path:
        out = out[name]
    return out


def is_number_text(c: Column | str) -> Column:
    """Digits with at most one dot, at least one digit."""
    c = _col(c)
    return c.rlike(r"\A\p{Nd}*\.?\p{Nd}*\z") & c.rlike(r"\p{Nd}")


def extract_tag(c: Column | str, tag: str = "answer", which: str = "first") -> Column:
    """Trimmed text between the tag pair; the whole text if one of the two tags is missing.

    ``first`` uses the first opening and the first closing tag independently of each other, ``last`` the
    last ones.
    """
    c = _col(c)
    opening, closing = f"<{tag}>", f"</{tag}>"
    if which == "first":
        start, end = F.instr(c, opening), F.instr(c, closing)
    elif which == "last":
        start, end = _last_position(c, opening), _last_position(c, closing)
    else:
        raise ValueError(f"invalid choice: {which}")
    inner = F.substring(c, start + len(opening), F.greatest(end - start - len(opening), F.lit(0)))
    return F.when((start > 0) & (end > 0), strip(inner)).otherwise(c)


def _last_position(c: Column, part: str) -> Column:
    tail = F.substring_index(c, part, -1)
    return F.when(F.contains(c, F.lit(part)), F.length(c) - F.length(tail) - len(part) + 1).otherwise(F.lit(0))


def count_of(c: Column | str, part: str) -> Column:
    """Number of non-overlapping occurrences of ``part``."""
    c = _col(c)
    gone = F.replace(c, F.lit(part), F.lit(""))
    return ((F.length(c) - F.length(gone)) / len(part)).cast("int")


def drop_final_dot(c: Column | str) -> Column:
    """Remove one dot at the very end."""
    return F.regexp_replace(_col(c), r"\.\z", "")


def answer_from_rationale(c: Column | str) -> Column:
    """Text after the last occurrence of the cue phrase; null without any cue."""
    c = _col(c)
    out = F.lit(None).cast("string")
    for cue in ANSWER_CUES:
        tail = drop_final_dot(strip(F.substring_index(c, cue, -1)))
        out = F.when(F.contains(c, F.lit(cue)), tail).otherwise(out)
    return out


def answer_to_bool(c: Column | str) -> Column:
    """Truth value of an answer text; null when the words are not known."""
    word = strip(F.lower(_col(c)))
    return F.when(word.isin(TRUE_ANSWERS), F.lit(True)).when(word.isin(FALSE_ANSWERS), F.lit(False))
