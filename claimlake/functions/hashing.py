"""Token hashing, hashed text vectors and vector similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimlake.functions.binding import let
from claimlake.functions.multisets import multiset
from claimlake.functions.text import _col

_MASK = 0xFFFFFFFF


def _times(a: Column, factor: int) -> Column:
    """Low 32 bits of a product of 32-bit numbers, in halves so that no product passes 64 bits."""
    low, high = factor & 0xFFFF, factor >> 16
    return (a * F.lit(low) + F.shiftleft((a * F.lit(high)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_MASK))


def _rotated(a: Column, by: int) -> Column:
    return F.shiftleft(a, by).bitwiseAND(F.lit(_MASK)).bitwiseOR(F.shiftright(a, 32 - by))


def murmur3(c: Column | str, seed: int = 0) -> Column:
    """The published 32-bit MurmurHash3 of a text's UTF-8 bytes as an unsigned number, by folding over its bytes."""

    def words_of(digits: Column, size: Column) -> Column:
        # four bytes at a time from the least significant on; a rest is filled up with zeros in front
        four = lambda i: F.substr(digits, i * 8 + 1, F.lit(8))
        byte = lambda w, k: F.substr(w, F.lit(2 * k + 1), F.lit(2))
        turned = lambda w: F.conv(F.concat(*[byte(w, k) for k in (3, 2, 1, 0)]), 16, 10).cast("long")
        count = F.ceil(size / 4).cast("int")
        return F.when(size == 0, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0), count - 1), lambda i: turned(four(i))))

    mix = lambda k: _times(_rotated(_times(k, 0xCC9E2D51), 15), 0x1B873593)

    def folded(ks: Column, size: Column) -> Column:
        # a rest of less than four bytes is mixed in, but not stirred
        whole = F.floor(size / 4)
        step = lambda acc, k: F.struct(
            (acc["i"] + 1).alias("i"),
            let(
                acc["h"].bitwiseXOR(mix(k)), acc["i"] < whole,
                lambda x, full: F.when(full, (_times(_rotated(x, 13), 5) + 0xE6546B64).bitwiseAND(F.lit(_MASK))).otherwise(x),
            ).alias("h"),
        )
        start = F.struct(F.lit(0).cast("long").alias("i"), F.lit(seed).cast("long").alias("h"))
        h = F.aggregate(ks, start, step)["h"].bitwiseXOR(size.cast("long"))
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = let(h, _spread(shift, factor))
        return let(h, lambda x: x.bitwiseXOR(F.shiftright(x, 16)))

    bound = lambda text: let(F.hex(F.encode(text, "UTF-8")), F.octet_length(text), lambda d, n: let(words_of(d, n), n, folded))
    return let(_col(c), lambda t: F.when(t.isNotNull(), bound(t)))


def _spread(shift: int, factor: int):
    return lambda x: _times(x.bitwiseXOR(F.shiftright(x, shift)), factor)


def token_bucket(c: Column | str, buckets: int, exact: bool = True) -> Column:
    """Bucket of a token: unsigned 32-bit murmur3 (seed 0) modulo ``buckets``.

    ``exact=False`` takes Spark's own murmur3, which differs in value but stays in the JVM.
    """
    c = _col(c)
    return (F.pmod(murmur3(c), F.lit(buckets)) if exact else F.pmod(F.hash(c), F.lit(buckets))).cast("int")


def hashed_vector(tokens: Column | str, dims: int = 64) -> Column:
    """Bag of words folded into ``dims`` counters, a stand-in for a sentence embedding.

    One fold over the slots in order: equal slots are counted by runs, the slots between them are filled with zeros.
    """
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)

    def filled(counts: Column) -> Column:
        after = lambda i: F.coalesce(F.get(counts, i + 1)["gram"], F.lit(dims))
        parts = F.transform(counts, lambda s, i: F.concat(F.array(s["n"].cast("double")), zeros(after(i) - s["gram"] - 1)))
        return F.concat(zeros(F.coalesce(F.get(counts, F.lit(0))["gram"], F.lit(dims))), F.flatten(parts))

    return let(multiset(F.transform(_col(tokens), lambda t: F.pmod(F.hash(t), F.lit(dims)))), filled)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors, 0 when one of them has no length."""
    norms = lambda x, y: F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    ratio = lambda x, y: F.when(norms(x, y) == 0, F.lit(0.0)).otherwise(dot(x, y) / norms(x, y))
    return let(_col(a), _col(b), ratio)


def parity(*parts: Column | str | int) -> Column:
    """Repeatable coin: parity of the first hex digit of the md5 of the parts joined by ``:``."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    digit = F.substring(F.md5(F.concat_ws(":", *[c.cast("string") for c in cols])), 1, 1)
    return F.instr(F.lit("02468ace"), digit) > 0
