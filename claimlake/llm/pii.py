"""Personal data: spans of four kinds, and the terms around them that give their owners away.

A term discloses a protected entity (one email address, phone number, ...) as far as seeing the term tells which
entity is meant: the pointwise mutual information of the two, as a share of the entity's own information.

    strength(t, e) = log(N * n(t, e) / (n(t) * n(e))) / log(N / n(e))

``N`` different texts, ``n(t)`` of them with the term, ``n(e)`` with the entity and ``n(t, e)`` with the term next to the
entity: copies of a text count once everywhere. It is 1 for a term that is never without the entity. Terms at or over
the threshold, seen in enough different contexts (copies of a context do not make its words look like names), are
marked wherever the documents of the entity have them, and taken out or put in general words by ``sanitise``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlake.functions.binding import let
from claimlake.llm.rowkeys import kept_table
from claimlake.llm.spans import joined, matches, ranked

KINDS = ["email", "ip", "card", "phone"]
#: Possessive forms of the contract's patterns. Where a match may begin is said first, so that a long run is read once.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Text without this has no match.
NEEDS = {"email": "@", "phone": "+"}
TERM = r"\p{L}[\p{L}\p{M}\p{N}]++"
WINDOW = 120
STRENGTH = 0.8
SUPPORT = 3
LEAST_BITS = 1.0


def digits(piece: Column) -> Column:
    return F.regexp_replace(piece, "[^0-9]", "")


def passes_luhn(number: Column) -> Column:
    """Checksum over a string of digits: every second digit from the right doubled, its digits added."""
    at = lambda i: F.substring(F.reverse(number), i, F.lit(1)).cast("int")
    worth = lambda i: F.when(i % 2 == 1, at(i)).when(at(i) > 4, at(i) * 2 - 9).otherwise(at(i) * 2)
    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda s, i: s + worth(i)) % 10 == 0


def valid(kind: str, piece: Column) -> Column:
    """Whether a match of a kind's pattern is one."""
    n = F.length(digits(piece))
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
        return F.forall(F.split(piece, r"\."), lambda x: (F.length(part(x)) <= 3) & (F.substring(part(x), 1, 3).cast("int") <= 255))
    if kind == "card":
        return n.between(14, 19) & F.when(n.between(14, 19), passes_luhn(digits(piece))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def found_spans(text: Column, kind: str) -> Column:
    """``start, end, piece`` of a kind's matches that hold."""
    places = F.filter(matches(text, PATTERNS[kind]), lambda s: valid(kind, s["piece"]))
    need = NEEDS.get(kind)
    return places if need is None else F.when(F.contains(text, F.lit(need)), places).otherwise(F.array().cast("array<struct<start:int,end:int,piece:string>>"))


def keyed_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, row_key, text`` (null as empty); the key tells rows of one id apart."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("row_key"), "text")


def base_spans(texts: DataFrame) -> DataFrame:
    """``doc_id, row_key`` and an array of spans per kind."""
    return texts.select("doc_id", "row_key", *[found_spans(F.col("text"), k).alias(k) for k in KINDS])


def contexts(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """``entity, kind, doc_id, row_key, context`` (a hash), ``terms``: the words next to each protected entity.

    The context of a span is the text between it and the next spans of its kind, up to ``window`` code points and
    without words cut at the edge.
    """
    out = []
    for kind in KINDS:
        some = texts.where(F.contains("text", F.lit(NEEDS[kind]))) if kind in NEEDS else texts
        some = some.withColumn("all", F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))).where(F.size("all") > 0)
        before = lambda p: F.when(F.length(p) > window, F.regexp_replace(F.substring(p, -window, window), r"^\S*", "")).otherwise(p)
        after = lambda p: F.when(F.length(p) > window, F.regexp_replace(F.substring(p, 1, window), r"\S*$", "")).otherwise(p)
        good = lambda fs: F.filter(F.sequence(F.lit(0), F.size(fs) - 1), lambda i: valid(kind, F.get(fs, i)))
        beside = lambda ps, i: F.concat_ws(" ", before(F.get(ps, i)), after(F.get(ps, i + 1)))
        # put together in the row: an exploded row with the parts beside it would hold the whole text
        placed = lambda ps, fs: F.transform(good(fs), lambda i: F.struct(F.get(fs, i).alias("piece"), beside(ps, i).alias("around")))
        each = some.select("doc_id", "row_key", F.explode_outer(let(F.split("text", PATTERNS[kind], -1), F.col("all"), placed)).alias("c"))
        each = each.where("c is not null").select("doc_id", "row_key", "c.piece", "c.around")
        value = F.lower("piece") if kind in ("email", "ip") else digits(F.col("piece"))
        out.append(
            each.select(
                "doc_id", "row_key", F.xxhash64(F.lit(kind), value).alias("entity"), F.xxhash64(F.lower("around")).alias("context"),
                F.array_distinct(F.regexp_extract_all(F.lower("around"), F.lit(TERM), F.lit(0))).alias("terms"),
            )
        )
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole


def disclosing_terms(
    docs: DataFrame, around: DataFrame, strength: float = STRENGTH, support: int = SUPPORT, least_bits: float = LEAST_BITS
) -> DataFrame:
    """``entity, term, strength`` of the terms that give an entity away, from counts over all different texts of ``docs``."""
    seen = around.select("entity", "row_key", "context", F.explode_outer("terms").alias("term")).where("term is not null")
    counted = seen.groupBy("entity", "term").agg(F.count_distinct("row_key").alias("n_both"), F.count_distinct("context").alias("n_contexts"))
    pairs = kept_table(counted.where(F.col("n_contexts") >= support).drop("n_contexts"), "pii-pairs")
    entities = around.select("entity", "row_key").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    once = docs.groupBy("row_key").agg(F.first("text").alias("text"))
    words = F.transform(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)), lambda t: F.xxhash64(t))
    in_docs = once.select(F.explode_outer(F.array_distinct(words)).alias("code")).where("code is not null").groupBy("code").agg(F.count(F.lit(1)).alias("n_term"))
    asked = pairs.withColumn("code", F.xxhash64("term")).join(in_docs, "code").join(entities, "entity")
    asked = asked.withColumn("n_docs", docs.agg(F.count_distinct("row_key")).scalar())
    n_term = F.greatest("n_term", "n_both")
    own = F.log2(F.greatest(F.col("n_docs") / F.col("n_entity"), F.lit(1.0)))
    shared = F.log2(F.col("n_docs") * F.col("n_both") / (n_term * F.col("n_entity")))
    scored = asked.withColumn("own", own).where(F.col("own") >= least_bits).withColumn("strength", shared / F.col("own"))
    return scored.where(F.col("strength") >= strength).select("entity", "term", "strength")


def term_spans(texts: DataFrame, **how: float) -> DataFrame:
    """``doc_id, row_key, term``: places of disclosing terms, a row for each different text that has entities of such."""
    around = kept_table(contexts(texts), "pii-contexts")
    terms = kept_table(disclosing_terms(texts, around, **how), "pii-terms")
    named = around.select("doc_id", "row_key", "entity").distinct().join(terms, "entity")
    per_row = named.groupBy("doc_id", "row_key").agg(F.collect_set("term").alias("terms"))
    per_row = per_row.select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key"), "terms")
    rows = texts.join(per_row.hint("shuffle_hash"), texts["doc_id"].eqNullSafe(per_row["__id"]) & (texts["row_key"] == per_row["__key"]))
    base = F.concat(*[found_spans(F.col("text"), k) for k in KINDS])
    free = lambda s, others: ~F.exists(others, lambda o: (s["start"] < o["end"]) & (o["start"] < s["end"]))
    marked = let(
        matches(F.col("text"), TERM), F.col("terms"), base,
        lambda ms, ts, others: F.filter(ms, lambda m: F.array_contains(ts, F.lower(m["piece"])) & free(m, others)),
    )
    return rows.select("doc_id", "row_key", marked.alias("term")).groupBy("doc_id", "row_key").agg(F.first("term").alias("term"))


def _with_terms(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``rows`` with ``term``, an empty array where there is none."""
    terms = terms.select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key"), F.col("term").alias("__term"))
    found = rows["doc_id"].eqNullSafe(terms["__id"]) & (rows["row_key"] == terms["__key"])
    none = F.array().cast("array<struct<start:int,end:int,piece:string>>")
    joined_rows = rows.join(terms.hint("shuffle_hash"), found, "left")
    return joined_rows.withColumn("term", F.coalesce("__term", none)).drop("__id", "__key", "__term", "row_key")


def pii_spans(docs: DataFrame, **how: float) -> DataFrame:
    """``doc_id``, spans per kind and ``term`` spans of every row of ``docs`` (``doc_id, text`` are read).

    A null text is an empty one and has no spans. Repeated rows give rows each; an empty table gives no rows. Spans
    are ``start, end, piece`` in code points, end exclusive. Term spans that lie in a span of another kind are left out.
    """
    texts = keyed_texts(docs)
    return _with_terms(base_spans(texts), term_spans(texts, **how))


def span_digests(spans: DataFrame) -> DataFrame:
    """``doc_id``, counts per kind, the digest of the base spans and the list of all."""
    base = F.concat(*[ranked(F.col(k), k, i) for i, k in enumerate(KINDS)])
    every = F.concat(base, ranked(F.col("term"), "term", len(KINDS)))
    return spans.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(every).alias("spans"),
        F.size("term").cast("long").alias("n_term"),
    )


def masked(text: Column, pattern: str, spans: Column, tag: str, kept: Column | None = None) -> Column:
    """``text`` with the matches of ``pattern`` that are among ``spans`` put as ``tag``; linear in the text."""
    hit = lambda m, wanted: F.array_contains(wanted, m["start"])
    put = lambda ms, wanted: F.transform(ms, lambda m: F.when(hit(m, wanted), F.lit(tag)).otherwise(m["piece"]))
    build = lambda parts, ms, wanted: F.array_join(
        F.concat(F.flatten(F.zip_with(F.slice(parts, 1, F.size(ms)), put(ms, wanted), lambda p, m: F.array(p, m))), F.slice(parts, -1, 1)), ""
    )
    starts = F.transform(spans, lambda s: s["start"])
    return F.when(F.size(spans) == 0, text).otherwise(let(F.split(text, pattern, -1), matches(text, pattern), starts, build))


def sanitise(docs: DataFrame, general: dict[str, str] | None = None, **how: float) -> DataFrame:
    """``doc_id, text`` with personal data in general words (``[email]``, ...) and disclosing terms as ``[term]``.

    ``general`` gives other words per kind; an empty one removes. Terms go first, then cards, phones, addresses; a
    span that overlaps one already replaced keeps what is left of it as it is.
    """
    words = {k: f"[{k}]" for k in [*KINDS, "term"]} | (general or {})
    texts = keyed_texts(docs)
    rows = _with_terms(texts, term_spans(texts, **how))
    for kind in ["term", "card", "phone", "ip", "email"]:
        pattern = TERM if kind == "term" else PATTERNS[kind]
        if kind != "term":
            rows = rows.withColumn(kind, found_spans(F.col("text"), kind))
        rows = rows.withColumn("text", masked(F.col("text"), pattern, F.col(kind), words[kind]))
    return rows.select("doc_id", "text")
