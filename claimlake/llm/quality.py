"""Quality rules with thresholds that follow the data.

Each document gets a few counts. Ratios of them go into quantile sketches per language and source. A sketch
is a histogram of rounded values (exact up to 63, then five leading bits, so a value is off by 6 % at most);
histograms of parts add up to the histogram of the whole, whatever the order. The thresholds are fences around
the middle half of a group. A group's fences are drawn outwards, never inwards, to those of its language and of
everything, each taken for as many rows as ``PRIOR_ROWS``: a group of few documents is judged as mildly as the widest of
them, a large one by its own sketch, and no size is a switch.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlake.llm.rowkeys import WHITE, id_number, id_text, kept_table, same, text_key

SYMBOLS = "#*$%&|<>"
COUNTS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
#: Rule: ratio as whole number, least distance of a fence from the quartiles, and whether a low value is bad too. The
#: least distance decides where both quartiles are the same, as in the last three rules, which most documents have at 0.
RULES = {
    "word_length": ("100 * word_chars div greatest(n_words, 1)", 50, True),
    "symbols": ("1000 * n_symbols div greatest(n_words, 1)", 200, False),
    "dup_lines": ("1000 * n_dup_lines div greatest(n_lines, 1)", 400, False),
    "repeat_words": ("1000 * n_repeat_words div greatest(n_words, 1)", 450, False),
}
SPREADS = 6
PRIOR_ROWS = 20


def count_text(text: str | None) -> tuple[int, int, int, int, int, int]:
    """Words, their characters, symbols, lines with a word, repeats of such lines, words in repeated 3-word windows."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    windows = list(zip(words, words[1:], words[2:]))
    found = Counter(windows)
    repeated = 0
    if len(found) < len(windows):
        end = 0
        for i, w in enumerate(windows):
            if found[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    blank = sum(map(text.count, WHITE))
    return len(words), len(text) - blank, sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in COUNTS.split(", ")]
    for pdf in batches:
        found = pd.DataFrame([count_text(t) for t in pdf.pop("text")], columns=names, index=pdf.index)
        yield pd.concat([pdf, found], axis=1)


def text_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source, key`` and the counts of every document; a null text has no words."""
    plain = docs.select(
        id_text(),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        text_key(F.col("text"))["a"].alias("key_a"),
        text_key(F.col("text"))["b"].alias("key_b"),
        F.col("text").cast("string").alias("text"),
    )
    schema = "doc_id string, lang string, source string, key_a long, key_b long, " + COUNTS
    return plain.mapInPandas(_counted, schema).withColumn("doc_id", id_number())


def rounded(v: Column) -> Column:
    """Bucket of a whole number: itself below 64, else its five leading bits."""
    shift = F.greatest(F.length(F.bin(v)) - 5, F.lit(0))
    power = F.pow(F.lit(2.0), shift).cast("long")
    return F.when(v < 64, v).otherwise(v - F.pmod(v, power))


def sketch(values: DataFrame, by: list[str]) -> DataFrame:
    """``by, rule, bucket, n``: counts per rounded value. Combined before the shuffle, and additive."""
    return values.groupBy(*by, "rule", "bucket").agg(F.sum("n").alias("n"))


def fences(sketched: DataFrame, by: list[str]) -> DataFrame:
    """Quartiles of every sketch, read off its running counts, and the fences around them.

    A quartile is the smallest bucket with at least that share of the rows at or below it.
    """
    w = Window.partitionBy(*by, "rule")
    upto = w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = lambda share: F.min(F.when(F.col("upto") * 4 >= F.col("total") * share, F.col("bucket")))
    quarters = (
        sketched.withColumn("total", F.sum("n").over(w))
        .withColumn("upto", F.sum("n").over(upto))
        .groupBy(*by, "rule")
        .agg(F.max("total").alias("rows"), at(1).alias("q1"), at(3).alias("q3"))
    )
    least = F.create_map(*[F.lit(x) for name, (_, gap, _) in RULES.items() for x in (name, gap)])[F.col("rule")]
    gap = F.greatest(F.lit(SPREADS) * (F.col("q3") - F.col("q1")), least)
    low = F.create_map(*[F.lit(x) for name, (_, _, two) in RULES.items() for x in (name, two)])[F.col("rule")]
    return quarters.select(
        *by, "rule", "rows", (F.col("q3") + gap).alias("high"), F.when(low, F.col("q1") - gap).otherwise(F.lit(-1)).alias("low")
    )


def thresholds(counts: DataFrame, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """One row per language and source: an array with the fences of every rule.

    Sketches of languages and of everything are sums of the sketches of the groups.
    """
    groups = ["lang", "source"]
    ratios = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.expr(e).alias("v")) for name, (e, _, _) in RULES.items()]))
    values = counts.where(~F.col("base_failed")).select(*groups, ratios.alias("r"))
    values = values.select(*groups, "r.rule", rounded(F.col("r.v").cast("long")).alias("bucket"), F.lit(1).cast("long").alias("n"))
    fine = kept_table(sketch(values, groups), "quality-sketch")
    whole = fences(sketch(fine, []), []).select("rule", F.col("high").alias("high_all"), F.col("low").alias("low_all"))
    langs = fences(sketch(fine, ["lang"]), ["lang"]).select(
        F.col("lang").alias("of_lang"), F.col("rule").alias("of_rule"), F.col("rows").alias("rows_lang"),
        F.col("high").alias("high_lang"), F.col("low").alias("low_lang"),
    )
    own = fences(fine, groups)
    both = own.join(langs, own["lang"].eqNullSafe(langs["of_lang"]) & (own["rule"] == langs["of_rule"]), "left").join(whole, "rule", "left")
    # means of fences weighted by rows, in whole numbers
    mean = lambda n, x, y: f"(({n}) * ({x}) + {prior_rows} * ({y})) div (({n}) + {prior_rows})"
    drawn = lambda x: F.expr(mean("rows", x, mean("rows_lang", f"{x}_lang", f"{x}_all")))
    chosen = both.select("lang", "source", "rule", F.greatest("high", drawn("high")).alias("high"), F.least("low", drawn("low")).alias("low"))
    take = lambda name, side: F.max(F.when(F.col("rule") == name, F.col(side)))
    return chosen.groupBy("lang", "source").agg(
        *[take(name, side).alias(f"{name}_{side}") for name in RULES for side in ("high", "low")]
    )


def quality_verdicts(docs: DataFrame, least_words: int = 50, most_repeated: int = 50, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """Counts and verdict for every row of ``docs`` (``doc_id, text, lang, source``; other columns are not read).

    ``base_failed``: fewer than ``least_words`` words, or over ``most_repeated`` percent of the words in repeated
    3-word windows. ``kept``: not failed, and every ratio within the fences of the document's language and source
    (null languages and sources are groups like others). ``failed_rules`` names the ratios outside. A null or empty
    text has zero counts and fails. Repeated rows each get the same verdict; an empty table gives no rows.
    """
    counts = text_counts(docs).withColumn(
        "base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    )
    counts = kept_table(counts, "quality-counts")
    limits = thresholds(counts, prior_rows)
    limits = limits.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *[c for c in limits.columns if c not in ("lang", "source")])
    joined = counts.join(limits, same(counts, limits, ("lang", "t_lang"), ("source", "t_source")), "left")
    outside = [
        F.when((F.expr(e) > F.col(f"{name}_high")) | (F.expr(e) < F.col(f"{name}_low")), F.lit(name)) for name, (e, _, _) in RULES.items()
    ]
    bad = F.array_compact(F.array(*outside))
    return joined.withColumn("failed_rules", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(bad)).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)
    )


def keep_good(docs: DataFrame, **how: int) -> DataFrame:
    """The rows of ``docs`` with all their columns that ``quality_verdicts`` keeps.

    Null and empty texts fail and go; of repeated rows all stay or none; an empty table gives no rows.
    """
    good = quality_verdicts(docs, **how).where("kept").select(F.col("doc_id").alias("g_id"), F.col("key_a").alias("g_a"), F.col("key_b").alias("g_b")).distinct()
    key = text_key(F.col("text"))
    found = docs["doc_id"].cast("long").eqNullSafe(good["g_id"]) & (key["a"] == good["g_a"]) & (key["b"] == good["g_b"])
    return docs.join(good, found, "left_semi")
