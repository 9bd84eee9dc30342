"""URL rules: host-suffix and path-prefix expressions, matched by short hashes and confirmed by full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.llm.lines import LOWER, UPPER
from claimlake.llm.rowkeys import kept_table

#: Hex digits of a digest in the join key: 32 bits.
SHORT = 8
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``; else empty."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``host, path, action`` from a list."""
    return spark.createDataFrame(rules, "host string, path string, action string")


def folder(path: Column) -> Column:
    """A path up to its last slash."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 0)


def keyed(df: DataFrame, expression: Column) -> DataFrame:
    """With the full digest of an expression and its short prefix."""
    return df.withColumn("digest", F.sha2(expression, 256)).withColumn("short", F.substring("digest", 1, SHORT))


def expressions(targets: DataFrame, labels: int, depth: int) -> DataFrame:
    """``host, path, digest, short`` of the expressions of distinct ``host, path``.

    All suffixes of the host with up to ``labels`` labels, times the empty path and all folders of the path up to
    ``depth`` deep. The two numbers are the greatest that any rule has, so no expression that could match is left out.
    """
    parts = F.split("host", r"\.", -1)
    n = F.size(parts)
    suffixes = F.transform(F.sequence(F.greatest(n - labels, F.lit(0)), n - 1), lambda i: F.array_join(F.slice(parts, i + 1, n - i), "."))
    steps = F.split("path", "/", -1)
    deep = F.least(F.size(steps) - 1, F.lit(depth))
    folders = F.when(deep < 1, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(deep, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(steps, 1, i), "/"), F.lit("/")))
    )
    prefixes = F.concat(F.array(F.lit("")), folders)
    each = targets.select("host", "path", F.explode_outer(suffixes).alias("suffix"), prefixes.alias("prefixes"))
    each = each.select("host", "path", "suffix", F.explode_outer("prefixes").alias("prefix"))
    return keyed(each, F.concat_ws("\n", "suffix", "prefix")).select("host", "path", "digest", "short")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages`` (``page_id, url``; others are not read).

    ``rules`` has ``host, path, action``. A rule fits its host and its subdomains where the path starts with the
    rule's path. The longest rule wins; of rules as long, that with the longer host, then a block. ``rule`` is its
    host and path, null where none fits, and the verdict is then ``default``. A null url, or one without ``://``,
    has an empty host and path. Rules without a host or an action are left out, a null path counts as empty.
    """
    named = pages.select(F.col("page_id"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    known = rules.where("host is not null and host <> '' and action is not null").select(
        F.translate("host", UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("action").alias("action")
    ).distinct()
    slashes = lambda c: F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit("")))
    size = known.agg(F.max(F.size(F.split("r_host", r"\.", -1))), F.max(slashes(F.col("r_path")))).first()
    known = keyed(known, F.concat_ws("\n", "r_host", folder(F.col("r_path"))))
    known = known.withColumnsRenamed({"digest": "r_digest", "short": "r_short"})
    targets = named.where("host <> ''").select("host", "path").distinct()
    asked = expressions(targets, size[0] or 0, size[1] or 0)
    hits = asked.join(known, asked["short"] == known["r_short"])
    order = F.struct(
        (F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), (F.col("action") == "block").alias("b"), "r_host", "r_path", "action"
    )
    # candidates share the short prefix; the full digest is compared within the aggregate, where it cannot become a join key
    confirmed = (F.col("digest") == F.col("r_digest")) & F.startswith(F.col("path"), F.col("r_path"))
    best = hits.groupBy("host", "path").agg(F.max(F.when(confirmed, order)).alias("best")).where("best is not null")
    # written, so that the join shuffles both sides itself and Spark can split a hot url
    best = kept_table(best.select(F.col("host").alias("b_host"), F.col("path").alias("b_path"), "best"), "url-rules")
    some = named.where("host <> ''")
    out = some.join(best, (some["host"] == best["b_host"]) & (some["path"] == best["b_path"]), "left").select("page_id", "host", "path", "best")
    # no rule fits an empty host
    none = named.where("host = ''").withColumn("best", F.lit(None).cast(best.schema["best"].dataType))
    return out.unionByName(none).select(
        "page_id", "host", "path", F.concat("best.r_host", "best.r_path").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")
    )
