"""Classification reports and metric summaries, each from one pass over the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlake.session import cut_lineage

# Label sets by number of classes, in report order.
OTHER = "other"
LABELS = {2: ["refutes", "supports"], 3: ["refutes", "supports", "not enough info"]}


def _labelled(pred: DataFrame) -> DataFrame:
    return pred.withColumns({"gold": F.trim("gold"), "prediction": F.trim("prediction")})


def confusion_matrix(pred: DataFrame, labels: list[str], dims: list[str] | None = None) -> DataFrame:
    """``(dims, gold, prediction, n)`` with a row for every pair of labels, zeros included.

    Labels outside ``labels``, or missing, are counted as ``other``, so the cells add up to the rows.
    """
    dims = dims or []
    pairs = [(g, p) for g in [*labels, OTHER] for p in [*labels, OTHER]]
    named = lambda c: F.when(F.col(c).isin(labels), F.col(c)).otherwise(F.lit(OTHER))
    sums = [F.count_if((named("gold") == g) & (named("prediction") == p)) for g, p in pairs]
    grid = F.array(*[F.struct(F.lit(g).alias("gold"), F.lit(p).alias("prediction"), s.alias("n")) for (g, p), s in zip(pairs, sums)])
    return _labelled(pred).groupBy(*dims).agg(grid.alias("_grid")).select(*dims, F.inline("_grid"))


def classification_report(pred: DataFrame, labels: list[str], dims: list[str] | None = None) -> DataFrame:
    """``(dims, label, precision, recall, f1, support)`` per label, plus accuracy, macro and weighted means.

    Undefined ratios are 0. Accuracy stands in ``f1`` with null precision and recall. A prediction outside ``labels``
    (or none) is a wrong one. Rows whose gold label is not in ``labels`` are counted in a last line, ``unknown gold``.
    """
    dims = dims or []
    aggs = []
    for i, label in enumerate(labels):
        gold, said = F.col("gold") == label, F.col("prediction") == label
        aggs += [F.count_if(gold & said).alias(f"_tp{i}"), F.count_if(gold).alias(f"_g{i}"), F.count_if(said).alias(f"_p{i}")]
        # a label said of a row with an unknown gold label is no mistake of that label
        aggs[-1] = F.count_if(said & F.col("gold").isin(labels)).alias(f"_p{i}")
    unknown = F.count_if(~F.coalesce(F.col("gold").isin(labels), F.lit(False))).alias("_unknown")
    sums = _labelled(pred).groupBy(*dims).agg(*aggs, unknown)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    rows: list[tuple[Column, Column, Column, Column]] = []
    for i, _ in enumerate(labels):
        tp, gold, said = F.col(f"_tp{i}"), F.col(f"_g{i}"), F.col(f"_p{i}")
        rows.append((ratio(tp, said), ratio(tp, gold), ratio(2 * tp, gold + said), gold))
    total = sum((r[3] for r in rows[1:]), rows[0][3])
    right = sum((F.col(f"_tp{i}") for i in range(1, len(labels))), F.col("_tp0"))
    macro = [sum((r[m] for r in rows[1:]), rows[0][m]) / len(rows) for m in range(3)]
    weighted = [ratio(sum((r[m] * r[3] for r in rows[1:]), rows[0][m] * rows[0][3]), total) for m in range(3)]
    none = F.lit(None).cast("double")
    lines = [(label, *row) for label, row in zip(labels, rows)]
    lines += [("accuracy", none, none, ratio(right, total), total), ("macro avg", *macro, total), ("weighted avg", *weighted, total)]
    lines += [("unknown gold", none, none, none, F.col("_unknown"))]
    names = ("label", "precision", "recall", "f1", "support")
    table = F.array(*[F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(n) for v, n in zip(line, names)]) for line in lines])
    return sums.select(*dims, F.inline(table))


def report_by(pred: DataFrame, dims_table: DataFrame, labels: list[str], key: str = "num_hops") -> DataFrame:
    """Report per group (for example the number of hops) that ``dims_table(id, key)`` gives each prediction."""
    return classification_report(pred.join(dims_table.select("id", key), "id"), labels, [key])


def unmatched_ids(pred: DataFrame, dims_table: DataFrame) -> DataFrame:
    """Predictions whose id has no group."""
    return pred.select("id").join(dims_table.select("id"), "id", "left_anti")


def long_scores(scores: DataFrame, keep: list[str], metrics: list[str]) -> DataFrame:
    """One row per metric: ``(keep, metric, score)``."""
    return scores.unpivot(keep, metrics, "metric", "score")


def mean_metrics(scores: DataFrame, metrics: list[str], by: str = "model") -> DataFrame:
    """``(by, metric, mean, n)``."""
    return long_scores(scores, [by], metrics).groupBy(by, "metric").agg(F.avg("score").alias("mean"), F.count("score").alias("n"))


def compare_models(scores: DataFrame, metrics: list[str], a: str, b: str, by: str = "model") -> DataFrame:
    """Means of two models per metric, their difference ``b - a`` and whether ``b`` is better or worse."""
    rows = long_scores(scores.where(F.col(by).isin(a, b)), [by], metrics)
    means = rows.groupBy("metric").agg(
        F.avg(F.when(F.col(by) == a, F.col("score"))).alias("mean_a"), F.avg(F.when(F.col(by) == b, F.col("score"))).alias("mean_b")
    )
    diff = F.col("mean_b") - F.col("mean_a")
    return means.withColumn("diff", diff).withColumn("verdict", F.when(diff > 0, "better").otherwise("worse"))


def running_means(
    scores: DataFrame, metrics: list[str], order: str = "seq", by: str = "model", every: int = 10
) -> DataFrame:
    """``(by, n, metric means)`` after every ``every`` samples of a group.

    ``order`` is any sortable value, unique within a group. A group may be very large, so the rows are
    partitioned by ranges of (group, order), whatever the values are. Counts and sums per range are added up over
    the ranges first (a row per group and partition); within a range only its own rows are added.
    """
    ranged = scores.select(by, order, *metrics).repartitionByRange(by, order).withColumn("_chunk", F.spark_partition_id())
    rows = cut_lineage(ranged, "running-means")
    per_chunk = rows.groupBy(by, "_chunk").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(m).alias(f"_s_{m}") for m in metrics], *[F.count(m).alias(f"_c_{m}") for m in metrics]
    )
    earlier = Window.partitionBy(by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_chunk.select(
        by,
        "_chunk",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.sum(f"_s_{m}").over(earlier), F.lit(0.0)).alias(f"_s0_{m}") for m in metrics],
        *[F.coalesce(F.sum(f"_c_{m}").over(earlier), F.lit(0)).alias(f"_c0_{m}") for m in metrics],
    )
    within = Window.partitionBy(by, "_chunk").orderBy(order)
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select(
        by,
        "_chunk",
        F.row_number().over(within).alias("_k"),
        *[F.coalesce(F.sum(m).over(so_far), F.lit(0.0)).alias(f"_s_{m}") for m in metrics],
        *[F.count(m).over(so_far).alias(f"_c_{m}") for m in metrics],
    )
    n = F.col("_n0") + F.col("_k")
    mean = lambda m: ((F.col(f"_s0_{m}") + F.col(f"_s_{m}")) / F.nullif(F.col(f"_c0_{m}") + F.col(f"_c_{m}"), F.lit(0))).alias(m)
    joined = local.join(offsets, [by, "_chunk"]).where(n % every == 0)
    return joined.select(by, n.alias("n"), *[mean(m) for m in metrics])


def audit_means(stored: DataFrame, details: DataFrame) -> DataFrame:
    """``(model, metric, stored, recomputed, difference)`` of ``stored(model, metric, stored)`` and detail rows."""
    fresh = details.groupBy("model", "metric").agg(F.avg("score").alias("recomputed"))
    return stored.join(fresh, ["model", "metric"], "full_outer").withColumn("difference", F.abs(F.col("stored") - F.col("recomputed")))
