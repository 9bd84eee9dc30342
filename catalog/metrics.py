"""Evaluation: reports, overlap metrics, means, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.registry import query
from claimlake.functions.hashing import cosine_similarity, hashed_vector
from claimlake.functions.text import words
from claimlake.operators import evaluation as evl
from claimlake.operators import overlap
from claimlake.session import scratch_path
from claimlake.streaming import metrics as stream

_LABELS = evl.LABELS[2]
_GRID = """grid AS (SELECT * FROM (VALUES ('refutes'), ('supports'), ('other')) a(gold), (VALUES ('refutes'), ('supports'), ('other')) b(prediction)),
named AS (SELECT id, CASE WHEN gold IN ('refutes', 'supports') THEN gold ELSE 'other' END AS gold,
                 CASE WHEN prediction IN ('refutes', 'supports') THEN prediction ELSE 'other' END AS prediction FROM pred)"""


def _report(dims: str = "") -> str:
    lead = f"{dims}, " if dims else ""
    part = f"PARTITION BY {dims}" if dims else ""
    group = f"GROUP BY {dims}" if dims else ""
    return f"""marks AS (SELECT *, unnest(['refutes', 'supports']) AS label FROM rows_),
sums AS (SELECT {lead}label, count_if(gold = label AND prediction = label) AS tp, count_if(gold = label) AS support, count_if(prediction = label AND gold IN ('refutes', 'supports')) AS said
         FROM marks GROUP BY {lead}label),
per AS (SELECT {lead}label, CASE WHEN said > 0 THEN tp / said ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
               CASE WHEN said + support > 0 THEN 2 * tp / (said + support) ELSE 0 END AS f1, support, tp FROM sums)
SELECT {lead}label, precision, recall, f1, support FROM per
UNION ALL SELECT {lead}'accuracy', NULL, NULL, sum(tp) / sum(support), CAST(sum(support) AS BIGINT) FROM per {group}
UNION ALL SELECT {lead}'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM per {group}
UNION ALL SELECT {lead}'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM per {group}
UNION ALL SELECT {lead}'unknown gold', NULL, NULL, NULL, count_if(gold NOT IN ('refutes', 'supports')) FROM rows_ {group}"""


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _means(df, *columns):
    """Scores have two decimals, so means can lie halfway between two rounded values; the nudge decides."""
    return df.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in columns})


def _round_sql(sql: str, columns: str, rounded: list[str]) -> str:
    cut = ", ".join(f"round({c}, 6) AS {c}" for c in rounded)
    return f"SELECT {columns}, {cut} FROM ({sql})"


@query(
    "V1_confusion_matrix",
    f"WITH {fx.SQL_PREDICTIONS}, {_GRID} SELECT g.gold, g.prediction, count(p.id) AS n FROM grid g LEFT JOIN named p ON p.gold = g.gold AND p.prediction = g.prediction GROUP BY ALL",
)
def _(spark, d):
    return evl.confusion_matrix(fx.predictions(spark, d), _LABELS)


@query(
    "V2_classification_report",
    _round_sql(f"WITH {fx.SQL_PREDICTIONS}, rows_ AS (SELECT * FROM pred), {_report()}", "label, support", ["precision", "recall", "f1"]),
    whole=["support"],
)
def _(spark, d):
    return _rounded(evl.classification_report(fx.predictions(spark, d), _LABELS), "precision", "recall", "f1")


@query(
    "V3_report_by_hops",
    _round_sql(
        f"WITH {fx.SQL_PREDICTIONS}, rows_ AS (SELECT pred.*, 2 + id % 3 AS num_hops FROM pred), {_report('num_hops')}",
        "num_hops, label, support",
        ["precision", "recall", "f1"],
    ),
    whole=["support"],
)
def _(spark, d):
    return _rounded(evl.report_by(fx.predictions(spark, d), fx.hops(spark, d), _LABELS), "precision", "recall", "f1")


@query("V3_unmatched_ids", "SELECT doc_id AS id FROM labels WHERE doc_id NOT IN (SELECT item_id FROM benchmark)")
def _(spark, d):
    return evl.unmatched_ids(fx.predictions(spark, d), fx.table(spark, d, "benchmark").select(F.col("item_id").alias("id")))


# ---------------------------------------------------------------- overlap of texts


def sql_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda t: t <> '')"


def sql_grams(tokens: str, n: int) -> str:
    return f"list_transform(range(1, len({tokens}) - {n - 1} + 1), lambda i: array_to_string({tokens}[i:i + {n - 1}], ' '))"


def sql_rouge(rows: str, n: int, a: str, b: str, name: str) -> str:
    """CTE ``name(id, p, r, f)`` of n-gram overlap between columns ``a`` and ``b`` of ``rows``."""
    return f"""{name}_t AS (SELECT id, {sql_tokens(a)} AS x, {sql_tokens(b)} AS y FROM {rows}),
{name}_x AS (SELECT id, g, count(*) AS c FROM (SELECT id, unnest({sql_grams('x', n)}) AS g FROM {name}_t) GROUP BY id, g),
{name}_y AS (SELECT id, g, count(*) AS c FROM (SELECT id, unnest({sql_grams('y', n)}) AS g FROM {name}_t) GROUP BY id, g),
{name}_o AS (SELECT x.id, sum(least(x.c, y.c)) AS o FROM {name}_x x JOIN {name}_y y USING (id, g) GROUP BY x.id),
{name}_pr AS (
    SELECT t.id, coalesce(o / nullif(greatest(len(x) - {n - 1}, 0), 0), 0) AS p, coalesce(o / nullif(greatest(len(y) - {n - 1}, 0), 0), 0) AS r
    FROM {name}_t t LEFT JOIN {name}_o USING (id)),
{name} AS (SELECT id, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM {name}_pr)"""


def sql_lcs(rows: str, a: str, b: str, name: str) -> str:
    """CTE ``name(id, p, r, f)`` of the longest common subsequence, row by row of the usual table."""
    # the row's candidates, then their running maximum
    step = """CASE WHEN len(x) = 0 THEN prev ELSE list_reduce(list_prepend([0], list_transform(range(1, len(prev) + 1),
        lambda j: [CASE WHEN x[j] = t THEN coalesce(prev[j - 1], 0) + 1 ELSE prev[j] END])), lambda acc, c: list_append(acc, greatest(acc[len(acc)], c[1])))[2:] END"""
    return f"""{name}_t AS (SELECT id, {sql_tokens(a)} AS x, {sql_tokens(b)} AS y FROM {rows}),
{name}_l AS (
    SELECT id, 0 AS i, list_transform(x, lambda t: 0) AS prev, x, y FROM {name}_t
    UNION ALL
    SELECT id, i + 1, {step.replace("= t ", "= y[i + 1] ")}, x, y FROM {name}_l WHERE i < len(y)),
{name}_pr AS (
    SELECT id, coalesce(coalesce(list_max(prev), 0) / nullif(len(x), 0), 0) AS p, coalesce(coalesce(list_max(prev), 0) / nullif(len(y), 0), 0) AS r
    FROM {name}_l WHERE i = len(y)),
{name} AS (SELECT id, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM {name}_pr)"""


@query(
    "V4_rouge_n",
    f"""WITH {fx.SQL_PAIRS}, {sql_rouge('pairs', 1, 'prediction', 'original', 'r1')}, {sql_rouge('pairs', 2, 'prediction', 'original', 'r2')}
        SELECT id, round(r1.p, 6) AS rouge1_p, round(r1.r, 6) AS rouge1_r, round(r1.f, 6) AS rouge1_f,
               round(r2.p, 6) AS rouge2_p, round(r2.r, 6) AS rouge2_r, round(r2.f, 6) AS rouge2_f FROM r1 JOIN r2 USING (id)""",
)
def _(spark, d):
    scores = overlap.rouge_n(fx.pairs(spark, d), ["id"], "prediction", "original")
    return _rounded(scores, *[c for c in scores.columns if c != "id"])


@query("V4_rouge_n_stemmed")
def _(spark, d):
    scores = overlap.rouge_n(fx.pairs(spark, d), ["id"], "prediction", "original", stem=True)
    return _rounded(scores, *[c for c in scores.columns if c != "id"])


@query(
    "V5_rouge_l",
    f"""WITH RECURSIVE {fx.SQL_PAIRS}, {sql_lcs('pairs', 'mutated', 'gold_evidence', 'rl')}
        SELECT id, round(p, 6) AS p, round(r, 6) AS r, round(f, 6) AS f FROM rl""",
)
def _(spark, d):
    rows = fx.pairs(spark, d).select("id", overlap.rouge_l("mutated", "gold_evidence").alias("s")).select("id", "s.*")
    return _rounded(rows, "p", "r", "f")


@query("V5_rouge_l_long")
def _(spark, d):
    """Whole documents against their own text with words swapped, up to 20,000 words."""
    docs = fx.table(spark, d, "documents").select("doc_id", overlap.rouge_l("text", F.replace("text", F.lit("e "), F.lit("es "))).alias("s"))
    return _rounded(docs.select("doc_id", "s.*"), "p", "r", "f")


def sql_sari(source: str, pred: str, ref: str) -> str:
    tok = lambda x: f"list_filter(regexp_split_to_array(lower({x}), '{fx.SPACE}+'), lambda t: t <> '')"
    parts = " UNION ALL ".join(
        f"SELECT id, {n} AS n, {side} AS side, unnest({sql_grams(col, n)}) AS g FROM st" for n in (1, 2, 3, 4) for side, col in enumerate("xyz")
    )
    return f"""st AS (SELECT id, {tok(source)} AS x, {tok(pred)} AS y, {tok(ref)} AS z FROM pairs),
sc AS (SELECT id, n, g, count_if(side = 0) AS s, count_if(side = 1) AS c, count_if(side = 2) AS r FROM ({parts}) GROUP BY id, n, g),
sn AS (
    SELECT id, n,
           sum(CASE WHEN least(s, c) > 0 THEN least(s, c, r) / least(s, c) END) AS kp, count_if(least(s, c) > 0) AS kn, sum(least(s, c, r)) AS ko, sum(least(s, r)) AS ka,
           sum(CASE WHEN s > c THEN greatest(s - c - r, 0) / (s - c) END) AS dp, count_if(s > c) AS dn,
           count_if(c > 0 AND s = 0 AND r > 0) AS ao, count_if(c > 0 AND s = 0) AS an, count_if(r > 0 AND s = 0) AS aw
    FROM sc GROUP BY id, n),
sp AS (
    SELECT id, n, CASE WHEN kn > 0 THEN kp / kn ELSE 1 END AS kp, CASE WHEN ka > 0 THEN ko / ka ELSE 1 END AS kr, CASE WHEN dn > 0 THEN dp / dn ELSE 1 END AS d,
           CASE WHEN an > 0 THEN ao / an ELSE 1 END AS ap, CASE WHEN aw > 0 THEN ao / aw ELSE 1 END AS ar FROM sn),
sf AS (SELECT id, ((CASE WHEN kp + kr > 0 THEN 2 * kp * kr / (kp + kr) ELSE 0 END) + d + (CASE WHEN ap + ar > 0 THEN 2 * ap * ar / (ap + ar) ELSE 0 END)) / 3 AS v FROM sp),
sari AS (SELECT id, (sum(v) + 4 - count(*)) / 4 * 100 AS sari FROM sf GROUP BY id)"""


@query("V6_sari", f"WITH {fx.SQL_PAIRS}, {sql_sari('mutated', 'prediction', 'original')} SELECT id, round(sari, 6) AS sari FROM sari")
def _(spark, d):
    return _rounded(overlap.sari(fx.pairs(spark, d), ["id"], "mutated", "prediction", ["original"]), "sari")


@query(
    "V7_cosine_similarity",
    """SELECT a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))
           / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS cosine
       FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def _(spark, d):
    a = fx.table(spark, d, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(cosine_similarity("embedding", "other"), 6).alias("cosine"))


@query(
    "X5_hashed_embedding",
    f"""WITH {fx.SQL_PAIRS}, t AS (SELECT id, 0 AS side, unnest({fx.sql_words('lower(mutated)')}) AS w FROM pairs UNION ALL SELECT id, 1, unnest({fx.sql_words('lower(original)')}) FROM pairs),
        slots AS (SELECT w, {fx.sql_murmur3('h', '(length(h) // 2)', 42, True)} % 64 AS slot FROM (SELECT DISTINCT w, hex(w) AS h FROM t)),
        c AS (SELECT id, slot, count_if(side = 0) AS a, count_if(side = 1) AS b FROM t JOIN slots USING (w) GROUP BY ALL),
        n AS (SELECT id, sum(a * b) AS dot, sqrt(sum(a * a)) * sqrt(sum(b * b)) AS norms FROM c GROUP BY id)
        SELECT id, round(coalesce(CASE WHEN norms > 0 THEN dot / norms END, 0), 6) AS cosine FROM pairs LEFT JOIN n USING (id)""",
)
def _(spark, d):
    rows = fx.pairs(spark, d)
    vector = lambda c: hashed_vector(words(F.lower(c)))
    return rows.select("id", F.round(cosine_similarity(vector("mutated"), vector("original")), 6).alias("cosine"))


# ---------------------------------------------------------------- means

_METRICS = ["score", "rank_score"]
_LONG = f"WITH {fx.SQL_SCORES}, long AS (SELECT model, 'score' AS metric, score FROM scores UNION ALL SELECT model, 'rank_score', rank_score FROM scores)"


@query("V8_mean_metrics", f"{_LONG} SELECT model, metric, round(avg(score) + 1e-9, 6) AS mean, count(score) AS n FROM long GROUP BY ALL")
def _(spark, d):
    return _means(evl.mean_metrics(fx.scores(spark, d), _METRICS), "mean")


@query(
    "V9_compare_models",
    f"""{_LONG}, m AS (SELECT metric, avg(score) FILTER (model = 'click') AS mean_a, avg(score) FILTER (model = 'view') AS mean_b FROM long GROUP BY metric)
        SELECT metric, round(mean_a + 1e-9, 6) AS mean_a, round(mean_b + 1e-9, 6) AS mean_b, round(mean_b - mean_a + 1e-9, 6) AS diff, CASE WHEN mean_b - mean_a > 0 THEN 'better' ELSE 'worse' END AS verdict FROM m""",
)
def _(spark, d):
    return _means(evl.compare_models(fx.scores(spark, d), _METRICS, "click", "view"), "mean_a", "mean_b", "diff")


@query(
    "V10_running_means",
    f"""WITH {fx.SQL_SCORES}, r AS (SELECT model, row_number() OVER w AS n, avg(score) OVER w AS score, avg(rank_score) OVER w AS rank_score FROM scores
            WINDOW w AS (PARTITION BY model ORDER BY seq ROWS UNBOUNDED PRECEDING))
        SELECT model, n, round(score + 1e-9, 6) AS score, round(rank_score + 1e-9, 6) AS rank_score FROM r WHERE n % 10 = 0""",
)
def _(spark, d):
    return _means(evl.running_means(fx.scores(spark, d), _METRICS), *_METRICS)


@query(
    "V11_audit_means",
    f"""{_LONG}, fresh AS (SELECT model, metric, avg(score) AS recomputed FROM long GROUP BY ALL),
        stored AS (SELECT model, metric, round(recomputed, 2) AS stored FROM fresh)
        SELECT model, metric, stored, round(recomputed + 1e-9, 6) AS recomputed, round(abs(stored - recomputed) + 1e-9, 6) AS difference FROM stored JOIN fresh USING (model, metric)""",
)
def _(spark, d):
    details = evl.long_scores(fx.scores(spark, d), ["model"], _METRICS)
    stored = evl.mean_metrics(fx.scores(spark, d), _METRICS).select("model", "metric", F.round("mean", 2).alias("stored"))
    return _means(evl.audit_means(stored, details), "recomputed", "difference")


@query(
    "V12_score_pairs",
    f"""WITH RECURSIVE {fx.SQL_PAIRS}, {sql_rouge('pairs', 1, 'prediction', 'original', 'r1')}, {sql_rouge('pairs', 2, 'prediction', 'original', 'r2')},
        {sql_sari('mutated', 'prediction', 'original')}, {sql_lcs('pairs', 'prediction', 'original', 'rl')}
        SELECT id, round(r1.f, 6) AS rouge1, round(r2.f, 6) AS rouge2, round(rl.f, 6) AS "rougeL", round(sari, 6) AS sari
        FROM r1 JOIN r2 USING (id) JOIN rl USING (id) JOIN sari USING (id)""",
)
def _(spark, d):
    scores = overlap.score_pairs(fx.pairs(spark, d), ["id"])
    return _rounded(scores, "rouge1", "rouge2", "rougeL", "sari")


@query(
    "V12_score_pairs_grams",
    f"""WITH {fx.SQL_PAIRS}, {sql_rouge('pairs', 1, 'prediction', 'mutated', 'r1')}, {sql_rouge('pairs', 2, 'prediction', 'mutated', 'r2')},
        {sql_sari('mutated', 'prediction', 'original')}
        SELECT id, round(r1.f, 6) AS rouge1, round(r2.f, 6) AS rouge2, round(sari, 6) AS sari FROM r1 JOIN r2 USING (id) JOIN sari USING (id)""",
)
def _(spark, d):
    """Scores against the mutated text, as one of the two evaluators does."""
    scores = overlap.score_pairs(fx.pairs(spark, d), ["id"], reference_col="mutated").drop("rougeL")
    return _rounded(scores, "rouge1", "rouge2", "sari")


# ---------------------------------------------------------------- stream


@query(
    "ST1_stream_metrics",
    f"WITH {fx.SQL_SCORES} SELECT model, count(*) AS n, round(avg(score) + 1e-9, 6) AS score, round(avg(rank_score) + 1e-9, 6) AS rank_score FROM scores GROUP BY model",
)
def _(spark, d):
    schema = fx.table(spark, d, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    rows = events.select(
        F.col("event_type").alias("model"), F.col("value").alias("score"), F.get_json_object("props", "$.k").cast("double").alias("rank_score")
    )
    path = scratch_path(spark, "metrics")
    stream.publish_metrics(stream.stream_metrics(rows, _METRICS), path).awaitTermination()
    return _means(stream.latest_metrics(spark, path), *_METRICS)
