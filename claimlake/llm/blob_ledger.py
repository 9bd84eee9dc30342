"""Secret scans with a ledger of blobs.

Every version of a text is named by its digest. The ledger has a row for each blob and rule version scanned, with
what was found. A commit scans the blobs that the ledger does not know for its rule version, each once however many
paths hold it, and findings are joined back to all paths. The ledger is a folder of Parquet files, one folder per
rule version and batch; sending a batch again writes nothing new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from claimlake.llm.rowkeys import kept_table
from claimlake.llm.spans import joined, matches, ranked

RULE_VERSION = "2"
BASE = ["assign", "access", "hex"]
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++""",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"[0-9a-f]{24,}+",
    "pem": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----",
    "jwt": r"eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+",
    "forge": r"gh[pousr]_[A-Za-z0-9]{36,}+",
}
#: Kinds by rule version; a new list is a new version.
RULES = {"1": BASE, "2": [*BASE, "pem", "jwt", "forge"]}
#: Text without any of these has no match.
NEEDS = {"access": ["AKIA"], "pem": ["-----BEGIN "], "jwt": [".eyJ"], "forge": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"]}
LEAST_VALUE = 6
BLOB = "blob string, kind_spans array<struct<start:int,rank:int,end:int,kind:string>>"


def scan(text: Column, kind: str) -> Column:
    """``start, end, piece`` of a kind's findings."""
    found = matches(text, PATTERNS[kind])
    if kind == "assign":
        value = lambda p: F.regexp_extract(p, r"""(?s)^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(.*)$""", 1)
        found = F.filter(found, lambda s: F.length(value(s["piece"])) >= LEAST_VALUE)
    if kind not in NEEDS:
        return found
    some = F.lit(False)
    for need in NEEDS[kind]:
        some = some | F.contains(text, F.lit(need))
    return F.when(some, found).otherwise(F.array().cast("array<struct<start:int,end:int,piece:string>>"))


def blob_of(text: Column) -> Column:
    """A text's content address; null is the empty text."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def ledger(spark: SparkSession, store: str, rule_version: str) -> DataFrame:
    """``blob, kind_spans`` of everything scanned with a rule version; empty before the first commit."""
    try:
        return spark.read.schema(BLOB).option("recursiveFileLookup", "true").parquet(f"{store}/scans/rules={rule_version}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], BLOB)


def commit(versions: DataFrame, store: str, batch: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """Scan the blobs of ``versions`` (``text``) that the ledger lacks for ``rule_version`` and return the ledger.

    The new rows go to the folder of ``batch``; a batch that was cut off by a failure is simply sent again.
    """
    spark = versions.sparkSession
    known = ledger(spark, store, rule_version).select("blob")
    blobs = versions.select(blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    unseen = blobs.groupBy("blob").agg(F.first("text").alias("text")).join(known, "blob", "left_anti")
    kinds = RULES[rule_version]
    found = unseen.select("blob", *[scan(F.col("text"), k).alias(k) for k in kinds])
    rows = found.select("blob", F.concat(*[ranked(F.col(k), k, i) for i, k in enumerate(kinds)]).alias("kind_spans"))
    # an append: a repeated batch finds its blobs in the ledger and adds no rows
    rows.write.mode("append").parquet(f"{store}/scans/rules={rule_version}/batch={batch}")
    return ledger(spark, store, rule_version)


def findings(versions: DataFrame, scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, blob, kind_spans`` for every row of ``versions``: what its blob holds, an empty array for nothing.

    Ledger rows repeated by a batch that was written twice count once.
    """
    hits = scanned.where(F.size("kind_spans") > 0).dropDuplicates(["blob"]).withColumnRenamed("blob", "s_blob")
    # written, so that the join shuffles both sides itself and Spark can split the paths of one blob
    hits = kept_table(hits, "blob-hits")
    paths = versions.select(F.col(key), blob_of(F.col("text")).alias("blob"))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    return paths.join(hits, paths["blob"] == hits["s_blob"], "left").select(key, "blob", F.coalesce("kind_spans", empty).alias("kind_spans"))


def scan_documents(docs: DataFrame, store: str, batch: str = "first", rule_version: str = RULE_VERSION) -> DataFrame:
    """``doc_id``, counts of the base kinds, the digest of the base spans and the list of all, for every row of ``docs``.

    A null text is an empty one without findings. Rows with one text share a scan. An empty table gives no rows.
    """
    rows = findings(docs, commit(docs, store, batch, rule_version))
    base = F.filter("kind_spans", lambda s: s["rank"] < len(BASE))
    count = lambda k: F.size(F.filter("kind_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("kind_spans")).alias("spans"), "blob")
