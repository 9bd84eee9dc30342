"""One query per operator, over its whole table and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.llm.bpe import encode_documents
from claimlake.llm.chat_tree import format_conversations
from claimlake.llm.collocations import collocations
from claimlake.llm.decontam import contaminated
from claimlake.llm.dialogue_repair import conversation_digests, repair
from claimlake.llm.html_text import main_text
from claimlake.llm.lines import line_bitmaps
from claimlake.llm.oracles import CHAT_SQL, LINE_SQL, PHRASE_SQL, TOKEN_SQL, quality_sql, url_sql
from claimlake.llm.pii import pii_spans, span_digests
from claimlake.llm.quality import quality_verdicts
from claimlake.llm.rowkeys import kept_table, read_table
from claimlake.llm.blob_ledger import scan_documents
from claimlake.llm.simhash import near_groups
from claimlake.llm.token_rollup import commit_batch, count_tokens, totals
from claimlake.llm.url_rules import judge_urls, rule_table
from claimlake.session import scratch_path

#: Rules of the URL query: host, path, action.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer file; it is installed with the Python of every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_verdicts(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("failed_rules", ",").alias("failed_rules"),
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(pii_spans(read_table(spark, sf_dir, "documents")))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read_table(spark, sf_dir, "documents"), words=3, bits=64, radius=3)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_bitmaps(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start_word", "n_words", "distance", "similarity")


def op7_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches over the whole table: all documents come in under two tokenizer versions, copies of a smaller
    ``doc_id`` go, and texts with markup signs are counted again without those; the second is sent twice."""
    docs = read_table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    markup = "[#*$%&|<>!]+"
    counted = docs.select(
        "doc_id", "source", "lang", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"),
        count_tokens(F.col("text"), "words-1").alias("words"),
        count_tokens(F.col("text"), "pieces-1").alias("pieces"),
        F.when(F.col("text").rlike(markup), count_tokens(F.regexp_replace("text", markup, ""), "words-1")).alias("revised"),
    )
    counted = kept_table(counted, "token-counts")
    firsts = counted.groupBy("h", "g").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "g", "first_id")
    # written, so that the join shuffles both sides itself and Spark can split the copies of one text
    firsts = kept_table(firsts, "token-firsts")
    counted = kept_table(counted.join(firsts, ["h", "g"], "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))), "token-rows")
    change = lambda rows, kind, tokenizer, old, new: rows.select(
        "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(kind).alias("kind"), F.expr(old).alias("old_tokens"), F.expr(new).alias("new_tokens")
    )
    store = scratch_path(spark, "token-rollup")
    commit_batch(change(counted, "insert", "words-1", "null", "words"), store, "words")
    commit_batch(change(counted, "insert", "pieces-1", "null", "pieces"), store, "pieces")
    copies = counted.where("copy")
    gone = change(copies, "delete", "words-1", "words", "null").unionByName(change(copies, "delete", "pieces-1", "pieces", "null"))
    commit_batch(gone, store, "copies")
    commit_batch(gone, store, "copies")
    commit_batch(change(counted.where("revised is not null and not copy"), "revise", "words-1", "words", "revised"), store, "markup")
    return totals(spark, store)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"), rule_table(spark, URL_RULES))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return format_conversations(turns.unionByName(own))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table as the first commit of a new ledger."""
    found = scan_documents(read_table(spark, sf_dir, "documents"), scratch_path(spark, "blob-ledger"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read_table(spark, sf_dir, "pages"))


def beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join by ``conv_id``, nulls equal to nulls."""
    right = right.withColumnRenamed("conv_id", "right_id")
    return left.join(right, left["conv_id"].eqNullSafe(right["right_id"]), "left").drop("right_id")


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with planted faults: by the CRC of ``conv_id:turn``, a row of twenty is dropped, one emptied, one
    loses its sentence ends, one comes twice, one is said by the user."""
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20).alias("fault"),
    ).where("fault != 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    report, fixed = repair(damaged(turns))
    found = beside(report, conversation_digests(fixed))
    every = turns.select("conv_id").distinct()
    numbers = [F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return beside(every, found).select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


ORACLES: dict[str, str] = {
    "op1_quality_rules": quality_sql(),
    "op5_line_dedup": LINE_SQL,
    "op7_token_rollup": TOKEN_SQL,
    "op8_url_filter": url_sql(URL_RULES),
    "op9_chat_format": CHAT_SQL,
    "op13_collocations": PHRASE_SQL,
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_pii": op2_pii,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_bpe": op4_bpe,
    "op5_line_dedup": op5_line_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_token_rollup": op7_token_rollup,
    "op8_url_filter": op8_url_filter,
    "op9_chat_format": op9_chat_format,
    "op10_secret_scan": op10_secret_scan,
    "op11_html_text": op11_html_text,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_collocations": op13_collocations,
}
