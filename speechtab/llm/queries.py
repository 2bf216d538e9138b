"""Contract queries ``opN_<name>`` over the text operators: name ->
(function of (spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechtab.llm import chat, filter_audit, licenses, merkle, metric_join, mixing, packing, quality, secrets, simhash, suffix_dedup, tokens, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed", ",").alias("failed"))


def op2_simhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_dups(_documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_documents(spark, sf_dir))


#: Production mix: two domains of the twenty sources, English doubled, one source held down.
MIX = mixing.Mix(
    weights={"web": 60, "curated": 40, ("web", "en"): 2, ("curated", "en"): 2, ("web", "en", "src0"): 2},
    domains={f"src{k}": "web" if k < 12 else "curated" for k in range(20)},
    share=0.8,
    epochs=2,
)


def op4_mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).withColumn("n_tokens", mixing.n_words(F.coalesce("text", F.lit(""))))
    out = mixing.select(docs, MIX, tokens="n_tokens")
    leaf = mixing.leaf_columns(MIX)
    return out.select("doc_id", "epoch", *[leaf[c].alias(c) for c in mixing.LEVELS], "n_tokens")


def tokenizer_path(name: str) -> str:
    """Where an installed public vocabulary file lies, on every machine alike."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return toxicity.toxicity(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_documents(spark, sf_dir))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_documents(spark, sf_dir))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filter_audit.filter_audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.drop("filter")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(merkle.document_leaves(_documents(spark, sf_dir), merkle.every_fifth())).withColumnRenamed("id", "doc_id")


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.with_control_case(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return chat.read_back(chat.format_turns(rows)).withColumnRenamed("conv", "conv_id")


#: The conversations and the one of control strings.
WITH_CONTROL_CASE = (
    "(SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, t, CASE WHEN t = 0 THEN 'user' ELSE 'assistant' END, "
    f"'{chat.END}{chat.START}assistant ok' FROM range(2) r(t))"
)

QUERIES: dict = {
    "op1_quality_rules": (op1_quality_rules, quality.oracle_sql()),
    "op2_simhash_near_dups": (op2_simhash_near_dups, None),
    "op3_suffix_dedup": (op3_suffix_dedup, None),
    "op4_mixed_sources": (op4_mixed_sources, mixing.oracle_sql(MIX)),
    "op5_toxicity": (op5_toxicity, None),
    "op6_token_counts": (op6_token_counts, None),
    "op7_secret_scans": (op7_secret_scans, secrets.oracle_sql()),
    "op8_best_fit_packing": (op8_best_fit_packing, None),
    "op9_near_vectors": (op9_near_vectors, metric_join.oracle_sql()),
    "op10_license_scans": (op10_license_scans, licenses.oracle_sql()),
    "op11_filter_audit": (op11_filter_audit, filter_audit.oracle_sql()),
    "op12_merkle_manifest": (op12_merkle_manifest, merkle.oracle_sql()),
    "op13_chat_format": (op13_chat_format, chat.oracle_sql(WITH_CONTROL_CASE)),
}
