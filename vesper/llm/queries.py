"""The queries over the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25, bpe, chat, frames, jaccard, line_dedup, mixing, packing, quality_model, quality_rules, repair, sparse_rank, sqltext, suffix_dedup, toxicity


def op1_chat_formatting(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    rows = frames.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    segments = chat.format_conversations(rows.unionByName(own), tokenizer or public_tokenizer("byte_bpe_50k.json"))
    return chat.digests(segments).drop("n_tokens", "n_loss_tokens")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.clean(frames.table(spark, sf_dir, "documents")).drop("clean_text")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.judge(frames.table(spark, sf_dir, "documents"), frames.table(spark, sf_dir, "labels"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(frames.table(spark, sf_dir, "documents"), k=4, percent=85)


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose doc_id is divisible by 50, as a query against all rows."""
    docs = frames.table(spark, sf_dir, "documents")
    return bm25.search(docs, docs.where("doc_id % 50 = 0"))


def op6_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(frames.table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return packing.pack(frames.table(spark, sf_dir, "documents"), tokenizer or public_tokenizer("byte_bpe_50k.json"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(frames.table(spark, sf_dir, "documents")).drop("spans")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(frames.table(spark, sf_dir, "documents"), frames.table(spark, sf_dir, "labels"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup(frames.table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_units", "n_removed", "chars_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    import public_tokenizers

    path, pattern = ranks or public_tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    said = bpe.decode(bpe.encode(frames.table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return said.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_lexical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_rank.rank(frames.table(spark, sf_dir, "documents"), frames.table(spark, sf_dir, "benchmark"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(*repair.repair(repair.damaged(frames.table(spark, sf_dir, "conversations")), whole=True))


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict:
    return {f.__name__: f for f in (op1_chat_formatting, op2_quality_rules, op3_quality_classifier, op4_ngram_jaccard_join, op5_topk_search, op6_mixing_sources, op7_best_fit_packing, op8_suffix_array_dedup, op9_toxicity, op10_substring_dedup, op11_byte_bpe, op12_lexical_rank, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_formatting": chat.ORACLE,
        "op2_quality_rules": sqltext.QUALITY_RULES,
        "op4_ngram_jaccard_join": sqltext.jaccard_components(4, 85),
        "op6_mixing_sources": mixing.ORACLE,
        "op8_suffix_array_dedup": sqltext.SUFFIX_DEDUP,
        "op10_substring_dedup": line_dedup.ORACLE,
        "op12_lexical_rank": sparse_rank.ORACLE,
        "op13_conversation_repair": repair.ORACLE,
    }
