"""The operators as queries over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe, chat_format, embedding_dedup, exact_dedup, filter_audit, hmm, near_dedup, packing, quality, substring_dedup, suffix_dedup,
    token_files, treap_search,
)
from .common import Workspace, id_remainder
from .oracles import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Path of an installed public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False))
    labels = _table(spark, sf_dir, "labels").filter(~held_out).select("doc_id", "quality")
    scored = quality.score_quality(docs, quality.train_quality(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_hmm_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.hmm_scores(_table(spark, sf_dir, "documents"), id_remainder("doc_id", 7) == 2)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    chats = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.chat_digests(chat_format.format_chats(chats))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1, capacity=4096)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_table(spark, sf_dir, "documents"), percent=85)


def op6_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op7_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark, "tokens").path("ids")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"), end_id=2)
    return token_files.token_digests(token_files.read_token_files(spark, path))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.removal_digests(suffix_dedup.repeated_runs(docs, length=100))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.word_removal_digests(substring_dedup.repeated_words(docs, length=35))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treap_search.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=20)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = [
    op1_quality_classifier, op2_hmm_language_model, op3_chat_format, op4_best_fit_packing, op5_minhash_near_dedup,
    op6_bpe_encode_decode, op7_token_id_output, op8_suffix_array_dedup, op9_embedding_near_dedup, op10_exact_dedup,
    op11_substring_dedup, op12_ranked_search, op13_filter_audit,
]


def queries() -> dict:
    return {query.__name__: query for query in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
