"""The training-data pipeline: documents through five operators, each stage's table written and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linesieve.llm import exact_dedup, near_dedup, packing, quality, suffix_dedup
from linesieve.llm.common import Workspace, id_remainder
from linesieve.llm.queries import tokenizer


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least 0.3. The classifier learns from labelled documents outside the held-out fifth."""
    held_out = F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out).select("doc_id", "quality")
    model = quality.train_quality(docs, labels)
    return quality.keep_scored(docs, model, 0.3)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal texts, the one with the smallest id; of repeated rows one."""
    return exact_dedup.keep_first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, the one with the smallest id; null ids stay. Near means that at least
    0.8 of the five-word shingles of both are common to them."""
    return near_dedup.keep_representatives(docs, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without byte strings of 100 bytes that occur earlier; all rows stay."""
    return suffix_dedup.without_repeats(docs, length=100)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 4,096 tokens."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [
    ("quality_classifier", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("best_fit_packing", pack),
]

#: The classifier's scores and the packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table over all documents."""
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = space.write(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            space.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
