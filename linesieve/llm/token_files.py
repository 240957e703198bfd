"""Token ids in Parquet list columns: dictionary-coded ids, delta-coded positions, small pages with indexes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ship, text_or_empty
from .words import word_encoder

FILE_SCHEMA = "shard int, doc_id bigint, shard_start bigint, n_tokens bigint, ids array<int>"
_FILE_ARROW = pa.schema([
    ("shard", pa.int32()), ("doc_id", pa.int64()), ("shard_start", pa.int64()), ("n_tokens", pa.int64()),
    ("ids", pa.list_(pa.int32())),
])

#: Second-version pages code positions as deltas; ids use a dictionary, which holds any vocabulary of 16 bits.
#: Every column chunk gets a page index, so that a reader can skip to the pages of some documents.
FILE_OPTIONS = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#shard_start": "false",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.page.row.count.limit": "2000",
    "compression": "zstd",
}


def _tokenise(tokenizer_path: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_path)
        position = 0
        for batch in batches:
            for first, end, ids, counts in encoder.encode(batch.column(2)):
                ends = np.cumsum(counts)
                if end_id is not None:
                    ids = np.insert(ids, ends, end_id)
                    counts = counts + 1
                    ends = np.cumsum(counts)
                offsets = np.concatenate(([0], ends)).astype(np.int32)
                rows = slice(first, end)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[rows], batch.column(1)[rows], pa.array(position + ends - counts),
                    pa.array(counts.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))),
                ], schema=_FILE_ARROW)
                position += int(ends[-1])

    return run


def write_token_files(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = None, id_col: str = "doc_id",
    text_col: str = "text", row_group_bytes: int = 16 << 20, page_bytes: int = 128 << 10,
) -> None:
    """Writes every document's ids, `end_id` last, as one row of a Parquet file, in ascending id order over the files.

    Files are ranges of ids, numbered by `shard`; inside one, `shard_start` counts the ids before the document. A null
    text is empty, a null id comes first, and rows that share an id lie next to each other in the order of their texts.
    An empty table gives a folder without rows. Other columns are ignored.
    """
    ship(docs.sparkSession)
    ordered = (
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("body"))
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "body")
        .select(F.spark_partition_id().alias("shard"), "doc_id", "body")
    )
    rows = ordered.mapInArrow(_tokenise(tokenizer_path, end_id), FILE_SCHEMA)
    writer = rows.write.mode("overwrite").options(**FILE_OPTIONS)
    writer.option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids; columns not asked for are not read.

    The base of each shard comes from the narrow columns alone: one row per file.
    """
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = rows.groupBy("shard").agg(F.max(F.col("shard_start") + F.col("n_tokens")).alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "shard").select(
        "doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids"
    )


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids, as little-endian unsigned 32-bit numbers, of each row read."""
    ship(tokens.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            offsets = np.asarray(lists.offsets)
            values = np.ascontiguousarray(np.asarray(lists.values), dtype="<u4")
            crcs = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            counts = pa.array(np.diff(offsets).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts, pa.array(crcs, pa.int64())], schema=schema)

    return tokens.select("doc_id", "start", "ids").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
