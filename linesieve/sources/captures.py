"""Captures of any size as line tables: files are read in byte ranges, no cell holds more than a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linesieve.functions.text import normalize_newlines, split_lines
from linesieve.operators.chunks import numbered
from linesieve.operators.lines import ID, LINE, N, NO


def read_capture_lines(spark: SparkSession, path: str) -> DataFrame:
    """The line table of text files, one output per file, its id the file's path.

    Spark cuts the files into byte ranges (``spark.sql.files.maxPartitionBytes``); a line belongs to the range in which
    it begins, wherever it ends. Lines are counted per range, and the sums of the ranges before give the line numbers.
    Carriage returns and the rarer line breaks inside a read line open lines of their own, as for texts in one cell,
    with one difference: a file whose last line ends with a rare break and no line feed has an empty line more. Escape
    sequences that span lines stay. Spark lists no empty files: they have no row here or in ``capture_sizes``.
    """
    read = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias(ID), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_seq"), F.col("value"),
    )
    # The read line with its line feed: a final break opens no line, so nothing is lost and nothing added.
    parts = split_lines(normalize_newlines(F.concat("value", F.lit("\n"))))
    lines = read.select(ID, "_start", "_seq", F.posexplode(parts).alias("_sub", LINE))
    placed = numbered(lines, [ID], ["_seq", "_sub"], "_start", 1, NO, N)
    return placed.select(ID, NO, N, LINE)


def capture_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(output_id, raw_bytes) of the files, from their metadata alone."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias(ID), F.col("length").alias("raw_bytes"))
