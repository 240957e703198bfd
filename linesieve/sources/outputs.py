"""Sources: captured outputs, text tables seen as outputs, and the line table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linesieve.functions import patterns as P
from linesieve.functions.knobs import SAFE
from linesieve.functions.text import let, normalize_newlines, split_lines

OUTPUT_DEFAULTS = {
    "command": lambda: F.array().cast("array<string>"),
    "exit_code": lambda: F.lit(0),
    "cwd": lambda: F.lit(None).cast("string"),
    "profile": lambda: F.lit(SAFE),
    "kind_hint": lambda: F.lit(None).cast("string"),
    "min_bytes": lambda: F.lit(P.DEFAULT_MIN_BYTES),
    "min_lines": lambda: F.lit(P.DEFAULT_MIN_LINES),
    "min_savings_ratio": lambda: F.lit(P.DEFAULT_MIN_SAVINGS),
    "store_original": lambda: F.lit(True),
}


def spread(df: DataFrame) -> DataFrame:
    """Deal out a table that has fewer partitions than the session has task slots.

    Large tables have more partitions than slots and are left as they are, so this never shuffles them.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def read_outputs(spark: SparkSession, path: str, fmt: str = "binaryFile") -> DataFrame:
    """Captured outputs: one file per output, or a table that already has the output columns."""
    if fmt == "binaryFile":
        files = spark.read.format("binaryFile").load(path)
        return with_output_defaults(files.select(F.col("path").alias("output_id"), F.col("content").alias("raw")))
    return with_output_defaults(spark.read.format(fmt).load(path))


def with_output_defaults(df: DataFrame, **values) -> DataFrame:
    """Add every missing output column, from ``values`` (a Column or constant) or the default."""
    added = {
        name: (v if isinstance(v, Column) else F.lit(v)) for name, v in values.items()
    }
    for name, default in OUTPUT_DEFAULTS.items():
        if name not in added and name not in df.columns:
            added[name] = default()
    return df.withColumns(added) if added else df


def outputs_from_text(df: DataFrame, id_col: str, text_col: str, **values) -> DataFrame:
    """Any text table as outputs; ``values`` set output columns such as ``profile`` or ``command``."""
    base = df.withColumns(
        {"output_id": F.col(id_col), "raw": F.col(text_col).cast("binary")}
    )
    full = with_output_defaults(base, **values)
    return full.select("output_id", "raw", *OUTPUT_DEFAULTS)


def explode_lines(df: DataFrame, text_col: str = "text", normalize: bool = False) -> DataFrame:
    """One row per text line: 0-based ``line_no``, the output's ``n_lines`` and ``line``.

    All other columns of ``df`` are kept, so facts known per output travel without a join.
    """
    text = normalize_newlines(text_col) if normalize else F.col(text_col)
    keep = [c for c in df.columns if c != text_col]
    numbered = let(
        split_lines(text),
        lambda p: F.transform(
            p, lambda x, i: F.struct(i.cast("long").alias("line_no"), F.size(p).cast("long").alias("n_lines"),
                                     x.alias("line"))
        ),
    )
    return df.select(*keep, F.explode(numbered).alias("_l")).select(*keep, "_l.*")
