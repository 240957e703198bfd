"""Tables of the store on disk, and report files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linesieve.functions.predicates import redact_command
from linesieve.operators.store import ARTIFACT, latest

RUN = [
    "created_at", "artifact_id", "command", "kind", "profile", "transformed", "quality_passed", "fallback_reason",
    "raw_bytes", "compact_bytes", "raw_lines", "compact_lines", "raw_tokens_est", "compact_tokens_est",
]


SCHEMA = (
    "id string, sha256 string, created_at timestamp, command array<string>, cwd string, exit_code int, kind string, encoding string, "
    "payload binary, raw_bytes long, raw_lines long, run_date date"
)


def write_artifacts(artifacts: DataFrame, path: str, mode: str = "append") -> None:
    """Exact originals and their facts, cut by day, compressed by the file format."""
    dated = artifacts.select(*ARTIFACT, F.to_date("created_at").alias("run_date"))
    dated.write.mode(mode).option("compression", "zstd").partitionBy("run_date").parquet(path)


def as_runs(results: DataFrame, created_at: Column) -> DataFrame:
    """One metrics row per output, transformed or not, with a redacted command."""
    return results.withColumns({"created_at": created_at, "command": redact_command("command")}).select(*RUN)


def append_runs(runs: DataFrame, path: str) -> None:
    runs.withColumn("run_date", F.to_date("created_at")).write.mode("append").partitionBy("run_date").parquet(path)


def read_artifacts(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The newest row of each artifact: a put of known bytes appends a row that refreshes the earlier one.

    A store without any artifact has no files yet and reads as no rows. With ``columns`` no others are read, but for the id
    and the time of the put, so that payloads are exchanged only where they are asked for.
    """
    rows = spark.read.schema(SCHEMA).parquet(path)
    if columns is None:
        return latest(rows, "id", ["created_at"])
    read = list(dict.fromkeys(["id", "created_at", *columns]))
    return latest(rows.select(*read), "id", ["created_at"]).select(*columns)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_report(report: DataFrame, path: str, fmt: str = "json") -> None:
    """A report table as JSON lines or as CSV with a header."""
    if fmt == "csv":
        flat = [
            F.array_join(f.name, "; ").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name)
            for f in report.schema.fields
        ]
        report.select(*flat).write.mode("overwrite").csv(path, header=True)
    elif fmt == "json":
        report.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown report format: {fmt}")
