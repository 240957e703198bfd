"""Retrieval: requested ids to stored texts, then a slice, an edge or a search, for all requests at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesieve.operators.lines import grep_context, head_lines, slice_lines, tail_lines
from linesieve.operators.store import lookup_artifacts
from linesieve.sources.outputs import explode_lines


def stored_lines(prefixes: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Lines of every uniquely found artifact, after its digest was checked."""
    found = lookup_artifacts(prefixes, artifacts).where(F.col("status") == "found").select("id").distinct()
    texts = artifacts.join(found, "id", "left_semi").where(F.sha2("payload", 256) == F.col("sha256"))
    return explode_lines(texts.select(F.col("id").alias("output_id"), F.col("payload").cast("string").alias("text")))


def show(
    prefixes: DataFrame, artifacts: DataFrame, start: int | None = None, end: int | None = None,
    head: int | None = None, tail: int | None = None, pattern: str | None = None, context: int = 2, fixed: bool = False,
) -> DataFrame:
    """Lines of the requested artifacts: searched, sliced, or cut to head or tail."""
    lines = stored_lines(prefixes, artifacts)
    if pattern is not None:
        return grep_context(lines, pattern, context, fixed)
    if start is not None or end is not None:
        return slice_lines(lines, start, end)
    if head is not None:
        return head_lines(lines, head)
    return lines if tail is None else tail_lines(lines, tail)
