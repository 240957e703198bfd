"""Written intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_written: dict[str, list[str]] = {}
_off: list[bool] = []
_sealed: list[bool] = []
#: Key of this process for staged texts that must not be readable on the disk; it is never written.
_KEY = os.urandom(16)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or where that is unset the session's warehouse folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (folder or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


@contextmanager
def unstaged() -> Iterator[None]:
    """Plans built inside write no intermediate tables: for texts that must not reach the disk."""
    _off.append(True)
    try:
        yield
    finally:
        _off.pop()


def staging() -> bool:
    """Whether ``stage`` writes its tables here."""
    return not _off


def clear_staged(spark: SparkSession) -> int:
    """Deletes the application's staged tables, once their results are written; returns their number."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


@contextmanager
def sealed_staging() -> Iterator[None]:
    """Tables staged inside hold their texts encrypted with a key that only this process has.

    For outputs with a probable secret: later branches read a table, as for all others, and nobody who finds its files
    can read them. The key is part of the plan, so it stands in an event log if one is written; the files are deleted
    by ``clear_staged``.
    """
    _sealed.append(True)
    try:
        yield
    finally:
        _sealed.pop()


def seal(value: Column) -> Column:
    return F.aes_encrypt(value.cast("binary"), F.lit(_KEY))


def unseal(value: Column) -> Column:
    return F.aes_decrypt(value, F.lit(_KEY))


def _plain(field: T.StructField, open_names: set[str]) -> bool:
    """Fields without text, and those named, are written as they are."""
    kind = field.dataType
    return field.name in open_names or not isinstance(kind, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType))


def _sealed_columns(schema: T.StructType, open_names: set[str]) -> list[Column]:
    out = []
    for field in schema.fields:
        value = F.col(f"`{field.name}`")
        if not _plain(field, open_names):
            nested = not isinstance(field.dataType, (T.StringType, T.BinaryType))
            # Options keep what JSON would drop: null fields and the difference of null and empty.
            value = seal(F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"}) if nested else value)
        out.append(value.alias(field.name))
    return out


def _unsealed_columns(schema: T.StructType, open_names: set[str]) -> list[Column]:
    out = []
    for field in schema.fields:
        value = F.col(f"`{field.name}`")
        if not _plain(field, open_names):
            value = unseal(value)
            if isinstance(field.dataType, T.StringType):
                value = value.cast("string")
            elif not isinstance(field.dataType, T.BinaryType):
                value = F.from_json(value.cast("string"), T.StructType([T.StructField("v", field.dataType)]))["v"]
        out.append(value.alias(field.name))
    return out


def stage(df: DataFrame, name: str, partition_by: list[str] = ()) -> DataFrame:
    """Write ``df`` once and read it back: later branches reuse the work and survive lost executors."""
    if _off:
        return df
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/linesieve-{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    open_names = {"output_id", *partition_by}
    written = df.select(*_sealed_columns(df.schema, open_names)) if _sealed else df
    writer = written.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    back = spark.read.schema(written.schema).parquet(path)
    return back.select(*_unsealed_columns(df.schema, open_names)) if _sealed else back
