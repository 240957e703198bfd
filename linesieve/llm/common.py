"""Shared tables, column guards and sized joins used by the operators of this package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in bytes, that a join may copy to every executor; a larger side is shuffled.
BROADCAST_BYTES = 32 << 20


_SHIPPED: set[str] = set()
#: Folders of the workspaces of each application.
_ROOTS: dict[str, list[str]] = {}


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once an application, so that it need not be installed there."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    package = Path(__file__).resolve().parents[1]
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="linesieve-")), f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as file:
        for path in sorted(package.rglob("*.py")):
            file.write(path, path.relative_to(package.parent))
    context.addPyFile(archive)


class Workspace:
    """Tables written once under the cluster's shared folder, so that a lost executor costs a reread and no rerun.

    The folder is `spark.checkpoint.dir`; where that is unset, as in tests, it is the session's warehouse folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        conf = spark.sparkContext.getConf()
        root = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
        self.spark = spark
        self.root = f"{root.rstrip('/')}/linesieve-{name}-{uuid.uuid4().hex}"
        _ROOTS.setdefault(spark.sparkContext.applicationId, []).append(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, **options: object) -> DataFrame:
        """Writes the table and returns it as read from its files."""
        writer = df.write.mode("overwrite")
        for key, value in options.items():
            writer = writer.option(key, value)
        writer.parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_workspaces(spark: SparkSession) -> int:
    """Deletes the tables that the application's operators have left, once their results are written; returns the number
    of folders. Results read from them can't be read any more."""
    roots = _ROOTS.pop(spark.sparkContext.applicationId, [])
    for root in roots:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(roots)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores in front until no column of `df` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def keep_matching(df: DataFrame, ids: DataFrame, key: str, rows: int, row_bytes: int = 16, how: str = "left_semi") -> DataFrame:
    """Rows of `df` whose key is in `ids`, or is not with `how` as left_anti; `rows` is the counted size of `ids`, which
    decides how the sides meet."""
    small = rows * row_bytes <= BROADCAST_BYTES
    return df.join(F.broadcast(ids) if small else ids.hint("merge"), key, how)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
