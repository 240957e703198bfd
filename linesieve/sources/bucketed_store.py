"""A store bucketed by the leading characters of the digest: puts append generations, a manifest names those that count."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linesieve.functions import patterns as P
from linesieve.operators.store import ARTIFACT, assign_ids, latest_puts
from linesieve.sources.staging import stage

STEM = "stem"


class BucketedStore:
    """Artifacts in ``buckets`` files a generation, cut and sorted by the first characters of the digest.

    Rows with one digest, and digests whose ids may collide, share a bucket, so reading, refreshing and giving ids
    exchange only the rows of the put. A put writes a generation of its own and then a manifest with the next number;
    a manifest is created in one step and never replaced, so of two puts at a time one fails, and a reader sees a put
    whole or not at all. ``merge`` rewrites all generations into one.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        number, found = self._manifest()
        self.buckets = found["buckets"] if found else buckets

    # ---- manifest -----------------------------------------------------------------------------

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _manifest(self) -> tuple[int, dict | None]:
        fs, where = self._fs(f"{self.path}/manifest")
        if not fs.exists(where):
            return 0, None
        number = max((int(f.getPath().getName()) for f in fs.listStatus(where) if f.getPath().getName().isdigit()), default=0)
        if not number:
            return 0, None
        line = self.spark.read.text(f"{self.path}/manifest/{number:09d}").first()
        return number, json.loads(line.value)

    def _commit(self, after: int, generations: list[str]) -> None:
        """Creates the manifest that follows number ``after``; refused if another put was faster."""
        fs, where = self._fs(f"{self.path}/manifest/{after + 1:09d}")
        _, draft = self._fs(f"{self.path}/manifest/_draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "generations": generations}).encode() + b"\n"))
        out.close()
        # A rename onto an existing name is refused, so the manifest appears whole or not at all.
        try:
            done = not fs.exists(where) and fs.rename(draft, where)
        except Py4JJavaError:
            done = False
        if not done:
            fs.delete(draft, False)
            raise RuntimeError(f"another put has changed {self.path}")

    # ---- tables -------------------------------------------------------------------------------

    def _write(self, rows: DataFrame) -> str:
        name = f"g{uuid.uuid4().hex}"
        table = f"linesieve_{name}"
        dealt = rows.select(*ARTIFACT, F.substring("sha256", 1, P.ID_LENGTHS[0]).alias(STEM)).repartition(self.buckets, STEM)
        (
            dealt.write.bucketBy(self.buckets, STEM).sortBy(STEM).option("compression", "zstd").format("parquet")
            .option("path", f"{self.path}/data/{name}").saveAsTable(table)
        )
        self.spark.sql(f"DROP TABLE {table}")
        return name

    def rows(self) -> DataFrame:
        """All rows of all generations, known to Spark as cut by ``stem``."""
        _, found = self._manifest()
        if found is None:
            schema = "id string, sha256 string, created_at timestamp, command array<string>, cwd string, exit_code int, kind string, " \
                "encoding string, payload binary, raw_bytes long, raw_lines long, stem string"
            return self.spark.createDataFrame([], schema)
        generations = found["generations"]
        table = f"linesieve_read_{uuid.uuid4().hex}"
        schema = self.spark.read.parquet(f"{self.path}/data/{generations[0]}").schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        self.spark.sql(
            f"CREATE TABLE {table} ({columns}, generation string) USING parquet PARTITIONED BY (generation) "
            f"CLUSTERED BY ({STEM}) SORTED BY ({STEM}) INTO {found['buckets']} BUCKETS LOCATION '{self.path}/data'"
        )
        parts = " ".join(f"PARTITION (generation='{g}') LOCATION '{self.path}/data/{g}'" for g in generations)
        self.spark.sql(f"ALTER TABLE {table} ADD {parts}")
        return self.spark.table(table).drop("generation")

    def read(self) -> DataFrame:
        """The newest row of each artifact, without an exchange."""
        newest = self.rows().groupBy(STEM, "id").agg(F.max_by(F.struct(*[c for c in ARTIFACT if c != "id"]), "created_at").alias("row"))
        return newest.select("id", "row.*").select(*ARTIFACT)

    # ---- puts ---------------------------------------------------------------------------------

    def ids_for(self, new: DataFrame) -> DataFrame:
        """(sha256, id) for the contents of ``new``: known ones keep their id, others get the shortest free prefix.

        Only the new digests are exchanged. A stem of one content needs no more than a look at the stored rows of its
        bucket; the few that several contents share go through ``assign_ids``.
        """
        stem = F.substring("sha256", 1, P.ID_LENGTHS[0]).alias(STEM)
        fresh = new.groupBy(stem, "sha256").agg(F.min("created_at").alias("first_put"))
        fresh = fresh.groupBy(STEM).agg(F.count(F.lit(1)).alias("_n"), F.min("sha256").alias("sha256"))
        held = self.rows().groupBy(STEM).agg(
            F.min("sha256").alias("_least"), F.max("sha256").alias("_most"), F.min_by("id", F.length("id")).alias("_id")
        )
        seen = stage(fresh.join(held, STEM, "left"), "stems")
        alone = (F.col("_n") == 1) & (F.col("_least").isNull() | ((F.col("_least") == F.col("sha256")) & (F.col("_most") == F.col("sha256"))))
        simple = seen.where(alone).select("sha256", F.coalesce("_id", STEM).alias("id"))
        shared = seen.where(~alone).select(STEM)
        if shared.isEmpty():
            return simple
        contested = new.select("sha256", "created_at", stem).join(shared, STEM, "left_semi").drop(STEM)
        owners = self.rows().join(shared, STEM, "left_semi").select("id", "sha256").distinct()
        return simple.unionByName(assign_ids(contested.distinct(), owners).select("sha256", "id").distinct())

    def put(self, new: DataFrame) -> None:
        """Adds the rows (the columns of an artifact without ``id``); equal content refreshes its row, later rows win."""
        number, found = self._manifest()
        rows = latest_puts(new)
        named = rows.join(self.ids_for(rows.select("sha256", "created_at")), "sha256")
        self._commit(number, [*(found["generations"] if found else []), self._write(named)])

    def merge(self) -> None:
        """Rewrites the newest rows as one generation; the files of the earlier ones stay until ``sweep``."""
        number, found = self._manifest()
        if found is not None:
            self._commit(number, [self._write(self.read())])

    def sweep(self) -> int:
        """Deletes generations that the newest manifest doesn't name, and earlier manifests; returns their number.

        For times without readers or puts: a put that isn't committed yet would lose its files.
        """
        number, found = self._manifest()
        live, gone = set(found["generations"]) if found else set(), 0
        for folder, keep in (("data", lambda n: n in live), ("manifest", lambda n: n == f"{number:09d}")):
            fs, where = self._fs(f"{self.path}/{folder}")
            for file in fs.listStatus(where) if fs.exists(where) else []:
                if not keep(file.getPath().getName()):
                    fs.delete(file.getPath(), True)
                    gone += folder == "data"
        return gone

