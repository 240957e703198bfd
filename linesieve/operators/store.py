"""The content-addressed store as a keyed table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linesieve.functions import patterns as P
from linesieve.functions.predicates import redact_command
from linesieve.functions.text import byte_line_count, content_digest

ARTIFACT = [
    "id", "sha256", "created_at", "command", "cwd", "exit_code", "kind", "encoding", "payload", "raw_bytes", "raw_lines",
]
ENCODING = "bytes"


def as_artifacts(results: DataFrame, created_at: Column, raw: str = "raw") -> DataFrame:
    """Store rows of results: exact bytes, digest, redacted command. ``id`` comes with ``assign_ids``."""
    return results.select(
        content_digest(raw).alias("sha256"), created_at.alias("created_at"), redact_command("command").alias("command"),
        "cwd", "exit_code", "kind", F.lit(ENCODING).alias("encoding"), F.col(raw).alias("payload"),
        F.octet_length(raw).cast("long").alias("raw_bytes"), byte_line_count(raw).alias("raw_lines"),
    )


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row per key.

    ``max_by`` over the whole row is an ordinary aggregate: copies of a key meet inside each task
    first, so one content that makes up a third of all rows costs one row per task.
    """
    rest = [c for c in df.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(key).agg(newest).select(key, "_row.*").select(*df.columns)


def latest_puts(new: DataFrame, order: list[str] = ("created_at",)) -> DataFrame:
    """One row per content. Payloads of equal digests are equal bytes, so only one of them is carried."""
    return latest(new, "sha256", list(order))


def assign_ids(new: DataFrame, existing: DataFrame | None = None, lengths: list[int] = P.ID_LENGTHS) -> DataFrame:
    """Give each content the shortest digest prefix that no other content holds.

    Stored ids never change. Within a batch the earliest content keeps a contested prefix and the
    others try the next length. Works on the narrow (digest, time) columns.
    """
    firsts = new.groupBy("sha256").agg(F.min("created_at").alias("first_put"))
    taken = None if existing is None else existing.select(F.col("id").alias("_id"), F.col("sha256").alias("_owner"))
    done = []
    if taken is not None:
        prefixes = F.array(*[F.substring("sha256", 1, n) for n in lengths])
        own = taken.where(F.array_contains(F.array(*[F.substring("_owner", 1, n) for n in lengths]), F.col("_id")))
        held = own.groupBy("_owner").agg(F.min_by("_id", F.length("_id")).alias("id"))
        done.append(firsts.join(held, firsts["sha256"] == held["_owner"]).select("sha256", "id"))
        firsts = firsts.join(held, firsts["sha256"] == held["_owner"], "left_anti")
    open_rows = firsts
    for n in lengths:
        tried = open_rows.withColumn("id", F.substring("sha256", 1, n))
        if taken is not None:
            tried = tried.join(taken, (tried["id"] == taken["_id"]) & (tried["sha256"] != taken["_owner"]), "left")
            tried = tried.withColumn("_busy", F.col("_owner").isNotNull()).drop("_id", "_owner")
        else:
            tried = tried.withColumn("_busy", F.lit(False))
        first = F.row_number().over(Window.partitionBy("id").orderBy("_busy", "first_put", "sha256"))
        ranked = tried.withColumn("_rank", first)
        wins = ~F.col("_busy") & (F.col("_rank") == 1) if n != lengths[-1] else F.lit(True)
        done.append(ranked.where(wins).select("sha256", "id"))
        open_rows = ranked.where(~wins).select("sha256", "first_put")
    ids = reduce(DataFrame.unionByName, done)
    return new.join(ids, "sha256")


def upsert_artifacts(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The table after a put: equal content refreshes its row, later rows win."""
    return latest(existing.select(*ARTIFACT).unionByName(new.select(*ARTIFACT)), "id", ["created_at"])


FENCE = 4  # characters of an id that decide where it is looked for; no valid request is shorter


def lookup_artifacts(prefixes: DataFrame, artifacts: DataFrame, column: str = "prefix") -> DataFrame:
    """Each requested id or prefix with its ``status`` and, when it is unique, the artifact ``id``.

    An exact id beats longer ids that start with it, in either case of letters. Several rows with one id are one
    artifact. A prefix p is the interval from p up to, but without, p followed by "g", which is behind all hex digits.
    Ids and both ends of the intervals are sorted together, inside the fences set by their first characters: each end
    finds the number of ids that aren't smaller and the first of them. So an id is one row and a request two, whatever
    lengths are asked for.
    """
    asked = prefixes.select(F.col(column).alias("prefix")).distinct()
    low = F.lower("prefix")
    none = F.lit(None).cast("string")
    ends = asked.where(F.col("prefix").rlike(P.ARTIFACT_ID)).select("prefix", F.explode(F.array(
        F.struct(low.alias("key"), F.lit(1).alias("side")), F.struct(F.concat(low, F.lit("g")).alias("key"), F.lit(-1).alias("side")),
    )).alias("end")).select("prefix", "end.*", none.alias("id"))
    ids = artifacts.select(none.alias("prefix"), F.col("id").alias("key"), F.lit(0).alias("side"), "id").distinct()
    # From the last key back: an id equal to the low end comes before it.
    back = Window.partitionBy(F.substring("key", 1, FENCE)).orderBy(F.desc("key"), F.abs("side")).rowsBetween(Window.unboundedPreceding, 0)
    placed = ids.unionByName(ends).withColumns({"_n": F.count("id").over(back), "_next": F.last("id", ignorenulls=True).over(back)})
    found = placed.where("prefix is not null").groupBy("prefix").agg(
        F.sum(F.col("_n") * F.col("side")).alias("n"), F.max(F.when(F.col("side") == 1, F.col("_next"))).alias("first_id")
    )
    exact = F.col("first_id") == low
    status = (
        F.when(F.col("n").isNull(), "invalid").when(F.col("n") == 0, "not found")
        .when(exact | (F.col("n") == 1), "found").otherwise("ambiguous")
    )
    return asked.join(found, "prefix", "left").withColumn("status", status).select(
        "prefix", "status", F.when(F.col("status") == "found", F.col("first_id")).alias("id"),
        F.coalesce("n", F.lit(0).cast("long")).alias("matches"),
    )


def verify_artifacts(artifacts: DataFrame) -> DataFrame:
    """Artifacts whose bytes no longer have their digest."""
    return artifacts.where(content_digest("payload") != F.col("sha256"))


def expire(df: DataFrame, as_of: Column, days: int | None = None) -> DataFrame:
    """Rows that survive a retention of ``days`` days (default 7); zero or less keeps everything."""
    days = P.DEFAULT_RETENTION_DAYS if days is None else days
    if days <= 0:
        return df
    cut = as_of - F.make_interval(days=F.lit(days))
    kept = df.where(F.col("created_at") >= cut)
    return kept.where(F.col("run_date") >= F.to_date(cut)) if "run_date" in df.columns else kept


def purge(
    artifacts: DataFrame, runs: DataFrame, as_of: Column, older_than_days: int | None = None, everything: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remaining artifacts, remaining runs, and a one-row table with the number of artifacts gone."""
    days = P.DEFAULT_RETENTION_DAYS if older_than_days is None else older_than_days
    old = F.lit(True) if everything else F.col("created_at") < as_of - F.make_interval(days=F.lit(days))
    return artifacts.where(~old), runs.where(~old), artifacts.agg(F.count_if(old).alias("purged"))


def artifact_metadata(artifacts: DataFrame) -> DataFrame:
    """Everything but the payload, which is then never read."""
    return artifacts.drop("payload")
