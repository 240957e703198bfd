"""The bucketed store, retention on disk, sealed staging and the successor search."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from linesieve.operators.metrics import run_totals, savings_by_kind, savings_by_profile
from linesieve.operators.store import lookup_artifacts
from linesieve.plans.retention import purge_store
from linesieve.sources import staging
from linesieve.sources.bucketed_store import BucketedStore
from linesieve.sources.run_partials import RunTable
from linesieve.sources.store_tables import read_artifacts, write_artifacts


def puts(spark, numbers, at):
    raw = F.concat(F.lit("text "), F.col("n").cast("string")).cast("binary")
    rows = spark.createDataFrame([(n,) for n in numbers], "n long")
    return rows.select(
        F.sha2(raw, 256).alias("sha256"), F.lit(at).cast("timestamp").alias("created_at"), F.array(F.lit("x")).alias("command"), F.lit("/").alias("cwd"),
        F.lit(0).alias("exit_code"), F.lit("generic").alias("kind"), F.lit("bytes").alias("encoding"), raw.alias("payload"),
        F.octet_length(raw).cast("long").alias("raw_bytes"), F.lit(1).cast("long").alias("raw_lines"),
    )


def test_puts_refresh_and_merge(spark, tmp_path):
    store = BucketedStore(spark, str(tmp_path / "store"), 4)
    assert store.read().count() == 0
    store.put(puts(spark, [*range(40), 3, 3], "2024-01-01 00:00:00"))
    store.put(puts(spark, range(20, 60), "2024-01-02 00:00:00"))
    rows = store.read()
    want = {n: 2 if n >= 20 else 1 for n in range(60)}
    assert {int(r.payload.decode().split()[1]): r.created_at.day for r in rows.collect()} == want
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    assert all(r.id == r.sha256[:16] for r in rows.select("id", "sha256").collect())
    before = {tuple(r) for r in rows.drop("payload", "command").collect()}
    store.merge()
    assert BucketedStore(spark, str(tmp_path / "store")).buckets == 4
    assert {tuple(r) for r in store.read().drop("payload", "command").collect()} == before
    assert store.sweep() == 2 and store.read().count() == 60


def test_stems_that_collide_get_longer_ids(spark, tmp_path):
    def digests(names, at):
        return puts(spark, range(len(names)), at).withColumn("n", F.regexp_extract(F.col("payload").cast("string"), "[0-9]+", 0).cast("int")).withColumn(
            "sha256", F.element_at(F.array(*[F.lit(x) for x in names]), F.col("n") + 1)
        ).drop("n")

    stem = "0123456789abcdef"
    one, two, three = (stem + x * 48 for x in "123")
    store = BucketedStore(spark, str(tmp_path / "store"), 3)
    store.put(digests([one, "f" * 64], "2024-01-01 00:00:00"))
    store.put(digests([two, one], "2024-01-02 00:00:00"))
    store.put(digests([three, two], "2024-01-03 00:00:00"))
    ids = {r.sha256: (r.id, r.created_at.day) for r in store.read().select("sha256", "id", "created_at").collect()}
    assert ids == {one: (stem, 2), two: (two[:24], 3), three: (three[:24], 3), "f" * 64: ("f" * 16, 1)}


def test_of_two_puts_at_a_time_one_fails(spark, tmp_path):
    store = BucketedStore(spark, str(tmp_path / "store"), 2)
    store.put(puts(spark, range(3), "2024-01-01 00:00:00"))
    number, found = store._manifest()
    store.put(puts(spark, range(5), "2024-01-02 00:00:00"))
    with pytest.raises(RuntimeError):
        store._commit(number, found["generations"])
    assert store.read().count() == 5


def test_purge_rewrites_the_day_of_the_cut(spark, tmp_path):
    path, runs = str(tmp_path / "artifacts"), str(tmp_path / "runs")
    for day, hour, numbers in ((1, 5, range(10)), (2, 3, range(5, 12)), (2, 20, [1]), (3, 1, [20]), (9, 0, [0])):
        rows = puts(spark, numbers, f"2024-01-{day:02d} {hour:02d}:00:00").withColumn("id", F.substring("sha256", 1, 16))
        write_artifacts(rows, path)
    number = lambda df: {int(r.payload.decode().split()[1]) for r in df.collect()}
    # The cut is the second of January, noon.
    as_of = datetime(2024, 1, 9, 12)
    gone = purge_store(spark, path, runs, as_of)
    assert gone.count() == len(set(range(12)) - {0, 1})
    assert number(read_artifacts(spark, path)) == {0, 1, 20}
    files = sorted(p.name for p in (tmp_path / "artifacts").iterdir() if p.name.startswith("run_date"))
    assert files == ["run_date=2024-01-02", "run_date=2024-01-03", "run_date=2024-01-09"]
    assert purge_store(spark, path, runs, as_of).count() == 0 and number(read_artifacts(spark, path)) == {0, 1, 20}
    assert purge_store(spark, path, runs, datetime(2024, 2, 9), 0).count() == 3
    assert purge_store(spark, str(tmp_path / "none"), runs, as_of).count() == 0


def test_sealed_tables_hold_no_text(spark):
    rows = [(1, "the secret word", ["secret", None], b"secret", 5, None), (2, None, [], b"", None, {"a": "secret"}), (3, "", None, None, 1, {})]
    df = spark.createDataFrame(rows, "output_id long, line string, tags array<string>, raw binary, n int, facts map<string,string>")
    with staging.sealed_staging():
        back = staging.stage(df, "sealed-test")
    path = staging._written[spark.sparkContext.applicationId][-1]
    assert sorted(map(tuple, back.collect())) == rows and back.schema == df.schema
    stored = spark.read.parquet(path)
    assert {f.name: f.dataType.typeName() for f in stored.schema} == {
        "output_id": "long", "line": "binary", "tags": "binary", "raw": "binary", "n": "integer", "facts": "binary"
    }
    assert not any(b"secret" in bytes(v) for r in stored.collect() for v in r if isinstance(v, (bytes, bytearray)))


def test_successor_search_equals_a_scan(spark):
    rng = random.Random(2)
    ids = {"".join(rng.choice("0123456789abcdef"[: rng.choice([2, 16])]) for _ in range(rng.choice([16, 24, 64]))) for _ in range(300)}
    ids |= {i[:16] for i in list(ids)[:40]}
    asked = {i[: rng.randint(3, 66)] for i in ids} | {"0000", "ffff", "FFFF", "%", "", "abcg", "0" * 64, *[i.upper() for i in list(ids)[:20]]}
    got = {
        r.prefix: (r.status, r.id, r.matches)
        for r in lookup_artifacts(spark.createDataFrame([(a,) for a in asked] * 2, "prefix string"), spark.createDataFrame([(i,) for i in ids] * 2, "id string")).collect()
    }
    want = {}
    for a in asked:
        low = a.lower()
        found = sorted(i for i in ids if i.startswith(low))
        if not (4 <= len(a) <= 64 and all(c in "0123456789abcdef" for c in low)):
            want[a] = ("invalid", None, 0)
        elif low in ids or len(found) == 1:
            want[a] = ("found", found[0], len(found))
        else:
            want[a] = ("ambiguous" if found else "not found", None, len(found))
    assert got == want


def test_totals_are_merged_from_partials(spark, tmp_path):
    rows = [
        (datetime(2024, 1, 1 + k % 9, k % 24), "log" if k % 3 else "json", "safe" if k % 2 else "max", k % 4 > 0, k % 7 > 0, 100 + k, 10 + k, 50 + k, 5 + k)
        for k in range(300)
    ]
    schema = "created_at timestamp, kind string, profile string, transformed boolean, quality_passed boolean, raw_bytes long, compact_bytes long, raw_tokens_est long, compact_tokens_est long"
    kept = RunTable(spark, str(tmp_path / "runs"))
    assert kept.run_totals().first().runs == 0
    for k in range(3):
        kept.append(spark.createDataFrame(rows[k::3], schema), f"b{k}")
    kept.append(spark.createDataFrame(rows[1::3], schema), "b1")
    # An append that broke off before its partials were written.
    spark.createDataFrame(rows, schema).withColumn("run_date", F.to_date("created_at")).write.partitionBy("run_date").parquet(f"{tmp_path}/runs/runs/batch=broken")
    every = spark.createDataFrame(rows, schema)
    as_of = datetime(2024, 1, 9, 13, 30)
    for days in (None, 0, 1, 3, 20):
        at = F.lit("2024-01-09 13:30:00").cast("timestamp")
        got, want = kept.run_totals(as_of if days is not None else None, days).first(), run_totals(every, at, days).first()
        assert {c: got[c] for c in want.asDict()} == want.asDict(), days
        kinds = [tuple(r) for r in savings_by_kind(every, at, days).collect()]
        assert [tuple(r) for r in kept.savings_by_kind(as_of if days is not None else None, days).collect()] == kinds
    want = {(r.profile, r.kind, r.level, r.cases, r.transformed, r.raw_bytes) for r in savings_by_profile(every).collect()}
    assert {(r.profile, r.kind, r.level, r.cases, r.transformed, r.raw_bytes) for r in kept.savings_by_profile().collect()} == want
    assert all("/partials/" in f for f in kept.run_totals().inputFiles())
    read = kept.run_totals(as_of, 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_date" in read
