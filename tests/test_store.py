"""Store, retrieval, metrics, evaluation joins and streaming jobs."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from linesieve.functions.predicates import contains_secret
from linesieve.operators.containment import containment_check, lines_holding, missing_lines, recovery_check, stored_secrets
from linesieve.operators.metrics import recent_artifacts, run_totals, savings_by_kind
from linesieve.operators.records import numeric_summary, numeric_summary_of_maps, sample_records
from linesieve.operators.store import (
    ARTIFACT, as_artifacts, artifact_metadata, assign_ids, expire, latest_puts, lookup_artifacts, purge,
    upsert_artifacts, verify_artifacts,
)
from linesieve.plans.compact import compact_corpus
from linesieve.plans.put import compact_and_store, with_final_ids
from linesieve.plans.reduce import register_reducer, _custom
from linesieve.plans.retrieve import show
from linesieve.sources.staging import clear_staged
from linesieve.sources.outputs import outputs_from_text, read_outputs, with_output_defaults
from linesieve.sources.store_tables import (
    append_runs, as_runs, read_artifacts, read_runs, write_artifacts, write_report,
)
from linesieve.streaming.jobs import current_artifacts, stream_compact, stream_run_totals, stream_upsert_artifacts

AT = lambda s: F.lit(s).cast("timestamp")


def puts(spark, rows):
    df = spark.createDataFrame(
        [(i, bytearray(raw), cmd, at) for i, (raw, cmd, at) in enumerate(rows)],
        "n int, raw binary, command array<string>, at long")
    full = df.withColumns({"cwd": F.lit("/w"), "exit_code": F.lit(0), "kind": F.lit("log")})
    return as_artifacts(full, F.timestamp_seconds("at"))


def test_put_refresh_and_lookup(spark, tmp_path):
    raw = b"first\x00second\nthird\xff"
    first = assign_ids(latest_puts(puts(spark, [(raw, ["a"], 1000), (b"other", ["b"], 1000)])))
    again = assign_ids(latest_puts(puts(spark, [(raw, ["c", "--token", "x"], 2000)])), first)
    path = str(tmp_path / "artifacts")
    write_artifacts(upsert_artifacts(first, again), path)
    stored = read_artifacts(spark, path)
    rows = {bytes(r.payload): r for r in stored.collect()}
    digest = hashlib.sha256(raw).hexdigest()
    assert set(rows) == {raw, b"other"}
    assert rows[raw].id == digest[:16] and rows[raw].sha256 == digest
    assert rows[raw].command == ["c", "--token", "<redacted>"] and rows[raw].created_at.timestamp() == 2000
    assert rows[raw].raw_bytes == len(raw) and rows[raw].raw_lines == 2
    asked = spark.createDataFrame([(digest[:8],), (digest[:8].upper(),), ("%",), ("ffff0000ffff",), (digest[:16],)], "prefix string")
    got = {r.prefix: (r.status, r.id) for r in lookup_artifacts(asked, stored).collect()}
    assert got == {digest[:8]: ("found", digest[:16]), digest[:8].upper(): ("found", digest[:16]), "%": ("invalid", None),
                   "ffff0000ffff": ("not found", None), digest[:16]: ("found", digest[:16])}
    assert verify_artifacts(stored).count() == 0
    assert verify_artifacts(stored.withColumn("payload", F.lit(b"x"))).count() == 2
    assert "payload" not in artifact_metadata(stored).columns


def test_lookup_prefers_exact_and_reports_ambiguity(spark):
    ids = spark.createDataFrame([("abcd",), ("abcd11",), ("abce",)], "id string")
    asked = spark.createDataFrame([("abcd",), ("abcd1",), ("abcdef",), ("abc",)], "prefix string")
    got = {r.prefix: (r.status, r.id) for r in lookup_artifacts(asked, ids).collect()}
    assert got == {"abcd": ("found", "abcd"), "abcd1": ("found", "abcd11"), "abcdef": ("not found", None), "abc": ("invalid", None)}
    two = spark.createDataFrame([("abcd11",), ("abcd22",)], "id string")
    assert lookup_artifacts(asked.where("prefix = 'abcd'"), two).first().status == "ambiguous"


def test_ids_grow_on_collision(spark):
    rng = random.Random(2)
    shas = ["".join(rng.choice("ab") for _ in range(8)) for _ in range(60)]
    shas = list(dict.fromkeys(shas))
    lengths = [2, 3, 5, 8]
    held = {"ab": "ab" + "c" * 6, "bb": "bb" + "c" * 6}
    existing = spark.createDataFrame([(k, v) for k, v in held.items()], "id string, sha256 string")
    new = spark.createDataFrame([(s, i) for i, s in enumerate(shas)], "sha256 string, created_at long").repartition(3)
    got = {r.sha256: r.id for r in assign_ids(new, existing, lengths).collect()}
    owner, want, waiting = dict(held), {}, list(shas)
    for n in lengths:
        left = []
        for s in waiting:
            if n == lengths[-1] or owner.get(s[:n], s) == s:
                owner[s[:n]] = s
                want[s] = s[:n]
            else:
                left.append(s)
        waiting = left
    assert got == want
    kept = assign_ids(spark.createDataFrame([(held["ab"], 9)], "sha256 string, created_at long"), existing, lengths)
    assert kept.first().id == "ab"


def test_longer_id_can_undo_a_view(spark):
    raw = "x" * 200
    rows = [("keep", raw, "[view id0]\nshort\n", 0.1), ("undo", raw + "y", "[view id1]\n" + "z" * 178 + "\n", 0.05)]
    df = spark.createDataFrame(rows, "output_id string, t string, v string, min_savings_ratio double").select(
        "output_id", F.col("t").cast("binary").alias("raw"), F.col("v").cast("binary").alias("output"), "min_savings_ratio",
        F.octet_length("t").cast("long").alias("raw_bytes"), F.octet_length("v").cast("long").alias("compact_bytes"),
        F.lit(1).alias("raw_lines"), F.lit(2).alias("compact_lines"), F.lit(50).alias("raw_tokens_est"),
        F.lit(5).alias("compact_tokens_est"), F.lit(True).alias("transformed"), F.lit(None).cast("string").alias("fallback_reason"),
        F.when(F.col("output_id") == "keep", "id0").otherwise("id1").alias("artifact_id"))
    ids = df.select(F.sha2("raw", 256).alias("sha256"), F.concat("artifact_id", F.lit("0123456789")).alias("id"))
    got = {r.output_id: r for r in with_final_ids(df, ids).collect()}
    assert bytes(got["keep"].output) == b"[view id00123456789]\nshort\n" and got["keep"].artifact_id == "id00123456789"
    assert got["keep"].compact_bytes == len(bytes(got["keep"].output))
    assert not got["undo"].transformed and bytes(got["undo"].output) == (raw + "y").encode() and got["undo"].artifact_id is None
    assert got["undo"].fallback_reason == "the longer id takes up what the view saves"


def test_expiry_and_purge(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "day int").withColumn(
        "created_at", F.timestamp_seconds(F.col("day") * 86400))
    as_of = F.timestamp_seconds(F.lit(9 * 86400))
    assert {r.day for r in expire(df, as_of).collect()} == set(range(2, 10))
    assert expire(df, as_of, 0).count() == 10 and expire(df, as_of, 3).count() == 4
    kept, runs, gone = purge(df, df, as_of, 5)
    assert kept.count() == runs.count() == 6 and gone.first().purged == 4
    assert purge(df, df, as_of, everything=True)[2].first().purged == 10


def test_retrieval(spark):
    text = "\n".join(f"row {i}" for i in range(1, 11)) + "\n"
    stored = assign_ids(latest_puts(puts(spark, [(text.encode(), ["a"], 1), (b"one\ntwo\n", ["b"], 2)])))
    key = hashlib.sha256(text.encode()).hexdigest()[:6]
    asked = spark.createDataFrame([(key,)], "prefix string")
    rows = lambda **k: [r.line for r in show(asked, stored, **k).orderBy("line_no").collect()]
    assert rows(start=2, end=3) == ["row 2", "row 3"] and rows(head=1) == ["row 1"] and rows(tail=0) == []
    assert len(rows()) == 10
    found = show(asked, stored, pattern="row 1$", context=1).orderBy("o1", "o2").collect()
    assert [r.line for r in found] == ["1:row 1", "2:row 2"]


def test_totals(spark):
    rows = [("log", True, True, 100, 20, 30, 5, 1), ("log", False, False, 50, 50, 9, 9, 2), ("test", True, True, 80, 70, 8, 7, 9)]
    runs = spark.createDataFrame(
        rows, "kind string, transformed boolean, quality_passed boolean, raw_bytes long, compact_bytes long, "
        "raw_tokens_est long, compact_tokens_est long, d int").withColumn("created_at", F.timestamp_seconds(F.col("d") * 86400))
    as_of = F.timestamp_seconds(F.lit(9 * 86400))
    r = run_totals(runs).first()
    assert (r.runs, r.transformed, r.raw_bytes, r.compact_bytes, r.guard_failures) == (3, 2, 230, 140, 1)
    assert run_totals(runs, as_of, 3).first().runs == 1
    empty = run_totals(runs.where("false")).first()
    assert empty.runs == 0 and empty.raw_bytes == 0 and empty.transformed == 0
    assert [r.kind for r in savings_by_kind(runs).collect()] == ["log", "test"]
    newest = recent_artifacts(runs.withColumnRenamed("kind", "id"), 1).collect()
    assert [r.d for r in newest] == [9]


def test_containment(spark):
    need = spark.createDataFrame([(1, "abc"), (1, "b"), (1, "zz"), (2, "x")], "output_id int, line string")
    view = spark.createDataFrame([(1, "abc"), (1, "q"), (2, "xx"), (2, None)], "output_id int, line string")
    assert {(r.output_id, r.line) for r in missing_lines(need, view).collect()} == {(1, "zz")}
    got = {r.output_id: (r.needed, r.missing, r.passed) for r in containment_check(need, view).collect()}
    assert got == {1: (3, 1, False), 2: (1, 0, True)}


def test_lines_holding_parts(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.choice([1, 2, 5, 30])))
    lines = [(rng.choice([0, 0, 0, 1, 2]), k, " ".join(word() for _ in range(rng.randint(0, 6)))) for k in range(120)]
    long = "".join(rng.choice("abcdefgh") for _ in range(2600))
    lines += [(0, 500, long), (0, 501, long), (3, 502, "")]
    parts = [(i, s) for i, _, s in lines[:40]] + [(i, s[3:9]) for i, _, s in lines] + [(i, s[1:25]) for i, _, s in lines]
    parts += [(0, long[990:1030]), (0, long[2560:]), (0, long[5:2590]), (0, long + "x"), (3, ""), (4, "a"), (4, "")]
    texts = spark.createDataFrame(lines, "output_id int, line_no int, line string")
    asked = spark.createDataFrame(parts, "output_id int, line string")
    got = [(r.output_id, r.line_no, r._part) for r in lines_holding(asked, texts).collect()]
    want = {(i, n, part) for i, n, line in lines for j, part in parts if i == j and part in line}
    assert len(got) == len(set(got)) and set(got) == want


def test_records(spark):
    rng = random.Random(4)
    groups = {g: [rng.random() < 0.3 for _ in range(rng.randint(1, 40))] for g in range(25)}
    rows = [(g, i * 5, c) for g, v in groups.items() for i, c in enumerate(v)]
    df = spark.createDataFrame(rows, "g int, at long, bad boolean").repartition(3)
    for size in (20, 65_536):
        got = {}
        for r in sample_records(df, ["g"], "at", F.col("bad"), 6, size).collect():
            got.setdefault(r.g, []).append((r._index, r.total_items, r.sampled_items))
        for g, v in groups.items():
            n = len(v)
            keep = [i for i in range(n) if n <= 6 or i < 3 or i >= n - 2 or v[i]]
            if len(keep) > 6:
                hits = [i for i in keep if v[i]]
                keep = sorted(hits + [i for i in keep if not v[i]][:max(0, 6 - len(hits))])
            assert sorted(got[g]) == [(i, n, len(keep)) for i in keep]
    s = numeric_summary(df, ["g"], ["at"]).collect()
    assert {r.g for r in s} == {g for g, v in groups.items() if len(v) >= 3}
    maps = spark.createDataFrame([('{"a":1,"b":"x"}',), ('{"a":2}',), ('{"a":6,"c":true}',)], "j string")
    out = numeric_summary_of_maps(maps, [], F.try_variant_get(F.parse_json("j"), "$", "map<string,variant>")).collect()
    assert [(r.field, r.n, r["min"], r["max"], r["mean"]) for r in out] == [("a", 3, 1.0, 6.0, 3.0)]


def log_text(i: int) -> str:
    return "".join(f"INFO request {i} took {j} ms\n" for j in range(200))


def test_no_store_no_secret_no_orphan(spark):
    rows = [("plain", log_text(1)), ("secret", log_text(2) + "password=hunter2\n")]
    df = spark.createDataFrame(rows, "k string, text string")
    make = lambda **v: outputs_from_text(df, "k", "text", command=F.array(F.lit("tail"), F.lit("x.log")), **v)
    run = lambda **v: {r.output_id: r for r in compact_corpus(make(), **v).collect()}
    normal, closed, opened = run(), run(store_available=False), run(allow_secrets=True)
    assert normal["plain"].transformed and not normal["secret"].transformed
    assert normal["secret"].fallback_reason == "probable secret: exact-recovery storage not permitted"
    assert closed["plain"].fallback_reason == "exact-recovery store unavailable" and closed["plain"].artifact_id is None
    assert opened["secret"].transformed and opened["secret"].artifact_id
    strict = compact_corpus(make(min_savings_ratio=0.999)).collect()
    assert all(r.artifact_id is None and not r.transformed for r in strict)
    outputs = make()
    kept = [(normal["plain"].artifact_id, bytearray(log_text(1).encode()))]
    art = spark.createDataFrame(kept, "id string, payload binary").withColumn("sha256", F.sha2("payload", 256))
    secret = contains_secret(F.col("raw").cast("string"))
    assert stored_secrets(outputs, art, secret).count() == 0
    results = compact_corpus(outputs).drop("output").join(outputs.select("output_id", "raw"), "output_id")
    assert [r.recovered for r in recovery_check(results, art).collect()] == [True]


def test_own_reducer(spark):
    from linesieve.operators.lines import head_lines, emit, view_row
    def first_line(lines):
        return emit(head_lines(lines, 1), F.array(view_row(F.col("line_no"), 0, F.col("line"), F.col("n_lines") - 1)))
    register_reducer("heads", first_line)
    try:
        df = spark.createDataFrame([("a", "top\n" + "x" * 40 + "\n" + "y\n" * 300)], "k string, text string")
        r = compact_corpus(outputs_from_text(df, "k", "text", kind_hint="heads")).first()
        assert r.transformed and bytes(r.output).decode().split("\n")[1] == "top" and r.omitted_lines == 301
    finally:
        _custom.pop("heads")


def test_files_and_reports(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"INFO x\n" * 3000)
    outputs = read_outputs(spark, str(tmp_path / "in"))
    results = compact_corpus(outputs)
    append_runs(as_runs(results, AT("2026-01-02 03:04:05")), str(tmp_path / "runs"))
    append_runs(as_runs(results, AT("2026-01-03 03:04:05")), str(tmp_path / "runs"))
    runs = read_runs(spark, str(tmp_path / "runs"))
    assert runs.count() == 2 and run_totals(runs, AT("2026-01-03 12:00:00"), 1).first().runs == 1
    write_report(run_totals(runs), str(tmp_path / "json"))
    write_report(results.select("output_id", "notes", "kind"), str(tmp_path / "csv"), "csv")
    assert spark.read.json(str(tmp_path / "json")).first().runs == 2
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 1
    with pytest.raises(ValueError):
        write_report(runs, str(tmp_path / "x"), "xml")


def test_streams(spark, tmp_path):
    docs = [(i, log_text(i % 4)) for i in range(6)]
    src = str(tmp_path / "src")
    rows = spark.createDataFrame(docs, "n long, text string").select(
        F.col("n").cast("string").alias("output_id"), F.col("text").cast("binary").alias("raw"),
        F.array(F.lit("tail"), F.lit("x.log")).alias("command"))
    with_output_defaults(rows).repartition(3).write.parquet(src)
    stream = lambda: spark.readStream.schema(with_output_defaults(rows).schema).option("maxFilesPerTrigger", 1).parquet(src)
    stream_compact(stream(), str(tmp_path / "out"), str(tmp_path / "ck1")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 6 and out.where("transformed").count() == 6
    batch = {r.output_id: bytes(r.output) for r in compact_corpus(with_output_defaults(rows)).collect()}
    assert {r.output_id: bytes(r.output) for r in out.collect()} == batch

    typed = stream().withColumns({"kind": F.lit("log")})
    made = as_artifacts(typed, F.timestamp_seconds(F.col("output_id").cast("long")))
    store = str(tmp_path / "store")
    stream_upsert_artifacts(made, store, str(tmp_path / "ck2")).awaitTermination()
    now = {bytes(r.payload).decode(): r.created_at.timestamp() for r in current_artifacts(spark, store).collect()}
    assert now == {log_text(0): 4, log_text(1): 5, log_text(2): 2, log_text(3): 3}


def test_no_output_is_lost_and_no_secret_written(spark, tmp_path):
    long = "\n".join(["the same line of text, over and over"] * 400)
    rows = [
        ("blank-log", "\n" * 900, ["git", "log"], "max"), ("plain", long, [], "safe"), ("short", "x", [], "safe"),
        ("secret", "password = hunter2hunter2hunter2\n" + long, [], "safe"),
    ]
    table = spark.createDataFrame(rows, "id string, text string, command array<string>, profile string")
    outputs = outputs_from_text(table, "id", "text", command=F.col("command"), profile=F.col("profile"))
    assert contains_secret is not None and outputs.where(contains_secret(F.col("raw").cast("string"))).count() == 1
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    at = AT("2024-01-01 00:00:00")
    paths = str(tmp_path / "artifacts"), str(tmp_path / "runs")
    results = compact_and_store(outputs, *paths, at)
    assert sorted(r.output_id for r in results.collect()) == sorted(r[0] for r in rows)
    stored = read_artifacts(spark, paths[0])
    compact_and_store(outputs.where("output_id = 'plain'"), *paths, AT("2024-01-02 00:00:00"), stored)
    again = read_artifacts(spark, paths[0])
    digest = hashlib.sha256(long.encode()).hexdigest()
    assert [r.created_at.day for r in again.where(F.col("sha256") == digest).collect()] == [2]
    asked = spark.createDataFrame([(digest[:8],), (digest[:16].upper(),)], "prefix string")
    assert {r.status for r in lookup_artifacts(asked, again).collect()} == {"found"}
    import glob
    for path in glob.glob(f"{folder}/linesieve-classified*") + glob.glob(f"{folder}/linesieve-results*") + glob.glob(f"{folder}/linesieve-final*"):
        if not glob.glob(f"{path}/**/*.parquet", recursive=True):
            continue
        for column in [c for c, t in spark.read.parquet(path).dtypes if t in ("binary", "string")]:
            assert spark.read.parquet(path).where(F.col(column).cast("string").contains("hunter2hunter2")).count() == 0, (path, column)
    assert clear_staged(spark) > 0
