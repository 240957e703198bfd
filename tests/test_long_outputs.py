"""Outputs given as line tables: splittable captures, detection by line statistics, and the whole job against the cells."""

import random

import pytest
from pyspark.sql import functions as F

from cases import FURTHER, STATIONS, core_cases, text_of
from linesieve.operators.detect import classify
from linesieve.operators.detect_lines import classify_lines, line_signs
from linesieve.plans.compact import compact_corpus
from linesieve.plans.evaluate import under_profiles
from linesieve.plans.long_outputs import compact_lines
from linesieve.sources import staging
from linesieve.sources.captures import capture_sizes, read_capture_lines
from linesieve.sources.outputs import explode_lines, with_output_defaults
from linesieve.sources.staging import clear_staged


@pytest.mark.parametrize("size", ["37b", "1000b", "128m"])
def test_captures_cut_into_ranges_give_the_same_lines(spark, tmp_path, size):
    rng = random.Random(6)
    breaks = ["\n", "\n", "\n", "\r\n", "\r", "\n\n", "\x0b\n", " "]
    texts = {
        f"c{k}.txt": "".join("x" * rng.choice([0, 1, 30, 200]) + rng.choice(["é", "🙂", "\x1b[31mred\x1b[0m", ""]) + rng.choice(breaks) for _ in range(rng.randint(0, 80)))
        + rng.choice(["", "end", "\n"]) for k in range(6)
    } | {"empty.txt": "", "one.txt": "one line", "feed.txt": "\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        lines = read_capture_lines(spark, str(tmp_path))
        got = sorted((r.output_id.rsplit("/")[-1], r.line_no, r.n_lines, r.line) for r in lines.collect())
        ranges = spark.read.text(str(tmp_path)).select("_metadata.file_path", "_metadata.file_block_start").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    cells = explode_lines(spark.createDataFrame(list(texts.items()), "output_id string, text string"), normalize=True)
    assert got == sorted((r.output_id, r.line_no, r.n_lines, r.line) for r in cells.collect())
    assert ranges > 60 if size == "37b" else ranges > 8 if size == "1000b" else ranges <= 9
    sizes = {r.output_id.rsplit("/")[-1]: r.raw_bytes for r in capture_sizes(spark, str(tmp_path)).collect()}
    assert sizes == {n: len(t.encode()) for n, t in texts.items() if t}


def drawn_tree(holds=True):
    rows = ["."]
    for s in STATIONS:
        rows.append(f"├── {s}")
        rows += [f"│   ├── {s}{n}.rb" for n in range(15)]
        rows.append("│   └── Makefile" if holds else "│   │   │   └── lost.rb")
    return text_of(rows, "", "7 directories, 112 files")


def commit_log():
    rows = []
    for n in range(30):
        rows += [f"commit {n:040x}", "Author: A <a@skywatch.invalid>", "Date: now", "", *[f"    line {k} of {n}" for k in range(12)], ""]
    return text_of(rows)


def mixed_log():
    rng = random.Random(1)
    words = ["INFO polled", "DEBUG woke", "WARN low", "ERROR lost", "fetching 10%", "plain"]
    return text_of([f"{rng.choice(words)} {rng.choice(STATIONS)} {k % 7}" for k in range(400)], "Traceback (most recent call last):", "ValueError: bad gauge")


CASES = [(c.name, c.text, c.command, c.exit_code) for c in [*core_cases(), *[c for c, _ in FURTHER]] if c.kind != "json"] + [
    ("drawn", drawn_tree(), ["tree"], 0), ("undrawn", drawn_tree(False), ["tree"], 0), ("commits", commit_log(), ["git", "log"], 0),
    ("mixed", mixed_log(), ["mytool"], 0), ("mixed-failed", mixed_log(), ["mytool"], 3), ("failed-mute", text_of(["a"] * 50), ["mytool"], 1),
    ("blank", "\n\n   \n\n\n", ["mytool"], 0), ("no-feed", "one\ntwo", ["mytool"], 0), ("bare-log", text_of([f"INFO a {k}" for k in range(90)]), [], 0),
    ("bare-test", text_of("collected 3 items", [f"x{k} ok" for k in range(50)], "short test summary info"), [], 0),
    ("bare-diff", text_of("diff --git a/x b/x", [f"+{k}" for k in range(50)]), [], 0), ("trailing", text_of(["same"] * 30, "", "", ""), ["mytool"], 0),
    ("one-path", text_of([f"a.py:{k}:x" for k in range(50)]), ["rg", "x"], 0), ("long-list", text_of([f"-rw-r--r-- 1 a b {k} x{k}" for k in range(90)]), ["ls", "-l"], 0),
    ("progress", text_of([f"Loading [{k}%]" for k in range(100)], [f"row {k}" for k in range(90)]), ["mytool"], 0), ("empty", "", ["mytool"], 0),
]


@pytest.fixture(scope="module")
def outputs(spark):
    rows = [(n, bytearray(t.encode()), c, e) for n, t, c, e in CASES]
    df = spark.createDataFrame(rows, "output_id string, raw binary, command array<string>, exit_code int")
    return under_profiles(with_output_defaults(df, min_bytes=0, min_lines=0, min_savings_ratio=0.0))


def as_lines(outputs):
    lines = explode_lines(outputs.select("output_id", F.col("raw").cast("string").alias("text")), normalize=True)
    return lines, outputs.withColumn("raw_bytes", F.octet_length("raw").cast("long")).drop("raw")


def test_line_statistics_find_the_kinds_and_routes(spark, outputs):
    cells = classify(outputs).select("output_id", "kind", "confidence", "detection_reason", "route", "route_note")
    lines, facts = as_lines(outputs)
    got = classify_lines(facts, line_signs(lines, 16)).where("raw_lines is not null")
    names = ["output_id", "kind", "confidence", "detection_reason", "route", "route_note"]
    want = {tuple(r) for r in cells.where(F.octet_length("raw") > 0).select(*names).collect()}
    assert {tuple(r) for r in got.select(*names).collect()} == want
    routes = {r.route for r in got.select("route").distinct().collect()}
    assert routes == {"generic", "log", "test", "test_strict", "search", "tree_flat", "tree_nested", "git_status", "git_log", "git_diff", "duplicates"}


COMPARED = [
    "output_id", "kind", "profile", "transformed", "quality_passed", "raw_bytes", "compact_bytes", "raw_lines", "compact_lines", "raw_tokens_est",
    "compact_tokens_est", "notes", "detection_reason", "confidence", "omitted_lines",
]


def test_views_in_parts_equal_views_in_cells(spark, outputs):
    cells = {r.output_id: r for r in compact_corpus(outputs).collect()}
    lines, facts = as_lines(outputs)
    results, parts = compact_lines(lines, facts, part_lines=7)
    got = {r.output_id: r for r in results.collect()}
    assert set(got) == set(cells) and len(cells) == 3 * len(CASES)
    texts = {}
    for r in sorted(parts.collect(), key=lambda r: (r.output_id, r.part)):
        assert r.text.count("\n") <= 7
        before = texts.setdefault(r.output_id, "")
        assert r.offset == len(before.encode())
        texts[r.output_id] = before + r.text
    assert set(texts) == {n for n, r in got.items() if r.transformed}
    for name, cell in cells.items():
        mine = got[name]
        assert [mine[c] for c in COMPARED] == [cell[c] for c in COMPARED], name
        # Which of several missing texts is named first may differ.
        plain = lambda reason: reason and reason.split("omitted: ")[0]
        assert plain(mine.fallback_reason) == plain(cell.fallback_reason), name
        if cell.transformed:
            text = bytes(cell.output).decode()
            want = text.replace(cell.artifact_id, mine.artifact_id, 1) if cell.artifact_id else text
            assert texts[name] == want, name


def test_only_secrets_are_sealed_and_view_lines_are_not_looked_up(spark):
    """Outputs without a secret are staged as they are; needed lines that are view lines need no index of the view."""
    log = lambda mark: [f"INFO {mark} step" for _ in range(40)] + [f"ERROR {mark} broke", f"INFO {mark} end"]
    texts = {"plain": log("openly"), "held": [*log("hidden"), "password=hunter2hunter2"]}
    rows = [(i, n, len(ls), line) for i, ls in texts.items() for n, line in enumerate(ls)]
    lines = spark.createDataFrame(rows, "output_id string, line_no long, n_lines long, line string")
    sizes = spark.createDataFrame([(i, sum(len(x) + 1 for x in ls)) for i, ls in texts.items()], "output_id string, raw_bytes long")
    clear_staged(spark)
    results, _ = compact_lines(lines, with_output_defaults(sizes, min_bytes=0, min_lines=0, min_savings_ratio=0.0))
    got = {r.output_id: r for r in results.collect()}
    assert got["plain"].transformed and not got["held"].transformed
    assert got["held"].fallback_reason == "probable secret: exact-recovery storage not permitted"
    tables = [spark.read.parquet(p) for p in staging._written[spark.sparkContext.applicationId]]
    stored = [v if isinstance(v, str) else bytes(v).decode("latin-1") for t in tables for r in t.collect() for v in r if isinstance(v, (str, bytes, bytearray))]
    assert any("openly" in v for v in stored) and not any("hidden" in v or "hunter2" in v for v in stored)
    keys = [t for p, t in zip(staging._written[spark.sparkContext.applicationId], tables) if "line-keys" in p]
    assert keys and all(t.count() == 0 for t in keys)
