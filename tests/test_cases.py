"""End-to-end runs of the described cases: sizes, facts, recovery and secrecy."""

import json

import pytest
from pyspark.sql import functions as F

from cases import FURTHER, core_cases
from linesieve.operators.metrics import savings_by_profile
from linesieve.plans.compact import compact_corpus
from linesieve.plans.evaluate import critical_retention, expected_passthrough, strict_gate, under_profiles
from linesieve.plans.put import compact_and_store
from linesieve.sources.outputs import with_output_defaults
from linesieve.sources.store_tables import read_artifacts, read_runs

# Least share of bytes that the accepted views of a profile save over all cases.
LEAST_SAVED = {"strict": 0.0, "safe": 0.45, "max": 0.45}
SHRUNK = {"specs-green", "specs-red", "collector", "readings", "hits", "assets", "firmware", "status"}


def as_outputs(spark, cases, **values):
    rows = [(c.name, bytearray(c.text.encode()), c.command, c.exit_code) for c in cases]
    df = spark.createDataFrame(rows, "output_id string, raw binary, command array<string>, exit_code int")
    return with_output_defaults(df, **values)


@pytest.fixture(scope="module")
def core(spark):
    cases = core_cases()
    outputs = as_outputs(spark, cases, min_bytes=0, min_lines=0, min_savings_ratio=0.0)
    results = compact_corpus(under_profiles(outputs)).cache()
    rows = {}
    for r in results.collect():
        profile, name = r.output_id.split("#")
        rows[profile, name] = r
    return cases, outputs, results, rows


def test_sizes_and_kinds(core):
    cases, _, _, rows = core
    for c in cases:
        r = rows["safe", c.name]
        assert r.raw_bytes == len(c.text.encode()) and r.raw_lines == len(c.text.splitlines()), c.name
        assert r.kind == c.kind, c.name
        assert r.compact_bytes == len(r.output) and (r.transformed or r.compact_bytes == r.raw_bytes)


@pytest.mark.parametrize("profile", ["strict", "safe", "max"])
def test_savings_and_quality(core, profile):
    cases, _, results, rows = core
    mine = {c.name: rows[profile, c.name] for c in cases}
    assert all(r.quality_passed for n, r in mine.items() if n != "firmware" or profile != "strict")
    raw, left = (sum(getattr(r, f) for r in mine.values()) for f in ("raw_bytes", "compact_bytes"))
    table = {(r.profile, r.level): r for r in savings_by_profile(results).collect()}[profile, 1]
    assert table.cases == 10 and table.byte_savings_ratio >= LEAST_SAVED[profile]
    assert abs(table.byte_savings_ratio - (raw - left) / raw) < 1e-9


def test_max_is_never_longer_than_safe(core):
    cases, _, _, rows = core
    for c in cases:
        assert rows["max", c.name].compact_bytes <= rows["safe", c.name].compact_bytes, c.name


def test_transformed_cases_and_reasons(core):
    cases, _, _, rows = core
    done = {p: {c.name for c in cases if rows[p, c.name].transformed} for p in ("strict", "safe", "max")}
    assert done == {"strict": {"readings"}, "safe": SHRUNK, "max": SHRUNK}
    reason = lambda p, n: rows[p, n].fallback_reason
    assert reason("strict", "firmware") == "quality guard: format confidence too low for selective omission"
    assert reason("strict", "collector") == "net savings 0.0% below minimum 0.0%"
    for p in ("strict", "safe", "max"):
        assert reason(p, "patch") == "filter found no safe reduction"
        assert reason(p, "credential") == "probable secret: exact-recovery storage not permitted"


def test_required_facts_and_protected_cases(core):
    cases, _, _, rows = core
    for (profile, name), r in rows.items():
        case = next(c for c in cases if c.name == name)
        text = bytes(r.output).decode()
        for fact in case.required:
            assert fact in text, (profile, name, fact)
        if case.protected:
            assert text == case.text and not r.transformed and r.artifact_id is None
        if name == "readings" and r.transformed:
            body = text.split("\n", 1)[1]
            assert json.loads(body) is not None


def test_critical_lines_are_retained(core):
    _, outputs, results, _ = core
    checked = critical_retention(results, under_profiles(outputs)).collect()
    assert len(checked) == 3 and all(r.retained for r in checked)


def test_strict_json_keeps_the_value(core):
    cases, _, _, rows = core
    r = rows["strict", "readings"]
    assert r.transformed and r.omitted_lines == 0
    text = next(c.text for c in cases if c.name == "readings")
    assert json.loads(bytes(r.output).decode().split("\n", 1)[1]) == json.loads(text)


def test_store_round_trip(spark, core, tmp_path):
    cases, outputs, _, _ = core
    art, runs = str(tmp_path / "artifacts"), str(tmp_path / "runs")
    results = compact_and_store(outputs, art, runs, F.lit("2031-03-04 12:00:00").cast("timestamp"))
    ids = {r.output_id: r.artifact_id for r in results.collect() if r.artifact_id}
    stored = {r.id: bytes(r.payload) for r in read_artifacts(spark, art).collect()}
    by_name = {c.name: c.text.encode() for c in cases}
    assert len(ids) == 8 and set(ids.values()) == set(stored)
    for name, key in ids.items():
        assert stored[key] == by_name[name]
    assert read_runs(spark, runs).count() == 10


def test_cross_cases_pass_the_strict_gate(spark):
    cases = core_cases() + [c for c, _ in FURTHER]
    outputs = as_outputs(spark, cases)
    results = compact_corpus(outputs).cache()
    anchors = [(c.name, i, a) for c in core_cases() for i, a in enumerate(c.required)]
    anchors += [(c.name, i, a) for c, groups in FURTHER for i, g in enumerate(groups) for a in g]
    flags = [(c.name, c.name in ("patch", "credential", "small-patch"),
              c.name == "credential", c.protected) for c in cases]
    spec = spark.createDataFrame(
        flags, "output_id string, exact_visible boolean, sensitive boolean, expect_passthrough boolean")
    gate = strict_gate(results, outputs, spec, spark.createDataFrame(anchors, "case string, group_no int, alternative string"))
    rows = {r.output_id: r for r in gate.collect()}
    assert len(rows) == 15
    assert all(r.strict_pass and r.exact_available for r in rows.values()), rows
    assert sum(r.transformed for r in rows.values()) == 11
    assert rows["letter"].fallback_reason == "below compression threshold"
    assert expected_passthrough(results, spec).count() == 0
