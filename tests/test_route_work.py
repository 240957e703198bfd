"""Patterns of the routes run once for a line, and only where a plain search finds one of their words."""

import re

from pyspark.sql import functions as F

from linesieve.functions import patterns as P
from linesieve.functions import predicates as p
from linesieve.operators.reduce_git import git_status_facts

LINES = [
    "tests/part_1.py PASSED", "3 passed in 2s", "Tests: 4", "testsuite:", "TEST RESULT: ok", "ok  pkg", "FAIL x", "x FAIL x", "fail", "faıled",
    "failing", "Failure", "aſſert", "asſertion", "E  x", "e x", "  E x", "F\tx", "__ a __", "___", "=== ERRORS ===", "== failure", "Panic!", "WARNING",
    "warned", "deprecated", "DEPRECATEDx", "١ passed", "12 teſts", "", "build succeeded", "Finished test", "ParseError", "denied", "ﬀ x",
    "stack trace", "ſtack trace", "stacktrace", "SEGFAULT", "timeouts", "3  warnings", "3 skipped", "  tests :", "tracebacK", "tracebacK",
]
FAILURE = (
    r"(?iU)(?:\b(?:fail(?:ed|ure|ures)?|error|exception|traceback|panic|assert(?:ion)?)\b"
    r"|^E\s+|^F\s+|^_{2,}\s*.*\s*_{2,}$|^={2,}\s*(?:FAILURES?|ERRORS?)\s*={2,})"
)
SUMMARY = (
    r"(?iU)(?:\b\d+\s+(?:passed|failed|skipped|xfailed|xpassed|warnings?|tests?)\b"
    r"|^(?:test suites|tests|snapshots|time|ran all test suites)\s*:"
    r"|^test result:|^failures:|^successfully ran|^build (?:succeeded|failed)"
    r"|^finished test|^ok\s|^FAIL\s)"
)


def test_guards_lose_no_match(spark):
    df = spark.createDataFrame([(x,) for x in [*LINES, None]], "line string")
    x = F.col("line")
    both = {
        "failure": (p.is_test_failure(x), x.rlike(FAILURE)), "summary": (p.is_test_summary(x), p.strip(x).rlike(SUMMARY)),
        "warning": (p.is_test_warning(x), x.rlike(P.TEST_WARNING)), "error": (p.is_error_match(x), x.rlike(P.ERROR_MATCH)),
    }
    for name, (new, old) in both.items():
        rows = df.select(x, new.alias("new"), old.alias("old")).collect()
        assert [r for r in rows if r.new != r.old] == [], name
        assert {r.old for r in rows} == {True, False, None}


def test_status_rows_are_parsed_once(spark, tmp_path):
    rows = [(1, 0, "On branch main"), (1, 1, "\tmodified:   a.py"), (1, 2, "?? b c"), (1, 3, "free words"), (1, 4, ""), (1, 5, None)]
    spark.createDataFrame(rows, "output_id int, line_no long, line string").write.parquet(str(tmp_path / "lines"))
    facts = git_status_facts(spark.read.parquet(str(tmp_path / "lines")))
    assert {(r.output_id, r.line) for r in facts.collect()} == {
        (1, "main"), (1, "changed M"), (1, "a.py"), (1, "porcelain ??"), (1, "b c"),
    }
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("regexp_extract", plan)) <= 8 and not re.search(r"Filter [^\n]*RLIKE", plan)
