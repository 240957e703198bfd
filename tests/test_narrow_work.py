"""Work that must not grow with the width of texts: what joins carry and how often a filter folds a text."""

from pyspark.sql import functions as F

from linesieve.functions.predicates import contains_secret
from linesieve.plans.evaluate import strict_gate


def nodes(plan):
    yield plan
    for k in range(plan.children().size()):
        yield from nodes(plan.children().apply(k))


def test_a_filter_for_secrets_folds_the_text_once(spark):
    texts = ["API_KEY = x1", "token", None, "Password: y", "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string").where(contains_secret("text"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert sorted(r.n for r in df.collect()) == [0, 3]


def test_the_gate_joins_no_originals(spark):
    rows = [("a", b"one", b"one", None), ("b", b"one two", b"one", "id"), ("c", None, None, None), ("d", b"x", b"y", None)]
    made = spark.createDataFrame(rows, "output_id string, raw binary, output binary, artifact_id string")
    results = made.drop("raw").withColumns({
        "kind": F.lit("log"), "transformed": F.col("artifact_id").isNotNull(), "fallback_reason": F.lit(None).cast("string"), "quality_passed": F.lit(True),
    })
    cases = made.select("output_id", F.lit(True).alias("exact_visible"), F.lit(True).alias("sensitive"))
    anchors = spark.createDataFrame([("a", 0, "ONE"), ("b", 0, "two")], "case string, group_no int, alternative string")
    gate = strict_gate(results, made.select("output_id", "raw"), cases, anchors)
    got = {r.output_id: (r.anchors_ok, r.exact_ok, r.sensitive_ok, r.strict_pass, r.exact_available) for r in gate.collect()}
    assert got == {
        "a": (True, True, True, True, True), "b": (False, False, False, False, True), "c": (True, None, None, None, None),
        "d": (True, False, False, False, False),
    }
    joins = [n for n in nodes(gate._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Join"]
    carried = " ".join(n.children().apply(k).output().mkString(" ") for n in joins for k in range(2))
    assert joins and " raw#" not in f" {carried}" and " output#" not in f" {carried}"
