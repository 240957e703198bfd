"""Tables that registered queries are made of, on inputs larger than the given ones."""

from pyspark.sql import functions as F

from linesieve.operators.lines import LINE, NO
from linesieve.plans import catalogue


def test_commits_of_over_a_million_lines_stay_apart(spark, tmp_path):
    n = 1_000_004
    turns = spark.createDataFrame([(1, 0, "user", "\n" * n + "last"), (1, 1, "user", "next")], "conv_id long, turn long, role string, text string")
    turns.write.parquet(str(tmp_path / "conversations.parquet"))
    lines = catalogue.commit_lines(spark, str(tmp_path))
    got = {r[LINE]: r[NO] for r in lines.where(F.col(LINE).isin("last", "commit 1", "next")).collect()}
    assert got == {"last": n + 3, "commit 1": n + 5, "next": n + 8}
