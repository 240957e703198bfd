"""Drawn trees rebuilt from block summaries, against a plain stack."""

import random

import pytest
from pyspark.sql import functions as F

from linesieve.operators.lines import ID, LINE, NO
from linesieve.operators.reduce_listing import rebuild_tree_paths


@pytest.mark.parametrize("block, jump", [(256, 1), (4, 1), (3, 4), (1, 1)])
def test_paths_equal_a_stack(spark, block, jump):
    rng = random.Random(block)
    rows, want = [], []
    for output in range(3):
        depth, latest = -1, {}
        for n in range(120):
            if rng.random() < 0.1:
                rows.append((output, n, rng.choice(["", ".", "3 directories, 4 files"])))
                continue
            depth = rng.randint(0, min(depth + jump, 40)) if rng.random() < 0.3 else min(depth + 1, 40)
            latest[depth] = f"n{n}"
            rows.append((output, n, "│   " * depth + "├── " + f"n{n}"))
            want.append((output, n, depth, "/".join(latest[k] for k in range(depth + 1) if k in latest)))
    lines = spark.createDataFrame(rows, f"{ID} int, {NO} long, {LINE} string").withColumn("profile", F.lit("safe"))
    out = rebuild_tree_paths(lines, 64, block)
    assert sorted((r[ID], r[NO], r.depth, r.value) for r in out.collect()) == want
    assert out.columns == [ID, NO, "depth", "profile", "value"]
