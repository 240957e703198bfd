"""Format detection from line statistics: counts and marks that add up over blocks, for outputs beyond one cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linesieve.functions import patterns as P
from linesieve.functions.predicates import contains_secret, is_test_failure, match_head, match_parts
from linesieve.functions.text import let, strip, token_parts
from linesieve.operators.chunks import BEFORE, BLOCK, CHUNK, carry, in_chunk, with_chunk
from linesieve.operators.detect import command_words, detect_by, is_tree_noise, listing_by, route_by, tree_depth
from linesieve.operators.lines import ID, LINE, N, NO


def _any(x: Column) -> Column:
    return F.coalesce(F.max(x), F.lit(False))


def line_signs(lines: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row per output with what the detector, the router and the guard ask of its whole text.

    All are counts, sums, maxima and minima, so they are found per task and merged; no output comes together. A text
    cut into lines is not parsed as JSON.
    """
    line = F.col(LINE)
    low, bare = F.lower(line), strip(line)
    path = let(match_head(line), lambda h: F.when(h != "", match_parts(line, h)["path"]))
    has = lambda words: [F.contains(low, F.lit(w)) for w in words]
    marked = F.lit(False)
    for mark in P.TREE_MARKS:
        marked = marked | F.contains(line, F.lit(mark))
    tests = has(["test", "passed", "failed"])
    cjk, n_bytes, marks = token_parts(line)
    counted = lines.groupBy(ID).agg(
        F.count(F.lit(1)).alias("raw_lines"), _any((F.col(NO) == 0) & F.startswith(line, F.lit("diff --git "))).alias("diff_head"),
        _any(F.startswith(line, F.lit("@@ ")) & line.rlike(P.GIT_HUNK)).alias("hunk"),
        _any(tests[0] | tests[1] | tests[2]).alias("test_words"),
        sum((_any(m).cast("int") for m in has(P.TEST_MARKERS)), F.lit(0)).alias("markers"),
        F.count_if(line.rlike(P.SEVERITY_WORDS)).alias("severe"),
        (F.min(path) != F.max(path)).alias("many_paths"),
        F.count_if(bare != "").alias("filled"), F.count_if((bare != "") & bare.rlike(P.LONG_LISTING)).alias("long_rows"), _any(marked).alias("marked"),
        F.count_if((bare != "") & ~is_tree_noise(line)).alias("tree_rows"), F.count_if((bare != "") & ~is_tree_noise(line) & line.rlike(P.TREE_NODE)).alias("tree_nodes"),
        _any(contains_secret(line)).alias("secret"), _any(is_test_failure(line)).alias("test_failed"),
        F.sum(cjk).cast("long").alias("cjk"), F.sum(marks).cast("long").alias("marks"), F.sum(n_bytes).cast("long").alias("line_bytes"),
    )
    return counted.join(_jumps(lines, size), ID, "left").withColumns({
        "jumps": F.coalesce("jumps", F.lit(0).cast("long")), "many_paths": F.coalesce("many_paths", F.lit(False)),
    })


def _jumps(lines: DataFrame, size: int) -> DataFrame:
    """Drawn nodes more than one level below the node before them, per output."""
    nodes = lines.where((strip(LINE) != "") & ~is_tree_noise(F.col(LINE)) & F.col(LINE).rlike(P.TREE_NODE))
    nodes = with_chunk(nodes.select(ID, NO, tree_depth(F.col(LINE)).alias("depth")), NO, size)
    local = nodes.withColumn("_prev", F.lag("depth").over(in_chunk([ID], NO)))
    linked = carry(local, [ID], {"_back": (F.max_by("depth", NO), lambda c: F.last(c, ignorenulls=True), BEFORE)})
    step = F.col("depth") - F.coalesce("_prev", "_back", F.lit(-1))
    return linked.groupBy(ID).agg(F.count_if(step > 1).alias("jumps"))


def classify_lines(facts: DataFrame, signs: DataFrame) -> DataFrame:
    """``facts`` (command, kind_hint, profile) with the signs of their lines, the kind, confidence, reason and route.

    The same rules as for texts in one cell. Outputs without lines have no signs and no route.
    """
    known = facts.join(signs, ID, "left")
    words = F.transform(command_words(F.col("command")), lambda w: F.lower(w))
    severe = F.col("severe")
    found = detect_by(words, F.col("kind_hint"), {
        "diff_head": F.col("diff_head"), "hunk": F.col("hunk"), "test_words": F.col("test_words"), "markers": F.col("markers"), "json": F.lit(False),
        "dense": (severe > 0) & (severe >= F.greatest(F.lit(8), F.floor(F.col("raw_lines") / 8))),
    })
    nodes, rows = F.col("tree_nodes"), F.col("tree_rows")
    holds = (nodes > 0) & (rows - nodes <= F.greatest(F.lit(3), F.floor(nodes / 10))) & (F.col("jumps") == 0)
    listing = listing_by(F.col("filled"), F.col("long_rows"), F.col("marked"), holds)
    with_kind = known.withColumn("_d", F.when(F.col("raw_lines").isNotNull(), found)).withColumns(
        {"kind": F.col("_d.kind"), "confidence": F.col("_d.confidence"), "detection_reason": F.col("_d.reason")}
    ).drop("_d")
    route = F.when(F.col("kind").isNotNull(), route_by(F.col("kind"), F.col("profile"), F.lit(False), F.col("many_paths"), listing))
    return with_kind.withColumn("_r", F.split(route, ":")).withColumns(
        {"route": F.get("_r", F.lit(0)), "route_note": F.get("_r", F.lit(1))}
    ).drop("_r")
