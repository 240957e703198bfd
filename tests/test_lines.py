"""Line operators against brute force, with tiny blocks so that every block border is crossed."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from linesieve.operators.chunks import numbered
from linesieve.operators.lines import (
    anchor_rows, assemble_view, carry_section, collapse_consecutive_duplicates, collapse_progress, count_lines,
    duplicate_runs, expand_windows, extract_critical_lines, grep_context, head_lines, render_windows, slice_lines,
    spread_sample, tail_lines,
)
from linesieve.operators.reduce_git import cap_commit_bodies
from linesieve.operators.reduce_listing import rebuild_tree_paths
from linesieve.operators.reduce_search import alias_repeated_bodies, sample_matches
from linesieve.operators.reduce_text import reduce_generic, reduce_log
from linesieve.sources.outputs import explode_lines

SIZES = [3, 65_536]


def table(spark, texts: dict) -> object:
    rows = [(k, i, len(v), line) for k, v in texts.items() for i, line in enumerate(v)]
    schema = "output_id long, line_no long, n_lines long, line string"
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    return {k: [rng.choice("abc") for _ in range(rng.randint(1, 23))] for k in range(60)}


def views(df):
    return {r.output_id: r for r in assemble_view(df).collect()}


def runs_of(lines):
    return [(len(list(g)), k) for k, g in itertools.groupby(lines)]


@pytest.mark.parametrize("size", SIZES)
def test_collapse_duplicates(spark, texts, size):
    lines = table(spark, texts)
    got = views(collapse_consecutive_duplicates(lines, size))
    for k, v in texts.items():
        want = []
        for n, x in runs_of(v):
            want.append(x)
            if n > 1:
                want.append(f"… previous line repeated {n - 1} more times …")
        assert got[k].view == "\n".join(want)
        assert got[k].omitted_lines == len(v) - len(runs_of(v))
    assert duplicate_runs(lines, size).agg(F.sum("run")).first()[0] == sum(map(len, texts.values()))


def covered_set(n, hits, r):
    return {j for h in hits for j in range(h - r, h + r + 1) if 0 <= j < n}


def windowed(lines, covered):
    out, gap = [], 0
    for i, x in enumerate(lines):
        if i in covered:
            if gap:
                out.append(f"… {gap} lines omitted …")
            gap = 0
            out.append(x)
        else:
            gap += 1
    return out + ([f"… {gap} lines omitted …"] if gap else [])


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("radius", [0, 2])
def test_windows(spark, texts, size, radius):
    texts = {k: [f"{x}{i}" for i, x in enumerate(v)] for k, v in texts.items()}
    lines = table(spark, texts)
    hits = anchor_rows(lines, 1, 1, F.col("line").rlike("a(5|1.)"))
    got = views(render_windows(lines, expand_windows(hits, radius), size))
    for k, v in texts.items():
        where = [i for i, x in enumerate(v) if i == 0 or i == len(v) - 1 or re.search("a(5|1.)", x)]
        cover = covered_set(len(v), where, radius)
        assert got[k].view == "\n".join(windowed(v, cover))
        assert got[k].omitted_lines == len(v) - len(cover)


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("context", [0, 1, 3])
def test_grep(spark, texts, size, context):
    got = views(grep_context(table(spark, texts), "a", context, size=size))
    for k, v in texts.items():
        cover = sorted(covered_set(len(v), [i for i, x in enumerate(v) if x == "a"], context))
        want = []
        for a, b in zip([None, *cover], cover):
            want += (["--"] if a is not None and b > a + 1 else []) + [f"{b + 1}:{v[b]}"]
        assert (got[k].view if k in got else "") == "\n".join(want)


def test_literal_grep_takes_marks_as_text(spark):
    lines = table(spark, {1: ["a.c", "abc", "a.c."]})
    found = grep_context(lines, "a.c", 0, fixed=True).where("o2 = 0").select("line").collect()
    assert sorted(r.line for r in found) == ["1:a.c", "3:a.c."]


def test_slices(spark, texts):
    lines = table(spark, texts)
    pick = lambda df: {(r.output_id, r.line_no) for r in df.collect()}
    every = [(k, i, len(v)) for k, v in texts.items() for i in range(len(v))]
    assert pick(head_lines(lines, 4)) == {(k, i) for k, i, n in every if i < 4}
    assert pick(tail_lines(lines, 4)) == {(k, i) for k, i, n in every if i >= n - 4}
    assert pick(tail_lines(lines, 0)) == set()
    assert pick(slice_lines(lines, 2, 3)) == {(k, i) for k, i, n in every if i in (1, 2)}
    assert pick(slice_lines(lines, None, 2)) == {(k, i) for k, i, n in every if i < 2}
    assert pick(slice_lines(lines, 5)) == {(k, i) for k, i, n in every if i >= 4}
    assert pick(slice_lines(lines, 0, 0)) == set()


@pytest.mark.parametrize("size", SIZES)
def test_numbers_and_spread(spark, texts, size):
    lines = table(spark, texts).select("output_id", (F.col("line_no") * 7).alias("at"))
    placed = numbered(lines, ["output_id"], ["at"], "at", size)
    assert all(r.idx == r.at // 7 and r.n_items == len(texts[r.output_id]) for r in placed.collect())
    for k in (1, 2, 5, 12):
        got = {(r.output_id, r.idx) for r in spread_sample(lines, ["output_id"], "at", k, size).collect()}
        want = set()
        for key, v in texts.items():
            n = len(v)
            places = range(n) if n <= k else [0] if k == 1 else [round(s * (n - 1) / (k - 1)) for s in range(k)]
            want |= {(key, p) for p in places}
        assert got == want


@pytest.mark.parametrize("size", SIZES)
def test_sections_and_counts(spark, texts, size):
    lines = table(spark, texts)
    got = {
        (r.output_id, r.line_no): r.section
        for r in carry_section(
            lines, ["output_id"], "line_no", F.when(F.col("line") == "a", F.concat("line", "line_no")), size
        ).collect()
    }
    for k, v in texts.items():
        last = None
        for i, x in enumerate(v):
            last = f"a{i}" if x == "a" else last
            assert got[k, i] == last
    counted = count_lines(lines.drop("n_lines"), size).collect()
    assert all(r.n_lines == len(texts[r.output_id]) for r in counted) and len(counted) == sum(map(len, texts.values()))


@pytest.mark.parametrize("size", SIZES)
def test_progress_families(spark, size):
    rng = random.Random(3)
    make = lambda: rng.choice([f"Building core {rng.randint(1, 9)}", f"Processing web {rng.randint(1, 9)}", "note", "tail"])
    texts = {k: [make() for _ in range(rng.randint(1, 15))] for k in range(40)}
    rows = collapse_consecutive_duplicates(table(spark, texts), size)
    got = views(collapse_progress(rows))
    for k, v in texts.items():
        out, place, gone, dropped = [], {}, 0, 0
        for n, x in runs_of(v):
            key = re.sub(r"\d+", "<n>", x)
            if key[-3:] == "<n>" and key in place:
                out[place[key]] = x
                gone += 1
            else:
                place.setdefault(key, len(out))
                out.append(x)
            if n > 1:
                out.append(f"… previous line repeated {n - 1} more times …")
                dropped += n - 1
        if gone:
            out.append(f"… {gone} intermediate progress lines collapsed …")
        assert got[k].view == "\n".join(out)
        assert got[k].omitted_lines == gone + dropped


@pytest.mark.parametrize("size", SIZES)
def test_generic_windows_on_long_views(spark, size):
    """Decisive lines, lines that hold one inside other text, and the edges stay with two neighbours."""
    rng = random.Random(11)
    words = ["plain", "row", "panics", "x terror y", "note"]
    texts = {}
    for k in range(6):
        v = [f"{rng.choice(words)} {i}" for i in range(rng.randint(100, 260))]
        for at in rng.sample(range(len(v)), 2):
            v[at] = rng.choice(["error", "panic", "disk timeout seen"])
        texts[k] = v
    got = views(reduce_generic(table(spark, texts), "max", size))
    word = re.compile(r"\b(error|panic|timeout)\b")
    for k, v in texts.items():
        squeezed = [x for _, x in runs_of(v)]
        assert len(squeezed) == len(v)
        if len(v) <= 120:
            assert got[k].view == "\n".join(v)
            continue
        critical = {x for x in v if word.search(x)}
        hits = [i for i, x in enumerate(v) if i < 8 or i >= len(v) - 16 or any(c in x for c in critical)]
        cover = covered_set(len(v), hits, 2)
        assert got[k].view == "\n".join(windowed(v, cover))
        assert got[k].omitted_lines == len(v) - len(cover)


def test_critical_lines_keep_first_place(spark):
    lines = table(spark, {1: ["ok", "error: a", "x", "error: a", "app.py:12 here", "exit code 3", "exit code 0"]})
    got = {(r.line, r.line_no) for r in extract_critical_lines(lines).collect()}
    assert got == {("error: a", 1), ("app.py:12 here", 4), ("exit code 3", 5)}


@pytest.mark.parametrize("size", SIZES)
def test_commit_bodies(spark, size):
    rng = random.Random(5)
    make = lambda: rng.choice(["commit 1f", "Author: me", "Date: now", "", "", "  ", "text", "more", "body"])
    texts = {k: [make() for _ in range(rng.randint(1, 30))] for k in range(80)}
    got = views(cap_commit_bodies(table(spark, texts), size))
    for k, v in texts.items():
        kept, body, seen, gone = [], False, 0, 0
        for x in v:
            if x.startswith("commit "):
                body, seen = False, 0
            is_header = x.startswith(("commit ", "Author:", "Date:"))
            if x.strip() == "":
                body = True
                if kept and kept[-1] != "":
                    kept.append("")
            elif is_header or not body or seen < 2:
                seen += body and not is_header
                kept.append(x)
            else:
                gone += 1
        if gone:
            kept.append(f"… {gone} commit-body lines omitted …")
        assert (got[k].view if k in got else "") == "\n".join(kept)


@pytest.mark.parametrize("size", SIZES)
def test_tree_paths(spark, size):
    rng = random.Random(9)
    texts, want = {}, {}
    for k in range(30):
        rows, paths, depth, stack = ["root"], [], -1, []
        for i in range(rng.randint(1, 25)):
            depth = rng.randint(0, depth + 1)
            stack = stack[:depth] + [f"n{i}"]
            rows.append("│   " * depth + rng.choice(["├── ", "└── "]) + f"n{i}")
            paths.append("/".join(stack))
        texts[k], want[k] = rows, paths
    got = rebuild_tree_paths(table(spark, texts), size).collect()
    found = {k: [r.value for r in sorted(got, key=lambda r: r.line_no) if r.output_id == k] for k in texts}
    assert found == want


@pytest.mark.parametrize("size", SIZES)
def test_match_sample_and_aliases(spark, size):
    rng = random.Random(13)
    bodies = ["short", "a rather long repeated body of a match", "another long body that comes back", "fatal failure"]
    bodies += [f"routine number {i} with a long tail" for i in range(14)]
    rows, cases = [], {}
    for k in range(12):
        case = [(rng.choice("pqrst"), rng.choice(bodies)) for _ in range(rng.randint(5, 150))]
        cases[k] = case
        rows += [(k, i, p, b) for i, (p, b) in enumerate(case)]
    matches = spark.createDataFrame(rows, "output_id long, line_no long, path string, body string").repartition(4)
    budget = 6
    chosen = sample_matches(matches, F.lit(budget), size).cache()
    got = {(r.output_id, r.line_no) for r in chosen.collect()}
    aliases = {(r.output_id, r.body): r.alias for r in alias_repeated_bodies(chosen).collect()}
    for k, case in cases.items():
        by_path = {}
        for i, (p, b) in enumerate(case):
            by_path.setdefault(p, []).append((i, b))
        picked = []
        for items in by_path.values():
            n = len(items)
            bad = [j for j, (_, b) in enumerate(items) if "fatal" in b]
            spread = range(n) if n <= budget else sorted({round(s * (n - 1) / (budget - 1)) for s in range(budget)})
            free = [j for j in spread if j not in bad]
            room = budget - len(bad)
            if 0 < room < len(free):
                free = free[:room]
            picked.append([items[j] for j in sorted({*bad, *free})])
        assert {(k, i) for group in picked for i, _ in group} == {g for g in got if g[0] == k}
        order, counts = [], {}
        for group in picked:
            for _, b in group:
                if "fatal" not in b:
                    if b not in counts:
                        order.append(b)
                    counts[b] = counts.get(b, 0) + 1
        want = {}
        for b in order:
            name, c = f"@{len(want) + 1}", counts[b]
            if c >= 3 and len(b) * c - (len(name) * c + len(name) + len(b) + 4) >= 24:
                want[b] = name
        assert {b: a for (o, b), a in aliases.items() if o == k} == want


def test_many_aliases_change_length(spark):
    """More than 99 accepted bodies, so that the alias length grows twice."""
    rng = random.Random(1)
    rows, order = [], []
    for i in range(260):
        b, c = "x" * rng.randint(10, 24) + f"{i}", rng.randint(3, 4)
        order.append((b, c))
        rows += [(1, len(rows) + j, "p", b, False, 0) for j in range(c)]
    df = spark.createDataFrame(
        rows, "output_id long, line_no long, path string, body string, is_error boolean, first_no long").repartition(3)
    got = {r.body: r.alias for r in alias_repeated_bodies(df).collect()}
    want = {}
    for b, c in order:
        name = f"@{len(want) + 1}"
        if c >= 3 and len(b) * c - (len(name) * c + len(name) + len(b) + 4) >= 24:
            want[b] = name
    assert len(want) > 99 and got == want


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("profile", ["safe", "max"])
def test_log_reduction(spark, size, profile):
    rng = random.Random(21)
    make = lambda: rng.choice(
        [f"INFO job {rng.randint(1, 99)} done", f"DEBUG step {rng.randint(1, 99)}", f"INFO load={rng.randint(1, 9)}.5",
         "idle", "", "WARN slow", "ERROR down"])
    texts = {k: [make() for _ in range(rng.randint(1, 60))] for k in range(30)}
    got = views(reduce_log(table(spark, texts), profile, size))
    least, radius, shown = (1, 3, 40) if profile == "safe" else (3, 2, 20)
    for k, v in texts.items():
        families, hits = {}, set()
        for i, x in enumerate(v):
            if i < 5 or i >= len(v) - 8 or x.startswith(("WARN", "ERROR")):
                hits.add(i)
            if not x.startswith(("WARN", "ERROR")):
                families.setdefault(re.sub(r"\d+(\.\d+)?", "<n>", x), []).append(i)
        families.pop("", None)
        hits |= {f[0] for f in families.values() if len(f) >= least}
        want = "\n".join(windowed(v, covered_set(len(v), hits, radius)))
        listed = [f"×{len(f)} {t}" for t, f in families.items() if len(f) > 1]
        if listed:
            want += "\n\n[repeated log templates]\n" + "\n".join(listed[:shown])
        assert got[k].view == want


def test_lines_follow_every_break(spark):
    raw = "a\nb\r\nc\rd\x0be\x0cf\x1cg h\x85\n\ni\n"
    df = spark.createDataFrame([(1, raw), (2, ""), (3, "\n"), (4, "x")], "output_id long, text string")
    got = {}
    for r in explode_lines(df).collect():
        got.setdefault(r.output_id, {})[r.line_no] = r.line
    for k, text in ((1, raw), (3, "\n"), (4, "x")):
        assert [got[k][i] for i in range(len(got[k]))] == text.splitlines()
    assert 2 not in got
