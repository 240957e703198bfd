"""The registered check of whole needed lines, on long lines and lines without numbers."""

import random

import pytest

from linesieve.operators import containment
from linesieve.operators.containment import containment_check, lines_holding, missing_lines
from linesieve.plans import catalogue
from linesieve.sources.staging import unstaged


@pytest.mark.parametrize("piece", [7, 1 << 20])
def test_lines_inside_lines(spark, monkeypatch, piece):
    """Parts of every class, of one byte to thousands, in lines that are cut into tiny pieces and in whole ones."""
    monkeypatch.setattr(containment, "PIECE", piece)
    rng = random.Random(6)
    alphabet = "aé🙂 b"
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    lines = [(k % 3, k, text(rng.choice([0, 1, 2, 6, 20, 60, 300, 2000]))) for k in range(90)]
    parts = [(9, "a"), (1, "")]
    for i, _, line in lines:
        at, size = rng.randint(0, len(line)), rng.choice([1, 2, 4, 9, 17, 33, 70, 130, 400])
        parts += [(i, line[at:at + size]), ((i + 1) % 3, line[at:at + size]), (i, line), (i, line[:-1] + "c")]
    need = spark.createDataFrame(parts, "output_id int, line string")
    view = spark.createDataFrame([*lines, (1, 400, None)], "output_id int, line_no int, line string")
    got = [(r.output_id, r.line_no, r._part) for r in lines_holding(need, view).collect()]
    want = {(i, n, part) for i, n, line in lines for j, part in parts if i == j and part in line}
    assert len(got) == len(set(got)) and set(got) == want
    met = {(i, part) for i, _, part in want}
    assert {(r.output_id, r.line) for r in missing_lines(need, view).collect()} == set(parts) - met
    checked = {r.output_id: (r.needed, r.missing, r.passed) for r in containment_check(need, view).collect()}
    for i in (0, 1, 2, 9):
        mine = {p for p in parts if p[0] == i}
        assert checked[i] == (len(mine), len(mine - met), mine <= met)


def test_needed_lines_are_whole(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    long = [" ".join(word() for _ in range(4096 // 2)) for _ in range(2)]
    texts = [
        long[0] + "\nno number",                   # first line shown whole, second one without its last character
        "start\n" + long[1] + "\nend",             # only the last character of a long line is missing
        "\n".join(f"line {k:02d}" for k in range(10)),
        "a\n\nb" + "\n" * 3, "x" * (4096 + 15), "", None,
    ]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.output_id: (r.needed, r.missing, r.passed) for r in catalogue.doc_containment_whole(spark, str(tmp_path)).collect()}
    want = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        lines = lines[:-1] if lines[-1] == "" else lines
        shown = [f"> {line if k % 2 == 0 else line[:-1]} <" for k, line in enumerate(lines) if k < 3 or k >= len(lines) - 2]
        needed = {line for line in lines if line}
        if needed:
            missing = sum(not any(line in s for s in shown) for line in needed)
            want[i] = (len(needed), missing, missing == 0)
    assert want[0][1] == 1 and want[1][1] == 1 and want[2][1] > 2
    assert got == want


@pytest.mark.parametrize("few", [0, 2, 8])
def test_parts_in_many_lines(spark, monkeypatch, few):
    """Parts whose least minimizer is in many lines of the output are looked up by their rarest one; repeated rows too."""
    monkeypatch.setattr(containment, "FEW", few, raising=False)
    rng = random.Random(8)
    start = "2024-01-01 00:00:00 INFO worker started with the usual settings "
    lines = [(k % 2, k, start + "".join(rng.choice("abc") for _ in range(40)) + " end") for k in range(60)]
    lines += [(0, 60 + k, "x" * k) for k in range(12)] + [(1, 80, ""), (1, 81, None)]
    parts = [(i, line[:-1]) for i, _, line in lines if line] + [(0, start), (0, "x"), (0, "xxx"), (0, ""), (2, ""), (1, ""), (1, "abc")]
    parts += [(i, part + "?") for i, part in parts] + parts[:9]
    need = spark.createDataFrame(parts, "output_id int, line string")
    view = spark.createDataFrame([*lines, *lines[:5]], "output_id int, line_no int, line string")
    want = sorted((i, n, p) for i, n, line in [*lines, *lines[:5]] if line is not None for j, p in set(parts) if i == j and p in line)
    assert sorted((r.output_id, r.line_no, r._part) for r in lines_holding(need, view).collect()) == want
    with unstaged():
        assert sorted((r.output_id, r.line_no, r._part) for r in lines_holding(need, view).collect()) == want
    missing = set(parts) - {(i, p) for i, _, p in want}
    assert sorted((r.output_id, r.line) for r in missing_lines(need, view).collect()) == sorted(missing)
    got = {r.output_id: (r.needed, r.missing) for r in containment_check(need, view).collect()}
    assert got == {i: (sum(j == i for j, _ in set(parts)), sum(j == i for j, _ in missing)) for i in (0, 1, 2)}


def test_lines_are_made_twice_and_written_never(spark, monkeypatch):
    """The lines of both sides are made for the keys and for the comparison only, and tables in between hold no text."""
    kinds, staged = [], containment.stage
    monkeypatch.setattr(containment, "stage", lambda df, *a: kinds.extend(t for c, t in df.dtypes) or staged(df, *a))
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abcdef ") for _ in range(50))) for i in range(40) for _ in range(3)]
    made = [spark.sparkContext.accumulator(0) for _ in range(2)]

    def counted(df, count):
        def run(batches):
            for batch in batches:
                count.add(batch.num_rows)
                yield batch
        return df.mapInArrow(run, df.schema)

    need = counted(spark.createDataFrame(rows, "output_id int, line string"), made[0])
    view = counted(spark.createDataFrame([(i, f"> {line} <") for i, line in rows[::2]], "output_id int, line string"), made[1])
    assert sum(r.missing for r in containment_check(need, view).collect()) == 60
    assert made[0].value <= 2 * 120 and made[1].value <= 2 * 60
    assert "string" not in kinds
