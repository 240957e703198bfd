"""Substring deduplication, ranked search and the filter audit against brute force, and on awkward tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from linesieve.llm import filter_audit, spans, substring_dedup, treap_search
from linesieve.llm.common import Workspace

SCHEMA = "doc_id long, text string, source string, body string, row string, runs string, doc int, null_text int"


def docs_of(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, s, "b", "r", "x", 7, 8) for i, t, s in rows], SCHEMA)


def awkward_texts(seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(200)] + ["Ünï", "a,b", "x-1", "THE", "The", "the", "#", "5%"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 260))) for _ in range(40)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(0, 50))) + " " + passage + "\n" + " ".join(rng.choice(words) for _ in range(9)) for _ in range(12)]
    texts += [" ".join(passage.split()[k:k + n]) for k, n in ((0, 34), (3, 35), (20, 36), (1, 59))]
    for k in range(0, 12, 3):
        copy = texts[k].split()
        for _ in range(3):
            if copy:
                copy[rng.randrange(len(copy))] = "changed"
        texts.append("\t".join(copy))
    texts += ["a b " * 60, "b a " * 40, "one " * 35, "one " * 34, "z" * 70_000 + " the w1", "é" * 120 + "🙂 x", "", "  \n", "CAPS LOCK", texts[3], texts[3]]
    return texts


def awkward_rows():
    rows = [(k * 3 % 211, t, f"src{k % 3}") for k, t in enumerate(awkward_texts())]
    again = rows[2]
    return rows + [(None, None, None), (None, rows[5][1], None), (300, None, ""), (301, "", "src0"), again, again, (1000, again[1], "src1")]


# substring deduplication

def brute_removed(texts, length):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[k:k + length]) for w in split for k in range(len(w) - length + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k:k + length])] > 1:
                gone[k:k + length] = [True] * length
        out.append((w, gone))
    return out


@pytest.mark.parametrize("run_limit, length", [(500, 35), (1, 35), (500, 11), (1, 80)])
def test_substrings_match_brute_force(spark, monkeypatch, run_limit, length):
    monkeypatch.setattr(substring_dedup, "RUN", run_limit)
    rows = awkward_rows()
    runs = substring_dedup.repeated_words(docs_of(spark, rows), length)
    got = sorted(map(str, (tuple(r) for r in substring_dedup.word_removal_digests(runs).collect())))
    judged = brute_removed([t for _, t, _ in rows], length)
    kept = [" ".join(x for x, g in zip(w, gone) if not g) for w, gone in judged]
    want = [(i, len(w), sum(gone), hashlib.sha256(k.encode()).hexdigest()) for (i, _, _), (w, gone), k in zip(rows, judged, kept)]
    assert got == sorted(map(str, want))
    if length == 35 and run_limit > 1:
        found = Counter((r.doc_id, r.n_words) for r in substring_dedup.word_repeat_spans(runs).collect())
        maximal = Counter((i, len(list(g))) for (i, _, _), (_, gone) in zip(rows, judged) for x, g in itertools.groupby(gone) if x)
        assert found == maximal
        docs = docs_of(spark, rows)
        cut = substring_dedup.without_repeated_words(docs, length)
        assert cut.columns == docs.columns
        texts = [t if t is None or not any(gone) else k for (_, t, _), (_, gone), k in zip(rows, judged, kept)]
        assert Counter((r.doc_id, r.text, r.source) for r in cut.collect()) == Counter((i, t, s) for (i, _, s), t in zip(rows, texts))


def test_substrings_of_long_texts_are_cut_into_slices(monkeypatch):
    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(500)}" for _ in range(30_000)) + " " + "y" * 70_000 + " end"
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([long])], names=["doc", "code", "body"])
    windows = lambda: {(r["gram"], r["pos"] + r["back"], s) for b in substring_dedup._anchors(35)([batch]) for r in b.to_pylist() for s in range(r["pos"], r["pos"] + r["more"] + 1)}
    whole = windows()
    assert sorted(s for *_, s in whole) == list(range(30_002 - 34))
    monkeypatch.setattr(substring_dedup, "SLICE", 10_000)
    monkeypatch.setattr(substring_dedup, "BLOCK", 700)
    assert windows() == whole
    words = long.encode().split()
    assert [w for part in spans.word_slices(long.encode(), 5000) for w in part] == words
    monkeypatch.setattr(substring_dedup, "word_slices", lambda raw: spans.word_slices(raw, 1000))
    cut = np.array([[0, 40], [500, 9000], [29_990, 30_002]])
    assert [w for part in substring_dedup.kept_words(long.encode(), cut) for w in part] == words[40:500] + words[9000:29_990]


def test_substring_lengths_and_empty_table(spark):
    with pytest.raises(ValueError):
        substring_dedup.repeated_words(docs_of(spark, []), substring_dedup.GRAM)
    assert substring_dedup.word_removal_digests(substring_dedup.repeated_words(docs_of(spark, []))).collect() == []


# ranked search

def terms_of(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute_search(rows, items, k):
    docs = [(i, Counter(terms_of(t))) for i, t, _ in rows]
    n = [sum(c.values()) for _, c in docs]
    many, total = sum(x > 0 for x in n), sum(n)
    held = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in set(items):
        asked = Counter(terms_of(text))
        scores = []
        for (i, c), size in zip(docs, n):
            m = 100 - 25 + (25 * size * many) // total if size else 0
            score = sum(
                times * math.floor(1000 * math.log((2 * many + 2) / (2 * held[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m))
                for t, times in asked.items() if t in c
            )
            if score > 0:
                scores.append((-score, i is None, i))
        scores.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, place + 1, i, -s) for place, (s, _, i) in enumerate(scores[:k])]
    return out


ITEMS = [(1, "w1 w2 w3 The THE the"), (2, "w17"), (3, None), (4, ""), (5, "nowhere else"), (6, "Ünï x 1 changed one a b"), (None, "w5 w6 w7 w8"), (2, "w17"), (2, "w18 w19")]


@pytest.mark.parametrize("k", [1, 4, 20])
def test_search_matches_brute_force(spark, k):
    rows = awkward_rows()
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = treap_search.ranked_search(docs_of(spark, rows), items, k).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_search(rows, ITEMS, k)))


@pytest.mark.parametrize("beam, docs", [(1, 3), (2, 8), (16, 1)])
def test_search_by_small_blocks_and_beams(spark, monkeypatch, beam, docs):
    for name, value in (("BEAM", beam), ("BLOCK_DOCS", docs), ("TOGETHER", 2)):
        monkeypatch.setattr(treap_search, name, value)
    rows = awkward_rows()
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, *_ in rows], pa.int64()), pa.array([t or "" for _, t, _ in rows])], names=["id", "body"])
    sizes = pa.Table.from_batches(treap_search._sizes(iter([batch.select(["body"])]))).to_pylist()[0]
    blocks = list(treap_search._index(sizes["documents"], sizes["terms"])([batch]))
    assert len(blocks) >= len(rows) // docs // 2
    items = treap_search.Items([t or "" for _, t in ITEMS])
    held = pa.Table.from_batches(treap_search._held_by(items.terms)(blocks)).to_pylist()
    items.weigh({r["term"] & (1 << 64) - 1: r["n"] for r in held}, sizes["documents"])
    found = pa.Table.from_batches(treap_search._search(items, list(range(len(ITEMS))), 5)(blocks)).to_pylist()
    want = brute_search(rows, [(k, t) for k, (_, t) in enumerate(ITEMS)], 5)
    assert sorted(str((r["item_id"], r["doc_id"], r["score"])) for r in found) == sorted(str((i, d, s)) for i, _, d, s in want)


def test_treap_keeps_points_and_maxima():
    rng = np.random.default_rng(4)
    point = np.unique(rng.integers(0, 64 * 64, 300))
    rows, columns, values = point // 64, point % 64, rng.integers(1, 1000, len(point))
    treap = treap_search.Treap.build(rows, columns, values, 6)
    child, top = treap.unfold()
    assert top[0] == values.max() and (treap.drops >= 0).all()
    for r in range(64):
        for c in range(64):
            cell = 0
            for level in range(6):
                quarter = (r >> 5 - level & 1) * 2 + (c >> 5 - level & 1)
                bits = int(treap.bits[cell])
                if not bits >> quarter & 1:
                    cell = None
                    break
                cell = child[cell] + bin(bits & (1 << quarter) - 1).count("1")
                inside = (rows >> 5 - level == r >> 5 - level) & (columns >> 5 - level == c >> 5 - level)
                assert top[cell] == values[inside].max()
            assert (cell is not None) == bool(((rows == r) & (columns == c)).any())


def test_search_without_documents_or_items(spark):
    none, items = docs_of(spark, []), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert treap_search.ranked_search(none, items).collect() == []
    assert treap_search.ranked_search(docs_of(spark, [(1, "w1", "s")]), items.limit(0)).collect() == []
    assert treap_search.ranked_search(docs_of(spark, [(1, "?! ", "s"), (2, None, "s")]), items).collect() == []


def test_search_takes_items_in_passes(spark, monkeypatch):
    monkeypatch.setattr(treap_search, "PASS_BYTES", 30)
    rows = awkward_rows()
    space = Workspace(spark, "search")
    index = treap_search.build_index(docs_of(spark, rows), space)
    got = treap_search.search(index, spark.createDataFrame(ITEMS, "item_id long, text string"), space, 3).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_search(rows, ITEMS, 3)))


# filter audit

def brute_audit(rows, labels):
    def fails(k):
        i, text, _ = rows[k]
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        smaller = any((t or "") == text and j is not None and (i is None or j < i) for j, t, _ in rows)
        return {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": smaller,
        }

    judged = [(s or "", fails(k), i) for k, (i, _, s) in enumerate(rows)]
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    out = []
    for part in {p for p, *_ in judged}:
        removed_by = defaultdict(int)
        part_rows = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [(f, i) for p, f, i in judged if p == part]
            whole = left
            for step, letter in enumerate(order):
                gone = [(f, i) for f, i in left if f[letter]]
                left = [(f, i) for f, i in left if not f[letter]]
                removed_by[letter] += len(gone)
                part_rows.append([
                    part, order, step + 1, len(left), len(gone), sum(f[letter] for f, _ in whole) - len(gone),
                    sum(f[letter] and sum(f.values()) == 1 for f, _ in whole), sum(i in good for _, i in gone), sum(i in toxic for _, i in gone), letter,
                ])
        out += [(*r[:-1], removed_by[r[-1]]) for r in part_rows]
    return out


def test_audit_matches_brute_force(spark):
    rows = awkward_rows()
    labels = [(k * 3 % 211, k % 2, k % 3) for k in range(60)] + [(None, 1, 1), (3, 1, 1), (6, None, None), (999, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(docs_of(spark, rows), table)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = sorted(tuple(r) for r in got.collect())
    assert len(got) == 600 * 4 and got == sorted(brute_audit(rows, labels))


def test_audit_without_documents_or_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(docs_of(spark, []), labels).collect() == []
    rows = [(1, "short", "s"), (2, "short", "s")]
    got = filter_audit.filter_audit(docs_of(spark, rows), labels).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute_audit(rows, []))


def test_positional_counts_and_truth_table():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 4, 5, 31, 1000):
        words = rng.integers(0, 1 << 32, n, np.uint64).astype(np.uint32)
        assert filter_audit.positional_counts(words).tolist() == [int((words >> np.uint32(b) & np.uint32(1)).sum()) for b in range(32)]
    assert all(bool(int(filter_audit.TRUTH[m]) >> s & 1) == (not m & s) for m in range(32) for s in range(32))
