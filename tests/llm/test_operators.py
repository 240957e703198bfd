"""Every operator against brute force, and on nulls, empty tables, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import json
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linesieve.llm import (
    bpe, chat_format, embedding_dedup, exact_dedup, hmm, near_dedup, packing, quality, suffix_dedup, token_files, words,
)
from linesieve.llm.common import id_remainder
from linesieve.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, body string, row string, score double, hash long"


def docs_of(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "b", "r", 1.0, 7) for i, t in rows], SCHEMA)


def some_texts(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 90))) for _ in range(n)]
    for k in range(0, n, 4):
        copy = texts[k].split()
        for _ in range(rng.randint(0, 3)):
            if copy:
                copy[rng.randrange(len(copy))] = "changed"
        texts.append("  ".join(copy).upper() if k % 8 else "\n".join(copy))
    return texts + [None, "", "   ", "\t\n", "one", "one two", "ONE  two", "a" * 5000, "é" * 120 + "🙂 x", texts[3], texts[3]]


def awkward_rows():
    rows = [(k * 3 % 101, t) for k, t in enumerate(some_texts())]
    return rows + [(None, "one two"), (None, None), (5, "repeated row"), (5, "repeated row")]


# exact deduplication

def test_exact_matches_brute_force(spark):
    rows = awkward_rows()
    out = exact_dedup.exact_dedup(docs_of(spark, rows), memory_bytes=2000).collect()
    groups: dict[bytes, list] = {}
    for i, t in rows:
        groups.setdefault(exact_dedup.normalise(t or ""), []).append(i)
    want = []
    for content, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), hashlib.sha256(content).hexdigest()) for i in ids]
    key = lambda r: str(tuple(r))
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out], key=key) == sorted(want, key=key)
    assert sum(r.kept for r in out) == len(groups)
    assert all(r.doc_id == r.keep_id for r in out if r.kept)


def test_grace_spills_and_survives_equal_hashes():
    rng = random.Random(3)
    records = [(rng.choice([1, 2, rng.getrandbits(64)]), bytes([rng.randrange(6)]) * rng.randrange(400), k) for k in range(500)]
    records = [(zlib.crc32(c) % 3 if h < 3 else zlib.crc32(c), c, p) for h, c, p in records]
    got = {}
    for content, payloads in exact_dedup.grace_groups(iter(records), memory_bytes=500, fan_out=4):
        got.setdefault(content, []).extend(payloads)
    want = {}
    for _, content, payload in records:
        want.setdefault(content, []).append(payload)
    assert {c: sorted(p) for c, p in got.items()} == want


def test_keep_first_copies_keeps_columns(spark):
    rows = awkward_rows()
    kept = exact_dedup.keep_first_copies(docs_of(spark, rows))
    assert kept.columns == ["doc_id", "text", "body", "row", "score", "hash"]
    assert kept.count() == len({exact_dedup.normalise(t or "") for _, t in rows})


# near duplicates

def brute_components(rows, percent=85, width=5):
    sets: dict = {}
    for i, t in rows:
        if i is None:
            continue
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        w = [x for x in w if x]
        s = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(s)
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, sets


def test_near_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE", 4)
    rng = random.Random(8)
    base = [f"v{k}" for k in range(60)]
    chain = []
    for k in range(40):
        variant = list(base)
        for _ in range(rng.randint(0, 3)):
            variant[rng.randrange(len(variant))] = f"x{rng.randrange(99)}"
        chain.append((500 + k, " ".join(variant)))
    rows = awkward_rows() + chain
    out = near_dedup.near_dedup(docs_of(spark, rows)).collect()
    want, sets = brute_components(rows)
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id], r
            assert r.n_shingles in {len(s) for s in sets[r.doc_id]}
            assert r.kept == (r.component_id == r.doc_id)


def test_bands_follow_the_threshold():
    for threshold in (0.5, 0.7, 0.8, 0.85, 0.9, 1.0):
        bands, rows = near_dedup.banding(threshold)
        assert bands * rows <= near_dedup.REGISTERS
        assert (1 - threshold ** rows) ** bands < 1e-4, threshold
    assert near_dedup.banding(0.85) == (22, 6)


def test_registers_estimate_similarity():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.8, 0.95):
        for size in (8, 40, 1000, 5000):
            guesses = []
            for _ in range(20):
                pool = rng.integers(1, 1 << 63, 2 * size, np.uint64)
                both = round(2 * size * share / (1 + share))
                a, b = np.sort(pool[:size]), np.sort(np.concatenate((pool[:both], pool[size:2 * size - both])))
                x, y = near_dedup.registers(np.concatenate((a, b)), np.array([len(a), len(b)]))
                guesses.append(float(near_dedup.estimate(np.array([(x == y).sum()]), np.array([size]), np.array([size]))[0]))
            true = both / (2 * size - both)
            assert abs(np.mean(guesses) - true) < 0.06, (share, size)


# suffix deduplication

def brute_spans(rows, length):
    seen, out = set(), []
    for i, t in sorted(rows):
        raw = (t or "").encode()
        mask = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - length + 1):
            w = raw[k:k + length]
            if w in seen:
                mask[k:k + length] = True
            seen.add(w)
        kept = bytes(b for b, m in zip(raw, mask) if not m)
        out.append((i, len(raw), int(mask.sum()), int((mask[1:] & ~mask[:-1]).sum() + mask[0]), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("run_limit", [20_000, 1])
def test_suffix_matches_brute_force(spark, monkeypatch, run_limit):
    monkeypatch.setattr(suffix_dedup, "RUN", run_limit)
    rng = random.Random(5)
    passage = "The common passage that many texts hold, long enough to be found wherever it stands in a text; " * 2
    rows = [(k, t) for k, t in enumerate(some_texts(2))]
    rows += [(1000 + k, "x" * k + passage[rng.randrange(30):] + str(rng.random()) * rng.randint(1, 9)) for k in range(40)]
    rows += [(2000, "The The " * 80), (2001, "ab" * 400), (2002, "ab" * 70), (2003, None)]
    got = suffix_dedup.removal_digests(suffix_dedup.repeated_runs(docs_of(spark, rows))).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute_spans(rows, 100))


def test_suffix_cut_gram_and_shared_ids(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SAMPLE", 400)
    rows = [(k, f"{k:05d}" + "same words in every text of this corpus, over and over again, so that one gram fills buckets " + f"{k * k:09d}" * 12) for k in range(300)]
    got = suffix_dedup.removal_digests(suffix_dedup.repeated_runs(docs_of(spark, rows))).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute_spans(rows, 100))
    long = "".join(chr(97 + (k * k) % 26) for k in range(400)) + "end"
    twice = [(1, long), (1, long), (2, long), (None, long), (3, "é" * 90 + long)]
    out = {(r.doc_id, r.n_removed) for r in suffix_dedup.removal_digests(suffix_dedup.repeated_runs(docs_of(spark, twice))).collect()}
    assert (2, len(long)) in out and (None, len(long)) in out
    assert len({n for i, n in out if i == 1}) == 1
    cut = suffix_dedup.without_repeats(docs_of(spark, [(1, "é" * 200), (2, "x" + "é" * 200), (3, None)]))
    assert cut.columns == ["doc_id", "text", "body", "row", "score", "hash"]
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[3] is None and set(texts[2]) <= {"x", "é"}


def test_suffix_long_strings(spark):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(1500))
    rows = [(k, f"{k:04d}" * (k + 1) + passage[k * 7:k * 7 + 900] + str(rng.random())) for k in range(30)]
    for length in (24, 280, 600):
        got = suffix_dedup.removal_digests(suffix_dedup.repeated_runs(docs_of(spark, rows), length)).collect()
        assert sorted(tuple(r) for r in got) == sorted(brute_spans(rows, length)), length
    for length in (23, suffix_dedup.LONGEST + 1):
        with pytest.raises(ValueError):
            suffix_dedup.repeated_runs(docs_of(spark, rows), length)


@pytest.mark.parametrize("run_limit", [20_000, 1])
@pytest.mark.parametrize("shared", [30, 60, 99, 100, 300])
def test_suffix_shared_grams_without_equal_windows(spark, monkeypatch, run_limit, shared):
    monkeypatch.setattr(suffix_dedup, "RUN", run_limit)
    rng = random.Random(shared)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    common = letters(shared)
    rows = [(k, letters(150) + common + letters(150)) for k in range(40)]
    got = suffix_dedup.removal_digests(suffix_dedup.repeated_runs(docs_of(spark, rows))).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute_spans(rows, 100))


def test_helper_columns_leave_the_input_alone(spark):
    rows = [(1, "a  b", 1, 2, 3, 4), (2, "a b", 5, 6, 7, 8), (3, None, 9, 9, 9, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, null_text int, id_key int, sha_key int, place_in_key int")
    assert [tuple(r) for r in exact_dedup.keep_first_copies(docs).orderBy("doc_id").collect()] == [rows[0], rows[2]]
    assert [tuple(r) for r in suffix_dedup.without_repeats(docs).orderBy("doc_id").collect()] == rows


def test_suffix_columns_hold_the_longest_segment():
    length = suffix_dedup.LONGEST
    text = np.frombuffer(random.Random(3).randbytes(3 * length), np.uint8)
    anchors = suffix_dedup.anchors_of(text, np.array([0, len(text)]), length)
    anchors |= {"doc": anchors["text"], "pos": anchors["low"], "back": anchors["place"] - anchors["low"], "more": anchors["high"] - anchors["low"]}
    again = suffix_dedup._unpack([suffix_dedup._pack(anchors, slice(0, None))])
    assert (again["back"] == anchors["back"]).all() and (again["more"] == anchors["more"]).all()
    assert (anchors["more"] + length).max() < 1 << 16


def test_multikey_quicksort_sorts():
    rng = np.random.default_rng(2)
    keys = [rng.integers(0, n, 30_000).astype(np.uint64) for n in (3, 5, 1000)] + [rng.permutation(30_000)]
    assert (suffix_dedup.multikey_quicksort(keys, small=64) == np.lexsort(keys[::-1])).all()


# tokens

TEXTS = [
    "", " ", "a'S b'll 12 x² İ ß 'S'", "Ça <|endoftext|> b", "a<|startoftext|>", " don't DON'T I'LL 3rd ½ ªº", "\x1c a\x85b\xa0c",
    "ΑΣ ΣΑΣ", "é x", "\n\n a\n\nb  c   \n", "aaaaaaaaaaa aaaaaaa", "日本語 テスト 🙂🙂", "        x\t\ty \n", "....,,,, ...",
    "x\r\ny", "word " * 3000, "z" * 3000,
]


def test_word_encoder_equals_library():
    path = tokenizer("word_bpe_49k.json")
    library, encoder = Tokenizer.from_file(path), words.WordEncoder(path)
    texts = TEXTS + [t or "" for t in some_texts()]
    for _ in range(2):
        at = 0
        for first, end, ids, counts in encoder.encode(pa.array(texts)):
            ends = np.cumsum(counts)
            for text, e, n in zip(texts[first:end], ends, counts):
                assert ids[e - n:e].tolist() == library.encode(text, add_special_tokens=False).ids, text[:40]
                at += 1
        assert at == len(texts)


def test_special_tokens_in_any_case():
    path = tokenizer("word_bpe_49k.json")
    library, encoder = Tokenizer.from_file(path), words.WordEncoder(path)
    for text in ("a <|ENDOFTEXT|> b", "a <|endoftext|> b", "a<|StartOfText|>", "a<|startoftext|>", "<|EndOfText|>."):
        (_, _, ids, _), = encoder.encode(pa.array([text]))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_bpe_equals_library(spark):
    path = tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = list(enumerate(TEXTS + [t or "" for t in some_texts()])) + [(None, None)]
    tokens = bpe.bpe_encode(docs_of(spark, rows), path)
    got = {(r.doc_id, tuple(r.ids)) for r in tokens.collect()}
    assert got == {(i, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows}
    back = {r.doc_id: r.text for r in bpe.bpe_decode(tokens, path).collect()}
    assert back == {i: t or "" for i, t in rows}


def test_compatible_pairs_equal_plain_merging():
    with open(tokenizer("byte_bpe_50k.json"), encoding="utf-8") as file:
        rules = json.load(file)
    merges = bpe.Merges(rules["model"]["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in rules["model"]["merges"]])

    def plain(text: bytes) -> list[int]:
        ids = [merges.id[chr(b)] for b in text]
        while len(ids) > 1:
            rank, k = min((merges.rank.get(pair, bpe.NEVER), k) for k, pair in enumerate(zip(ids, ids[1:])))
            if rank == bpe.NEVER:
                break
            ids[k:k + 2] = [merges.id[(merges.text[ids[k]] + merges.text[ids[k + 1]]).decode("latin-1")]]
        return ids

    rng = random.Random(4)
    tokens = sorted(merges.text)
    for _ in range(3000):
        a, b = rng.choice(tokens[:3000]), rng.choice(tokens[:3000])
        assert merges.compatible(a, b) == (plain(merges.text[a] + merges.text[b]) == [a, b]), (a, b)


def test_token_files_round_trip(spark, tmp_path):
    path = tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in awkward_rows()]
    where = str(tmp_path / "ids")
    token_files.write_token_files(docs_of(spark, rows), where, path, end_id=2)
    got = token_files.read_token_files(spark, where).orderBy("start").collect()
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(i for i, _ in rows if i is not None)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    want = sorted((str(i), tuple(library.encode(t or "", add_special_tokens=False).ids) + (2,)) for i, t in rows)
    assert sorted((str(r.doc_id), tuple(r.ids)) for r in got) == want
    crcs = {r.ids_crc32 for r in token_files.token_digests(token_files.read_token_files(spark, where)).collect()}
    assert crcs == {zlib.crc32(np.array(ids, "<u4").tobytes()) for _, ids in want}
    files = sorted((tmp_path / "ids").glob("*.parquet"))
    group = pq.ParquetFile(files[0]).metadata.row_group(0)
    encodings = {group.column(k).path_in_schema: group.column(k).encodings for k in range(group.num_columns)}
    assert any("DICTIONARY" in e for e in next(v for c, v in encodings.items() if c.startswith("ids")))
    assert "DELTA_BINARY_PACKED" in encodings["shard_start"]
    assert all(group.column(k).has_offset_index for k in range(group.num_columns))


# packing

def test_packing_places_every_piece_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 40)
    path = tokenizer("word_bpe_49k.json")
    rows = awkward_rows() + [(900, "word " * 1000)]
    out = packing.pack_documents(docs_of(spark, rows), path, end_id=1, capacity=128).collect()
    library = Tokenizer.from_file(path)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(str(i), k, 128 * k, len(ids[128 * k:128 * k + 128]), zlib.crc32(np.array(ids[128 * k:128 * k + 128], "<u4").tobytes())) for k in range(-(-len(ids) // 128))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    bins: dict = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in bins.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= 128
    bound = -(-sum(w[3] for w in want) // 128)
    assert len(bins) <= bound + max(2, bound // 50)


def test_evolution_beats_its_start():
    rng = random.Random(7)
    lengths = sorted((rng.randint(20, 60) for _ in range(300)), reverse=True)
    start = packing.best_fit(list(range(300)), lengths, 100, [])
    best = packing.evolve(lengths, 100, [start], rng)[0]
    assert sorted(i for b in best for i in b) == list(range(300))
    assert packing.fitness(best, lengths, 100) >= packing.fitness(start, lengths, 100)


def test_evolution_needs_fewer_bins_than_best_fit():
    rng = random.Random(11)
    for _ in range(3):
        lengths = [rng.randint(900, 2000) for _ in range(1200)]
        falling = packing.best_fit(sorted(range(1200), key=lambda i: -lengths[i]), lengths, 4096, [])
        best = packing.evolve(lengths, 4096, [], rng)[0]
        assert sorted(i for b in best for i in b) == list(range(1200))
        assert all(sum(lengths[i] for i in b) <= 4096 for b in best)
        assert len(best) < len(falling)


def test_evolution_breeds_on_easy_lengths(monkeypatch):
    born, crossover = [], packing.crossover
    monkeypatch.setattr(packing, "crossover", lambda *a: born.append(1) or crossover(*a))
    rng = random.Random(12)
    lengths = [rng.randint(1, 900) for _ in range(600)]
    best = packing.evolve(lengths, 4096, [], rng)[0]
    assert born and len(best) == -(-sum(lengths) // 4096)
    assert packing.evolve([5], 10, [], rng)[0] == [[0]]


def test_pack_refuses_impossible_lengths(spark):
    items = spark.createDataFrame([(1, 5), (2, None), (3, 0), (4, 11), (5, 10)], "item long, length long")
    got = {r.item: (r.sequence_id is None, r.offset) for r in packing.pack(items, 10).collect()}
    assert got == {1: (False, 0), 2: (True, None), 3: (True, None), 4: (True, None), 5: (False, 0)}


def test_chat_templates_of_other_marks(spark):
    good = chat_format.Template(
        turns={"user": ("{user}", "{/user}"), "assistant": ("~a: ", " ~z")}, other=("{r}", "{/r}", "~end!"),
    )
    evil = ["{user} a {/user}{user}", "~a: x ~z", "\\~a:\\\\{/r}", "{/", "~", "{/user", "plain", "", "~en", "\\c \\a"]
    rows = [(k, 2 * j + t, role, text) for k, text in enumerate(evil) for j in range(1) for t, role in enumerate(["user", "assistant", "tool{r}"])]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.format_chats(chats, good).select("conv_id", chat_format.parse_turns(F.col("formatted"), good).alias("turns"))
    want = {k: [(role, text) for role in ("user", "assistant", "tool{r}")] for k, text in enumerate(evil)}
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in out.collect()} == want
    marks = lambda a, b: {"user": a, "assistant": b}
    for turns in (
        marks(("|u|", "|/u|"), ("|a|", "|/a|")), marks(("<u>", "</u>"), ("<u>", "</a>")), marks(("<u>", ""), ("<a>", "</a>")),
        marks(("u:", "</u>"), ("<a>", "</a>")), marks(("<u>", "\\n"), ("<a>", "</a>")), marks(("<u>", "<u><"), ("<a>", "</a>")),
        marks(("<u>", "</u>"), ("<a>", "<u>")),
    ):
        with pytest.raises(ValueError):
            chat_format.Template(turns=turns)


# embeddings

def test_embeddings_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE_ROWS", 16)
    monkeypatch.setattr(embedding_dedup, "PIVOTS", 5)
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(6, 16))
    vectors = [c + rng.normal(size=16) * s for c in centers for s in np.linspace(0.05, 0.6, 15)]
    rows = [(k, [float(x) for x in v], 1) for k, v in enumerate(vectors)]
    rows += [(200, rows[0][1], 2), (201, rows[0][1], 2), (202, [-x for x in rows[0][1]], 0), (203, None, 0), (204, [], 0), (205, [0.0] * 16, 0)]
    rows += [(206, [float("nan")] * 16, 0), (207, [None] + rows[0][1][1:], 0), (208, rows[0][1][:8], 0), (None, rows[0][1], 0)]
    out = embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int")).collect()
    ids = [i for i, *_ in rows if i is not None]
    good = {i: np.array(v) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    near = {i: {j for j in good if j != i and len(good[i]) == len(good[j]) and good[i] @ good[j] / np.linalg.norm(good[i]) / np.linalg.norm(good[j]) >= 0.9} for i in good}
    reach = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        reach[i] = min(seen)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out}
    assert got.pop(None) == (0, None, False)
    assert got == {i: (len(near.get(i, ())), reach[i], reach[i] == i) for i in ids}


def test_quantisation_bound_holds():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 40))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = embedding_dedup.quantise(x)
    for threshold in (0.1, 0.3):
        parts = list(embedding_dedup.possible_pairs(q, q, threshold))
        found = {(i, j): c for a, b, certain in parts for i, j, c in zip(a.tolist(), b.tolist(), certain.tolist())}
        true = set(zip(*map(np.ndarray.tolist, np.nonzero(x @ x.T >= threshold))))
        assert true <= set(found) and {pair for pair, certain in found.items() if certain} <= true
        open_pairs = [pair for pair, certain in found.items() if not certain]
        assert 0 < len(open_pairs) < len(true) / 2


def test_embeddings_near_the_threshold(spark, monkeypatch):
    """Pairs that int8 codes leave open, of two lengths and with a shared id, beside pairs that they make certain."""
    monkeypatch.setattr(embedding_dedup, "TILE_ROWS", 8)
    rng = np.random.default_rng(5)
    rows = []
    for dims in (12, 1100):
        base = rng.normal(size=dims)
        base /= np.linalg.norm(base)
        for cosine in [0.9 + (k + 0.5) * 1e-4 for k in range(-12, 12)] + [0.5, 0.99, 0.999]:
            side = rng.normal(size=dims)
            side -= (side @ base) * base
            side /= np.linalg.norm(side)
            rows.append((len(rows), [float(x) for x in 3 * (cosine * base + math.sqrt(1 - cosine ** 2) * side)]))
        rows.append((len(rows), [float(x) for x in base]))
    rows.append((rows[0][0], rows[3][1]))
    out = embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    x = [np.array(v) / np.linalg.norm(v) for _, v in rows]
    links, parent = [0] * len(rows), {i: i for i, _ in rows}
    for a in range(len(rows)):
        for b in range(len(rows)):
            if a != b and len(x[a]) == len(x[b]) and x[a] @ x[b] >= 0.9:
                links[a] += 1
                old, new = sorted((parent[rows[a][0]], parent[rows[b][0]]), reverse=True)
                parent = {i: new if c == old else c for i, c in parent.items()}
    # Row 0's id is on two vectors, and row 3's vector is on two ids, whose smaller one stands for both.
    got = {r.vec_id: (r.n_links, r.component_id) for r in out.collect() if r.vec_id not in (0, 3)}
    assert got == {i: (links[k], parent[i]) for k, (i, _) in enumerate(rows) if i not in (0, 3)}
    q = embedding_dedup.quantise(np.array([v for v in x if len(v) == 12]))
    certain = np.concatenate([c for _, _, c in embedding_dedup.possible_pairs(q, q, 0.9)])
    assert certain.any() and not certain.all()


# chat text

def test_chat_round_trip(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [
        (1, 0, "system", "be \\brief\\"), (1, 1, "user", said), (1, 2, "assistant", "\\[INST]\\\\l<s>"), (2, 0, "assistant", "first"),
        (2, 1, None, None), (3, 0, "tool", "<role>x</role></turn>"), (3, 1, "a</role>[INST]", "\\l\\b"), (4, None, "user", ""), (5, 0, "user", "a"),
        (5, 0, "user", "a"), (5, 1, "assistant", "é🙂"), (None, 0, "user", "nobody"),
    ]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, segments string")
    chats = chat_format.format_chats(table)
    parsed = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chats.select("conv_id", chat_format.parse_turns(F.col("formatted")).alias("turns")).collect()}
    out = {r.conv_id: r for r in chat_format.chat_digests(chats).collect()}
    for conv in {r[0] for r in rows}:
        turns = [(role or "", text or "") for _, _, role, text in sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))]
        assert parsed[conv] == turns
        loss = "".join(t for role, t in turns if role == "assistant")
        assert out[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (out[conv].loss_chars, out[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert [out[c].valid for c in (1, 2, 3, 4, 5)] == [True, False, False, True, False]
    assert chats.filter("conv_id = 5").first().first_fault == 1


# models

def test_quality_separates_noise(spark):
    rng = random.Random(2)
    syllables = ["ta", "re", "mo", "li", "ne", "su"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    good = [" ".join(word() for _ in range(rng.randint(20, 80))) + "." for _ in range(200)]
    bad = ["!! ".join(word().upper() for _ in range(rng.randint(20, 80))) for _ in range(100)] + [" ".join([word()] * 50) for _ in range(100)]
    rows = list(enumerate(good + bad)) + [(None, None), (9999, ""), (9999, "")]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(0, 400, 2)] + [(None, 1), (3, None), (0, 1)], "doc_id long, quality int")
    model = quality.train_quality(docs, labels)
    out = quality.score_quality(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 2]
    assert np.mean([(r.score >= 0.5) == (r.doc_id < 200) for r in held]) > 0.95
    kept = quality.keep_scored(docs, model, 0.3)
    assert kept.columns == docs.columns and kept.count() == sum(r.score >= 0.3 for r in out)


def test_hmm_base_and_likelihood(spark):
    rows = awkward_rows()
    out = hmm.hmm_scores(docs_of(spark, rows), id_remainder("doc_id", 7) == 2).collect()
    tokens = [(i, ["".join(c.lower() if c.isascii() else c for c in w) for w in (t or "").split()] + [None], i is not None and zlib.crc32(str(i).encode()) % 7 == 2) for i, t in rows]
    counts: dict = {}
    for _, ws, held in tokens:
        for w in ws:
            counts[w] = counts.get(w, 0) + (not held)
    counts = {w: c for w, c in counts.items() if c}
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held, len(ws), sum(w in counts for w in ws), n, round(sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in ws), 5)) for i, ws, held in tokens)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in out) == want
    assert all(r.score < 0 for r in out)


def test_forward_recursion_equals_path_sum():
    rng = np.random.default_rng(6)
    share = lambda x: x / x.sum(-1, keepdims=True)
    p = hmm.Parameters(share(rng.random(3)), share(rng.random((3, 3))), share(rng.random((3, 5))))
    sequences = [rng.integers(0, 5, n).astype(np.uint16) for n in (1, 4, 6, 2, 6)]
    for s, got in zip(sequences, hmm.forward_score(sequences, p)):
        state = p.start * p.emit[:, s[0]]
        for x in s[1:]:
            state = state @ p.move * p.emit[:, x]
        assert abs(got - np.log10(state.sum())) < 1e-9
    start, moves, emitted = hmm.expected_counts(sequences, np.ones(len(sequences), bool), p)
    assert abs(start.sum() - 5) < 1e-3 and abs(moves.sum() - sum(len(s) - 1 for s in sequences)) < 1e-2
    assert abs(emitted.sum() - sum(map(len, sequences))) < 1e-2
    before = hmm.forward_score(sequences, p).sum()
    assert hmm.forward_score(sequences, hmm.Parameters.from_counts(start + 1e-9, moves, emitted)).sum() > before - 0.5


def test_counts_of_pieces_equal_those_of_whole_documents():
    rng = np.random.default_rng(8)
    share = lambda x: x / x.sum(-1, keepdims=True)
    p = hmm.Parameters(share(rng.random(3)), share(rng.random((3, 3)) + np.eye(3)), share(rng.random((3, 9)) ** 3))
    documents = [rng.integers(0, 9, n).astype(np.uint16) for n in (1, 30, 31, 200, 1000, 59, 60)]
    whole = hmm.expected_counts(documents, np.ones(len(documents), bool), p)
    parts = [(k == 0, *piece) for d in documents for k, piece in enumerate(hmm.pieces_of(d, 30, 16))]
    assert sum(high - low for _, _, low, high in parts) == sum(map(len, documents))
    fresh, pieces, low, high = zip(*parts)
    got = hmm.expected_counts(list(pieces), np.array(fresh), p, list(zip(low, high)))
    assert abs(got[1].sum() - sum(len(d) - 1 for d in documents)) < 0.05
    for a, b in zip(got, whole):
        assert np.abs(a - b).max() < 0.02 * max(1, np.abs(b).max())
    cut = hmm.expected_counts(list(pieces), np.array(fresh), p)
    assert np.abs(cut[1] - whole[1]).max() > np.abs(got[1] - whole[1]).max()


@pytest.mark.parametrize("name", ["exact", "near", "suffix", "bpe", "pack", "hmm", "quality", "tokens", "vectors", "chat"])
def test_empty_tables(spark, tmp_path, name):
    docs = docs_of(spark, [])
    jobs = {
        "exact": lambda: exact_dedup.exact_dedup(docs), "near": lambda: near_dedup.near_dedup(docs),
        "suffix": lambda: suffix_dedup.removal_digests(suffix_dedup.repeated_runs(docs)),
        "bpe": lambda: bpe.bpe_digests(docs, tokenizer("byte_bpe_50k.json")),
        "pack": lambda: packing.pack_documents(docs, tokenizer("word_bpe_49k.json")),
        "hmm": lambda: hmm.hmm_scores(docs, F.lit(False)),
        "quality": lambda: quality.score_quality(docs, quality.train_quality(docs, docs.select("doc_id", F.lit(1).alias("label")))),
        "vectors": lambda: embedding_dedup.embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")),
        "chat": lambda: chat_format.chat_digests(chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))),
    }
    if name == "tokens":
        path = str(tmp_path / "none")
        token_files.write_token_files(docs, path, tokenizer("word_bpe_49k.json"), end_id=2)
        assert token_files.token_digests(token_files.read_token_files(spark, path)).count() == 0
    else:
        assert jobs[name]().count() == 0
