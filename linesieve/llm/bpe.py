"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For a fixed list of merges the encoding of a string's prefix is unique, and the encoding of a longer prefix ends with a
token whose predecessor is the last token of the shorter one. So one last token per prefix is enough: tokens that end at
a place come from an automaton over the vocabulary, the right one is the one whose pair with the stored last token is
stable, and following the stored tokens backwards gives the ids.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import ship, text_or_empty
from .spans import HashedArrays, per_text, ragged, span_hashes, texts_of, word_spans
from .words import PLAIN, without_stops

NEVER = 1 << 60
CACHE = 1_000_000
#: Fixed value: how the vocabulary's pre-tokenizer splits text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """The vocabulary's tokens, their merge trees, and the test whether two tokens may stand side by side."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        letters = byte_letters()
        self.text = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        self.id = {text.decode("latin-1"): i for i, text in self.text.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            pair = vocab[a], vocab[b]
            self.rank[pair] = rank
            self.parts.setdefault(vocab[a + b], (*pair, rank))
        self.automaton = ahocorasick.Automaton()
        for text, i in self.id.items():
            self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.stable: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces at the token's left (0) or right (1) end while it grows, each with the rank that absorbs it."""
        if (token, side) not in self.edges:
            chain, piece = [(token, NEVER)], token
            while piece in self.parts:
                rank = self.parts[piece][2]
                piece = self.parts[piece][side]
                chain.append((piece, rank))
            self.edges[token, side] = chain[::-1]
        return self.edges[token, side]

    def compatible(self, left: int, right: int) -> bool:
        """Whether encoding both tokens' bytes together gives these two tokens: no merge crosses their border first.

        Both ends grow in the order of merge ranks. A pair across the border merges if its rank comes before the ranks
        that absorb its two pieces; equal ranks go from left to right.
        """
        key = left, right
        if key not in self.stable:
            a, b = self.edge(left, 1), self.edge(right, 0)
            i = j = 0
            while True:
                (x, until_x), (y, until_y) = a[i], b[j]
                rank = self.rank.get((x, y), NEVER)
                if rank < until_x and rank <= until_y:
                    self.stable[key] = False
                    break
                if until_x == until_y == NEVER:
                    self.stable[key] = True
                    break
                if until_x <= until_y:
                    i += 1
                else:
                    j += 1
            if len(self.stable) > 400_000:
                self.stable = {key: self.stable[key]}
        return self.stable[key]

    def sound(self, token: int) -> bool:
        """Whether the token's own bytes encode as the token."""
        if token not in self.whole:
            parts = self.parts.get(token)
            self.whole[token] = parts is None or (
                self.sound(parts[0]) and self.sound(parts[1]) and self._only_this_rank(*parts)
            )
        return self.whole[token]

    def _only_this_rank(self, left: int, right: int, rank: int) -> bool:
        a, b = self.edge(left, 1), self.edge(right, 0)
        i = j = 0
        while a[i][1] != NEVER or b[j][1] != NEVER:
            crossing = self.rank.get((a[i][0], b[j][0]), NEVER)
            if crossing < a[i][1] and crossing <= b[j][1]:
                return False
            if a[i][1] <= b[j][1]:
                i += 1
            else:
                j += 1
        return True

    def encode(self, piece: str) -> list[int]:
        """Ids of one pre-token, given as one letter per byte."""
        whole = self.id.get(piece)
        if whole is not None and self.sound(whole):
            return [whole]
        last = [-1] * len(piece)
        compatible, sound = self.compatible, self.sound
        for end, (token, size) in self.automaton.iter(piece):
            if last[end] < 0 and sound(token):
                before = end - size
                if before < 0 or (last[before] >= 0 and compatible(last[before], token)):
                    last[end] = token
        ids, at = [], len(piece) - 1
        while at >= 0:
            token = last[at]
            assert token >= 0, "a prefix without a last token"
            ids.append(token)
            at -= len(self.text[token])
        return ids[::-1]


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that cover all bytes and that the split rule never crosses, for texts with ASCII white space alone.

    A word takes the one space before it. Of the white space before that, all is one span; where the word has no space
    of its own, the last character is a span by itself. White space at a text's end is one span.
    """
    starts, ends = word_spans(data, offsets)
    owner = np.searchsorted(offsets, starts, "right") - 1
    floor = offsets[owner]
    prior = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    gap = np.maximum(prior, floor)
    spaced = (starts > gap) & (data[np.maximum(starts - 1, 0)] == 32)
    begin = starts - spaced
    lone = ~spaced & (begin - gap > 1)
    texts = len(offsets) - 1
    tail = offsets[:-1].copy()
    np.maximum.at(tail, owner, ends)
    parts = [
        (begin, ends), (gap[begin > gap], np.where(lone, begin - 1, begin)[begin > gap]),
        (begin[lone] - 1, begin[lone]), (tail[:texts], offsets[1:]),
    ]
    a, b = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    a, b = a[b > a], b[b > a]
    order = np.argsort(a, kind="stable")
    return without_stops(data, a[order], b[order])


class ByteEncoder:
    """Ids and decoding of whole texts for a byte-level BPE file, special tokens' strings included."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in rules["model"]["merges"]]
        self.merges = Merges(rules["model"]["vocab"], pairs)
        self.specials = {t["content"]: t["id"] for t in rules["added_tokens"]}
        self.presplit = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.split = regex.compile(SPLIT).findall
        odd = [rf"[^\t\n\r {PLAIN}]", *map(re.escape, self.specials)]
        self.odd_piece = re.compile("|".join(odd)).search
        self.special_split = re.compile("|".join(f"({re.escape(s)})" for s in self.specials)).split if self.specials else None
        table = dict(self.merges.text) | {i: s.encode() for s, i in self.specials.items()}
        size = max(table) + 1
        sizes = np.zeros(size, np.int64)
        for i, text in table.items():
            sizes[i] = len(text)
        self.bytes = np.frombuffer(b"".join(table.get(i, b"") for i in range(size)), np.uint8)
        self.byte_starts, self.byte_counts = np.cumsum(sizes) - sizes, sizes
        self.pieces = HashedArrays(CACHE)
        self.odd = np.empty(0, bool)

    def _piece(self, text: str) -> list[int]:
        return [i for part in self.split(text) for i in self.merges.encode(part.encode().decode("latin-1"))]

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        odd = np.array([self.odd_piece(p) is not None for p in pieces])
        ids = [[] if o else self._piece(p) for p, o in zip(pieces, odd)]
        self.odd = np.concatenate((self.odd[:len(self.pieces.starts)], odd))
        return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)

    def _whole(self, text: str) -> list[int]:
        """Ids of a text with other characters, split by the file's own pre-tokenizer."""
        out: list[int] = []
        for segment in self.special_split(text) if self.special_split else [text]:
            if segment in self.specials:
                out.append(self.specials[segment])
            elif segment:
                for _, (a, b) in self.presplit(segment):
                    out.extend(self.merges.encode(segment[a:b].encode().decode("latin-1")))
        return out

    def encode(self, column: pa.Array):
        """(first row, end row, ids of those rows' texts one after another, each text's count) over runs of rows."""
        for first, end, data, offsets in texts_of(column):
            starts, ends = units(data, offsets)
            raw = data.tobytes()
            # A cut inside a character can't happen: spans begin and end beside ASCII characters or a text's ends.
            rows = self.pieces.rows_of(
                span_hashes(data, starts, ends),
                lambda at: self._learn([raw[starts[i]:ends[i]].decode() for i in at]),
            )
            bounds = per_text(starts, offsets)
            counts = self.pieces.counts[rows]
            ids = ragged(self.pieces.flat, self.pieces.starts[rows], counts)
            sums = np.concatenate(([0], np.cumsum(counts)))[bounds]
            strange = np.flatnonzero(self.odd[rows])
            sizes = np.diff(sums)
            if len(strange):
                parts, last = [], 0
                for i in np.unique(np.searchsorted(bounds, strange, "right") - 1):
                    whole = self._whole(raw[offsets[i]:offsets[i + 1]].decode())
                    parts += [ids[sums[last]:sums[i]], np.array(whole, np.uint32)]
                    sizes[i], last = len(whole), i + 1
                ids = np.concatenate([*parts, ids[sums[last]:]])
            yield first, end, ids, sizes

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Each text's bytes; bytes that are no UTF-8 become the replacement character, as in the library."""
        lengths = self.byte_counts[ids]
        flat = ragged(self.bytes, self.byte_starts[ids], lengths).tobytes()
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(counts)))]
        return [flat[a:b].decode("utf-8", "replace").encode() for a, b in zip(ends[:-1], ends[1:])]


_ENCODERS: dict[str, ByteEncoder] = {}


def byte_encoder(path: str) -> ByteEncoder:
    """The worker's encoder for the file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteEncoder(path)
    return _ENCODERS[path]


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("body"))


def bpe_encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every row's whole text. A null text is empty and has no ids; a null id stays null;
    repeated rows give repeated rows; other columns are ignored."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(tokenizer_path)
        for batch in batches:
            for first, end, ids, counts in encoder.encode(batch.column(1)):
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:end], lists], schema=schema)

    return _columns(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, ids array<int>")


def bpe_decode(tokens: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text decoded from each row's ids; a null list is empty, ids outside the file are left out."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(tokenizer_path)
        for batch in batches:
            lists = batch.column(1)
            offsets = np.asarray(lists.offsets)
            ids = np.asarray(lists.values)[offsets[0]:offsets[-1]].astype(np.int64)
            known = (ids >= 0) & (ids < len(encoder.byte_counts))
            ids = np.where(known, ids, 0)
            starts = np.concatenate(([0], np.cumsum(known)))[offsets - offsets[0]]
            texts = encoder.decode(ids[known], np.diff(starts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode() for t in texts], pa.string())], schema=schema)

    ship(tokens.sparkSession)
    ids = F.coalesce(F.col(ids_col), F.array().cast("array<int>"))
    ids = F.transform(ids, lambda x: F.coalesce(x.cast("int"), F.lit(-1)))
    return tokens.select(F.col(id_col).cast("bigint").alias("doc_id"), ids.alias("ids")).mapInArrow(run, "doc_id bigint, text string")


def bpe_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, sha256 of the ids (little-endian unsigned 32 bits) and of the text decoded from those ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(tokenizer_path)
        for batch in batches:
            for first, end, ids, counts in encoder.encode(batch.column(1)):
                ids = np.ascontiguousarray(ids, "<u4")
                ends = np.cumsum(counts)
                shas = [hashlib.sha256(ids[e - n:e]).hexdigest() for e, n in zip(ends, counts)]
                texts = [hashlib.sha256(t).hexdigest() for t in encoder.decode(ids, counts)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[first:end], pa.array(counts.astype(np.int64)), pa.array(shas, pa.string()), pa.array(texts, pa.string()),
                ], schema=schema)

    return _columns(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
