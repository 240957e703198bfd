"""Token ids of a word-end BPE file by the tokenizers library, one call per new word of a worker."""

from __future__ import annotations

import itertools
import json
import re

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from .spans import LOWER, HashedArrays, per_text, ragged, span_hashes, texts_of, word_spans

#: Characters on which lower case, composition and white space need no context, so that texts may be cut at white space.
PLAIN = "\x21-\x7e\xa1-ɏ"
#: Pieces held by one worker before it starts anew.
CACHE = 1_000_000


LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
STOP = np.zeros(256, bool)
STOP[[44, 46]] = True


def without_stops(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans with a comma or full stop after a last ASCII letter as a span of its own; it is a word of its own anyway."""
    at = np.flatnonzero(ends - starts > 1)
    at = at[STOP[data[ends[at] - 1]] & LETTER[data[ends[at] - 2]]]
    stops = ends[at]
    return np.insert(starts, at + 1, stops - 1), np.insert(ends, at, stops - 1)


class WordEncoder:
    """Ids of whole texts, equal to encode(text, add_special_tokens=False) of the tokenizer file.

    The file drops white space before it splits words, so the ids of a text are those of its pieces between white space,
    and the ids of a piece those of its words. Each new word goes through the library, which marks word ends in its last
    token. Texts with other characters, or with a special token's string in any case, go through the library whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        specials = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Pieces that differ by ASCII case share an entry, so a special token's string counts in every spelling.
        self.odd_piece = re.compile("|".join([f"[^{PLAIN}]", *[f"(?i:{s})" for s in specials]])).search
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        self.split = regex.compile(rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        suffix = rules["model"]["end_of_word_suffix"]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self.pieces = HashedArrays(CACHE)

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after another, and each piece's count; a piece that can't stand alone has none."""
        odd = np.array([self.odd_piece(p) is not None for p in pieces])
        split = [[] if o else self.split(p.lower()) for p, o in zip(pieces, odd)]
        words = itertools.chain.from_iterable(split)
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, np.uint32)
        ends = np.concatenate(([0], np.flatnonzero(self.ends[ids]) + 1))
        last = np.cumsum([len(s) for s in split])
        assert len(ends) == last[-1] + 1
        self.odd = np.concatenate((self.odd[:len(self.pieces.starts)], odd))
        return ids, np.diff(ends[last], prepend=0)

    odd = np.empty(0, bool)

    def encode(self, column: pa.Array):
        """(first row, end row, ids of those rows' texts one after another, each text's count) over runs of rows."""
        for first, end, data, offsets in texts_of(column):
            starts, ends = without_stops(data, *word_spans(data, offsets))
            raw = data.tobytes()
            rows = self.pieces.rows_of(
                span_hashes(LOWER[data], starts, ends),
                lambda at: self._learn([raw[starts[i]:ends[i]].decode() for i in at]),
            )
            bounds = per_text(starts, offsets)
            counts = self.pieces.counts[rows]
            ids = ragged(self.pieces.flat, self.pieces.starts[rows], counts)
            sums = np.concatenate(([0], np.cumsum(counts)))[bounds]
            strange = self.odd[rows]
            if strange.any():
                texts = np.unique(np.searchsorted(bounds, np.flatnonzero(strange), "right") - 1)
                parts, sizes = [], np.diff(sums)
                last = 0
                for i in texts:
                    parts.append(ids[sums[last]:sums[i]])
                    whole = self.tokenizer.encode(raw[offsets[i]:offsets[i + 1]].decode(), add_special_tokens=False)
                    parts.append(np.array(whole.ids, np.uint32))
                    sizes[i] = len(whole.ids)
                    last = i + 1
                parts.append(ids[sums[last]:])
                yield first, end, np.concatenate(parts), sizes
            else:
                yield first, end, ids, np.diff(sums)


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The worker's encoder for the file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
