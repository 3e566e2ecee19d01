"""Token ids of whole texts with a public tokenizer file.

The tokenizers used here treat white space as a hard boundary, so a text's ids
are its words' ids in order.  Each distinct word of a slice is encoded once.

Of a tokenizer that lower-cases and encodes runs of letters and of other signs apart,
a word's stem in lower case and the punctuation behind it are looked up each: many
words share them.  Stems of letters alone are encoded many in one text.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from loam.llm.text import as_list, expand_ranges, split_words

#: Words that are encoded at once, and stems of letters in one text.
ENCODED, JOINED = 4_096, 32

#: What a tokenizer does before its merges, for words to be looked up in two parts.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_END = "</w>"
#: Letters that NFC leaves alone and whose lower case is one letter: those of ASCII, Latin-1
#: and Latin Extended-A but for the dotted capital I.
_LETTER = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{17F}"
_SIGN = r"!-/:-@\[-`{-~"
_PLAIN, _LETTERS = f"^[{_LETTER}0-9{_SIGN}]*$", f"^[{_LETTER}]+$"


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    # A Spark task has one core: the library's own threads would compete for it.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def _form(path: str) -> tuple[np.ndarray, str] | None:
    """Which ids end a run, and a pattern of the added tokens, where words may be looked up
    in two parts; else None."""
    with open(path, encoding="utf-8") as source:
        parts = json.load(source)
    model, added = parts["model"], parts.get("added_tokens") or []
    same = parts.get("normalizer") == _NORMALIZER and parts.get("pre_tokenizer") == _PRE_TOKENIZER
    if not same or any(parts.get(k) for k in ("post_processor", "truncation", "padding")):
        return None
    if model["type"] != "BPE" or model.get("end_of_word_suffix") != _END or model.get("dropout"):
        return None
    if any(t[k] for t in added for k in ("normalized", "single_word", "lstrip", "rstrip")) or any(re.search(r"\s", t["content"]) for t in added):
        return None
    ends = np.zeros(1 + max([*model["vocab"].values(), *[t["id"] for t in added]]), bool)
    ends[[k for token, k in model["vocab"].items() if token.endswith(_END)]] = True
    return ends, "|".join(re.escape(t["content"]) for t in added)


def id_type(path: str, *more: int) -> type:
    """The narrowest type that holds every id of the vocabulary and the ids ``more``."""
    return np.uint16 if max(load_tokenizer(path).get_vocab_size(), *[i + 1 for i in more], 0) <= 1 << 16 else np.uint32


def _parts(words: pa.Array, added: str) -> tuple[pa.Array, pa.Array]:
    """Stem and signs behind it of each word: lower-cased and cut only where the ids of
    both, one after the other, are the word's."""
    plain = pc.match_substring_regex(words, _PLAIN)
    if added:  # a word that holds one, in any case, stays whole
        plain = pc.and_not(plain, pc.match_substring_regex(words, added, ignore_case=True))
    lower = pc.if_else(plain, pc.ascii_lower(words), words)
    stem = pc.if_else(plain, pc.replace_substring_regex(lower, f"[{_SIGN}]+$", ""), lower)
    signs = pc.if_else(plain, pc.replace_substring_regex(lower, f"^.*[{_LETTER}0-9]", ""), "")
    return stem, signs


class WordIds:
    """Ids of words met before, up to ``most`` words; then it starts anew."""

    def __init__(self, path: str, most: int = 300_000) -> None:
        self.path, self.most = path, most
        self.clear()

    def clear(self) -> None:
        self.rows = {"": 0}
        self.starts, self.sizes, self.table = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _encode(self, missing: list[str]) -> None:
        """Add the ids of words or parts of words."""
        form, tokenizer = _form(self.path), load_tokenizer(self.path)
        joined = as_list(pc.match_substring_regex(pa.array(missing, pa.string()), _LETTERS)) if form else [False] * len(missing)
        letters, others = ([w for w, j in zip(missing, joined, strict=True) if j is k] for k in (True, False))
        sizes, tables = [self.sizes], [self.table]

        def add(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            ids = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            each = np.fromiter(map(len, ids), np.int64, len(ids))
            return each, np.fromiter(chain.from_iterable(ids), np.uint32, int(each.sum()))

        for words, together in ((letters, JOINED), (others, 1)):
            for first in range(0, len(words), ENCODED):  # an encoding takes far more room than its ids
                some = words[first : first + ENCODED]
                each, ids = add([" ".join(some[k : k + together]) for k in range(0, len(some), together)])
                if together > 1:
                    # Every stem ends one run at least, so with as many ends each ends one.
                    stops = np.flatnonzero(form[0][ids])
                    each, ids = (np.diff(stops, prepend=-1), ids) if len(stops) == len(some) and stops[-1] == len(ids) - 1 else add(some)
                sizes.append(each)
                tables.append(ids)
        self.rows.update(zip(letters + others, range(len(self.sizes), len(self.sizes) + len(missing)), strict=True))
        self.sizes, self.table = np.concatenate(sizes), np.concatenate(tables)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _rows(self, words: pa.Array) -> np.ndarray:
        coded = words.dictionary_encode()
        distinct = as_list(coded.dictionary)
        row = np.fromiter(map(self.rows.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(row < 0)
        if len(new):
            missing = [distinct[k] for k in new.tolist()]
            self._encode(missing)
            row[new] = np.fromiter(map(self.rows.__getitem__, missing), np.int64, len(missing))
        return row[coded.indices.to_numpy(zero_copy_only=False)]

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and how many there are of each."""
        if len(self.rows) > self.most:
            self.clear()
        form = _form(self.path)
        parts = _parts(words, form[1]) if form else [words]
        rows = np.stack([self._rows(part) for part in parts], axis=1)
        sizes = self.sizes[rows]
        return self.table[expand_ranges(self.starts[rows].ravel(), sizes.ravel())], sizes.sum(axis=1)


def encode_texts(texts: pa.Array, known: WordIds, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and each text's range in them.

    ``end_id``: appended to every text, also to an empty one.
    """
    words, offsets = split_words(texts)
    coded = words.dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False)
    table, sizes = known.look_up(coded.dictionary)
    counts = sizes[index]
    flat = table[expand_ranges((np.cumsum(sizes) - sizes)[index], counts)]
    upto = np.concatenate(([0], np.cumsum(counts)))[offsets]
    if end_id is None:
        return flat, upto
    n = len(offsets) - 1
    out = np.full(len(flat) + n, end_id, np.uint32)
    owner = np.repeat(np.arange(n), np.diff(upto))
    out[np.arange(len(flat)) + owner] = flat
    return out, upto + np.arange(n + 1)
