"""Byte-pair encoding of many pre-tokens at once: rank-synchronous array merging.

The symbols of all pre-tokens lie in one ragged array. In each round every pre-token applies its
own lowest-rank pair, at all its places from left to right; pre-tokens without a pair leave. The
number of rounds is that of the longest chain of merges, not the number of merges.
"""

from __future__ import annotations

import json

import numpy as np
import regex

_NONE = np.int32(2**31 - 1)

#: White space as the tokenizer libraries take it.
SPACE = r"\t-\r\x20\x85\xa0  -     　"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else the next free one from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class Merges:
    """Symbols and pair ranks of a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, pairs = model["vocab"], [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        end = model.get("end_of_word_suffix") or ""
        self.special = [t["content"] for t in spec["added_tokens"]]
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + end] for c in letters], np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        # pairs in hash tables without collisions: what collides in one goes to the next
        key = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        rank = np.arange(len(pairs), dtype=np.int32)
        self.tables: list[tuple[np.uint64, np.ndarray, np.ndarray]] = []
        rng = np.random.default_rng(11)
        while len(key):
            factor = np.uint64(rng.integers(1, 2**62) * 2 + 1)
            at = self._place(key, factor)
            keys, ranks = np.full(1 << 18, -1, np.int64), np.full(1 << 18, _NONE)
            keys[at], ranks[at] = key, rank
            lost = keys[at] != key
            self.tables.append((factor, keys, ranks))
            key, rank = key[lost], rank[lost]

    @staticmethod
    def _place(key: np.ndarray, factor: np.uint64) -> np.ndarray:
        return ((key.view(np.uint64) * factor) >> np.uint64(46)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        out = np.full(len(key), _NONE)
        for factor, keys, ranks in self.tables:
            at = self._place(key, factor)
            hit = keys[at] == key
            out[hit] = ranks[at[hit]]
        return out

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and the number of ids of each."""
        return self.encode_bytes(np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words)))

    def encode_lines(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As `encode`, for words without line feeds."""
        if not words:
            return self.encode([])
        data = np.frombuffer(("\n".join(words) + "\n").encode(), np.uint8)
        ends = np.flatnonzero(data == 10)
        return self.encode_bytes(data[data != 10], np.diff(ends, prepend=-1) - 1)

    def encode_bytes(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As `encode`, for words of ``size`` bytes each, one after the other in ``data``."""
        symbol = self.first[data]
        ends = np.cumsum(size)
        full = size > 0
        symbol[ends[full] - 1] = self.last[data[ends[full] - 1]]
        word = np.repeat(np.arange(len(size)), size)
        rank = np.full(len(symbol), _NONE)
        inner = np.flatnonzero(word[:-1] == word[1:]) if len(word) else np.zeros(0, np.int64)
        rank[inner] = self.ranks(symbol[inner], symbol[inner + 1])
        done_word, done_symbol = [], []
        while len(symbol):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lowest = np.minimum.reduceat(rank, starts)
            length = np.diff(np.append(starts, len(word)))
            each = np.repeat(lowest, length)
            ready = each == _NONE
            if ready.any():
                done_word.append(word[ready])
                done_symbol.append(symbol[ready])
                word, symbol, rank, each = word[~ready], symbol[~ready], rank[~ready], each[~ready]
                if not len(word):
                    break
            hit = np.flatnonzero(rank == each)
            # of neighbouring hits (one letter repeated) every second one, from the left
            fresh = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
            since = np.arange(len(hit)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            hit = hit[since % 2 == 0]
            symbol[hit] = self.merged[rank[hit]]
            stay = np.ones(len(symbol), bool)
            stay[hit + 1] = False
            hit = (np.cumsum(stay) - 1)[hit]
            word, symbol, rank = word[stay], symbol[stay], rank[stay]
            near = np.concatenate([hit, hit[hit > 0] - 1])
            inner = near[near + 1 < len(word)]
            rank[near] = _NONE
            inner = inner[word[inner] == word[inner + 1]]
            rank[inner] = self.ranks(symbol[inner], symbol[inner + 1])
        word = np.concatenate(done_word or [np.zeros(0, np.int64)])
        symbol = np.concatenate(done_symbol or [np.zeros(0, np.int32)])
        order = np.argsort(word, kind="stable")
        return symbol[order], np.bincount(word, minlength=len(size))


def byte_pattern() -> regex.Pattern:
    """Pre-tokens of byte-level files: contractions, then letters, digits or signs with one space before, and space."""
    s = SPACE
    return regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{s}\p{{L}}\p{{N}}]+|[{s}]+(?![^{s}])|[{s}]+")


def word_pattern() -> regex.Pattern:
    """Pre-tokens of word-end files, for lower-cased words without white space."""
    return regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+")
