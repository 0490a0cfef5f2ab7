"""SentencePiece encoding and decoding by a batched Viterbi search.

A text is cut into units that no piece crosses. Units of equal length advance together: for each
end position all piece lengths are tried at once, substring hashes probe the sorted piece hashes,
and the best predecessor is a vectorised maximum that is stored as a backpointer.

For unigram models a path's value is the sum of its pieces' scores. For models of merged pairs the
maximum runs over paths whose neighbouring pieces may stand together: a pair may if merging never
crosses the border between the two, which is decided by undoing the merges of both pieces from the
last one on. Merging is right exactly when all neighbours may stand together, and one path remains.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from obsfuse.llm.store import texts

SPACE = "▁"
#: Units of one length that advance together.
BATCH = 8192
#: Units that a worker remembers, and the longest one that it does; this changes speed only.
REMEMBERED, REMEMBERED_CHARS = 500_000, 64

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _char_hash(codes: np.ndarray) -> np.ndarray:
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes of each row of code points, from the empty one on."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for i in range(codes.shape[1]):
        out[:, i + 1] = out[:, i] * _BASE + _char_hash(codes[:, i])
    return out


class Pieces:
    """A model file: pieces, their hashes in order, and for merging models how pieces come about."""

    def __init__(self, path: str) -> None:
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=path).serialized_model_proto())
        kind = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.piece = [p.piece for p in proto.pieces]
        self.score = np.array([p.score for p in proto.pieces], float)
        usable = [p.type in (kind.NORMAL, kind.USER_DEFINED) for p in proto.pieces]
        self.ids = {p: i for i, (p, ok) in enumerate(zip(self.piece, usable, strict=True)) if ok}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kind.BYTE}
        self.hidden = {i for i, p in enumerate(proto.pieces) if p.type in (kind.CONTROL, kind.UNKNOWN)}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kind.UNKNOWN)
        self.dummy = proto.normalizer_spec.add_dummy_prefix
        self.merging = proto.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models that leave texts as they are can be read")
        self.longest = max(map(len, self.ids))
        n = len(self.piece)
        # one more id: a character that no piece has; it joins nothing
        self.rank = np.full(n + 1, -1, np.int64)
        self.left, self.right = np.arange(n + 1), np.arange(n + 1)
        reached = dict(self.ids)
        pairs: dict[tuple[int, int], int] = {}
        if self.merging:
            order = np.unique(-self.score, return_inverse=True)[1]
            for p, i in self.ids.items():
                if len(p) > 1:
                    self.rank[i] = order[i]
                    pairs.update({(self.ids[p[:c]], self.ids[p[c:]]): i for c in range(1, len(p)) if p[:c] in self.ids and p[c:] in self.ids})
            for p, i in self.ids.items():
                if len(p) > 1:
                    merged, last = self.merge(p)
                    if merged == [i]:
                        self.left[i], self.right[i] = last
                    else:
                        del reached[p]  # no text merges to this piece
        self.pair_keys = np.array(sorted((a << 32) | b for a, b in pairs), np.int64)
        self.pair_ids = np.array([pairs[(int(k) >> 32, int(k) & 0xFFFFFFFF)] for k in self.pair_keys], np.int64)
        by_length = defaultdict(list)
        for p in reached:
            by_length[len(p)].append(p)
        hashed = [_hashes(np.array([[ord(c) for c in p] for p in same]))[:, -1] for same in by_length.values()]
        keys, ids = np.concatenate(hashed), np.array([reached[p] for same in by_length.values() for p in same])
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], ids[order]
        # most probes find nothing: a bit for each leading part of a hash tells that at once
        self.key_bits, self.pair_bits = np.zeros(1 << 20, bool), np.zeros(1 << 20, bool)
        self.key_bits[self.keys >> np.uint64(44)] = True
        self.pair_bits[self._pair_part(self.pair_keys >> 32, self.pair_keys & 0xFFFFFFFF)] = True
        self.gain = np.zeros(n + 1) if self.merging else np.append(self.score, self.score.min() - 10.0)

    def merge(self, unit: str) -> tuple[list[int], tuple[int, int]]:
        """The unit's ids by merging one pair at a time, and the last pair (for pieces and runs of spaces)."""
        got = [self.ids.get(c, len(self.piece)) for c in unit]
        word, after, before = list(unit), [*range(1, len(unit)), -1], [*range(-1, len(unit) - 1)]
        heap: list[tuple[float, int, str, int]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else -1
            if j >= 0 and (at := self.ids.get(word[i] + word[j])) is not None:
                heapq.heappush(heap, (-self.score[at], i, word[i] + word[j], j))

        for i in range(len(unit)):
            offer(i)
        last = (got[0], got[0])
        while heap:
            _, i, joined, j = heapq.heappop(heap)
            if not word[i] or after[i] != j or word[i] + word[j] != joined:
                continue
            last = (got[i], got[j])
            word[i], word[j], got[i] = joined, "", self.ids[joined]
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return [g for g, w in zip(got, word, strict=True) if w], last

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the piece that each two pieces make, or a number above all ranks."""
        out = np.full(len(a), np.int64(1 << 40))
        maybe = np.flatnonzero(self.pair_bits[self._pair_part(a, b)])
        if len(maybe):
            key = (a[maybe] << 32) | b[maybe]
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            hit = self.pair_keys[at] == key
            out[maybe[hit]] = self.rank[self.pair_ids[at[hit]]]
        return out

    @staticmethod
    def _pair_part(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 40503 ^ b * 1000003) & ((1 << 20) - 1)

    def may_meet(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves pieces ``a`` and ``b`` side by side: their last merges are undone one by
        one, and at no time may the two symbols at the border merge before the next step on either side.
        """
        out = np.ones(len(a), bool)
        rows, limit = np.arange(len(a)), np.full(len(a), 1 << 39)
        while len(rows):
            good = self.joined(a, b) >= limit
            out[rows[~good]] = False
            ra, rb = self.rank[a], self.rank[b]
            good &= (ra >= 0) | (rb >= 0)
            rows, a, b, ra, rb = (x[good] for x in (rows, a, b, ra, rb))
            later = ra > rb
            limit = np.where(later, ra, rb + 1)
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
        return out

    def search(self, units: list[str]) -> list[list[int]]:
        """The best path of each unit; all units have one length."""
        size, count = len(units[0]), len(units)
        codes = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).reshape(count, size)
        prefix = _hashes(codes)
        power = np.cumprod(np.append(np.uint64(1), np.full(self.longest, _BASE)))
        nobody = len(self.piece)
        value = np.full((count, size + 1), -np.inf)
        value[:, 0] = 0.0
        last, step = np.zeros((count, size + 1), np.int64), np.zeros((count, size + 1), np.int64)
        for end in range(1, size + 1):
            for length in range(1, min(end, self.longest) + 1):
                start = end - length
                key = prefix[:, end] - prefix[:, start] * power[length]
                found = np.full(count, -1, np.int64)
                maybe = np.flatnonzero(self.key_bits[key >> np.uint64(44)])
                if len(maybe):
                    at = np.minimum(np.searchsorted(self.keys, key[maybe]), len(self.keys) - 1)
                    found[maybe] = np.where(self.keys[at] == key[maybe], self.key_ids[at], -1)
                if length == 1:
                    found[found < 0] = nobody
                rows = np.flatnonzero((found >= 0) & (value[:, start] > -np.inf))
                if self.merging and start and len(rows):
                    rows = rows[self.may_meet(last[rows, start], found[rows])]
                if not len(rows):
                    continue
                new = value[rows, start] + self.gain[found[rows]]
                better = new > value[rows, end]
                rows = rows[better]
                value[rows, end], last[rows, end], step[rows, end] = new[better], found[rows], length
        paths: list[list[int]] = [[] for _ in units]
        at = np.full(count, size)
        rows = np.arange(count)
        while len(rows):
            for r, p in zip(rows.tolist(), last[rows, at[rows]].tolist(), strict=True):
                paths[r].append(p)
            at[rows] -= step[rows, at[rows]]
            rows = rows[at[rows] > 0]
        return [p[::-1] for p in paths]


class Coder:
    def __init__(self, path: str) -> None:
        self.pieces = Pieces(path)
        self.known: dict[str, bytes] = {}
        # units: spaces and what follows them, up to the next space or line feed (no piece has a line feed)
        self.units = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+").findall
        raw = [p.replace(SPACE, " ").encode() for p in self.pieces.piece]
        for b, i in self.pieces.byte.items():
            raw[i] = bytes([b])
        for i in self.pieces.hidden:
            raw[i] = b""
        raw[self.pieces.unknown] = " ⁇ ".encode()
        self.raw = raw

    def _ids(self, unit: str, path: list[int]) -> bytes:
        nobody, out, at = len(self.pieces.piece), [], 0
        if nobody not in path:
            return struct.pack(f"<{len(path)}I", *path)
        for p in path:
            if p == nobody:
                out += [self.pieces.byte.get(b, self.pieces.unknown) for b in unit[at].encode()] if self.pieces.byte else [self.pieces.unknown]
                at += 1
            else:
                out.append(p)
                at += len(self.pieces.piece[p])
        return np.array(out, "<u4").tobytes()

    def _add(self, units: set[str]) -> None:
        by_length = defaultdict(list)
        for u in units:
            if self.pieces.merging and u.startswith(SPACE * 2):  # runs of spaces have pieces of equal score
                self.known[u] = self._ids(u, self.pieces.merge(u)[0])
            else:
                by_length[len(u)].append(u)
        for same in by_length.values():
            for at in range(0, len(same), BATCH):
                part = same[at : at + BATCH]
                for u, path in zip(part, self.pieces.search(part), strict=True):
                    self.known[u] = self._ids(u, path)

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        front = SPACE if self.pieces.dummy else ""
        listed = [self.units(front + t.replace(" ", SPACE)) if t else [] for t in batch]
        new = set().union(*listed).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = set().union(*listed)
        self._add(new)
        out = [b"".join(map(self.known.__getitem__, units)) for units in listed]
        for u in new:
            if len(u) > REMEMBERED_CHARS:
                del self.known[u]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that form no character become U+FFFD."""
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.pieces.dummy and text.startswith(" ") else text


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids, decoded)`` for every row: the piece ids of the whole text as the library gives them,
    without begin and end, and the text that they decode to.

    Null and empty texts have no ids and decode to the empty text; null ids stay null; repeated
    rows give equal results; very long units are searched like short ones. Columns beside id and
    text are not read.
    """

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = coder(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [np.frombuffer(b, "<u4").astype(np.int32) for b in tool.encode(part.column(1).to_pylist())]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                decoded = pa.array([tool.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), flat, decoded], ["doc_id", "ids", "decoded"])

    out = texts(docs, id_col, text_col).mapInArrow(coded, "doc_id bigint, ids array<int>, decoded string")
    return out.withColumnRenamed("doc_id", id_col)


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_pieces, ids_crc32, decoded_crc32, round_trip)``: what `encode_documents` returns, digested in the task."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = coder(model)
        names = ["doc_id", "n_pieces", "ids_crc32", "decoded_crc32", "round_trip"]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                text = part.column(1).to_pylist()
                ids = tool.encode(text)
                decoded = [tool.decode(np.frombuffer(b, "<u4")) for b in ids]
                columns = [pa.array([len(b) // 4 for b in ids], pa.int64()), pa.array([zlib.crc32(b) for b in ids], pa.int64())]
                columns.append(pa.array([zlib.crc32(d.encode()) for d in decoded], pa.int64()))
                columns.append(pa.array([d == t for d, t in zip(decoded, text, strict=True)]))
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names)

    schema = "doc_id bigint, n_pieces bigint, ids_crc32 bigint, decoded_crc32 bigint, round_trip boolean"
    return texts(docs, id_col, text_col).mapInArrow(digested, schema).withColumnRenamed("doc_id", id_col)
