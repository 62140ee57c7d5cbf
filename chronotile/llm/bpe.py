"""Byte-level BPE encoding and decoding on length-bucketed padded numpy matrices.

The distinct pieces of a batch of texts are laid out as rows of a matrix for each length bucket. In every round each row merges
its leftmost pair of least rank: pair ranks come from an open-addressing hash table, the row closes up over the
merged cell, two ranks beside it are looked up again, and rows without a pair left leave the matrix.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotile.llm.common import in_batches

BUCKETS = (4, 8, 12, 16, 24, 32, 64, 128, 256)
#: Characters of text that one matrix pass takes in, and pieces that a worker remembers between passes.
PASS_CHARS, REMEMBERED = 1_000_000, 150_000
_NONE = np.int32(2**31 - 1)


class PairTable:
    """Rank of a pair of token ids, by linear probing in numpy arrays."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        self.bits = max(8, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, _NONE, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            self.keys[slot[free]] = keys[free]
            placed = self.keys[slot[left]] == keys[left]
            self.ranks[slot[left[placed]]] = ranks[left[placed]]
            left = left[~placed]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks for arrays of ids of any equal shape; an id below 0 pairs with nothing."""
        keys = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        keys[((left < 0) | (right < 0)).ravel()] = -2
        slot = self._slot(keys)
        found, out = self.keys[slot], self.ranks[slot]
        out[found != keys] = _NONE
        todo = np.flatnonzero((found != keys) & (found >= 0) & (keys >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out.reshape(left.shape)


class ByteBPE:
    """Encoder and decoder for a rank file (base64 token, blank, rank on each line) and a splitting pattern."""

    def __init__(self, lines: Iterable[bytes], pattern: str):
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.table = PairTable(np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))
        self.byte_id = np.array([self.ranks[bytes([k])] for k in range(256)], np.int32)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        start = chars = 0
        for k, text in enumerate(texts):
            chars += len(text)
            if chars >= PASS_CHARS or k == len(texts) - 1:
                out += self._encode_pass(texts[start : k + 1])
                start, chars = k + 1, 0
        return out

    def _encode_pass(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, pieces = self.known, [self.split(x) for x in texts]
        new = list({x for words in pieces for x in words if x not in known})
        known.update(zip(new, self.encode_pieces([x.encode() for x in new]), strict=True))
        return [b"".join([known[x] for x in words]) for words in pieces]

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        rows: list[list[int]] = [[] for _ in BUCKETS]
        for k, piece in enumerate(pieces):
            if (rank := self.ranks.get(piece)) is not None:
                out[k] = rank.to_bytes(4, "little")
            elif len(piece) > BUCKETS[-1]:
                out[k] = self._long_piece(piece)
            else:
                rows[next(b for b, most in enumerate(BUCKETS) if len(piece) <= most)].append(k)
        for width, members in zip(BUCKETS, rows, strict=True):
            for at in range(0, len(members), max(1, 400_000 // width)):
                self._matrix(pieces, members[at : at + max(1, 400_000 // width)], width, out)
        return out

    def _matrix(self, pieces: list[bytes], members: list[int], width: int, out: list[bytes]) -> None:
        raw = np.frombuffer(b"".join(pieces[k].ljust(width, b"\0") for k in members), np.uint8).reshape(len(members), width)
        length = np.array([len(pieces[k]) for k in members], np.int64)
        ids = np.where(np.arange(width) < length[:, None], self.byte_id[raw], np.int32(-1))
        ranks = self.table.find(ids[:, :-1], ids[:, 1:])
        row = np.array(members)
        while len(row):
            at = ranks.argmin(1)
            least = ranks[np.arange(len(row)), at]
            done = least == _NONE
            if done.any():
                for k, n, x in zip(row[done].tolist(), length[done].tolist(), ids[done].astype("<u4"), strict=True):
                    out[k] = x[:n].tobytes()
                keep = ~done
                ids, ranks, row, length, at, least = ids[keep], ranks[keep], row[keep], length[keep], at[keep], least[keep]
                if not len(row):
                    return
            every = np.arange(len(row))
            ids[every, at] = least
            columns = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, columns + (columns > at[:, None]), 1)
            length -= 1
            if ids.shape[1] == 1:
                ranks = np.full((len(row), 1), _NONE, np.int32)
                continue
            columns = columns[:-1]
            ranks = np.take_along_axis(ranks, columns + (columns >= at[:, None]), 1)
            for side in (at - 1, at):
                fits = (side >= 0) & (side < ranks.shape[1])
                ranks[every[fits], side[fits]] = self.table.find(ids[every[fits], side[fits]], ids[every[fits], side[fits] + 1])

    def _long_piece(self, piece: bytes) -> bytes:
        """The same merges for one piece longer than every bucket, with a heap over a linked list: n log n for any length."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = self.table.find(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        current: list[int] = [*pairs, int(_NONE)]
        heap = [(r, k) for k, r in enumerate(pairs) if r != _NONE]
        heapq.heapify(heap)

        def renew(k: int) -> None:
            a, b = self.tokens[ids[k]], self.tokens[ids[after[k]]] if after[k] < n else None
            current[k] = int(_NONE) if b is None else self.ranks.get(a + b, int(_NONE))
            if current[k] != _NONE:
                heapq.heappush(heap, (current[k], k))

        alive = bytearray(b"\1" * n)
        while heap:
            rank, k = heapq.heappop(heap)
            if not alive[k] or current[k] != rank:
                continue
            gone = after[k]
            ids[k], alive[gone], after[k] = rank, 0, after[gone]
            if after[k] < n:
                before[after[k]] = k
            renew(k)
            if before[k] >= 0:
                renew(before[k])
        return np.array([x for x, live in zip(ids, alive, strict=True) if live], "<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[tuple[str, str], ByteBPE] = {}


def tokenizer(name: str, pattern: str | None = None) -> ByteBPE:
    """A tokenizer of the installed public vocabularies, loaded once in each Python worker."""
    import public_tokenizers

    pattern = pattern or public_tokenizers.PATTERN
    if (name, pattern) not in _loaded:
        with open(public_tokenizers.path(name), "rb") as lines:
            _loaded[name, pattern] = ByteBPE(lines, pattern)
    return _loaded[name, pattern]


def encode_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", keep_ids: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids.

    A null text is empty and has no ids. Every row is encoded alone and whole, so repeated rows, null doc_ids and extra columns change
    nothing. No shuffle: each task holds one Arrow batch and the pieces it remembers.
    """

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(vocabulary)
        for batch in batches:
            ids = bpe.encode([x or "" for x in batch["text"]])
            out = {
                "doc_id": batch["doc_id"],
                "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids],
            }
            yield pd.DataFrame(out | ({"ids": [np.frombuffer(x, "<u4").astype("int32") for x in ids]} if keep_ids else {}))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return in_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInPandas(encoded, schema)
