"""BPE by merge list: speculate with greedy longest matches, verify every adjacent pair, merge exactly only where a check fails.

Merging two neighbouring tokens leaves both as they are if no merge ever reaches across their border. While the left token is put
together, its last symbol grows along the right edge of its merge tree; the first symbol of the right token grows along the left edge
of its own. ``MergeBPE.compatible`` plays both edges in the order of merge ranks, for arrays of pairs at once, and looks at each state
whether the two border symbols would merge before either of them is taken up by its own token. A split into tokens that merge to
themselves, all of whose neighbours are compatible, is the split that the merges give.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotile.llm.bpe import PairTable
from chronotile.llm.common import in_batches

#: Characters of text that one pass takes in, and words that a worker remembers between passes.
PASS_CHARS, REMEMBERED = 1_000_000, 150_000
#: Bytes of a word beyond which it is looked up alone, so that few long words do not hold up a whole pass, and merged by a heap.
LONG = 256
_LAST = 2**31 - 1
_NONE = np.int32(_LAST)


def byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in byte-level vocabularies: printable Latin-1 characters for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class MergeBPE:
    """Encoder and decoder for a byte-level BPE model in the JSON form of the tokenizers library.

    Settings that change results and are not built here (normalizers, prefixes, dropout, stripping added tokens) raise ValueError.
    """

    def __init__(self, spec: dict, pattern: str):
        import regex

        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")]
        stripped = any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", []))
        if any(odd) or stripped or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space"):
            raise ValueError("a plain byte-level BPE model is needed")
        letter = byte_letters()
        as_bytes = {t: bytes(letter[c] for c in t) for t in model["vocab"]}
        self.ids = {as_bytes[t]: k for t, k in model["vocab"].items()}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*self.ids.values(), *added.values()])
        self.tokens = [b""] * size
        for raw, k in self.ids.items():
            self.tokens[k] = raw
        for text, k in added.items():
            self.tokens[k] = text.encode()
        self.added = added
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split if added else None
        self.split = regex.compile(pattern).findall
        self._read_merges(model, size)
        self._find_steady(size)
        self._plant()
        self.known: dict[str, bytes] = {}

    def _read_merges(self, model: dict, size: int) -> None:
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        vocab = model["vocab"]
        left, right = (np.array([vocab[p[side]] for p in pairs], np.int64) for side in (0, 1))
        self.results = [vocab[a + b] for a, b in pairs]
        self.pairs = PairTable(left << 32 | right, np.arange(len(pairs), dtype=np.int32))
        self.of_pair = dict(zip((left << 32 | right).tolist(), range(len(pairs)), strict=True))
        self.birth = np.full(size, _NONE, np.int32)
        children = np.full((2, size), -1, np.int32)
        for k in range(len(pairs) - 1, -1, -1):  # the earliest merge that makes a token stays
            new = self.results[k]
            self.birth[new], children[0, new], children[1, new] = k, left[k], right[k]
        self.children = children
        # Edges of the merge trees, from the whole token down to its first (0) or last (1) byte.
        self.edge, self.depth = [], []
        for side in (0, 1):
            steps = [np.arange(size, dtype=np.int32)]
            while (below := np.where(steps[-1] >= 0, children[side][steps[-1]], -1)).max() >= 0:
                steps.append(below.astype(np.int32))
            self.edge.append(np.stack(steps, 1))
            self.depth.append((self.edge[-1] >= 0).sum(1).astype(np.int64) - 1)

    def _borders(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pairs of tokens side by side: whether a merge crosses the border, and whether the first that does joins the whole tokens."""
        crossed, whole = np.zeros(len(a), bool), np.zeros(len(a), bool)
        at = np.arange(len(a))
        i, j = self.depth[1][a], self.depth[0][b]
        while len(at):
            x, y = self.edge[1][a[at], i], self.edge[0][b[at], j]
            rank = self.pairs.find(x, y)
            next_a = np.where(i > 0, self.birth[self.edge[1][a[at], np.maximum(i - 1, 0)]], _NONE)
            next_b = np.where(j > 0, self.birth[self.edge[0][b[at], np.maximum(j - 1, 0)]], _NONE)
            # Of equal ranks the leftmost pair is merged first: one inside the left token before the border, that before the right token's.
            cross = (rank < next_a) & (rank <= next_b) & (rank != _NONE)
            crossed[at[cross]], whole[at[cross]] = True, ((i == 0) & (j == 0))[cross]
            on = ~cross & ((next_a != _NONE) | (next_b != _NONE))
            first = (next_a <= next_b)[on]
            at, i, j = at[on], i[on] - first, j[on] - ~first
        return crossed, whole

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each token of ``a`` followed by that of ``b`` stays these two tokens, for tokens that merge to themselves."""
        return ~self._borders(a, b)[0]

    def _find_steady(self, size: int) -> None:
        """Tokens whose bytes merge to the token itself; others are never proposed."""
        self.steady = np.zeros(size, bool)
        self.byte_ids = [self.ids[bytes([k])] for k in range(256)]
        self.steady[self.byte_ids] = True
        made = np.flatnonzero(self.birth != _NONE)
        made = made[np.argsort(self.birth[made])]
        _, whole = self._borders(self.children[0][made], self.children[1][made])
        for k, fits in zip(made.tolist(), whole.tolist(), strict=True):
            self.steady[k] = fits and self.steady[self.children[0][k]] and self.steady[self.children[1][k]]

    def _plant(self) -> None:
        """A trie of the steady tokens: next node by (node, byte), and the token that ends at a node."""
        step: dict[int, int] = {}
        ends: list[int] = [-1]
        for k in np.flatnonzero(self.steady).tolist():
            node = 0
            for byte in self.tokens[k]:
                key = node << 32 | byte
                if (after := step.get(key)) is None:
                    after = step[key] = len(ends)
                    ends.append(-1)
                node = after
            ends[node] = k
        self.step = PairTable(np.fromiter(step.keys(), np.int64, len(step)), np.fromiter(step.values(), np.int32, len(step)))
        self.ends = np.array(ends, np.int32)
        self.lengths = sorted({len(self.tokens[k]) for k in np.flatnonzero(self.steady).tolist()}, reverse=True)

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words at once: index of the word and token, in order."""
        size = np.array([len(w) for w in words], np.int64)
        end = np.cumsum(size)
        buffer = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        live = np.flatnonzero(size > 0)
        place = (end - size)[live]
        node, token, upto = np.zeros(len(live), np.int32), np.full(len(live), -1, np.int32), place.copy()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(live):
            after = self.step.find(node, buffer[place].astype(np.int32))
            on = (after != _NONE) & (place < end[live])
            node = np.where(on, after, 0).astype(np.int32)
            place = place + on
            ending = np.where(on, self.ends[node], -1)
            token, upto = np.where(ending >= 0, ending, token), np.where(ending >= 0, place, upto)
            if (stuck := ~on).any():
                found.append((live[stuck], upto[stuck], token[stuck]))
                place = np.where(stuck, upto, place)
                left = ~stuck | (place < end[live])
                live, place, node, token, upto = live[left], place[left], node[left], token[left], upto[left]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        word, upto, token = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(upto, kind="stable")  # words lie one after the other, so the end of a match orders both
        return word[order], token[order]

    def _propose_long(self, word: bytes) -> np.ndarray:
        """The same for one long word."""
        out, at = [], 0
        while at < len(word):
            for size in self.lengths:
                k = self.ids.get(word[at : at + size]) if at + size <= len(word) else None
                if k is not None and self.steady[k]:
                    out.append(k)
                    at += size
                    break
        return np.array(out, np.int32)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers: proposed, verified and, where that fails, merged."""
        out: list[bytes] = [b""] * len(words)
        short = [k for k, w in enumerate(words) if len(w) <= LONG]
        word, token = self.propose([words[k] for k in short])
        parts = [(np.array(short, np.int64)[word], token)] if len(word) else []
        for k, w in enumerate(words):
            if len(w) > LONG:
                parts.append((np.full(len(long := self._propose_long(w)), k), long))
        if not parts:
            return out
        word, token = (np.concatenate(x) for x in zip(*parts, strict=True))
        inside = np.flatnonzero(word[1:] == word[:-1])
        pairs, which = np.unique(token[inside].astype(np.int64) << 32 | token[inside + 1], return_inverse=True)
        fits = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[which]
        failing = set(word[inside[~fits]].tolist())
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        for k, a, b in zip(word[first].tolist(), first.tolist(), [*first[1:].tolist(), len(word)], strict=True):
            out[k] = self.merge(words[k]) if k in failing else token[a:b].astype("<u4").tobytes()
        return out

    def merge(self, word: bytes) -> bytes:
        """The ids that the merges themselves give: the leftmost pair of least rank first."""
        if len(word) > LONG:
            return self._merge_long(word)
        rank_of, result = self.of_pair.get, self.results
        ids = [self.byte_ids[b] for b in word]
        ranks = [rank_of(a << 32 | b, _LAST) for a, b in pairwise(ids)]
        while ranks and (least := min(ranks)) != _LAST:
            k = ranks.index(least)
            ids[k] = new = result[least]
            del ids[k + 1], ranks[k]
            if k:
                ranks[k - 1] = rank_of(ids[k - 1] << 32 | new, _LAST)
            if k < len(ranks):
                ranks[k] = rank_of(new << 32 | ids[k + 1], _LAST)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _merge_long(self, word: bytes) -> bytes:
        """The same by a heap over a linked list: n log n for any length."""
        ids = [self.byte_ids[b] for b in word]
        n = len(ids)
        right, left = [*range(1, n + 1)], [*range(-1, n - 1)]
        waiting: list[tuple[int, int, int, int]] = []

        def offer(k: int) -> None:
            if k >= 0 and right[k] < n and (rank := self.of_pair.get(ids[k] << 32 | ids[right[k]])) is not None:
                heapq.heappush(waiting, (rank, k, ids[k], ids[right[k]]))

        for k in range(n - 1):
            offer(k)
        while waiting:
            rank, k, a, b = heapq.heappop(waiting)
            if ids[k] != a or right[k] >= n or ids[right[k]] != b:
                continue  # one of the two was merged since
            gone = right[k]
            ids[k], ids[gone], right[k] = self.results[rank], -1, right[gone]
            if right[k] < n:
                left[right[k]] = k
            offer(left[k])
            offer(k)
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def _words(self, text: str) -> list[str]:
        """Words of ``text``; an added token in it is a word of its own."""
        if self.cut is None:
            return self.split(text)
        out: list[str] = []
        for k, part in enumerate(self.cut(text)):
            if k % 2:
                out.append(part)
            else:
                out += self.split(part)
        return out

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
        known = self.known
        if not known:
            known.update((text, k.to_bytes(4, "little")) for text, k in self.added.items())
        words = [self._words(x) for x in texts]
        new = list({x for one in words for x in one if x not in known})
        known.update(zip(new, self.encode_words([x.encode() for x in new]), strict=True))
        return [b"".join([known[x] for x in one]) for one in words]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_loaded: dict[tuple[str, str], MergeBPE] = {}


def tokenizer(name: str, pattern: str | None = None) -> MergeBPE:
    """A tokenizer of the installed public vocabularies, loaded once in each Python worker."""
    import public_tokenizers

    pattern = pattern or public_tokenizers.PATTERN
    if (name, pattern) not in _loaded:
        with open(public_tokenizers.path(name), encoding="utf-8") as spec:
            _loaded[name, pattern] = MergeBPE(json.load(spec), pattern)
    return _loaded[name, pattern]


def encode_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", keep_ids: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids.

    Added tokens that a text spells out (``<|endoftext|>``) are taken as such, none are put in. A null text is empty and has no ids.
    Every row is encoded alone and whole, so repeated rows, null doc_ids, texts of any length and extra columns change nothing; an empty
    table gives an empty one. No shuffle: each task holds one Arrow batch and the words it remembers.
    """

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(vocabulary)
        for batch in batches:
            ids = bpe.encode([x or "" for x in batch["text"]])
            out = {
                "doc_id": batch["doc_id"],
                "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids],
            }
            yield pd.DataFrame(out | ({"ids": [np.frombuffer(x, "<u4").astype("int32") for x in ids]} if keep_ids else {}))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return in_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInPandas(encoded, schema)
