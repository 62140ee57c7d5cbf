"""Word hashes and sets of hashed word shingles, for whole batches of texts at once (numpy only)."""

from __future__ import annotations

import numpy as np

PASS_BYTES = 400_000
_U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiply and shift until every input bit reaches every output bit."""
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


_BASE = 0x9E3779B97F4A7C15
_BYTE = mixed(np.arange(1, 257, dtype=_U) * _U(_BASE))
_PLACE = mixed(np.arange(1, 65, dtype=_U) * _U(0xC2B2AE3D27D4EB4F)) | _U(1)
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, PASS_BYTES + 200_000)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=_U)
    return _powers["up"], _powers["down"]


def word_hashes(texts: list[str | None], prefixes: tuple[int, ...] = ()) -> tuple:
    """Of the words (runs of anything but blanks, A-Z lower-cased) of all texts in order: text index, hash, first byte, end byte.

    Bytes count from the start of each text in UTF-8. Then, for each of ``prefixes``, hashes of so many first bytes, 0 for shorter words.
    """
    raw = [(x or "").encode() for x in texts]
    offsets = np.cumsum([0, *(len(x) + 1 for x in raw)])
    buffer = np.frombuffer(b" ".join(raw).lower() + b" ", np.uint8)
    blank = _BLANK[buffer]
    edge = np.flatnonzero(np.diff(blank, prepend=True))
    starts, ends = edge[::2], edge[1::2]
    up, down = _power_tables(len(buffer) + 1)
    sums = np.empty(len(buffer) + 1, _U)
    sums[0] = 0
    np.cumsum(_BYTE[buffer] * up[: len(buffer)], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _U(_BASE))
    text = np.searchsorted(offsets, starts, "right") - 1
    heads = []
    for k in prefixes:
        sum_ = (sums[np.minimum(starts + k, ends)] - sums[starts]) * down[starts]
        heads.append(np.where(ends - starts > k, mixed(sum_ + _U(k * 0xD6E8FEB86659FD93 % 2**64)), _U(0)))
    return text, hashes, starts - offsets[text], ends - offsets[text], *heads


def passes(texts: list[str | None], size: int = PASS_BYTES):
    """(first, last) index ranges of about ``size`` characters each."""
    start = chars = 0
    for k, text in enumerate(texts):
        chars += len(text or "")
        if chars >= size or k == len(texts) - 1:
            yield start, k + 1
            start, chars = k + 1, 0


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text; all of a text with fewer words is one shingle."""
    out: list[np.ndarray] = []
    for first, last in passes(texts):
        text, words, *_ = word_hashes(texts[first:last])
        counts = np.bincount(text, minlength=last - first) if len(text) else np.zeros(last - first, np.int64)
        whole = np.zeros(max(0, len(words) - width + 1), _U)
        for k in range(width if len(whole) else 0):
            whole += words[k : k + len(whole)] * _PLACE[k]
        whole = mixed(whole)
        at = 0
        for n in counts.tolist():
            if n >= width:
                found = np.sort(whole[at : at + n - width + 1])
                out.append(found[np.append(True, found[1:] != found[:-1])])
            elif n:
                out.append(mixed((words[at : at + n] * _PLACE[:n]).sum(keepdims=True) + _U(n * 0xD6E8FEB86659FD93 % 2**64)))
            else:
                out.append(np.empty(0, _U))
            at += n
    return out
