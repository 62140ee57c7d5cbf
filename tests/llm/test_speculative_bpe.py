import hashlib
import json
import random

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chronotile.llm import speculative_bpe as spec

NAME = "byte_bpe_50k.json"
LIBRARY = Tokenizer.from_file(public_tokenizers.path(NAME))
TEXTS = [
    "", "Hello world, it's 2026!  \n\n x", "ab" * 400, "a" * 3000, "日本語のテキスト" * 60, "🙂🙂 été naïve", "-" * 777, " " * 999 + "x",
    "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "  <|endoftext|>\n", "<|endoftext|", "\u0000​", "xqzj" * 700 + " 1234567890" * 9,
]


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def wanted(texts):
    return [x.ids for x in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def agree(texts):
    own = spec.tokenizer(NAME)
    for text, raw, want in zip(texts, own.encode(texts), wanted(texts), strict=True):
        assert ids(raw) == want, text[:80]
        assert own.decode(raw) == LIBRARY.decode(want, skip_special_tokens=False)


def test_same_ids_as_the_library():
    agree(TEXTS)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(texts):
    agree(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aehinorst", max_size=40), max_size=20))
def test_words_of_frequent_letters(texts):
    agree(texts)


def test_every_character_splits_as_in_the_library():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["a " + c + "1" + c + c + " b" for c in points]
    own = spec.tokenizer(NAME)
    for at in range(0, len(texts), 100_000):
        part = texts[at : at + 100_000]
        off = [p for p, raw, want in zip(part, own.encode(part), wanted(part), strict=True) if ids(raw) != want]
        assert not off, [hex(ord(x[2])) for x in off][:20]


def test_pairs_and_tokens_as_merging_has_them():
    own, rng = spec.tokenizer(NAME), random.Random(1)
    for k in rng.sample(range(len(own.ids)), 3000):
        assert (ids(own.merge(own.tokens[k])) == [k]) == bool(own.steady[k])
    steady = np.flatnonzero(own.steady).tolist()
    pairs = [(rng.choice(steady), rng.choice(steady)) for _ in range(4000)]
    by_byte = [k for k in steady if len(own.tokens[k]) <= 2]
    pairs += [(rng.choice(by_byte), rng.choice(by_byte)) for _ in range(4000)]
    fits = own.compatible(*map(np.array, zip(*pairs, strict=True)))
    for (a, b), fit in zip(pairs, fits.tolist(), strict=True):
        assert fit == (ids(own.merge(own.tokens[a] + own.tokens[b])) == [a, b])


def test_proposals_that_fail_are_merged(monkeypatch):
    own = spec.MergeBPE(json.load(open(public_tokenizers.path(NAME), encoding="utf-8")), public_tokenizers.PATTERN)
    merged, merge = [], own.merge
    monkeypatch.setattr(own, "merge", lambda w: merged.append(w) or merge(w))
    words = sorted({w for text in pd.read_parquet("/root/testdata/sf0.001/documents.parquet").text for w in text.split()})
    own.encode([" ".join(words)])
    assert 0 < len(merged) < len(words) / 2  # invented words fail far more often than real prose


def test_settings_that_are_not_built():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file, pytest.raises(ValueError, match="byte-level"):
        spec.MergeBPE(json.load(file), public_tokenizers.PATTERN)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = spec.encode_documents(docs).collect()
    assert len(rows) == len(texts)
    for r, want in zip(rows, wanted([texts[r.doc_id] for r in rows]), strict=True):
        raw = b"".join(x.to_bytes(4, "little") for x in want)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), hashlib.sha256(raw).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_nulls_repeats_long_texts_and_empty_table(make_docs, monkeypatch):
    monkeypatch.setattr(spec, "PASS_CHARS", 1000)
    long = "word <|endoftext|> " * 3000
    rows = spec.encode_documents(make_docs((1, None), (1, None), (None, "x"), (2, long)), keep_ids=True).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r.n_tokens, r.ids_sha256 == empty, len(r.ids)) for r in rows if r.doc_id != 2) == [(0, True, 0), (0, True, 0), (1, False, 1)]
    assert [list(r.ids) for r in rows if r.doc_id == 2] == wanted([long])
    assert spec.encode_documents(make_docs().limit(0)).count() == 0
