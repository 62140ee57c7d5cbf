import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from chronotile.llm import bpe

NAME = "byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def encoding():
    with open(public_tokenizers.path(NAME), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", "Hello world, it's 2026!  \n\n x", "ab" * 400, "a" * 3000, "日本語のテキスト" * 60, "🙂🙂 été naïve", "-" * 777, " " * 999 + "x", "<|endoftext|>", "\u0000​"]


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_same_ids_as_the_library(encoding):
    own = bpe.tokenizer(NAME)
    for text, raw in zip(TEXTS, own.encode(TEXTS), strict=True):
        assert ids(raw) == encoding.encode_ordinary(text)
        assert own.decode(raw) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(texts):
    own = bpe.tokenizer(NAME)
    with open(public_tokenizers.path(NAME), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    if not hasattr(test_any_text, "enc"):
        test_any_text.enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text, raw in zip(texts, own.encode(texts), strict=True):
        assert ids(raw) == test_any_text.enc.encode_ordinary(text)


def test_documents(spark, make_docs, encoding):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = bpe.encode_documents(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = encoding.encode_ordinary(texts[r.doc_id])
        raw = b"".join(x.to_bytes(4, "little") for x in want)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), hashlib.sha256(raw).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_nulls_repeats_and_empty_table(make_docs):
    rows = bpe.encode_documents(make_docs((1, None), (1, None), (None, "x")), keep_ids=True).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r.n_tokens, r.ids_sha256 == empty, len(r.ids)) for r in rows) == [(0, True, 0), (0, True, 0), (1, False, 1)]
    assert bpe.encode_documents(make_docs().limit(0)).count() == 0
