import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import encoding as e

pytestmark = pytest.mark.skipif(not os.path.exists(e.VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def own():
    with open(e.VOCABULARY, "rb") as f:
        return e.Encoder(f.read())


@pytest.fixture(scope="module")
def theirs():
    tiktoken = pytest.importorskip("tiktoken")
    with open(e.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=e.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_merging_by_rank(own, theirs):
    @settings(max_examples=400, deadline=None)
    @given(st.text(max_size=60) | st.text("abcdeinorst ABé的\n!<|>0", max_size=80))
    def check(text):
        if not any(0xD800 <= ord(c) < 0xE000 for c in text):
            ids = own.encode(text)
            assert ids == theirs.encode_ordinary(text) and own.decode(ids) == text.encode()

    check()


def test_long_and_special(own, theirs):
    for text in ("a" * 20_000, "ab" * 9_000, "的" * 5_000, "!" * 4_000, " " * 4_000, "<|endoftext|> x", "​﻿", "x\r\n\t y"):
        assert own.encode(text) == theirs.encode_ordinary(text)
    assert own.encode(None) == own.encode("") == []


def test_table(spark):
    rows = [(1, "hello world"), (2, None), (3, ""), (1, "hello world"), (None, "x")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, ids int")
    got = e.encode_corpus(df, "doc_id", "text")
    assert got.columns == ["doc_id", "ids"] and got.count() == 5
    assert {r.doc_id: r.ids for r in got.collect()}[2] == []
    back = sorted((r.doc_id or 0, r.text) for r in e.decode_corpus(got, "doc_id", "ids").collect())
    assert back == sorted((k or 0, t or "") for k, t in rows)
    assert e.encode_corpus(df.limit(0), "doc_id", "text").count() == 0
