import base64
import os
import random

import pytest

from examloom.llm.bpe import PATTERN, count_tokens, default_vocabulary, encode_texts, encoder

pytestmark = pytest.mark.skipif(not os.path.exists(default_vocabulary()), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(default_vocabulary(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


HARD = ["", " ", "  ", "a", "\n\n  x", "it's I'LL we're", "<|endoftext|>", "é́🙂👩‍👩‍👧", "٣٤ⅷ²", "​﻿", "0123456789" * 50, "x" * 100_001, "哈" * 30_000, "ab" * 40_000, " \t" * 3000, "\r\n\r\n", "𠀀𠮷", "\x00\x01"]


def test_equals_the_library_on_hard_texts(reference):
    enc = encoder(default_vocabulary())
    for t in HARD:
        assert enc.encode(t) == reference.encode_ordinary(t), t[:30]
    assert enc.encode(None) == []


def test_equals_the_library_on_random_texts(reference):
    rng, enc = random.Random(9), encoder(default_vocabulary())
    pools = ["abcdefghijklmnop ", "aab b", "的一是不了人我在有他这", "0123 .,-", "".join(map(chr, range(0x20, 0x250))), "eEtT hH  '"]
    for _ in range(4000):
        t = "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(1, 60)))
        assert enc.encode(t) == reference.encode_ordinary(t), t


def test_documents(spark, sf, reference):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.ids for r in encode_texts(docs.select("doc_id", "text")).select("doc_id", "ids").collect()}
    counts = {r.doc_id: r.n_tokens for r in count_tokens(docs.select("doc_id", "text")).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == (reference.encode_ordinary(r.text) if r.text else [])
        assert counts[r.doc_id] == len(got[r.doc_id])
    assert encoder(default_vocabulary()) is encoder(default_vocabulary())


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, [5], 3), (1, None, [5], 3), (2, "hi", None, None)], "doc_id long, text string, ids array<int>, n_tokens int")
    assert sorted((r.doc_id, r.text, r.ids) for r in encode_texts(df).collect() if r.text is None) == [(1, None, []), (1, None, [])]
    assert encode_texts(df.filter("false")).count() == 0
    assert sorted(r.n_tokens for r in count_tokens(df).collect()) == [0, 0, 1]
