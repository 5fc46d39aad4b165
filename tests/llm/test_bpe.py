import base64
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from marketloom.llm import bpe

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_random_texts_equal_the_reference(reference):
    random.seed(5)
    pieces = list(" \n\t\r  '’sdtmrevlASD09é中文\xa0　​🙂ab\x1c\x85_.,!-<|>") + ["'s", "'ll", "  ", "\n\n", "the", "aaa", "<|endoftext|>"]
    texts = ["".join(random.choices(pieces, k=random.randint(0, 50))) for _ in range(4000)] + ["ab" * k for k in range(60)] + ["a" * 5000]
    for got, text in zip(bpe.rank_encoder(RANKS, P.PATTERN).encode(texts), texts):
        assert ids(got) == reference.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_any_unicode(texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))} if not hasattr(test_any_unicode, "r") else test_any_unicode.r
    test_any_unicode.r = ranks
    table = bpe.rank_tokens(RANKS)
    for got, text in zip(bpe.rank_encoder(RANKS, P.PATTERN).encode(texts), texts):
        assert b"".join(table[i] for i in ids(got)) == text.encode()


def test_memo_turns_over_without_changing_ids():
    small = bpe.ChunkEncoder(bpe.tokenizer_from_json(P.path("byte_bpe_50k.json")), limit=20)
    big = bpe.json_encoder(P.path("byte_bpe_50k.json"))
    texts = [" ".join(f"word{i % 37} x{i}" for i in range(n)) for n in (5, 50, 7, 90)]
    for t in texts:
        assert small.encode([t]) == big.encode([t])


def test_round_trip_in_spark_with_nulls_repeats_and_clashing_columns(spark, reference):
    long = "Ünïcode text 🙂 " * 3000
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello  world\n", "x"), (3, "Hello  world\n", "x"), (None, "no id", "x"), (5, long, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = bpe.round_trip(df, RANKS, P.PATTERN).collect()
    assert sorted((r.doc_id or -1, bytes(r.bytes)) for r in out) == sorted((i or -1, (t or "").encode()) for i, t, _ in rows)
    for r in out:
        assert ids(r.ids) == reference.encode_ordinary(bytes(r.bytes).decode()) and r.n_tokens == len(r.ids) // 4
    arrays = bpe.encode(df, RANKS, P.PATTERN).select("ids", bpe.unpacked("ids").alias("list")).collect()
    assert all(ids(r.ids) == r.list for r in arrays)
    assert bpe.round_trip(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_split_characters_decode_to_bytes(spark, reference):
    emoji = "🦜"
    found = reference.encode_ordinary(emoji)
    assert len(found) > 1
    halves = [(k, np.array([i], "<u4").tobytes()) for k, i in enumerate(found)]
    out = bpe.decode(spark.createDataFrame([(k, bytearray(b)) for k, b in halves], "doc_id bigint, ids binary"), RANKS)
    rows = {r.doc_id: (bytes(r.bytes), r.t) for r in out.select("*", bpe.text("bytes").alias("t")).collect()}
    assert b"".join(rows[k][0] for k in range(len(found))) == emoji.encode()
    assert "�" in rows[0][1]


def test_offsets_cover_the_text(spark):
    text = "Hi 🦜 there"
    row = bpe.encode_with_offsets(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), RANKS, P.PATTERN).first()
    assert row.tokens[0].start == 0 and row.tokens[-1].end == len(text)
    assert {c for t in row.tokens for c in range(t.start, t.end)} == set(range(len(text)))
