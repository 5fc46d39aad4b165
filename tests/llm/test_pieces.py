import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marketloom.llm import pieces, queries

MODEL = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return pieces.library(MODEL)


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(MODEL)


def ids(packed):
    return np.frombuffer(packed, np.int32).tolist()


def test_random_texts_equal_the_library(library, encoder):
    random.seed(1)
    bits = list(" \n\t▁_aeiouthsd.,!ésß中文🙂\xa0​\x00<>") + ["  ", "   ", " " * 17, "the", " the", "ing", "<s>", "<0x41>", "▁▁", "    if", "\r\n", "0", "12"]
    texts = ["".join(random.choices(bits, k=random.randint(0, 60))) for _ in range(4000)]
    texts += [" " * k for k in range(60)] + ["x" + " " * k + "the" for k in range(60)] + ["ab" * k for k in range(50)] + ["thethe" * 3000]
    for got, text in zip(encoder.encode(texts), texts):
        assert ids(got) == library.encode(text)
        assert encoder.decode(ids(got)).decode() == library.decode(ids(got))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_unicode(text):
    if not hasattr(test_any_unicode, "both"):
        test_any_unicode.both = pieces.library(MODEL), pieces.Encoder(MODEL)
    library, encoder = test_any_unicode.both
    assert ids(encoder.encode([text])[0]) == library.encode(text)


def test_any_ids_decode_as_in_the_library(library, encoder):
    random.seed(2)
    some = [*range(300), *random.sample(range(32000), 40), 28705, 259, 230, 159, 189]
    for _ in range(5000):
        one = random.choices(some, k=random.randint(0, 12))
        assert encoder.decode(one).decode() == library.decode(one)


def test_prefix_table_holds_the_end_of_each_prefix(encoder, library):
    text = "▁thereafter,▁unbelievable▁things▁happened"
    last = encoder.last_tokens(text)
    for end in range(1, len(text) + 1):
        parts = encoder.model.merged(text[:end])
        assert encoder.model.ids[parts[-1]] == last[end - 1] >> encoder.size_bits


def test_small_tables_turn_over_without_changing_ids(library):
    small = pieces.Encoder(MODEL, pieces=20, pairs=10)
    texts = [" ".join(f"word{i % 37} x{i}" for i in range(n)) for n in (5, 50, 7, 90)]
    for t in texts:
        assert ids(small.encode([t])[0]) == library.encode(t)


def test_round_trip_in_spark_with_nulls_repeats_and_clashing_columns(spark, library):
    long = "Ünïcode  text 🙂 " * 3000
    rows = [(1, None, "x"), (2, "", "x"), (3, " Hello  world\n", "x"), (3, " Hello  world\n", "x"), (None, "no id", "x"), (5, long, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = pieces.round_trip(df, MODEL).collect()
    assert sorted((r.doc_id or -1, r.decoded) for r in out) == sorted((i or -1, t or "") for i, t, _ in rows)
    assert all(list(r.ids) == library.encode(r.decoded) for r in out)
    apart = pieces.decode(pieces.encode(df, MODEL), MODEL).collect()
    assert sorted((r.doc_id or -1, r.decoded) for r in apart) == sorted((i or -1, t or "") for i, t, _ in rows)
    assert pieces.round_trip(df.limit(0), MODEL).count() == 0
    nothing = spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>")
    assert pieces.decode(nothing, MODEL).first().decoded == ""


def test_query_equals_the_library(spark, data_path, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data_path}/documents.parquet").collect()}
    for r in queries.QUERIES["op11_pieces"](spark, data_path).collect():
        want = library.encode(texts[r.doc_id])
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in (",".join(map(str, want)), library.decode(want))]
        assert (r.n_tokens, [r.ids_sha256, r.decoded_sha256]) == (len(want), digests)
