import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from marketloom.llm import simhash


def fingerprint(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute(fps):
    label = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps[:i]):
                if (a ^ b).bit_count() <= 2:
                    label[i] = label[j] = min(label[i], label[j])
    return label


@settings(max_examples=400, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), min_size=0, max_size=2))
def test_two_bits_away_share_a_key(x, bits):
    y = x
    for b in bits:
        y ^= 1 << b
    keys = [set(simhash.keys_of(np.array([v], np.uint64))[1].tolist()) for v in (x, y)]
    assert keys[0] & keys[1]


def test_every_codeword_within_four_bits_is_found():
    words = np.random.default_rng(0).integers(0, 1 << 23, 200)
    row, index = simhash.golay_indices(words)
    per = np.bincount(row, minlength=len(words))
    assert set(per.tolist()) <= {1, 6}


def check(spark, rows, limit=simhash.PAIR_LIMIT):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp string").repartition(3)
    out = {}
    for r in simhash.components(df).collect():
        out.setdefault(r.doc_id, set()).add((r.fp % 2**64, r.component_id))
    fps = [fingerprint(t) for _, t, _ in rows]
    classes = sorted(set(fps))
    label = brute(classes)
    ids = {}
    for (i, _, _), f in zip(rows, fps):
        if i is not None:
            root = label[classes.index(f)]
            ids[root] = min(ids.get(root, i), i)
    want = {}
    for (i, _, _), f in zip(rows, fps):
        want.setdefault(i, set()).add((f, ids.get(label[classes.index(f)])))
    assert out == want


def near_copies(n):
    random.seed(7)
    base = [random.choice("abcdefghij") * 3 + str(i) for i in range(400)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(random.randint(0, 2)):
            words[random.randrange(400)] = f"new{random.randrange(50)}"
        rows.append((i, " ".join(words), "x"))
    return rows


def test_components_equal_brute_force(spark):
    rows = near_copies(60) + [(100 + i, f"Other text {i} about something {i * i} else", "x") for i in range(20)]
    rows += [(200, None, "x"), (201, "", "x"), (201, "", "x"), (None, "A b", "x"), (203, "a B", "x"), (204, "one", "x")]
    check(spark, rows)


def test_keys_of_many_classes_take_the_way_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PAIR_LIMIT", 1)
    check(spark, near_copies(80))


def test_representatives(spark):
    rows = [(5, "same text here now", "a"), (3, "same text here now", "b"), (3, "same text here now", "c"), (9, "quite different words for once", "d"), (None, "alone again or not", "e")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, extra string")
    out = simhash.representatives(df)
    assert out.columns == df.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["3", "9", "None"]
    assert simhash.components(df.limit(0)).count() == 0


def test_representatives_are_rows_not_ids(spark):
    rows = [(None, "alone again or not", "a"), (None, "another text without any id", "b"), (None, "alone again or not", "c"), (7, "first text under this id", "d"), (7, "some second text under that id", "e"), (9, "first text under this id", "f"), (None, None, "g")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, extra string")
    out = [(r.doc_id, r.text) for r in simhash.representatives(df).collect()]
    assert sorted(out, key=str) == sorted([(None, "alone again or not"), (None, "another text without any id"), (None, None), (7, "first text under this id"), (7, "some second text under that id")], key=str)


def test_columns_that_clash_with_names_used_inside(spark):
    from marketloom.llm import near_duplicates

    texts = ["one two three four five six", "one two three four five six", "quite another text of some words", None]
    rows = [(i, t, i, f"v{i}", i, i) for i, t in enumerate(texts)] + [(2, texts[2], 9, "copy", 9, 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _id int, `a.b` string, _hash int, _row int")
    for judge in (simhash.representatives, near_duplicates.distinct):
        out = judge(df)
        assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [0, 2, 3]
