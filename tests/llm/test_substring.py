import random
import zlib

import numpy as np
import pytest

from marketloom.llm import substring


def brute(rows):
    key = lambda d: substring.LAST if d is None else d
    words = [(t or "").encode().split() for _, t, *_ in rows]
    first = {}
    for (d, *_), w in zip(rows, words):
        for s in range(len(w) - 19):
            first[tuple(w[s:s + 20])] = min(first.get(tuple(w[s:s + 20]), (key(d), s)), (key(d), s))
    out = []
    for (d, *_), w in zip(rows, words):
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - 19):
            gone[s:s + 20] |= (key(d), s) > first[tuple(w[s:s + 20])]
        out.append((str(d), len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out)


def check(spark, rows, parts=4):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, key string").repartition(parts)
    out = substring.deduplicated(df).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in out) == brute(rows)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in out)
    return df


@pytest.mark.parametrize("seed", range(4))
def test_random_texts_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range((2, 3, 12, 40)[seed])]
    shared = [[rnd.choice(vocabulary) for _ in range(rnd.randint(15, 70))] for _ in range(4)]
    rows = []
    for d in range(40):
        words = []
        for _ in range(rnd.randint(0, 5)):
            words += rnd.choice(shared) if rnd.random() < 0.5 else [rnd.choice(vocabulary + [f"u{d}_{k}" for k in range(40)]) for _ in range(rnd.randint(1, 50))]
        rows.append((d if d % 9 else None, rnd.choice([" ", "\n", "\t "]).join(words) if d % 11 else None, "k"))
    check(spark, rows + rows[:4])


def test_one_passage_in_every_document_and_long_texts(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"own{i} a{i} {passage} end{i}", "k") for i in range(300)]
    rows += [(900, "x" * 1_100_000 + " " + "q " * 30, "k"), (901, "z y " * 200_000, "k"), (902, "nbsp\u00a0is\u2003no\u0085gap " * 30, "k"), (902, "b " * 40, "k")]
    df = check(spark, rows, 7)
    assert substring.deduplicated(df.limit(0)).count() == 0


def test_batches_may_end_anywhere(monkeypatch):
    """The streamed comparison gives the same marks however the rows are cut into batches."""
    import pyarrow as pa

    rnd = np.random.default_rng(3)
    n = 400
    cols = [rnd.integers(0, 12, n), rnd.integers(0, 3, n), rnd.integers(0, 20, n), np.zeros(n, np.int64), np.zeros(n, np.int64), rnd.integers(0, 5, n).astype(np.int32), np.ones(n, np.int32)]
    order = np.lexsort((cols[5], cols[2], cols[1], cols[0]))
    cols = [c[order] for c in cols]
    batch = pa.record_batch([*[pa.array(c) for c in cols], pa.array(rnd.random(n) < 0.1)], ["key", "span", "doc", "h1", "h2", "start", "n", "known"])
    rows = lambda out: sorted(tuple(r.values()) for b in out for r in b.to_pylist())
    whole = rows(substring._compare_batches([batch]))
    for size in (1, 2, 7, 50):
        assert rows(substring._compare_batches([batch.slice(i, size) for i in range(0, n, size)])) == whole


def test_cleaned_keeps_columns_and_white_space(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, f"first\n\n{passage}", "en", 5), (2, f"second {passage} tail", "en", 6), (3, "short  text\n", "de", 12), (4, None, "fr", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_chars bigint")
    out = substring.cleaned(df)
    assert out.columns == df.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: (rows[0][1], 5), 2: ("second tail", 11), 3: (rows[2][1], 12), 4: (None, None)}


def test_texts_of_one_check_sum_under_one_id(spark):
    """A text whose CRC-32 was forged to that of another: each is judged by its own words."""
    passage = " ".join(f"p{i}" for i in range(60))
    long = f"{passage} end"
    for k in range(10_000):  # until the four forged bytes are plain letters of UTF-8
        head = f"short text {k} ".encode()
        forged = head + _four_bytes(head, zlib.crc32(long.encode()))
        if all(33 <= b < 127 for b in forged[len(head):]):
            break
    assert zlib.crc32(forged) == zlib.crc32(long.encode())
    other = forged.decode()
    check(spark, [(1, f"first {passage}", "k"), (None, long, "k"), (None, other, "k"), (7, long, "k"), (7, other, "k")])


def _four_bytes(head: bytes, want: int) -> bytes:
    """What to append to ``head`` so that its CRC-32 becomes ``want``."""
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    by_top = {v >> 24: i for i, v in enumerate(table)}
    state, picks = want ^ 0xFFFFFFFF, []
    for _ in range(4):
        picks.append(by_top[state >> 24])
        state = (state ^ table[picks[-1]]) << 8 & 0xFFFFFFFF
    state, out = zlib.crc32(head) ^ 0xFFFFFFFF, bytearray()
    for i in reversed(picks):
        out.append((state ^ i) & 255)
        state = state >> 8 ^ table[i]
    return bytes(out)
