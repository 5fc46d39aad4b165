import random

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from marketloom.llm import near_duplicates


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(texts):
    """Components of the pairs with a Jaccard index of at least 0.8, by position."""
    sets = [shingle_set(t) for t in texts]
    label = list(range(len(sets)))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return label, pairs


def test_stage_equals_jaccard_brute_force(spark, data_path):
    docs = spark.read.parquet(f"{data_path}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    label, pairs = brute([t for _, t in rows])
    want = [i for k, (i, _) in enumerate(rows) if label[k] == k]
    assert any(rows[i][1] != rows[j][1] for i, j in pairs)
    out = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, data_path)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == want


def variants(n, seed=5):
    """Copies of two texts with up to twelve words replaced, some below and some above the threshold, and short texts."""
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(10**6)}" for _ in range(rng.choice((150, 300)))] for _ in range(2)]
    texts = []
    for _ in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.randint(0, 12)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    return texts + ["one two", "One  TWO", "one two three", "", None]


@pytest.mark.parametrize("limit", [near_duplicates.PAIR_LIMIT, 1, 4])
def test_large_keys_give_the_same_components(spark, monkeypatch, limit):
    monkeypatch.setattr(near_duplicates, "PAIR_LIMIT", limit)
    texts = variants(90)
    label, _ = brute(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    want = [i for i in range(len(texts)) if label[i] == i]
    assert 1 < len(want) < len(texts) - 2
    assert sorted(r.doc_id for r in near_duplicates.distinct(df).collect()) == want


def test_rows_without_an_id_and_no_rows(spark):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(None, base), (None, base + " end"), (None, "quite another text here for once"), (7, "a b c d e f g"), (7, "h i j k l m n"), (8, "a b c d e f g")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = near_duplicates.distinct(df).collect()
    assert sorted(str(r.doc_id) for r in out) == ["7", "7", "None", "None"]
    assert near_duplicates.distinct(df.limit(0)).count() == 0


def test_classes_that_share_a_hash_are_told_apart(spark):
    marked = spark.createDataFrame([(1, 10, 5, 100, 3, [1]), (2, 11, 5, 200, 3, [2]), (3, 12, 5, 100, 3, [1]), (4, 13, 6, 100, 3, [1])], "doc_id bigint, text_hash bigint, node bigint, again bigint, n int, keys array<bigint>")
    out = {r.doc_id: r.node for r in near_duplicates.told_apart(marked).collect()}
    assert out[1] == out[3] == 5 and out[4] == 6 and len(set(out.values())) == 3


def test_copies_with_words_of_their_own_are_not_compared_in_pairs(spark, monkeypatch):
    """Copies below the threshold to each other share most keys; the bound on own shingles leaves few pairs."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base)]
    for i in range(120):
        words = list(base)
        for at in rng.sample(range(200), 7):
            words[at] = f"own{i}x{at}"
        texts.append(" ".join(words))
    monkeypatch.setattr(near_duplicates, "PAIR_LIMIT", 1)
    seen = []
    keep = near_duplicates.verified
    monkeypatch.setattr(near_duplicates, "verified", lambda pairs, sets: (seen.append(pairs.count()), keep(pairs, sets))[1])
    label, _ = brute(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert sorted(r.doc_id for r in near_duplicates.distinct(df).collect()) == [i for i in range(len(texts)) if label[i] == i]
    assert len(seen) == 2 and seen[1] == 0 and sum(seen) < 8 * len(texts)


def within_two_bits(sets):
    """Pairs whose fingerprints differ in two bits at most: a bit is 1 if set in over half the hashes."""
    fps = []
    for s in sets:
        hashes = [xxhash.xxh64_intdigest(x) for x in s]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    return {(i, j) for i in range(len(sets)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2}


def test_fingerprints_find_close_copies_without_bands(spark):
    texts = variants(90)
    close = within_two_bits([shingle_set(t) for t in texts])
    pairs = close & set(brute(texts)[1])
    label = list(range(len(texts)))
    for _ in texts:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    assert len(pairs) >= 10 and len(set(label)) < len(texts) - 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    marked = near_duplicates.told_apart(near_duplicates.marks(df)).withColumn("keys", F.array().cast("array<bigint>"))
    found = near_duplicates.labels(df, marked).join(marked, "node", "right")
    groups = {}
    for r in found.collect():
        groups.setdefault(r.label if r.label is not None else r.node, set()).add(r.doc_id)
    assert sorted(sorted(g) for g in groups.values()) == sorted(sorted(i for i in range(len(texts)) if label[i] == k) for k in set(label))
