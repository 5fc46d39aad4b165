import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from marketloom.llm import packing
from marketloom.llm.packing import Capacity, plan

FILE = P.path("byte_bpe_50k.json")


def unfold(rows):
    places = defaultdict(list)
    for length, _, count, sequence, offset in rows:
        for i in range(count):
            places[sequence + i].append((offset, length))
    return places


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [Capacity(1024), Capacity(1024, 5), Capacity(1024, 16, 300_000)])
def test_plan_keeps_every_capacity_and_places_all(score, capacity):
    rng = np.random.default_rng(4)
    lengths = np.minimum(540, rng.lognormal(4, 1.2, 4000).astype(int) + 1).tolist()
    rows = plan(Counter(lengths), capacity, (1.0, 1.0, 1.0), score)
    placed, most = Counter(), 0
    ranks = defaultdict(list)
    for length, first, count, *_ in rows:
        ranks[length] += range(first, first + count)
    for length, n in Counter(lengths).items():
        assert sorted(ranks[length]) == list(range(n))
    for items in unfold(rows).values():
        items.sort()
        assert [o for o, _ in items] == np.cumsum([0, *[x for _, x in items[:-1]]]).tolist()
        assert sum(x for _, x in items) <= 1024
        assert len(items) <= (capacity.documents or 1024)
        assert sum(x * x for _, x in items) <= (capacity.attention or 1024 ** 2)
        placed.update(x for _, x in items)
        most = max(most, len(items))
    assert placed == Counter(lengths)


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 1025, 20_000)
    n = len(unfold(plan(Counter(lengths.tolist()), Capacity())))
    assert n <= 1.01 * -(-int(lengths.sum()) // 1024)


def test_a_piece_that_fits_nowhere_is_refused():
    with pytest.raises(ValueError):
        plan({100: 1}, Capacity(1024, None, 50))


def test_pack_documents(spark):
    random.seed(2)
    tokenizer = Tokenizer.from_file(FILE)
    texts = {i: " ".join(random.choices(["alpha", "beta", "γάμμα", "x1"], k=random.choice([1, 5, 60, 900]))) for i in range(60)}
    rows = [(i, t, "a") for i, t in texts.items()] + [(100, None, "a"), (101, "", "a"), (0, texts[0], "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, length string").repartition(3)
    out = packing.pack(packing.pieces(df, FILE)).collect()
    want = []
    for i, t, _ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        cut = len(ids) % 1024 or min(1024, len(ids))
        starts = [0, *range(cut, len(ids), 1024)]
        for k, a in enumerate(starts):
            part = ids[a:starts[k + 1] if k + 1 < len(starts) else None]
            want.append((i, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for items in by.values():
        items.sort()
        assert [o for o, _ in items] == np.cumsum([0, *[x for _, x in items[:-1]]]).tolist() and sum(x for _, x in items) <= 1024
    assert packing.pack(packing.pieces(df.limit(0), FILE)).count() == 0
