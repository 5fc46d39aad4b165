import zlib

import pandas as pd

from marketloom.llm import sharding


def placed(df, shards):
    out = sharding.shard(df, shards).toPandas()
    sizes = out.groupby("shard").size()
    assert sizes.max() - (sizes.min() if len(sizes) == shards else 0) <= 1
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    return out


def test_groups_stay_together_and_a_huge_group_fills_whole_shards(spark):
    rows = [(i, "hot") for i in range(400)] + [(1000 + i, f"pair{i // 2}") for i in range(200)] + [(2000 + i, f"single{i}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    out = placed(df, 6).merge(pd.DataFrame(rows, columns=["doc_id", "text"]), on="doc_id")
    assert len(out) == 1200
    cut = out.groupby("text").shard.nunique()
    assert cut["hot"] == 2 and (cut.drop("hot") == 1).all()


def test_sizes_checksums_nulls_and_repeats(spark):
    rows = [(1, None, 9), (1, None, 9), (2, "", 9), (None, "é" * 10_000, 9), (3, "x", 9)]
    out = placed(spark.createDataFrame(rows, "doc_id bigint, text string, shard int"), 3)
    got = sorted((-1 if pd.isna(i) else int(i), s, c) for i, s, c in zip(out.doc_id, out["size"], out.text_crc32))
    assert got == sorted((i or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)


def test_all_equal_and_empty(spark):
    assert len(placed(spark.createDataFrame([(i, "same") for i in range(100)], "doc_id bigint, text string"), 7)) == 100
    assert sharding.shard(spark.createDataFrame([], "doc_id bigint, text string"), 7).count() == 0
