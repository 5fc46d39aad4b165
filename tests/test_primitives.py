"""Ranks, running totals, quantiles, pairs and tail probabilities against brute force."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions import dist
from marketloom.functions.ordered import dominance, ntile_by, quantiles, running_totals
from marketloom.operators import stats, survival
from marketloom.operators.recommend import pairs_within


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key; one key is null; values tie often."""
    rng = np.random.default_rng(7)
    n = 6000
    keys = [None if i % 50 == 0 else ("hot" if i % 3 == 0 else f"k{int(rng.integers(0, 40))}") for i in range(n)]
    pdf = pd.DataFrame({"id": range(n), "k": keys, "v": rng.integers(0, 60, n).astype(float), "w": rng.integers(1, 5, n)})
    return spark.createDataFrame(pdf).repartition(8)


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Keep the range partitions apart so that offsets matter."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_running_totals_match_window(spark, skewed, keys):
    got = running_totals(skewed, [F.col("v").desc(), F.col("id")], keys=keys, sums={"run": "w"}, carry={"prev": "id"}, totals={"all_w": "w"}, rank="rn", count="n")
    assert got.count() == skewed.count()
    group = W.partitionBy(*(keys or [F.lit(0)]))
    w = group.orderBy(F.col("v").desc(), "id")
    want = skewed.select("*", F.row_number().over(w).alias("rn"), F.sum("w").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("run"), F.lag("id").over(w).alias("prev"), F.sum("w").over(group).alias("all_w"), F.count("*").over(group).alias("n"))
    cols = ["id", "rn", "run", "prev", "all_w", "n"]
    a = got.select(*cols).toPandas().sort_values("id").reset_index(drop=True)
    b = want.select(*cols).toPandas().sort_values("id").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_ntile_matches_window(skewed):
    got = ntile_by(skewed, "tile", 7, [F.col("v"), F.col("id")])
    want = skewed.withColumn("want", F.ntile(7).over(W.orderBy("v", "id"))).select("id", "want")
    assert got.join(want, "id").filter(F.col("tile") != F.col("want")).count() == 0


def test_quantiles_match_numpy(skewed):
    got = {r["k"]: r for r in quantiles(skewed, "v", {"a": 0.05, "b": 0.5, "c": 0.93}, keys=["k"]).collect()}
    pdf = skewed.toPandas()
    for key, part in pdf.groupby(pdf["k"].fillna("null"), dropna=False):
        row = got[None if key == "null" else key]
        for name, p in (("a", 0.05), ("b", 0.5), ("c", 0.93)):
            assert row[name] == pytest.approx(np.quantile(part["v"], p))


def test_quantiles_of_nulls_only(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id int, v double")
    assert quantiles(df, "v", {"m": 0.5}).first() is None or quantiles(df, "v", {"m": 0.5}).first()["m"] is None


@pytest.mark.parametrize("part", [2, 256])
def test_pairs_are_complete_when_a_group_is_split(spark, part):
    groups = {"big": list(range(25)), "small": [3, 9, 40], "one": [1]}
    df = spark.createDataFrame([(g, i) for g, items in groups.items() for i in items], "g string, i int")
    got = {(r["g"], r["a"], r["b"]) for r in pairs_within(df, "g", "i", part=part).collect()}
    assert got == {(g, a, b) for g, items in groups.items() for a, b in itertools.combinations(sorted(items), 2)}


def test_tail_probabilities_match_tables():
    assert dist._t(2.228, 10) == pytest.approx(0.05, abs=2e-4)
    assert dist._t(1.96, 1e6) == pytest.approx(0.05, abs=1e-4)
    assert dist._f(4.9646, 1, 10) == pytest.approx(0.05, abs=1e-4)
    assert dist.gamma_upper(2 / 2, 5.991 / 2) == pytest.approx(0.05, abs=1e-4)
    assert dist.gamma_upper(10 / 2, 18.307 / 2) == pytest.approx(0.05, abs=1e-4)
    assert dist.z_value(0.975) == pytest.approx(1.959964, abs=1e-6)


def test_tail_columns(spark):
    df = spark.createDataFrame([(2.228, 10.0), (0.0, 5.0), (None, 3.0)], "t double, d double")
    rows = df.select(dist.t_two_sided("t", "d").alias("p"), dist.normal_two_sided("t").alias("z"), dist.normal_cdf("t").alias("c")).collect()
    assert rows[0]["p"] == pytest.approx(0.05, abs=2e-4)
    assert rows[1]["p"] == pytest.approx(1.0) and rows[1]["c"] == pytest.approx(0.5)
    assert rows[2]["p"] is None
    assert rows[0]["z"] == pytest.approx(math.erfc(2.228 / math.sqrt(2)))


def test_a_hot_key_is_spread_over_ranges(spark, skewed):
    """No range holds more than about its share of the rows, whatever the keys."""
    order = [F.col("k"), F.col("v"), F.col("id")]
    ranges = skewed.repartitionByRange(*order).groupBy(F.spark_partition_id().alias("r")).agg(F.count("*").alias("n"), F.count_if(F.col("k") == "hot").alias("hot")).collect()
    assert sum(r["hot"] > 0 for r in ranges) >= 2
    assert max(r["n"] for r in ranges) < 2 * 6000 / len(ranges)


def pairs_of(x, y, wanted, weight):
    later = y[None, :] > y[:, None]
    both = wanted[:, None] * weight[None, :] * later
    return int((both * (x[None, :] < x[:, None])).sum()), int((both * (x[None, :] == x[:, None])).sum())


@pytest.mark.parametrize("levels, ranges", [((5, 7), "8"), ((400, 300), "8"), ((10 ** 6, 10 ** 6), "3"), ((1, 50), "8"), ((50, 1), "8")])
def test_dominance_counts_equal_all_pairs(spark, levels, ranges):
    rng = np.random.default_rng(levels[0])
    n = 900
    x, y = rng.integers(0, levels[0], n) / 4, rng.integers(-9, levels[1], n)
    x[: n // 3] = x[0]  # a third of the rows share one value
    wanted, weight = rng.integers(0, 3, n), rng.integers(0, 4, n)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "a": wanted, "b": weight})).repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        assert dominance(df, "x", "y", "a", "b") == pairs_of(x, y, wanted, weight)
        assert dominance(df.limit(0), "x", "y", "a", "b") == (0, 0)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_concordance_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    n = 700
    duration, event = rng.integers(1, 40, n), rng.integers(0, 2, n)
    risk = np.where(rng.random(n) < 0.4, np.round(rng.random(n), 1), rng.random(n))  # some scores tie, most do not
    df = spark.createDataFrame(pd.DataFrame({"risk": risk, "duration": duration, "event": event})).repartition(4)
    later = (event[:, None] == 1) & ((duration[None, :] > duration[:, None]) | (duration[None, :] == duration[:, None]) & (event[None, :] == 0))
    good, level = (later & (risk[None, :] < risk[:, None])).sum(), (later & (risk[None, :] == risk[:, None])).sum()
    out = survival.concordance(df, "risk").first()
    assert out.comparable_pairs == later.sum() and abs(out.concordance - (good + level / 2) / later.sum()) < 1e-12
    assert survival.concordance(df.limit(0), "risk").first().concordance == 0.5


def test_kendall_of_continuous_columns_equals_all_pairs(spark):
    rng = np.random.default_rng(5)
    n = 600
    a = rng.random(n)
    b = np.where(rng.random(n) < 0.3, np.round(a, 1), a + rng.normal(0, 0.3, n))
    a[:150] = 0.5
    sign = np.sign(a[None, :] - a[:, None]) * np.sign(b[None, :] - b[:, None])
    con, dis = (sign > 0).sum() / 2, (sign < 0).sum() / 2
    pairs = n * (n - 1) / 2
    tie = lambda v: (np.unique(v, return_counts=True)[1] * (np.unique(v, return_counts=True)[1] - 1) / 2).sum()
    out = stats.kendall_tau(spark.createDataFrame(pd.DataFrame({"a": a, "b": b})).repartition(4), "a", "b").first()
    assert (out.con, out.dis) == (con, dis) and abs(out.tau - (con - dis) / math.sqrt((pairs - tie(a)) * (pairs - tie(b)))) < 1e-12
