"""Searches with bounds, recurrences and one-pass bootstraps against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.functions.ordered import CHUNK, decayed_totals
from marketloom.operators import causal, graph, recommend


def _nearest(rows, n):
    by = {}
    for u, p, q in rows:
        by.setdefault(u, {})[p] = q
    norm = {u: sum(q * q for q in b.values()) ** 0.5 for u, b in by.items()}
    out = set()
    for u in by:
        scores = []
        for v in by:
            both = by[u].keys() & by[v].keys()
            if v != u and both:
                scores.append((-round(sum(by[u][p] * by[v][p] for p in both) / norm[u] / norm[v], 9), v))
        out |= {(u, v, round(-s, 6), i + 1) for i, (s, v) in enumerate(sorted(scores)[:n])}
    return out


@pytest.mark.parametrize("hot", [1, 3])
def test_nearest_rows_where_columns_are_held_by_all(spark, hot):
    rng = np.random.default_rng(hot)
    rows = [(u, 1000 + h, float(rng.integers(1, 5))) for u in range(150) for h in range(hot) if rng.random() < 0.95]
    rows += [(u, int(p), float(rng.integers(1, 5))) for u in range(0, 150, 2) for p in rng.choice(60, 4, replace=False)]
    df = spark.createDataFrame(rows, "customer_id int, product_id int, qty double")
    for n, long in ((3, 4), (5, 20)):
        got = {(r[0], r[1], round(r[2], 6), r[3]) for r in recommend.nearest_cosine(df, "customer_id", "product_id", n, long).collect()}
        assert got == _nearest(rows, n), (n, long)


def test_a_column_that_all_hold_costs_a_fixed_number_of_pairs(spark):
    for size in (400, 800):
        rows = [(u, 0, 1.0) for u in range(size)] + [(u, 1 + u // 2, float(1 + u % 3)) for u in range(size)]
        df = spark.createDataFrame(rows, "customer_id int, product_id int, qty double")
        pairs = recommend.cosine_candidates(df, "customer_id", "product_id", 3, 8)
        assert pairs.count() <= 6 * size
        assert {(r[0], r[1], round(r[2], 6), r[3]) for r in recommend.top_n(pairs, 3, "u", "v").select("u", "v", "score", "rank").collect()} == _nearest(rows, 3)


def test_nearest_rows_of_an_empty_table(spark):
    assert recommend.nearest_cosine(spark.createDataFrame([], "customer_id int, product_id int, qty double"), "customer_id", "product_id", 3).count() == 0


@pytest.mark.parametrize("threshold", [0.2, 0.3, 0.6])
def test_set_join_against_all_pairs(spark, threshold):
    rng = np.random.default_rng(5)
    sets = {}
    for node in range(120):
        base = sets[int(rng.integers(0, node))] if node > 20 and node % 2 else set()
        sets[node] = {x for x in base if rng.random() < 0.8} | {int(x) for x in rng.integers(0, 80, int(rng.integers(1, 7)))} | ({999} if node % 3 else set())
    edges = spark.createDataFrame([(a, p) for a, s in sets.items() for p in s], "customer_id int, product_id int")
    index = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sets, 2)}
    want = {pair for pair, j in index.items() if j > threshold}
    got = graph.similar_pairs(edges, "customer_id", "product_id", threshold).collect()
    assert want and {(r["a"], r["b"]) for r in got} == want
    assert all(abs(r["jaccard"] - index[r["a"], r["b"]]) < 1e-12 for r in got)
    label = {n: n for n in sets}
    for _ in sets:
        for a, b in want:
            label[a] = label[b] = min(label[a], label[b])
    found = graph.communities(edges, "customer_id", "product_id", threshold, 1).collect()
    assert {r["node"]: r["community_id"] for r in found} == label


def test_recurrence_over_several_chunks(spark):
    rng = np.random.default_rng(3)
    n = 3 * CHUNK + 7
    rows = [(k, t, None if t % 97 == 0 else float(rng.integers(0, 50)), "x") for k, m in (("long", n), (None, 5), ("full", CHUNK)) for t in range(m)]
    df = spark.createDataFrame(rows, "k string, t int, v double, note string").repartition(5)
    for decay in (0.5, 0.999):
        out = decayed_totals(df, ["t"], "v", "a", decay, ["k"])
        got = {(r["k"], r["t"]): r["a"] for r in out.collect()}
        want, last = {}, {}
        for k, t, v, _ in rows:
            last[k] = want[k, t] = (v or 0.0) + decay * last.get(k, 0.0)
        assert out.columns == ["k", "t", "v", "note", "a"] and got.keys() == want.keys()
        assert all(abs(got[i] - want[i]) < 1e-9 * max(1.0, want[i]) for i in want)
    assert decayed_totals(df.limit(0), ["t"], "v", "a", 0.5).count() == 0


def test_bootstraps_against_their_replicates(spark):
    rng = np.random.default_rng(11)
    rows = [(i, i % 2, float(rng.normal(i % 2)), float(i % 13), 0.3 + 0.4 * (i % 5) / 5) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, t int, y double, x double, propensity_score double").repartition(4)
    reps = 40
    drawn = df.select("k", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep")).withColumn("m", causal.poisson_weight("k", F.col("rep")))
    times = np.zeros((reps, len(rows)))
    for r in drawn.collect():
        times[r["rep"] - 1, r["k"]] = r["m"]
    k, t, y, x, e = (np.array(c) for c in zip(*rows))
    raw = np.where(t == 1, 1 / e, 1 / (1 - e))
    w = np.clip(raw, *np.quantile(raw, [0.01, 0.99]))
    mean = lambda m, g: (m * w * y)[t == g].sum() / (m * w)[t == g].sum()
    effects = [mean(m, 1) - mean(m, 0) for m in times]
    got = causal.inverse_probability_weighting(df, "k", "t", "y", replicates=reps).first()
    assert got["standard_error"] == pytest.approx(np.std(effects), rel=1e-9)
    assert got["ate"] == pytest.approx(mean(np.ones(len(rows)), 1) - mean(np.ones(len(rows)), 0), rel=1e-9)

    slope = lambda m, g: np.polyfit(x[t == g], y[t == g], 1, w=np.sqrt(m[t == g]))[0]
    gaps = [slope(m, 1) - slope(m, 0) for m in times]
    got = causal.parallel_trends(df, "k", "t", "y", "x", replicates=reps).first()
    assert [got["ci_95_lower"], got["ci_95_upper"]] == pytest.approx(np.quantile(gaps, [0.025, 0.975]).tolist(), rel=1e-6)
