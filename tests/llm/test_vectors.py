"""Metric join and nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import ann, metric_join

EDGE = [(1, [1.0, 0.0], "x"), (2, [2.0, 0.0], "x"), (3, None, "x"), (4, [0.0, 0.0], "x"), (5, [float("nan"), 1.0], "x"), (6, [None, 1.0], "x"), (None, [1.0, 0.0], "x"), (7, [1.0, 0.0, 0.0], "x"),
        (1, [1.0, 0.0], "x"), (8, [], "x"), (9, [float("inf"), 1.0], "x"), (50, [0.0, 1.0], "x")]
SCHEMA = "vec_id bigint, embedding array<double>, node string"


def clustered(n=900, dim=6, seed=0):
    rng = np.random.default_rng(seed)
    x = np.repeat(rng.standard_normal((6, dim)), n // 6, axis=0) + 0.25 * rng.standard_normal((n, dim))
    x[100:150] = x[5]  # a group of equal vectors
    return x


def frame(spark, x):
    return spark.createDataFrame([(int(i), v.tolist(), "x") for i, v in enumerate(x)], SCHEMA).repartition(4)


def brute_links(x, t):
    norm = np.linalg.norm(x, axis=1)
    hit = (x @ x.T) / (norm[:, None] * norm[None]) >= t
    np.fill_diagonal(hit, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(hit, label[None, :], len(x)).min(axis=1))
        if (new == label).all():
            return hit.sum(axis=1), label
        label = new


@pytest.mark.parametrize("threshold", [0.95, 0.8])
@pytest.mark.parametrize("sizes", [(4000, 4000), (90, 40)])
def test_join_equals_brute_force(spark, monkeypatch, threshold, sizes):
    monkeypatch.setattr(metric_join, "PER_PIVOT", sizes[0])
    monkeypatch.setattr(metric_join, "BLOCK", sizes[1])
    x = clustered()
    links, label = brute_links(x, threshold)
    out = metric_join.near_duplicates(frame(spark, x), threshold).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out} == {i: (int(a), int(b), bool(b == i)) for i, (a, b) in enumerate(zip(links, label))}


def test_join_of_odd_vectors(spark):
    df = spark.createDataFrame(EDGE, SCHEMA)
    out = sorted(((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in metric_join.near_duplicates(df).collect()), key=str)
    want = [("1", 1, 1, True), ("1", 1, 1, True), ("2", 1, 1, False), ("None", 0, None, None)] + [(str(i), 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 50)]
    assert out == sorted(want, key=str)
    assert metric_join.near_duplicates(df.limit(0)).count() == 0


def test_bounds_leave_cells_out_where_the_data_allow_it(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "PER_PIVOT", 100)
    rng = np.random.default_rng(2)
    x = np.repeat(np.eye(8), 100, axis=0) + 0.01 * rng.standard_normal((800, 8))
    classes = frame(spark, x).select(F.col("vec_id").alias("node"), F.lit(1).cast("bigint").alias("many"), F.col("embedding").alias("vec"), F.xxhash64("vec_id").alias("h1"), F.lit(0).alias("h2"))
    cells = metric_join.cells_of(classes)
    sent = classes.select("node", "many", "vec").mapInArrow(lambda it: metric_join._send_batches(it, cells, 0.1), "dim int, cell int, block int, kind int, node bigint, many bigint, vec array<double>")
    assert sent.filter("kind = 2").count() < 0.3 * 800 * 7


def brute_near(x, q, k=5):
    norm = np.linalg.norm(x, axis=1)
    s = (x @ x[q]) / (norm * norm[q])
    s[q] = -9
    return np.lexsort((np.arange(len(x)), -np.round(s, 12)))[:k], s


def test_recall_scores_and_ties(spark):
    x = np.vstack([clustered(600, 12, 1), np.random.default_rng(3).standard_normal((1400, 12))])
    out = {}
    for r in ann.nearest(frame(spark, x), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(out) == list(range(0, 2000, 50))
    hits = 0
    for q, rows in out.items():
        want, s = brute_near(x, q)
        assert [r for r, _, _ in rows] == [1, 2, 3, 4, 5]
        assert all(abs(s[v] - score) < 1e-12 for _, v, score in rows)
        assert [(-round(c, 12), v) for _, v, c in rows] == sorted((-round(c, 12), v) for _, v, c in rows)
        hits += len(set(want.tolist()) & {v for _, v, _ in rows})
    assert hits / (5 * len(out)) >= 0.9
    assert [v for _, v, _ in out[100]] == [5, 101, 102, 103, 104]  # equal vectors by id


def test_search_of_few_and_odd_vectors(spark):
    df = spark.createDataFrame(EDGE + [(0, [1.0, 1.0], "x")], SCHEMA)
    out = [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    half = round(2**-0.5, 6)
    assert out == [(0, 1, 1, half), (0, 2, 2, half), (0, 3, 50, half), (50, 1, 0, half), (50, 2, 1, 0.0), (50, 3, 2, 0.0)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


EXTREME = [[1e200, 1e200], [2e200, 2e200], [1e-200, 1e-200], [1.0, 1.0], [5e-324, 5e-324], [1.7e308, 1.7e308], [1.0, -1.0], [1e-300, -1e-300]]


def test_vectors_of_extreme_size(spark):
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(EXTREME)], SCHEMA)
    out = {r.vec_id: (r.n_links, r.component_id) for r in metric_join.near_duplicates(df).collect()}
    assert out == {i: (5, 0) if i < 6 else (1, 6) for i in range(8)}
    near = ann.nearest(df, F.col("vec_id").isin(0, 2, 4, 6), 3).collect()
    got = {q: [(r.vec_id, r.score) for r in sorted(near, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 2, 4, 6)}
    for q in (0, 2, 4):
        assert len(got[q]) == 3 and {i for i, _ in got[q]} <= set(range(6)) - {q} and all(abs(x - 1) < 1e-12 for _, x in got[q])
    assert got[6][0][0] == 7 and abs(got[6][0][1] - 1) < 1e-12


def test_every_step_of_a_walk_releases_the_one_before(spark, monkeypatch):
    x = clustered(300, 8, 4)
    nodes = frame(spark, x).select(F.col("vec_id").alias("node"), F.col("embedding").alias("vec"))
    graph = ann.build(ann.coded(nodes), degree=4)
    done = []
    keep = ann.materialize
    monkeypatch.setattr(ann, "materialize", lambda df: (done.append("step"), keep(df))[1])
    monkeypatch.setattr(ann, "_release", lambda df: done.append("release"))
    assert ann.search(graph, nodes.filter("node < 3"), beam=16).count() == 3
    assert len(done) > 3 and done == ["step"] + ["step", "release"] * (len(done) // 2)
