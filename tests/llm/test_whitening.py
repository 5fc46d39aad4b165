import math
import random

import numpy as np
import pytest

from marketloom.llm import queries, whitening


def brute(vectors):
    """Grid vectors, exact deviations, eigenvalues and eigenvectors of the covariance of the distinct ones."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[float(v * n - s) / n for v, s in zip(row, sums)] for row in fit])
    values, parts = np.linalg.eigh(y.T @ y / n)
    rows = np.array([[float(v * n - s) / n for v, s in zip(row, sums)] for row in x])
    return n, [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x], values[::-1], parts[:, ::-1], rows


def compare(out, vectors, ids, components=16, tolerance=1e-7):
    n, deviations, values, parts, rows = brute(vectors)
    got = {r.vec_id: r for r in out}
    assert sorted(got) == sorted(ids)
    k = min(components, int(np.sum(values > 1e-9 * values[0])))
    found = np.array([got[i].whitened for i in ids])
    assert found.shape == (len(ids), k)
    want = rows @ parts[:, :k] / np.sqrt(values[:k])
    for i, d in zip(ids, deviations):
        assert (got[i].n, got[i].deviation) == (n, d if d < 2 ** 63 else None)
        assert np.allclose(got[i].explained, values[:k] / values.sum(), rtol=1e-9)
        assert got[i].identity_error < 1e-9
    gaps = [j for j in range(k) if min([abs(values[j] - values[i]) for i in range(len(values)) if i != j], default=1) > 1e-3 * values[j]]
    for j in gaps:  # a component has either sign
        assert min(np.abs(found[:, j] - want[:, j]).max(), np.abs(found[:, j] + want[:, j]).max()) < tolerance
    return found, values


@pytest.mark.parametrize("dim, n", [(3, 40), (24, 300), (5, 4)])
def test_equals_eigenvectors(spark, dim, n):
    rng = np.random.default_rng(dim)
    data = (rng.standard_normal((n, dim)) @ rng.standard_normal((dim, dim))).tolist()
    data += data[: n // 3]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(data)], "vec_id bigint, embedding array<double>, whitened int").repartition(5)
    compare(whitening.whitened(df).collect(), data, list(range(len(data))))


def test_query_equals_brute_force(spark, data_path):
    out = queries.QUERIES["op13_whitening"](spark, data_path).collect()
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data_path}/embeddings.parquet").collect()]
    n, deviations, values, parts, rows = brute([v for _, v in table])
    at = {i: k for k, (i, _) in enumerate(table)}
    assert len(out) == 16 * len(table) and {r.n for r in out} == {n} and len({r.identity_error for r in out}) == 1
    for r in out:
        z = rows[at[r.vec_id]] @ parts[:, r.component - 1] / math.sqrt(values[r.component - 1])
        assert abs(abs(r.whitened) - abs(z)) < 1e-7 and r.deviation == deviations[at[r.vec_id]]
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-10 and r.identity_error < 1e-10


def test_repeated_values_and_dependent_dimensions(spark):
    """A cube has one singular value three times; a fourth dimension depends on the others, a fifth is constant."""
    data = [[a, b, c, a + b, 7.0] for a in (-1.0, 1.0) for b in (-1.0, 1.0) for c in (-1.0, 1.0)]
    df = spark.createDataFrame(list(enumerate(data)), "vec_id bigint, embedding array<double>")
    found, values = compare(whitening.whitened(df).collect(), data, list(range(8)))
    assert found.shape[1] == 3 and np.allclose(found.T @ found / 8, np.eye(3), atol=1e-9)
    cube = [[a, b, c] for a, b, c, *_ in data]
    df = spark.createDataFrame(list(enumerate(cube)), "vec_id bigint, embedding array<double>")
    found = np.array([r.whitened for r in whitening.whitened(df).collect()])
    assert found.shape == (8, 3) and np.allclose(found.T @ found / 8, np.eye(3), atol=1e-9)


def test_wide_grid_and_exact_deviations(spark):
    random.seed(3)
    data = [[random.choice((1e-3, 1.0, 300.0, 1e9, 2.0 ** 54)) * random.uniform(-1, 1) for _ in range(4)] for _ in range(60)] + [[0.5, 1.5, 300.0, -1.0]]
    df = spark.createDataFrame(list(enumerate(data)), "vec_id bigint, embedding array<double>")
    out = whitening.whitened(df).collect()
    n, deviations, values, *_ = brute(data)
    assert {r.vec_id: r.deviation for r in out} == {i: d if d < 2 ** 63 else None for i, d in enumerate(deviations)}


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (None, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, []), (9, [1e300, 1.0]), (10, [1.0]), (2, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    out = whitening.whitened(df).collect()
    assert sorted(str(r.vec_id) for r in out) == ["1", "2", "2", "None"] and {r.n for r in out} == {3}
    assert whitening.whitened(df.limit(0)).count() == 0
    one = whitening.whitened(df.filter("vec_id = 2")).collect()
    assert [(r.n, r.deviation, r.whitened) for r in one] == [(1, 0, [])] * 2
