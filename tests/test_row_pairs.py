"""Pairs of rows formed block by block against brute force, and what they shuffle."""

import itertools

import numpy as np
import pytest

from marketloom.functions import row_pairs
from marketloom.operators import graph, recommend


def _matrix(n_rows=60, n_columns=40, seed=3, hot=True):
    rng = np.random.default_rng(seed)
    cells = {(int(u), int(p)): float(rng.integers(1, 9)) for u, p in zip(rng.integers(0, n_rows, 400), rng.integers(0, n_columns, 400))}
    if hot:  # one column that all rows hold, one row that holds all columns, ids that are large, negative and null
        cells |= {(u, 7): 2.0 for u in range(n_rows)} | {(5, p): 1.0 for p in range(n_columns)} | {(-3, 1): 4.0, (1 << 40, 1): 2.5}
    return cells


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("pairs", [50, 2_000_000])
@pytest.mark.parametrize("method", ["cosine", "jaccard"])
def test_item_similarity_is_complete(spark, monkeypatch, method, pairs):
    monkeypatch.setattr(row_pairs, "BATCH_PAIRS", pairs)
    cells = _matrix()
    df = spark.createDataFrame([(p, u, q) for (u, p), q in cells.items()] + [(None, 1, 3.0)], "customer_id long, product_id long, qty double")
    held = {}
    for (u, p), q in cells.items():
        held.setdefault(u, {})[p] = q
    norm = {u: sum(q * q for q in h.values()) ** 0.5 for u, h in held.items()}
    expected = {}
    for a, b in itertools.permutations(held, 2):
        both = held[a].keys() & held[b].keys()
        if both:
            expected[a, b] = sum(held[a][p] * held[b][p] for p in both) / norm[a] / norm[b] if method == "cosine" else len(both) / len(held[a].keys() | held[b].keys())
    out = recommend.item_similarity(df, method)
    got = {(r.a, r.b): r.similarity for r in out.collect()}
    assert got == pytest.approx(expected, rel=1e-12)


def test_pairs_are_not_shuffled(spark):
    df = spark.createDataFrame([(p, u, q) for (u, p), q in _matrix().items()], "customer_id long, product_id long, qty double")
    plan = _plan(recommend.item_similarity(df))
    assert "Join" not in plan and plan.index("MapInArrow") < plan.index("Exchange")  # nothing is dealt after the pairs are made


def test_blocks_grow_with_the_table():
    assert row_pairs.enough_blocks(600_000, 15_000, 6) == 6
    few, many = (row_pairs.enough_blocks(n, n // 40, 6) for n in (100_000_000, 1_000_000_000))
    for n, blocks in ((100_000_000, few), (1_000_000_000, many)):
        assert n * (1 - (1 - 1 / blocks) ** 40) <= row_pairs.BLOCK_ENTRIES
    assert few < many


def _groups(nodes, pairs):
    label = {u: u for u in nodes}

    def root(u):
        while label[u] != u:
            u = label[u]
        return u

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        label[y] = x
    return {u: root(u) for u in nodes}


@pytest.mark.parametrize("tile", [7, 2048])
def test_dense_links_have_the_groups_of_all_similar_pairs(spark, monkeypatch, tile):
    # few columns with many nodes each: all pairs of one column were shuffled before
    monkeypatch.setattr(graph, "_TILE", tile)
    rng = np.random.default_rng(11)
    held = {u: frozenset(rng.choice(24, int(rng.integers(2, 9)), replace=False).tolist()) for u in range(-20, 100)}
    df = spark.createDataFrame([(u, f"k{p}") for u, h in held.items() for p in h], "customer_id long, kind string")
    for threshold in (0.5, 0.6):
        similar = [(a, b) for a, b in itertools.combinations(held, 2) if len(held[a] & held[b]) / len(held[a] | held[b]) > threshold]
        expected = _groups(held, similar)
        assert 1 < len(set(expected.values())) < len(held)
        links = [(r.a, r.b) for r in graph._dense_links(df, "customer_id", "kind", threshold).collect()]
        assert _groups(held, links) == expected
        exact = {(r.a, r.b) for r in graph.similar_pairs(df, "customer_id", "kind", threshold).collect()}
        assert exact == set(similar)


def test_common_columns_choose_the_dense_way_and_short_ones_do_not(spark):
    nodes = spark.range(3000)
    common = nodes.selectExpr("id AS customer_id", "explode(transform(sequence(0, 4), i -> pmod(xxhash64(id, i), 6))) AS kind").distinct()
    short = nodes.selectExpr("id AS customer_id", "explode(transform(sequence(0, 4), i -> pmod(xxhash64(id, i), 3000))) AS kind").distinct()
    assert "a#" in _plan(graph.similar_links(common, "customer_id", "kind", 0.3)) and "jaccard" not in _plan(graph.similar_links(common, "customer_id", "kind", 0.3))
    assert "jaccard" in _plan(graph.similar_links(short, "customer_id", "kind", 0.3))


def test_co_purchases_leave_the_task_only_above_the_minimum(spark):
    cells = _matrix()
    df = spark.createDataFrame(list(cells), "product_id long, customer_id long")
    by = {}
    for p, c in cells:
        by.setdefault(p, set()).add(c)
    expected = {(a, b, len(by[a] & by[b])) for a, b in itertools.permutations(by, 2) if len(by[a] & by[b]) >= 3}
    out = graph.co_purchases(df, 3)
    assert {tuple(r) for r in out.collect()} == expected
    plan = _plan(out)
    assert plan.index("MapInArrow") < plan.index("Exchange")


@pytest.mark.parametrize("pairs", [40, 2_000_000])
def test_co_buyers_against_brute_force(spark, monkeypatch, pairs):
    monkeypatch.setattr(row_pairs, "BATCH_PAIRS", pairs)
    cells = _matrix(40, 60, hot=False) | {(-3, 7): 1.0, (1 << 40, 1 << 41): 1.0}
    by = {}
    for u, p in cells:
        by.setdefault(u, set()).add(p)
    expected = set()
    for u in by:
        near = [v for v in by if v != u and by[u] & by[v]]
        score = {p: sum(p in by[v] for v in near) for v in near for p in by[v] - by[u]}
        expected |= {(u, p, float(score[p]), i + 1) for i, p in enumerate(sorted(score, key=lambda p: (-score[p], p))[:4])}
    out = graph.co_buyer_recommendations(spark.createDataFrame(list(cells), "customer_id long, product_id long"), 4)
    assert {(r.customer_id, r.product_id, r.score, r.rank) for r in out.collect()} == expected
    assert "Join" not in _plan(out)  # customers x customers and their products were joined and shuffled before


def test_communities_read_their_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    edges = [(u, p) for u in range(30) for p in range(u % 3, u % 3 + 3)]
    df = spark.createDataFrame(edges, "customer_id long, product_id long").mapInArrow(count, "customer_id long, product_id long")
    assert graph.communities(df, "customer_id", "product_id", 0.4, 1).count() == 30
    assert seen.value == len(edges)


def test_the_best_are_chosen_without_sorting_all(monkeypatch):
    rng = np.random.default_rng(2)
    a = np.sort(rng.integers(0, 40, 20_000))
    b = np.arange(len(a))
    score = np.round(rng.random(len(a)), 3)  # many ties
    expected = {int(i) for u in range(40) for i in sorted(np.flatnonzero(a == u), key=lambda i: (-score[i], b[i]))[:10]}
    sorted_rows, lexsort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: (sorted_rows.append(len(keys[0])), lexsort(keys))[1])
    assert set(row_pairs.best_of(a, b, score, 10, 9).tolist()) == expected
    assert sum(sorted_rows) < len(a) / 4
    few = row_pairs.best_of(np.array([1, 1, 2]), np.array([5, 6, 7]), np.array([0.1, 0.2, 0.3]), 10, 9)
    assert sorted(few.tolist()) == [0, 1, 2]
