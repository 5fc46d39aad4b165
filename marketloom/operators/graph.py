"""The customer-product graph as an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions.exprs import n_rows
from marketloom.functions.ordered import materialize
from marketloom.functions.row_pairs import Block, by_neighbours, collect_blocks, dealt, release, row_pairs
from marketloom.functions.shared import scratch_table
from marketloom.operators.recommend import SCORE_DIGITS, top_n


def bipartite_edges(orders: DataFrame, items: DataFrame) -> DataFrame:
    return items.select("order_id", "product_id").join(orders.select("order_id", "customer_id"), "order_id").select("customer_id", "product_id").distinct()


def _degrees(edges: DataFrame, node: str) -> DataFrame:
    return edges.groupBy(node).agg(n_rows().alias("degree"))


def degree_stats(edges: DataFrame) -> DataFrame:
    """Nodes, edges, density and degree statistics of the two sides."""
    side = lambda node: _degrees(edges, node).agg(F.struct(n_rows().alias("n"), F.avg("degree").alias("avg"), F.max("degree").alias("max"), F.sum("degree").alias("e"))).scalar()
    one = edges.sparkSession.range(1).select(side("customer_id").alias("c"), side("product_id").alias("p"))
    return one.select(
        (F.col("c.n") + F.col("p.n")).alias("n_nodes"), F.col("c.n").alias("n_customers"), F.col("p.n").alias("n_products"), F.col("c.e").alias("n_edges"),
        F.try_divide(F.col("c.e"), F.col("c.n") * F.col("p.n")).alias("graph_density"), F.col("c.avg").alias("avg_customer_degree"), F.col("p.avg").alias("avg_product_degree"),
        F.col("c.max").alias("max_customer_degree"), F.col("p.max").alias("max_product_degree"))


def degree_centrality(edges: DataFrame, node: str) -> DataFrame:
    """Degree over the largest degree."""
    d = _degrees(edges, node)
    return d.select(node, "degree", (F.col("degree") / d.agg(F.max("degree")).scalar()).alias("degree_centrality"))


def similar_pairs(edges: DataFrame, node: str, other: str, threshold: float) -> DataFrame:
    """Node pairs whose neighbour sets have a Jaccard index above the threshold.

    What two nodes share is counted where the pairs are formed, block by block of nodes, and only pairs above the
    threshold leave the task.
    """
    def above(a, b, shared, na, nb):
        jaccard = shared / (na + nb - shared)
        keep = jaccard > threshold
        return [a[keep], b[keep], jaccard[keep]]

    kind = dict(edges.dtypes)[node]
    found = row_pairs(edges, node, other, None, "count(1)", above, "a bigint, b bigint, jaccard double", half=True)
    return found.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "jaccard")


#: Cells of the node x neighbour table that a task holds at most as bits of a byte each; nodes on a side of a tile.
_DENSE_CELLS, _TILE = 200_000_000, 2048


def _dense_links(edges: DataFrame, node: str, other: str, threshold: float) -> DataFrame:
    """Links with the connected groups of ``similar_pairs``, for few neighbours with many nodes each.

    Each task counts what nodes share as a product of tiles of the 0/1 table.  It joins the groups it finds and leaves
    out pairs of nodes that it knows to be in one group; its links are one for each node that is not the first of its group.
    """
    messages, blocks = dealt(edges, node, other, None, "count(1)", wide=True)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data in collect_blocks(batches):
            label = _joined(data, block, blocks, threshold)
            moved = np.flatnonzero(label != np.arange(len(label)))
            for at in range(0, len(moved), 100_000):
                part = moved[at:at + 100_000]
                yield pa.record_batch([pa.array(data.ids[label[part]]), pa.array(data.ids[part])], ["a", "b"])

    kind = dict(edges.dtypes)[node]
    return messages.mapInArrow(links, "a bigint, b bigint").select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"))


def _joined(data: Block, block: int, blocks: int, threshold: float) -> np.ndarray:
    """The smallest place in the group of each node, by the tiles that fall to this block."""
    n, columns = len(data.ids), len(data.ptr) - 1
    held = np.zeros((n, columns), np.uint8)
    held[data.row, np.repeat(np.arange(columns), np.diff(data.ptr))] = 1
    size = data.stat.astype(np.int64)
    label = np.arange(n)
    # the least number two nodes must share, by the sum of their sizes, as the quotient decides
    sums = np.arange(2 * columns + 1)
    need = np.full(len(sums), columns + 1, np.float32)
    for shared in range(columns, 0, -1):
        rest = sums - shared
        need[(rest > 0) & (shared / np.maximum(rest, 1) > threshold)] = shared

    def join(x: np.ndarray, y: np.ndarray) -> None:
        nonlocal label
        if not len(x) or not len(y):
            return
        shared = held[x].astype(np.float32) @ held[y].astype(np.float32).T
        near = shared >= need[size[x][:, None] + size[y][None, :]]
        far = np.int64(n)
        while True:
            lx, ly = label[x], label[y]
            low_x, low_y = np.where(near, ly[None, :], far).min(axis=1), np.where(near, lx[:, None], far).min(axis=0)
            if (low_x >= lx)[low_x < far].all() and (low_y >= ly)[low_y < far].all():
                return
            parent = np.arange(n)
            np.minimum.at(parent, lx, low_x)
            np.minimum.at(parent, ly, low_y)
            while True:
                jump = parent[parent]
                if (jump == parent).all():
                    break
                parent = jump
            label = parent[label]

    tiles = -(-n // _TILE)
    for i in range(tiles):
        for j in range(i, tiles):
            if (i + j) % blocks != block:
                continue
            x, y = np.arange(i * _TILE, min(n, (i + 1) * _TILE)), np.arange(j * _TILE, min(n, (j + 1) * _TILE))
            values, counts = np.unique(np.r_[label[x], label[y]], return_counts=True)
            most = values[np.argmax(counts)]  # pairs inside the largest group need no look
            inside = label[x] == most
            other_x, same_x, other_y = x[~inside], x[inside], y[label[y] != most]
            join(other_x, y)
            join(same_x, other_y)
    return label


def similar_links(edges: DataFrame, node: str, other: str, threshold: float) -> DataFrame:
    """Pairs ``a``, ``b`` with the connected groups of ``similar_pairs``, by the cheaper of two exact ways."""
    degree = _degrees(edges, other)
    columns, pairs = degree.agg(n_rows(), F.sum(F.col("degree").cast("double") * F.col("degree"))).first()
    nodes = edges.agg(F.approx_count_distinct(node)).first()[0]
    # nanoseconds: a sparse pair is sorted, a dense one is multiplied by column and looked up
    if columns * nodes <= _DENSE_CELLS and nodes * nodes * (3 + 0.04 * columns) < 20 * (pairs or 0):
        return _dense_links(edges, node, other, threshold)
    return similar_pairs(edges, node, other, threshold).select("a", "b")


def _signatures(edges: DataFrame, node: str, other: str) -> DataFrame:
    """A fixed-size order-free digest of each neighbour set, and its smallest holder."""
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), other).cast("decimal(38,0)"))
    digests = scratch_table(edges.groupBy(node).agg(n_rows().alias("s0"), h(1).alias("s1"), h(2).alias("s2")), "digests", compression="zstd")
    release(edges)  # the digests are read twice, and what made them is as large as the edges
    first = digests.groupBy("s0", "s1", "s2").agg(F.min(node).alias("representative"))
    return digests.join(first, ["s0", "s1", "s2"]).select(node, "representative")


def connected_components(pairs: DataFrame) -> DataFrame:
    """Smallest reachable node per node, by label propagation with pointer jumping.

    Every round is written to the checkpoint folder, so the plan does not grow
    and a lost executor repeats one round only.  It ends when no label changes:
    labels only fall, so it always ends.
    """
    both = materialize(pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a"))).toDF("node", "peer").distinct())
    labels = materialize(both.groupBy("node").agg(F.least(F.min("peer"), F.col("node")).alias("label")))
    while True:
        heard = both.join(labels.select(F.col("node").alias("peer"), F.col("label").alias("heard")), "peer").groupBy("node").agg(F.min("heard").alias("heard"))
        step = labels.join(heard, "node").select("node", F.least("label", "heard").alias("label"), F.col("label").alias("was"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = materialize(step.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "was"))
        changed = moved.filter(F.col("label") != F.col("was")).limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels


def communities(edges: DataFrame, node: str, other: str, threshold: float = 0.3, min_size: int = 5) -> DataFrame:
    """Connected groups of nodes with similar neighbour sets and their sizes."""
    edges = scratch_table(edges.select(node, other), "edges", compression="zstd")
    release(edges)
    same = scratch_table(_signatures(edges, node, other), "same", compression="zstd")
    folded = scratch_table(edges.join(same.filter(F.col(node) == F.col("representative")).select(node), node, "left_semi"), "folded", compression="zstd")
    release(edges)
    groups = connected_components(similar_links(folded, node, other, threshold))
    member = same.join(groups.select(F.col("node").alias("representative"), "label"), "representative", "left").select(node, F.coalesce("label", "representative").alias("community_id"))
    sizes = member.groupBy("community_id").agg(n_rows().alias("community_size")).filter(F.col("community_size") >= min_size)
    return member.join(sizes, "community_id").withColumnRenamed(node, "node")


def shortest_paths(edges: DataFrame, source: int, max_length: int = 5) -> DataFrame:
    """Distance and previous node for everything reached from a customer.

    Each level joins the frontier to the edges and drops what was reached before.
    """
    links = edges.select(F.concat(F.lit("c"), F.col("customer_id")).alias("x"), F.concat(F.lit("p"), F.col("product_id")).alias("y"))
    links = links.union(links.select("y", "x"))
    start = edges.sparkSession.range(1).select(F.lit(f"c{source}").alias("node"), F.lit(0).alias("distance"), F.lit(None).cast("string").alias("previous"))
    reached, frontier = start, start
    for level in range(1, max_length):
        found = frontier.select(F.col("node").alias("x")).join(links, "x").groupBy(F.col("y").alias("node")).agg(F.min("x").alias("previous"))
        new = found.join(reached.select("node"), "node", "left_anti").select("node", F.lit(level).alias("distance"), "previous")
        frontier = materialize(new)
        reached = reached.unionByName(frontier)
        if frontier.isEmpty():
            break
    return reached


def co_buyer_recommendations(edges: DataFrame, k: int = 10) -> DataFrame:
    """Products held by the most customers who share a product with each customer."""
    kinds = dict(edges.dtypes)
    best = by_neighbours(edges, "customer_id", "product_id", k, SCORE_DIGITS)
    return top_n(best.select(*[F.col(was).cast(kinds[name]).alias(name) for was, name in (("user", "customer_id"), ("item", "product_id"))], "score"), k)


def co_purchases(edges: DataFrame, min_count: int = 5) -> DataFrame:
    """Product pairs bought by at least ``min_count`` common customers, both directions.

    A product with fewer customers than the minimum cannot be in such a pair and
    is dropped before pairs are formed.
    """
    often = _degrees(edges, "product_id").filter(F.col("degree") >= min_count).select("product_id")

    def common(a, b, shared, na, nb):
        keep = shared >= min_count
        return [a[keep], b[keep], shared[keep].astype(np.int64)]

    kind = dict(edges.dtypes)["product_id"]
    held = edges.join(often, "product_id", "left_semi")
    both = row_pairs(held, "product_id", "customer_id", None, "count(1)", common, "product1 bigint, product2 bigint, co_occurrence_count bigint")
    return both.select(F.col("product1").cast(kind).alias("product1"), F.col("product2").cast(kind).alias("product2"), "co_occurrence_count")


# --- lineage -----------------------------------------------------------------


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Everything downstream of the start nodes with its depth.

    ``edges`` holds ``source`` and ``target``, ``start`` a ``node`` column.
    """
    frontier = start.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"))
    reached, depth = frontier, 0
    while True:  # ends: a node is reached once
        depth += 1
        step = frontier.join(edges, frontier["node"] == edges["source"]).select("root", F.col("target").alias("node")).distinct()
        frontier = materialize(step.join(reached.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return reached
        reached = materialize(reached.unionByName(frontier))


def trace_flow(edges: DataFrame, source: str) -> DataFrame:
    """The transformations on the first path from a source to each node it reaches.

    ``edges`` holds ``source``, ``target`` and ``transformation``.
    """
    frontier = edges.sparkSession.range(1).select(F.lit(source).alias("node"), F.array().cast("array<string>").alias("path"))
    reached = frontier
    while True:
        step = frontier.join(edges, frontier["node"] == edges["source"]).groupBy(F.col("target").alias("node")).agg(F.min(F.concat("path", F.array("transformation"))).alias("path"))
        frontier = materialize(step.join(reached.select("node"), "node", "left_anti"))
        if frontier.isEmpty():
            return reached
        reached = materialize(reached.unionByName(frontier))
