"""All pairs of vectors within a cosine, as an exact range join over cells of pivots.

On unit vectors a cosine of at least t is a distance of at most e = sqrt(2 - 2 t).  Every
vector belongs to the cell of its nearest pivot.  It is sent to the cells of smaller
number that could hold a vector within e: the triangle inequality asks that its distance
to the other pivot is at most that cell's radius plus e, and that it is at most e from
the plane half way between the two pivots.  Each cell is then joined on its own, in
blocks of its vectors; a block streams the cell's other vectors and those sent to it.
Tasks return a count per vector and enough links to connect what is linked, not pairs.

Equal vectors are one class that counts for its members.  Cosines are computed in double
precision; single precision only finds the pairs near or above the threshold.

The pivots are the classes with the smallest hashes, one for ``PER_PIVOT`` classes and at
most ``MAX_PIVOTS``.  Where the data have no structure the bounds send most vectors to most
cells, and the work nears that of all pairs: that is the price of an exact result.

Edge cases: vectors that are null, zero, empty or hold null or non-finite components, and rows
without a vec_id, link with nothing; vectors of different dimensions do not link; rows that
repeat a vec_id and vector are one vector; if one vec_id has several vectors they are one node;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions.shared import materialize
from marketloom.llm.batches import runs
from marketloom.llm.vectors import hashed, list_array, matrix, scaled, usable
from marketloom.operators.graph import connected_components

PER_PIVOT = 4000
MAX_PIVOTS = 512
#: Vectors of a block of a cell: what a task holds while it streams the rest.
BLOCK = 4000
_CHUNK = 1024


@dataclass(frozen=True)
class Cells:
    """Unit pivots by dimension, and of each cell its radius and number of blocks."""

    pivots: dict[int, np.ndarray]
    radius: dict[tuple[int, int], float]
    blocks: dict[tuple[int, int], int]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_dimension(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = pc.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False)
    for d in np.unique(dims):
        yield int(d), batch.filter(pa.array(dims == d))


def _nearest(unit: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances to all pivots, and the nearest pivot of each row."""
    square = np.maximum(0, 2 - 2 * unit @ pivots.T)
    return square, square.argmin(axis=1)


def _place_batches(batches: Iterable[pa.RecordBatch], pivots: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for dim, part in _by_dimension(b, 1):
            unit = _unit(matrix(part.column(1), dim))
            if dim in pivots:
                square, cell = _nearest(unit, pivots[dim])
                away = np.sqrt(square[np.arange(len(cell)), cell])
            else:
                cell, away = np.zeros(len(unit), np.int64), np.full(len(unit), 2.0)
            yield pa.record_batch([pa.array(np.full(len(cell), dim, np.int32)), pa.array(cell.astype(np.int32)), pa.array(away)], ["dim", "cell", "away"])


def _send_batches(batches: Iterable[pa.RecordBatch], cells: Cells, reach: float) -> Iterator[pa.RecordBatch]:
    """Rows for every block that needs a vector; kind 0 is in the block, 1 elsewhere in its cell, 2 sent from another cell."""
    slack = 1e-9
    for b in batches:
        for dim, part in _by_dimension(b, 2):
            node, many = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            x = matrix(part.column(2), dim)
            unit = _unit(x)
            if dim in cells.pivots:
                pivots = cells.pivots[dim]
                square, home = _nearest(unit, pivots)
                n = len(pivots)
                radius = np.array([cells.radius.get((dim, c), -9.0) for c in range(n)])
                near = np.sqrt(square) <= radius + reach + slack
                apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))[home]
                own = square[np.arange(len(home)), home]
                near &= square - own[:, None] <= 2 * apart * (reach + slack) + slack
                near &= np.arange(n)[None, :] < home[:, None]
                guest_row, guest_cell = np.nonzero(near)
            else:
                home = np.zeros(len(unit), np.int64)
                guest_row = guest_cell = np.zeros(0, np.int64)
            blocks = np.array([cells.blocks.get((dim, c), 1) for c in range(int(home.max(initial=0)) + 1)])
            # a block by a mixed hash of the node, so that one cell's vectors spread evenly
            mixed = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            row = np.concatenate([np.arange(len(home)), guest_row])
            cell = np.concatenate([home, guest_cell])
            count = blocks[cell]
            block = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            guest = np.repeat(np.arange(len(row)) >= len(home), count)
            row, cell = np.repeat(row, count), np.repeat(cell, count)
            kind = np.where(guest, 2, np.where(mixed[row] % blocks[cell].astype(np.uint64) == block, 0, 1))
            for a in range(0, len(row), 20_000):
                at = slice(a, a + 20_000)
                r = row[at]
                yield pa.record_batch([
                    pa.array(np.full(len(r), dim, np.int32)), pa.array(cell[at].astype(np.int32)), pa.array(block[at].astype(np.int32)), pa.array(kind[at].astype(np.int32)),
                    pa.array(node[r]), pa.array(many[r]), list_array(x[r], pa.float64())], ["dim", "cell", "block", "kind", "node", "many", "vec"])


class _Block:
    """The vectors of a block, the number of links found, and which are connected."""

    def __init__(self, threshold: float):
        self.threshold, self.parts, self.x = threshold, [], None

    def add(self, node: np.ndarray, many: np.ndarray, x: np.ndarray) -> None:
        self.parts.append((node, many, x))

    def close(self) -> None:
        self.node, self.many, self.x = (np.concatenate(p) for p in zip(*self.parts))
        self.norm = np.linalg.norm(self.x, axis=1)
        self.small = (self.x / self.norm[:, None]).astype(np.float32)
        self.margin = np.float32(1e-5 + 2e-7 * self.x.shape[1])
        self.links = np.zeros(len(self.node), np.int64)
        self.label = np.arange(len(self.node))
        for a in range(0, len(self.node), _CHUNK):
            at = slice(a, a + _CHUNK)
            hit = self._hits(self.x[at], self.small[at], self.norm[at])
            hit[np.arange(len(hit)), np.arange(a, a + len(hit))] = False
            self.links[at] += (hit * self.many).sum(axis=1)
            for i in np.flatnonzero(hit.any(axis=1)):
                self._unite(np.r_[np.flatnonzero(hit[i]), a + i])

    def _hits(self, x: np.ndarray, small: np.ndarray, norm: np.ndarray) -> np.ndarray:
        cosine = small @ self.small.T
        hit = cosine >= self.threshold + self.margin
        row, col = np.nonzero((cosine >= self.threshold - self.margin) & ~hit)
        for a in range(0, len(row), 50_000):
            r, c = row[a:a + 50_000], col[a:a + 50_000]
            hit[r, c] = (x[r] * self.x[c]).sum(axis=1) / (norm[r] * self.norm[c]) >= self.threshold
        return hit

    def _unite(self, own: np.ndarray) -> None:
        roots = np.unique(self.label[own])
        if len(roots) > 1:
            self.label[np.isin(self.label, roots)] = roots[0]

    def visit(self, node: np.ndarray, many: np.ndarray, x: np.ndarray, guest: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Compare vectors from outside the block; gives the links of guests and one link of every visitor."""
        for a in range(0, len(node), _CHUNK):
            at = slice(a, a + _CHUNK)
            norm = np.linalg.norm(x[at], axis=1)
            hit = self._hits(x[at], (x[at] / norm[:, None]).astype(np.float32), norm)
            self.links += (hit * many[at][:, None]).sum(axis=0)
            linked = np.flatnonzero(hit.any(axis=1))
            for i in linked:
                self._unite(np.flatnonzero(hit[i]))
            if len(linked):
                count = np.where(guest[at][linked], (hit[linked] * self.many).sum(axis=1), 0)
                yield node[at][linked], self.node[hit[linked].argmax(axis=1)], count

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        some = np.flatnonzero((self.links > 0) | (self.label != np.arange(len(self.label))))
        return self.node[some], self.node[self.label[some]], self.links[some]


_FOUND = ["node", "peer", "links"]


def _join_batches(batches: Iterable[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell, block and kind: first the block, then its visitors."""
    key, block = None, None

    def emit(found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(f) for f in found], _FOUND)

    for b in batches:
        for dim, part in _by_dimension(b, 6):
            cols = [part.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            x = matrix(part.column(6), dim)
            at = runs(*cols[:3])
            for a, e in zip(at[:-1].tolist(), at[1:].tolist()):
                now = (dim, int(cols[1][a]), int(cols[2][a]))
                if now != key:
                    if block is not None:
                        if block.x is None:
                            block.close()
                        yield emit(block.result())
                    key, block = now, _Block(threshold)
                kind, node, many, rows = cols[3][a:e], cols[4][a:e], cols[5][a:e], x[a:e]
                own = kind == 0
                if own.any():
                    block.add(node[own], many[own], rows[own])
                if not own.all() and block.parts:
                    if block.x is None:
                        block.close()
                    for found in block.visit(node[~own], many[~own], rows[~own], kind[~own] == 2):
                        yield emit(found)
    if block is not None and block.parts:
        if block.x is None:
            block.close()
        yield emit(block.result())


def cells_of(classes: DataFrame) -> Cells:
    """Pivots from the classes with the smallest hashes; radius and blocks of their cells."""
    n = classes.count()
    wanted = max(1, min(MAX_PIVOTS, math.ceil(n / PER_PIVOT)))
    chosen = [r["vec"] for r in classes.select("vec", "h1", "h2").orderBy("h1", "h2").limit(wanted).collect()]
    pivots = {d: _unit(np.array([v for v in chosen if len(v) == d])) for d in {len(v) for v in chosen}}
    placed = classes.select("node", "vec").mapInArrow(lambda it: _place_batches(it, pivots), "dim int, cell int, away double")
    rows = placed.groupBy("dim", "cell").agg(F.max("away").alias("r"), F.count(F.lit(1)).alias("n")).collect()  # a row per pivot
    return Cells(pivots, {(r["dim"], r["cell"]): r["r"] for r in rows}, {(r["dim"], r["cell"]): math.ceil(r["n"] / BLOCK) for r in rows})


def class_links(classes: DataFrame, threshold: float) -> DataFrame:
    """Rows (node, peer, links): parts of a class's number of links, and a link that connects it."""
    cells = cells_of(classes)
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    sent = classes.select("node", "many", "vec").mapInArrow(lambda it: _send_batches(it, cells, reach), "dim int, cell int, block int, kind int, node bigint, many bigint, vec array<double>")
    n = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(cells.blocks.values()))
    dealt = sent.repartition(n, "dim", "cell", "block").sortWithinPartitions("dim", "cell", "block", "kind")
    return materialize(dealt.mapInArrow(lambda it: _join_batches(it, threshold), "node bigint, peer bigint, links bigint"))


def near_duplicates(df: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``df``."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = hashed(df, id_col, vec_col)
    each = rows.groupBy("h1", "h2", "vec_id").agg(F.first("vec").alias("vec"))
    classes = materialize(each.groupBy("h1", "h2").agg(F.min("vec_id").cast("long").alias("node"), F.count(F.lit(1)).alias("many"), F.first("vec").alias("vec")))
    found = class_links(classes, threshold)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = connected_components(found.filter("node != peer").select(F.col("node").alias("a"), F.col("peer").alias("b")).distinct())
    known = classes.select("h1", "h2", "node", "many").join(counts, "node", "left").join(labels, "node", "left").select(
        "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("label", "node").alias("component_id"))
    vec = F.col(vec_col).cast("array<double>")
    links = F.col(id_col).isNotNull() & usable(vec)
    all_rows = df.select(F.col(id_col).alias("vec_id"), F.when(links, F.xxhash64(scaled(vec))).alias("h1"), F.when(links, F.xxhash64(F.lit(1), scaled(vec))).alias("h2"))
    own = F.coalesce(F.col("component_id").cast(kind), F.col("vec_id"))
    return all_rows.join(known, ["h1", "h2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), (F.col("vec_id") == own).alias("kept"))
