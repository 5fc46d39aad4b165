"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries become whole numbers on a grid, so sums and deviations are exact.  The fit list, each
distinct grid vector once, is written to the shared folder as blocks of packed rows, a byte an
entry where that holds it.

A step multiplies the centred rows X by a direction, and the result by X transposed, in one
pass over the blocks: a task forms ``u = X w`` of its rows and returns ``X' u``, one row per
task.  Left vectors are never stored: each is named by its coefficients w (u = X w), its
products with the earlier ones are W' (X' u), and it is orthogonalised against all of them by
coefficients.  Right vectors have the dimension of the embeddings and are orthogonalised on the
driver.  After as many steps as there are dimensions, the small bidiagonal matrix has all
singular values; its singular vectors turn the right vectors into components.  Where a step
ends in zero (repeated or vanishing singular values), the next starts from another direction
orthogonal to all before, so nothing is missed.

Edge cases: rows without a vector, with null or non-finite entries, without entries, with
entries beyond ``LARGEST`` (their grid number is no long) or of another length than most rows
take no part; null ids stay; equal rows count once in the fit and get a result each; other
columns are not read; a table with fewer than two distinct vectors has no components, and its
rows have empty arrays.  ``deviation`` is null where it exceeds a long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions.shared import scratch_table
from marketloom.llm.vectors import list_array, matrix

#: Grid steps per unit, and the grid number of zero.
STEPS, ORIGIN = 64, 1_000_000
#: Entries of larger size have no grid number.
LARGEST = 2.0 ** 55
#: Bytes of a block of packed rows, and of a row group of blocks.
BLOCK_BYTES, GROUP_BYTES = 1 << 18, 1 << 24
#: Relative size below which a norm, or a singular value, counts as rounding.
TINY, NO_VALUE = 1e-13, 1e-9


def usable(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, int]:
    """vec_id and ``vec`` (doubles) of the rows that take part, and the length of their vectors."""
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.filter(F.col("vec").isNotNull() & (F.size("vec") > 0))
    rows = rows.filter(~F.exists("vec", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > LARGEST)))
    usual = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = usual["d"] if usual else 0
    return rows.filter(F.size("vec") == dim), dim


def grid(vectors: np.ndarray) -> np.ndarray:
    """Grid numbers less ``ORIGIN``."""
    return np.floor(STEPS * vectors).astype(np.int64)


# --- fit list ----------------------------------------------------------------


def _widths(rows: np.ndarray) -> np.ndarray:
    """Bytes an entry of each row needs: 1, 2, 4 or 8."""
    most = np.maximum(rows.max(axis=1), -1 - rows.min(axis=1))
    return np.select([most < 1 << 7, most < 1 << 15, most < 1 << 31], [1, 2, 4], 8)


def _key_batches(batches: Iterable[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            rows = grid(matrix(b.column(0), dim))
            widths = _widths(rows)
            for width in np.unique(widths):
                packed = rows[widths == width].astype(f"<i{width}")
                keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(packed.shape[1] * int(width)), len(packed), [None, pa.py_buffer(packed.tobytes())])
                yield pa.record_batch([pa.array(np.full(len(packed), width, np.int32)), keys.cast(pa.binary())], ["width", "row"])


def _block_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        widths, rows = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
        for width in np.unique(widths):
            some = [rows[i] for i in np.flatnonzero(widths == width)]
            step = max(1, BLOCK_BYTES // len(some[0]))
            for at in range(0, len(some), step):
                part = some[at:at + step]
                yield pa.record_batch([pa.array([width], pa.int32()), pa.array([len(part)], pa.int64()), pa.array([b"".join(part)], pa.binary())], ["width", "n", "rows"])


class FitList:
    """Each distinct grid vector once, in blocks: ``n`` of them with exact ``sums`` (grid numbers less ``ORIGIN``)."""

    def __init__(self, rows: DataFrame, dim: int):
        keys = rows.select("vec").mapInArrow(lambda it: _key_batches(it, dim), "width int, row binary").distinct()
        packed = keys.mapInArrow(_block_batches, "width int, n bigint, rows binary")
        self.dim = dim
        self.blocks = scratch_table(packed, "whitening", **{"parquet.block.size": str(GROUP_BYTES)})
        self.n = self.blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        # two halves of 32 bits: neither sum can overflow in a task
        halves = self._parts(lambda x: np.stack([(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)]), "bigint")
        self.sums = [sum((int(p[i]) << 32) + int(p[dim + i]) for p in halves) for i in range(dim)]

    def _parts(self, fold: Callable[[np.ndarray], np.ndarray], kind: str) -> list[np.ndarray]:
        """The sum of ``fold(rows)`` over the blocks of each task."""
        dim = self.dim

        def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for width, raw in zip(b.column(0).to_pylist(), b.column(1)):
                    found = fold(np.frombuffer(raw.as_buffer(), f"<i{width}").reshape(-1, dim).astype(np.int64))
                    total = found if total is None else total + found
            if total is not None:
                yield pa.record_batch([pa.array([total.ravel().tolist()])], ["part"])

        return [np.array(r.part) for r in self.blocks.select("width", "rows").mapInArrow(task, f"part array<{kind}>").collect()]

    def total(self, fold: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum of ``fold(centred rows)`` over all blocks, flat."""
        n, sums = self.n, self.sums
        return np.sum(self._parts(lambda x: fold(centred(x, n, sums)), "double"), axis=0)


def centred(rows: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Rows less the mean as doubles: whole numbers are subtracted first, so nothing is lost to a large mean."""
    return (rows - np.array([s // n for s in sums])).astype(np.float64) - np.array([(s % n) / n for s in sums])


# --- bidiagonalisation -------------------------------------------------------


def _without(vector: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """``vector`` orthogonalised against the rows of ``basis``, twice for rounding."""
    for _ in range(2 if basis else 0):
        vector = vector - np.array(basis).T @ (np.array(basis) @ vector)
    return vector


def bidiagonalise(fit: FitList) -> tuple[np.ndarray, np.ndarray, float]:
    """Bidiagonal matrix, right vectors (rows) and the sum of squares of the centred rows."""
    dim = fit.dim
    random = np.random.default_rng(13)
    square = float(fit.total(lambda x: np.array([np.square(x).sum()]))[0])
    small = TINY * np.sqrt(square)
    rights: list[np.ndarray] = []
    # left vector i is X ``lefts[i]``; ``images[i]`` is X' of it
    lefts: list[np.ndarray] = []
    images: list[np.ndarray] = []
    matrix_b = np.zeros((dim, dim))
    right, beta = random.standard_normal(dim), 0.0
    right /= np.linalg.norm(right)
    for step in range(dim):
        rights.append(right)
        if beta:
            matrix_b[step - 1, step] = beta
        w = right - beta * lefts[-1] if beta else right

        def products(x: np.ndarray, w: np.ndarray = w) -> np.ndarray:
            u = x @ w
            return np.r_[u @ u, x.T @ u]

        norm, *image = fit.total(products)
        image = np.array(image)
        for _ in range(2 if lefts else 0):
            shares = np.array(lefts) @ image
            w, image, norm = w - shares @ np.array(lefts), image - shares @ np.array(images), norm - shares @ shares
        alpha = np.sqrt(max(norm, 0.0))
        if alpha > small:
            w, image = w / alpha, image / alpha
            matrix_b[step, step] = alpha
        else:
            w, image, alpha = np.zeros(dim), np.zeros(dim), 0.0
        lefts.append(w)
        images.append(image)
        rest = _without(image - alpha * right, rights)
        beta = float(np.linalg.norm(rest))
        if beta <= small:
            beta = 0.0
            rest = _without(random.standard_normal(dim), rights)
        if step + 1 < dim:
            right = rest / np.linalg.norm(rest)
    return matrix_b, np.array(rights), square


@dataclass
class Whitening:
    """``n`` distinct vectors, their ``sums``, unit ``components`` (rows) and their ``values``, the ``trace`` of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float

    def projected(self, rows: np.ndarray) -> np.ndarray:
        return centred(rows, self.n, self.sums) @ self.components.T / np.sqrt(self.values)

    def deviations(self, rows: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, in whole numbers."""
        parts = [s // self.n for s in self.sums], [s % self.n for s in self.sums]
        most = int(np.abs(rows - np.array(parts[0])).max(initial=0)) + 1
        if (most * self.n) ** 2 * len(self.sums) < 2 ** 63:
            return np.square((rows - np.array(parts[0])) * self.n - np.array(parts[1])).sum(axis=1).tolist()
        found = (sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in rows.tolist())
        return [v if v < 2 ** 63 else None for v in found]


def fit(rows: DataFrame, dim: int, components: int = 16) -> Whitening:
    """Whitening of the vectors ``vec`` of ``rows``, all of length ``dim``."""
    vectors = FitList(rows, dim)
    n = vectors.n
    if n < 2:
        return Whitening(n, vectors.sums, np.zeros((0, dim)), np.zeros(0), 0.0, 0.0)
    matrix_b, rights, square = bidiagonalise(vectors)
    _, sizes, turned = np.linalg.svd(matrix_b)
    k = int(np.sum(sizes[:components] > NO_VALUE * sizes[0]))
    out = Whitening(n, vectors.sums, turned[:k] @ rights, np.square(sizes[:k]) / n, square / n, 0.0)

    def moments(x: np.ndarray) -> np.ndarray:
        z = x @ out.components.T / np.sqrt(out.values)
        return np.vstack([z.T @ z, z.sum(axis=0)])

    found = vectors.total(moments).reshape(k + 1, k) / n
    out.identity_error = float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())
    return out


def _whiten_batches(batches: Iterable[pa.RecordBatch], model: Whitening) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        rows = grid(matrix(b.column(1), len(model.sums)))
        yield pa.record_batch([b.column(0), pa.array(model.deviations(rows), pa.int64()), list_array(model.projected(rows), pa.float64())], ["vec_id", "deviation", "whitened"])


def whitened(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 16) -> DataFrame:
    """vec_id, ``n``, ``deviation`` and, by component, ``whitened`` and ``explained``; ``identity_error`` is one value."""
    rows, dim = usable(df, id_col, vec_col)
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, deviation bigint, whitened array<double>"
    model = fit(rows, dim, components) if dim else Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0, 0.0)
    out = rows.mapInArrow(lambda it: _whiten_batches(it, model), schema)
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.values]).cast("array<double>")
    return out.select("vec_id", F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", shares.alias("explained"), F.lit(model.identity_error).alias("identity_error"))
