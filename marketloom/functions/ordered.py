"""Ranks, running totals and exact quantiles without single-task windows.

A window without PARTITION BY, or one whose partition holds a third of the
rows, sorts all of them in one task.  Here the rows are range partitioned by
(keys, order), each range is numbered on its own, and the small table of
per-range totals supplies the offsets.  The sorted rows are written to the
checkpoint folder so that a lost executor cannot change the numbering.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions.exprs import or_zero
from marketloom.functions.shared import materialize

_LOCAL_BITS = 33


def running_totals(
    df: DataFrame,
    order_by: Sequence[str | Column],
    keys: Sequence[str] = (),
    sums: dict[str, str] | None = None,
    carry: dict[str, str] | None = None,
    rank: str | None = "row_num",
    totals: dict[str, str] | None = None,
    count: str | None = None,
) -> DataFrame:
    """Add a row number, running sums and previous values within ``keys`` in ``order_by``.

    ``order_by`` must be a total order within the keys.  ``sums`` maps an
    output column to the column summed up to and including the row, ``carry`` an
    output column to the column whose previous row is wanted, ``totals`` an
    output column to the column summed over the whole group, ``count`` names the
    group size.
    """
    sums, carry, totals = sums or {}, carry or {}, totals or {}
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    sort = [F.col(k) for k in keys] + order
    ranged = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    ranged = materialize(ranged.withColumn("_pos", F.monotonically_increasing_id()))
    # one struct key: equal even where a key is null, and one partitioning serves window and join
    group = F.struct(*keys) if keys else F.lit(0)
    ranged = ranged.withColumn("_range", F.shiftright("_pos", _LOCAL_BITS)).withColumn("_key", group)

    partial = [F.count(F.lit(1)).alias("_n")]
    partial += [F.sum(src).alias(f"_s_{out}") for out, src in sums.items()]
    partial += [F.sum(src).alias(f"_t_{out}") for out, src in totals.items()]
    partial += [F.max_by(F.struct(F.col(src).alias("v")), "_pos").alias(f"_c_{out}") for out, src in carry.items()]
    per_range = ranged.groupBy("_range", "_key").agg(*partial)
    # At most one row per key and range: the number of ranges bounds each window.
    before = W.partitionBy("_key").orderBy("_range")
    prior = before.rowsBetween(W.unboundedPreceding, -1)
    whole = before.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offsets = per_range.select(
        "_range", "_key",
        F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_n0"),
        F.sum("_n").over(whole).alias("_nall"),
        *[F.sum(f"_s_{o}").over(prior).alias(f"_s0_{o}") for o in sums],
        *[F.sum(f"_t_{o}").over(whole).alias(f"_tall_{o}") for o in totals],
        *[F.lag(f"_c_{o}").over(before).alias(f"_c0_{o}") for o in carry],
    )

    local = W.partitionBy("_range", "_key").orderBy("_pos")
    upto = local.rowsBetween(W.unboundedPreceding, W.currentRow)
    cols: list[Column] = []
    if rank:
        cols.append(F.row_number().over(local).cast("long").alias("_rn"))
    cols += [F.sum(src).over(upto).alias(f"_sl_{out}") for out, src in sums.items()]
    cols += [F.lag(F.struct(F.col(src).alias("v"))).over(local).alias(f"_cl_{out}") for out, src in carry.items()]
    joined = ranged.select("*", *cols).join(offsets, ["_range", "_key"])
    out = [c for c in df.columns]
    result: list[Column] = [F.col(c) for c in out]
    if rank:
        result.append((F.col("_rn") + F.col("_n0")).alias(rank))
    if count:
        result.append(F.col("_nall").alias(count))
    for name in sums:
        local_sum, start = F.col(f"_sl_{name}"), F.col(f"_s0_{name}")
        result.append(F.when(start.isNull(), local_sum).otherwise(start + F.coalesce(local_sum, F.lit(0))).alias(name))
    result += [F.col(f"_tall_{o}").alias(o) for o in totals]
    result += [F.coalesce(F.col(f"_cl_{o}"), F.col(f"_c0_{o}")).getField("v").alias(o) for o in carry]
    return joined.select(*result)


def tile(rank: Column, n: Column, k: int) -> Column:
    """The NTILE(k) bucket of row ``rank`` among ``n`` rows (longer buckets first)."""
    base = F.floor(n / k).cast("long")
    extra = (n % k).cast("long")
    split = extra * (base + 1)
    first = F.floor((rank - 1) / (base + 1))
    rest = extra + F.floor((rank - 1 - split) / F.greatest(base, F.lit(1)))
    return (F.when(rank <= split, first).otherwise(rest) + 1).cast("int")


def ntile_by(
    df: DataFrame, out: str, k: int, order_by: Sequence[str | Column], keys: Sequence[str] = ()
) -> DataFrame:
    ranked = running_totals(df, order_by, keys=keys, rank="_r", count="_n_rows")
    return ranked.withColumn(out, tile(F.col("_r"), F.col("_n_rows"), k)).drop("_r", "_n_rows")


def quantiles(
    df: DataFrame, value: str, probs: dict[str, float], keys: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Exact linearly interpolated quantiles per key, one column per entry of ``probs``.

    Equal values are counted before the sort, and only the two rows around each
    requested position are kept.
    """
    keys = list(keys)
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.cast("long").alias("__w"))
    ordered = running_totals(
        counts, [F.col(value)], keys=keys, sums={"__hi": "__w"}, totals={"__total": "__w"}, rank=None
    )
    ordered = ordered.withColumn("__lo", F.col("__hi") - F.col("__w"))
    v = F.col(value).cast("double")
    wanted = []
    for name, p in probs.items():
        position = F.lit(float(p)) * (F.col("__total") - 1)
        low = F.floor(position)
        high = F.ceil(position)
        covers = lambda at: (F.col("__lo") <= at) & (at < F.col("__hi"))
        wanted += [
            F.max(F.when(covers(low), v)).alias(f"_a_{name}"),
            F.max(F.when(covers(high), v)).alias(f"_b_{name}"),
            F.max(position - low).alias(f"_f_{name}"),
        ]
    picked = ordered.groupBy(*keys).agg(*wanted)
    return picked.select(
        *keys,
        *[
            (F.col(f"_a_{n_}") + (F.col(f"_b_{n_}") - F.col(f"_a_{n_}")) * F.col(f"_f_{n_}")).alias(n_)
            for n_ in probs
        ],
    )


# --- linear recurrence -------------------------------------------------------

#: Rows folded in one array by ``decayed_totals``.
CHUNK = 1024


def decayed_totals(df: DataFrame, order_by: Sequence[str | Column], value: str, out: str, decay: float, keys: Sequence[str] = ()) -> DataFrame:
    """Add a[t] = value[t] + decay * a[t-1] within ``keys`` in ``order_by``, a total order; a null value counts as zero.

    Rows are numbered over ranges and folded in chunks, each from zero.  What a chunk inherits follows from the last
    values of the chunks before it, so only one row per ``CHUNK`` rows of a key meets in one place.
    """
    decay, last = float(decay), lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0))
    placed = running_totals(df.withColumn("_x", or_zero(F.col(value).cast("double"))), order_by, keys=keys, rank="_place")
    row = F.struct("_place", "_x", F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    cut = placed.withColumn("_key", F.struct(*keys) if keys else F.lit(0)).withColumn("_chunk", F.floor((F.col("_place") - 1) / CHUNK).cast("int"))
    chunks = cut.groupBy("_key", "_chunk").agg(F.array_sort(F.collect_list(row), lambda a, b: (a["_place"] - b["_place"]).cast("int")).alias("_rows"))
    grow = lambda acc, r: F.concat(acc, F.array(r["_x"] + F.lit(decay) * last(acc)))
    folded = chunks.withColumn("_a", F.aggregate("_rows", F.array().cast("array<double>"), grow))
    ends = folded.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_chunk", F.element_at("_a", -1).alias("_end")))).alias("_ends"))
    # every chunk but the last of a key is full
    inherit = F.aggregate("_ends", F.array(F.lit(0.0)), lambda acc, e: F.concat(acc, F.array(e["_end"] + F.lit(decay**CHUNK) * last(acc))))
    starts = ends.select("_key", F.posexplode(inherit).alias("_chunk", "_start"))
    rows = folded.join(starts, ["_key", "_chunk"]).select(
        "_chunk", "_start", F.explode(F.arrays_zip(F.col("_rows").alias("r"), F.col("_a").alias("a"))).alias("z"))
    passed = F.col("z.r._place") - F.col("_chunk").cast("long") * CHUNK
    return rows.select("z.r._row.*", (F.col("z.a") + F.pow(F.lit(decay), passed) * F.col("_start")).alias(out))


# --- dominance counts --------------------------------------------------------

#: Ranges of either axis: the table between them has at most the square of it.
MOST_RANGES = 512


def _above(group: np.ndarray, y: np.ndarray, wanted: np.ndarray, weight: np.ndarray, left: np.ndarray, right: np.ndarray) -> int:
    """Sum over the ``right`` rows of ``wanted`` times the weight of ``left`` rows of their group with a larger ``y``."""
    wide = int(y.max(initial=0)) + 1
    order = np.argsort(group[left] * wide + y[left], kind="stable")
    key = (group[left] * wide + y[left])[order]
    upto = np.r_[0, np.cumsum(weight[left][order])]
    ends = np.searchsorted(key, (group[right] + 1) * wide)
    own = np.searchsorted(key, group[right] * wide + y[right], side="right")
    return int((wanted[right] * (upto[ends] - upto[own])).sum())


def _dominance_of(x: np.ndarray, y: np.ndarray, wanted: np.ndarray, weight: np.ndarray) -> tuple[int, int]:
    """Weighted pairs with a larger ``y`` and a smaller ``x``, and those with an equal ``x``.

    Two ranks of ``x`` part at one bit: for each bit, rows without it are compared with those that have it under the
    same higher bits.
    """
    x, y = np.unique(x, return_inverse=True)[1], np.unique(y, return_inverse=True)[1]
    every = np.ones(len(x), bool)
    below = sum(_above(x >> bit + 1, y, wanted, weight, x >> bit & 1 == 0, x >> bit & 1 == 1) for bit in range(int(x.max(initial=0)).bit_length()))
    return below, _above(x, y, wanted, weight, every, every)


def _dominance_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if sum(b.num_rows for b in held):
        below, level = _dominance_of(*[c.to_numpy() for c in pa.Table.from_batches(held).columns])
        yield pa.record_batch([pa.array([below], pa.int64()), pa.array([level], pa.int64())], ["below", "level"])


def dominance(df: DataFrame, x: str, y: str, wanted: str, weight: str) -> tuple[int, int]:
    """Exact weighted pairs of rows (p, q) with y(q) > y(p): where x(q) < x(p), and where x(q) = x(p).

    A pair counts ``wanted`` of p times ``weight`` of q (whole numbers).  Equal rows are added up first.  Rows are range
    partitioned by x and counted within a range; pairs from different ranges are counted within ranges of y, with the
    range in place of x; what is left differs in both ranges and follows from a table with one row per pair of ranges.
    No task holds more than a range.
    """
    conf = df.sparkSession.conf
    parts = min(int(conf.get("spark.sql.shuffle.partitions")), MOST_RANGES)
    both = [F.sum("wanted").alias("wanted"), F.sum("weight").alias("weight")]
    rows = df.select(F.col(x).alias("x"), F.col(y).alias("y"), F.col(wanted).cast("bigint").alias("wanted"), F.col(weight).cast("bigint").alias("weight"))
    rows = rows.filter("x IS NOT NULL AND y IS NOT NULL").groupBy("x", "y").agg(*both)
    by_x = materialize(rows.repartitionByRange(parts, "x").withColumn("part", F.spark_partition_id().cast("bigint")))
    by_y = materialize(by_x.groupBy("part", "y").agg(*both).repartitionByRange(parts, "y").withColumn("block", F.spark_partition_id().cast("bigint")))
    count = lambda d, axis: d.select(axis, "y", "wanted", "weight").mapInArrow(_dominance_batches, "below bigint, level bigint").agg(
        *[F.coalesce(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(0)).alias(c) for c in ("below", "level")]).first()
    inside, across = count(by_x, "x"), count(by_y, "part")
    far = by_y.groupBy("part", "block").agg(*both).collect()  # at most MOST_RANGES squared
    between = _dominance_of(*[np.array([r[c] for r in far], np.int64) for c in ("part", "block", "wanted", "weight")])[0]
    return int(inside["below"]) + int(across["below"]) + between, int(inside["level"])
