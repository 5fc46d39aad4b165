"""Pairs of rows that share a column of a sparse table, without shuffling the pairs.

Joining a table with itself on the column and grouping by pair shuffles every pair.  Here the rows are dealt over
blocks; a block receives the columns that one of its rows holds, each once, as packed arrays, and forms the pairs of
its rows in small batches.  All pairs of a row come up in one task, so what a query wants of them (the best n, those
above a threshold) is taken there.  What travels is a copy of the table for each block, not its pairs.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions.exprs import n_rows
from marketloom.functions.shared import scratch_table

#: Entries of the table that a task holds at most, as far as columns are not held by most rows.
BLOCK_ENTRIES = 40_000_000
#: Pairs formed at once in a task.
BATCH_PAIRS = 2_000_000
_SEND = 2_000_000  # entries a sender keeps back, over all blocks
_MESSAGES = "block int, stat boolean, lists int, entries int, payload binary"

#: (a, b, shared, stat of a, stat of b) -> columns to return; all pairs of a row come in one call, sorted by a and b
Finish = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]


def release(df: DataFrame) -> None:
    """Shuffle files whose frames nobody holds go when both collectors have run."""
    gc.collect()
    df.sparkSession._jvm.System.gc()


def _deflate(parts: list[np.ndarray]) -> bytes:
    """Arrays in the narrowest type that holds them, byte by byte, compressed."""
    out = []
    for x in parts:
        if x.dtype == np.float64 and x.size and x.min() >= 0 and x.max() < 65536 and (x == np.floor(x)).all():
            x = x.astype(np.uint16)
        elif x.dtype == np.int64:
            low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
            x = x.astype(np.uint16 if low >= 0 and high < 1 << 16 else np.uint32 if low >= 0 and high < 1 << 32 else np.int64)
        out.append((x.dtype.str.encode().ljust(4), np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()))
    raw = b"".join(kind + body for kind, body in out)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _inflate(payload: bytes, sizes: list[int]) -> list[np.ndarray]:
    raw = pa.decompress(payload[8:], int.from_bytes(payload[:8], "little"), "zstd", asbytes=True)
    at, out = 0, []
    for n in sizes:
        kind = np.dtype(raw[at:at + 4].decode().strip())
        end = at + 4 + n * kind.itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw[at + 4:end], np.uint8).reshape(kind.itemsize, n).T).view(kind).reshape(-1))
        at = end
    return out


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start .. start + length - 1 of each span, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def block_of(ids: np.ndarray, blocks: int) -> np.ndarray:
    x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64) % blocks


def _row(block: int, stat: bool, lists: int, entries: int, payload: bytes) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array([block], pa.int32()), pa.array([stat]), pa.array([lists], pa.int32()), pa.array([entries], pa.int32()), pa.array([payload], pa.binary())], ["block", "stat", "lists", "entries", "payload"])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(lengths, rows, values, names) of whole columns from batches in order of column and row."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        key = table.column("c").combine_chunks()
        change = np.flatnonzero(pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)) + 1
        if held and held[-1].column("c")[-1] != table.column("c")[0]:
            change = np.r_[0, change]
        if not len(change):
            held.append(table)
            continue
        yield _cut(pa.concat_tables([*held, table.slice(0, int(change[-1]))]))
        held = [table.slice(int(change[-1]))]
    if held:
        yield _cut(pa.concat_tables(held))


def _cut(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    key = table.column("c").combine_chunks()
    n = table.num_rows
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    change = np.flatnonzero(pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)) + 1
    first = np.r_[0, change]
    names = key.take(pa.array(first)).to_numpy(zero_copy_only=False).astype(np.int64) if pa.types.is_integer(key.type) else np.zeros(len(first), np.int64)
    return np.diff(np.r_[first, n]), table.column("r").to_numpy().astype(np.int64), table.column("v").to_numpy().astype(float), names


def _send_lists(blocks: int, wide: bool, named: bool):
    """Each list to the blocks of its rows, or to all; with the number of its column, if it is ``named``."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(4096, _SEND // blocks)
        kept: list[list] = [[] for _ in range(blocks)]
        count = [0] * blocks

        def flush(k: int) -> pa.RecordBatch:
            lengths, rows, values, names = (np.concatenate(x) for x in zip(*kept[k]))
            first = np.zeros(len(rows), bool)
            first[np.cumsum(lengths) - lengths] = True
            step = np.where(first, rows, rows - np.r_[0, rows[:-1]])
            kept[k], count[k] = [], 0
            return _row(k, False, len(lengths), len(rows), _deflate([lengths.astype(np.int64), step, values, *([names] if named else [])]))

        for lengths, rows, values, names in _lists(batches):
            if not len(lengths):
                continue
            starts = np.cumsum(lengths) - lengths
            if wide:
                wanted = [(k, np.arange(len(lengths))) for k in range(blocks)]
            else:
                meets = np.unique(block_of(rows, blocks) * len(lengths) + np.repeat(np.arange(len(lengths)), lengths))
                edges = np.searchsorted(meets, np.arange(blocks + 1) * len(lengths))
                wanted = [(k, meets[edges[k]:edges[k + 1]] - k * len(lengths)) for k in range(blocks) if edges[k] < edges[k + 1]]
            for k, which in wanted:
                at = _spans(starts[which], lengths[which])
                kept[k].append((lengths[which], rows[at], values[at], names[which]))
                count[k] += len(at)
                if count[k] >= most:
                    yield flush(k)
        for k in range(blocks):
            if kept[k]:
                yield flush(k)

    return send


def _send_stats(blocks: int):
    """The statistic of every row to all blocks."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, stat = batch.column("r").to_numpy().astype(np.int64), batch.column("stat").to_numpy().astype(float)
                order = np.argsort(ids)
                payload = _deflate([np.r_[ids[order][:1], np.diff(ids[order])], stat[order]])
                for k in range(blocks):
                    yield _row(k, True, 0, batch.num_rows, payload)

    return send


class Block:
    """The columns that reach a block: ``ptr`` cuts ``row`` (places in ``ids``) and ``value`` into lists, ``names`` numbers them."""

    def __init__(self, messages: list[tuple], named: bool = False):
        stats = [_inflate(m[3], [m[2], m[2]]) for m in messages if m[0]]
        ids = np.concatenate([np.cumsum(s[0].astype(np.int64)) for s in stats])
        order = np.argsort(ids)
        self.ids, self.stat = ids[order], np.concatenate([s[1].astype(float) for s in stats])[order]
        lists = [m for m in messages if not m[0]]
        total = sum(m[2] for m in lists)
        self.row, self.value = np.empty(total, np.int32), None
        lengths, names, at = [], [np.zeros(0, np.int64)], 0
        for _, n, entries, payload in lists:
            length, step, value, *name = _inflate(payload, [n, entries, entries, *([n] if named else [])])
            names += [x.astype(np.int64) for x in name]
            length = length.astype(np.int64)
            step = step.astype(np.int64)
            upto = np.cumsum(step)
            starts = np.cumsum(length) - length
            ids_here = upto - np.repeat(upto[starts] - step[starts], length)
            self.row[at:at + entries] = np.searchsorted(self.ids, ids_here)
            if self.value is None:
                self.value = np.empty(total, value.dtype)
            elif np.promote_types(self.value.dtype, value.dtype) != self.value.dtype:
                self.value = self.value.astype(float)
            self.value[at:at + entries] = value
            lengths.append(length)
            at += entries
        self.ptr = np.r_[0, np.cumsum(np.concatenate(lengths))] if lengths else np.zeros(1, np.int64)
        self.names = np.concatenate(names)
        if self.value is None:
            self.value = np.empty(0)

    def own(self, block: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the entries of the block's own rows in order of row, and their lists."""
        mine = np.flatnonzero((block_of(self.ids, blocks) == block)[self.row])
        mine = mine[np.argsort(self.row[mine], kind="stable")]
        return mine, np.searchsorted(self.ptr, mine, side="right") - 1


def batches_of(rows: np.ndarray, work: np.ndarray) -> Iterator[slice]:
    """Slices of sorted ``rows`` that keep a row together, each of at most ``BATCH_PAIRS`` work or one row."""
    if not len(rows):
        return
    edges = np.r_[0, np.flatnonzero(np.diff(rows)) + 1, len(rows)]
    upto = np.r_[0, np.cumsum(work)][edges]
    i = 0
    while i < len(edges) - 1:
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + BATCH_PAIRS, side="right")) - 1)
        yield slice(int(edges[i]), int(edges[j]))
        i = j


def _pairs(block: int, blocks: int, data: Block, weighted: bool, half: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, shared) as places in the ids, by batches of a."""
    mine, which = data.own(block, blocks)
    start = mine + 1 if half else data.ptr[which]
    length = data.ptr[which + 1] - start
    rows = data.row[mine].astype(np.int64)
    n = len(data.ids)
    for cut in batches_of(rows, length):
        a_ids, a_at = np.unique(rows[cut], return_inverse=True)
        if len(a_ids) == 1 and int(length[cut].sum()) > BATCH_PAIRS:  # a row of many pairs: added up by place, piece by piece
            total, met = np.zeros(n), np.zeros(n, bool)
            for at, s, m in zip(mine[cut], start[cut], length[cut]):
                other = data.row[s:s + m]
                met[other] = True
                np.add.at(total, other, data.value[at].astype(float) * data.value[s:s + m] if weighted else 1.0)
            met[a_ids[0]] = False
            b = np.flatnonzero(met)
            yield np.full(len(b), a_ids[0]), b, total[b]
            continue
        at = _spans(start[cut], length[cut])
        key = np.repeat(a_at * n, length[cut]) + data.row[at]
        if weighted:
            order = np.argsort(key)
            key = key[order]
            value = (np.repeat(data.value[mine[cut]].astype(float), length[cut]) * data.value[at])[order]
        else:
            key.sort()
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        shared = (np.add.reduceat(value, first) if weighted else np.diff(np.r_[first, len(key)]).astype(float)) if len(first) else np.zeros(0)
        a, b = a_ids[key[first] // n], key[first] % n
        keep = a != b
        yield a[keep], b[keep], shared[keep]


def collect_blocks(batches: Iterator[pa.RecordBatch], named: bool = False) -> Iterator[tuple[int, Block]]:
    """The blocks of a task, one after another; messages stay packed until the last has come."""
    messages: dict[int, list[tuple]] = {}
    for batch in batches:
        for r in batch.to_pylist():
            messages.setdefault(r["block"], []).append((r["stat"], r["lists"], r["entries"], r["payload"]))
    for block in sorted(messages):
        yield block, Block(messages.pop(block), named)


def enough_blocks(entries: int, columns: int, least: int) -> int:
    """So many blocks that each receives ``BLOCK_ENTRIES`` entries, for columns of average size; their copies grow with the blocks."""
    size, blocks = entries / max(1, columns), max(1, least)
    while blocks < 20_000 and entries * (1 - (1 - 1 / blocks) ** size) > BLOCK_ENTRIES:
        blocks += max(1, blocks // 8)
    return blocks


def dealt(df: DataFrame, row: str, column: str, value: str | None, stat: str, wide: bool = False, named: bool = False) -> tuple[DataFrame, int]:
    """Messages of the table, partitioned by block, and the number of blocks.

    ``stat`` is SQL over ``v``, the values of a row.  ``wide`` sends every column to every block, ``named`` with its number.
    """
    kinds = dict(df.dtypes)
    for name in (row, column) if named else (row,):
        if kinds[name] not in ("tinyint", "smallint", "int", "bigint"):
            raise TypeError(f"{name} must be a whole number, not {kinds[name]}")
    narrow = df.select(F.col(row).alias("r"), F.col(column).alias("c"), (F.col(value).cast("double") if value else F.lit(1.0)).alias("v")).filter("r IS NOT NULL AND c IS NOT NULL")
    table = scratch_table(narrow, "pairs", compression="zstd")
    release(df)
    spark = df.sparkSession
    n, columns = table.agg(n_rows(), F.approx_count_distinct("c")).first()
    blocks = enough_blocks(n, columns, spark.sparkContext.defaultParallelism)
    conf = spark.conf.get("spark.sql.shuffle.partitions")
    parts = int(conf) if conf.isdigit() else 200
    lists = table.repartition(parts, "c").sortWithinPartitions("c", "r").mapInArrow(_send_lists(blocks, wide, named), _MESSAGES)
    stats = table.groupBy("r").agg(F.expr(stat).cast("double").alias("stat")).mapInArrow(_send_stats(blocks), _MESSAGES)
    return lists.unionByName(stats).repartitionById(blocks, F.col("block")), blocks


def row_pairs(df: DataFrame, row: str, column: str, value: str | None, stat: str, finish: Finish, schema: str, half: bool = False) -> DataFrame:
    """``finish`` of all pairs of rows that share a column; ``half`` forms pairs with a < b only.

    ``shared`` is the sum over shared columns of the product of both values, or their number without ``value``.
    ``df`` has one line per row and column.
    """
    messages, blocks = dealt(df, row, column, value, stat)
    names = [item.strip().split(" ")[0] for item in schema.split(",")]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data in collect_blocks(batches):
            for a, b, shared in _pairs(block, blocks, data, value is not None, half):
                out = finish(data.ids[a], data.ids[b], shared, data.stat[a], data.stat[b])
                for at in range(0, len(out[0]), 100_000):
                    yield pa.record_batch([pa.array(x[at:at + 100_000]) for x in out], names)

    return messages.mapInArrow(pairs, schema)


class Bag:
    """Sums by place, emptied in the time it took to fill."""

    def __init__(self, n: int):
        self.sums, self.mark = np.zeros(n), np.full(n, -1, np.int64)
        self.places: list[np.ndarray] = []

    def add(self, places: np.ndarray, values: np.ndarray | float) -> None:
        np.add.at(self.sums, places, values)
        self.mark[places] = np.arange(len(places))  # one of the equal places keeps its mark
        once = places[self.mark[places] == np.arange(len(places))]
        self.mark[once] = -1
        self.places.append(once)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """The places added to, each once, and their sums."""
        places = self.places[0] if len(self.places) == 1 else np.unique(np.concatenate(self.places)) if self.places else np.zeros(0, np.int64)
        sums = self.sums[places]
        self.sums[places] = 0.0
        self.places = []
        return places, sums


def by_neighbours(df: DataFrame, user: str, item: str, n: int, digits: int) -> DataFrame:
    """For each user the items it lacks by the number of other users that hold them and share an item with it: ``user``, ``item``, ``score``.

    Among them are the ``n`` best of each user, ties to the smaller item.  A user's neighbours hold most of the table,
    so every block receives all of it, packed; users are counted one at a time, and neither neighbours nor scores leave the task.
    """
    messages, blocks = dealt(df, item, user, None, "count(1)", wide=True, named=True)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data in collect_blocks(batches, named=True):
            out: list[tuple] = []
            for one in _scored(block, blocks, data, n, digits):
                out.append(one)
                if len(out) == 5000:
                    yield _scores(out)
                    out = []
            if out:
                yield _scores(out)

    return messages.mapInArrow(scores, "user bigint, item bigint, score double")


def _scores(out: list[tuple]) -> pa.RecordBatch:
    users = np.repeat(np.array([o[0] for o in out], np.int64), [len(o[1]) for o in out])
    return pa.record_batch([pa.array(users), pa.array(np.concatenate([o[1] for o in out])), pa.array(np.concatenate([o[2] for o in out]))], ["user", "item", "score"])


def _scored(block: int, blocks: int, data: Block, n: int, digits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(user, items, scores) of the block's users; lists are the users' items here."""
    start, length = data.ptr[:-1], np.diff(data.ptr)
    turned = np.argsort(data.row, kind="stable").astype(np.int32 if len(data.row) < 1 << 31 else np.int64)
    holder = np.repeat(np.arange(len(length), dtype=np.int32), length)[turned]
    ptr = np.r_[0, np.cumsum(np.bincount(data.row, minlength=len(data.ids)))]
    del turned
    near, found = Bag(len(length)), Bag(len(data.ids))
    for u in np.flatnonzero(block_of(data.names, blocks) == block):
        own = data.row[start[u]:start[u] + length[u]]
        for cut in _pieces(ptr[own + 1] - ptr[own]):
            near.add(holder[_spans(ptr[own[cut]], ptr[own[cut] + 1] - ptr[own[cut]])], 1.0)
        others, _ = near.take()
        others = others[others != u]
        for cut in _pieces(length[others]):
            found.add(data.row[_spans(start[others[cut]], length[others[cut]])], 1.0)
        items, score = found.take()
        keep = ~np.isin(items, own)
        items, score = items[keep], score[keep]
        if len(items) > 4 * n:  # what scores below the n-th cannot come among them
            keep = score >= np.partition(score, len(score) - n)[len(score) - n] - 2.0 * 10.0**-digits
            items, score = items[keep], score[keep]
        keep = best_of(np.zeros(len(items), np.int64), items, score, n, digits)
        if len(keep):
            yield int(data.names[u]), data.ids[items[keep]], score[keep]


def _pieces(work: np.ndarray) -> Iterator[slice]:
    """Slices of at most ``BATCH_PAIRS`` work, or of one element."""
    upto = np.r_[0, np.cumsum(work)]
    i = 0
    while i < len(work):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + BATCH_PAIRS, side="right")) - 1)
        yield slice(i, j)
        i = j


def best_of(a: np.ndarray, b: np.ndarray, score: np.ndarray, n: int, digits: int) -> np.ndarray:
    """Places among which are the ``n`` best of each ``a`` by rounded score, ties to the smaller ``b``; ``a`` comes sorted.

    A score within a hair of a rounding tie may round either way and is kept where it can matter.
    """
    if not len(a):
        return np.zeros(0, np.int64)
    scaled = score * 10.0**digits
    rounded = np.round(scaled)
    # the least of the maxima of n parts of a row's pairs is no more than its n-th best: what is below is not sorted
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    size = np.diff(np.r_[first, len(a)])
    parts = np.minimum(n, size)
    which = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    tops = np.maximum.reduceat(rounded, np.repeat(first, parts) + which * np.repeat(size, parts) // np.repeat(parts, parts))
    floor = np.minimum.reduceat(tops, np.cumsum(parts) - parts)
    chosen = np.flatnonzero(rounded >= np.repeat(floor, size) - 1)
    a, b, scaled, rounded = a[chosen], b[chosen], scaled[chosen], rounded[chosen]
    order = np.lexsort((b, -rounded, a))
    first = np.flatnonzero(np.r_[True, a[order][1:] != a[order][:-1]])
    size = np.diff(np.r_[first, len(a)])
    place = np.arange(len(a)) - np.repeat(first, size)
    floor = np.repeat(rounded[order[first + np.minimum(n, size) - 1]], size)
    unsure = np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3
    return chosen[order[(place < n) | (unsure[order] & (rounded[order] >= floor - 1))]]
