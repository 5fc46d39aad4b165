"""Best-fit packing of documents into sequences of bounded length.

A piece of a document is a vector: its tokens, one document, and its attention cost (its
length squared).  A sequence has a capacity for each.  Pieces of one length have one
vector, so the plan is made on the histogram of lengths, which has at most as many rows as
a sequence has tokens, whatever the number of documents: longest pieces first, each goes
to the open sequence that scores best among those with room in every dimension.  Equal
sequences are kept as one row with a count.  Spark numbers the pieces of each length and
looks their places up in the plan.

Edge cases: a null text is the empty text and packs as its end mark alone; equal rows
are packed each; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions.shared import materialize
from marketloom.llm.batches import split_batches, texts_of
from marketloom.llm.bpe import MEMO_CHUNKS, json_encoder

#: Rows of one length are numbered in so many independent buckets per shuffle partition.
NUMBERING_BUCKETS = 4


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds; ``None`` leaves a dimension without a bound of its own."""

    tokens: int = 1024
    documents: int | None = None
    attention: int | None = None

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens ** 2], float)


def _piece_batches(batches: Iterable[pa.RecordBatch], path: str, end_id: int, tokens: int, chunks: int) -> Iterator[pa.RecordBatch]:
    encoder = json_encoder(path, chunks)
    end = np.array([end_id], "<u4").tobytes()
    for part in split_batches(batches, "text"):
        row, piece, start, length, crc = [], [], [], [], []
        for r, ids in enumerate(encoder.encode(texts_of(part.column(1)))):
            ids += end
            n = len(ids) // 4
            cuts = [0, *range((n - 1) % tokens + 1, n + 1, tokens)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                row.append(r), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(ids[4 * a:4 * b]))
        yield pa.record_batch([
            part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
            pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, tokens: int = 1024, chunks: int = MEMO_CHUNKS) -> DataFrame:
    """The pieces of each document: ids of its text and the end mark, cut where they exceed ``tokens``.

    All pieces but the first are full.  ``chunks`` bounds the table of known chunks of a worker (about 200 bytes each).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _piece_batches(it, tokenizer, end_id, tokens, chunks), schema)


def plan(histogram: dict[int, int], capacity: Capacity, weights: tuple[float, float, float] = (1.0, 0.0, 0.0), score: str = "norm") -> list[tuple[int, int, int, int, int]]:
    """Places for all pieces of a histogram of lengths.

    Returns rows (length, first, count, sequence, offset): pieces ``first`` ..
    ``first + count - 1`` of that length go to as many consecutive sequences from
    ``sequence`` on, each at ``offset``.  ``score`` chooses among the open sequences with
    room in every dimension: ``norm`` takes the smallest weighted norm of what is left,
    ``dot`` the largest weighted product of the piece and the room.  All capacities are
    scaled to one.
    """
    cap = capacity.vector()
    weight = np.asarray(weights, float)
    # open groups of equal sequences: room left (scaled), first sequence, number of sequences, tokens used
    room = np.empty((0, 3))
    first = np.empty(0, np.int64)
    many = np.empty(0, np.int64)
    used = np.empty(0, np.int64)
    out, opened = [], 0
    for length in sorted(histogram, reverse=True):
        item = np.array([length, 1, length * length]) / cap
        if (item > 1 + 1e-12).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        left, done = histogram[length], 0
        fits = (room >= item - 1e-12).all(axis=1)
        value = lambda rest: float((weight * (rest - item) ** 2).sum() if score == "norm" else -(weight * rest * item).sum())
        pool = [(value(room[g]), int(first[g]), g, room[g], int(many[g]), int(used[g])) for g in np.flatnonzero(fits)]
        heapq.heapify(pool)
        new: list[tuple[np.ndarray, int, int, int]] = []
        gone: list[int] = []
        while left:
            if pool:
                _, seq, g, state, n, at = heapq.heappop(pool)
                gone += [g] if g >= 0 else []
            else:
                g, state, seq, at, n = -2, np.ones(3), opened, 0, left
            # by the norm, a sequence that has taken a piece fits this length better than before and goes on;
            # by the product it goes back to the others; a new one is filled, as it opens only if no other has room
            depth = 1
            while (score == "norm" or g == -2) and (state - (depth + 1) * item >= -1e-12).all():
                depth += 1
            whole = min(n, left // depth)
            for k in range(depth if whole else 0):
                out.append((length, done + k * whole, whole, seq, at + k * length))
            done, left = done + whole * depth, left - whole * depth
            filled = [(state - depth * item, seq, whole, at + depth * length)] if whole else []
            part = left if whole < n and left < depth else 0
            for k in range(part):
                out.append((length, done + k, 1, seq + whole, at + k * length))
            done, left = done + part, left - part
            filled += [(state - part * item, seq + whole, 1, at + part * length)] if part else []
            touched = whole + bool(part)
            if g == -2:
                opened += touched
            elif touched < n:
                filled.append((state, seq + touched, n - touched, at))
            for rest, at_seq, count, tokens in filled:
                if g != -2 and score == "dot" and left and (rest >= item - 1e-12).all():
                    heapq.heappush(pool, (value(rest), at_seq, -1, rest, count, tokens))
                else:
                    new.append((rest, at_seq, count, tokens))
        new += [(rest, seq, count, tokens) for _, seq, g, rest, count, tokens in pool if g == -1]
        keep = np.ones(len(room), bool)
        keep[gone] = False
        room = np.vstack([room[keep], *[x[0][None] for x in new]])
        first = np.r_[first[keep], [x[1] for x in new]].astype(np.int64)
        many = np.r_[many[keep], [x[2] for x in new]].astype(np.int64)
        used = np.r_[used[keep], [x[3] for x in new]].astype(np.int64)
        smallest = np.array([1, 1, 1]) / cap
        alive = (room >= smallest - 1e-12).all(axis=1)
        room, first, many, used = room[alive], first[alive], many[alive], used[alive]
    return out


def numbered(df: DataFrame, key: str, order: list[str], out: str) -> DataFrame:
    """Number the rows of each ``key`` from 0 without sorting one key in one task.

    Rows are dealt to buckets by a hash of all columns, buckets are numbered on their
    own, and a table with a row per key and bucket has what lies before each.  Rows that
    are equal in every column may swap numbers, which changes no result.
    """
    width = NUMBERING_BUCKETS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(width)).cast("int"))
    counts = dealt.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(W.partitionBy(key).orderBy("_bucket")) - F.col("_n")).drop("_n")
    local = dealt.withColumn("_local", F.row_number().over(W.partitionBy(key, "_bucket").orderBy(*order)))
    return local.join(before, [key, "_bucket"]).withColumn(out, F.col("_before") + F.col("_local") - 1).drop("_bucket", "_local", "_before")


def pack(parts: DataFrame, capacity: Capacity = Capacity(), weights: tuple[float, float, float] = (1.0, 0.0, 0.0), score: str = "norm") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces that have a ``length``.

    Full pieces are sequences of their own and take their numbers after the planned ones.
    """
    parts = materialize(parts)  # tokens are counted once, and a lost executor cannot change a piece
    columns = parts.columns
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = plan(histogram, capacity, weights, score)
    spark = parts.sparkSession
    schema = "length bigint, first bigint, many bigint, sequence bigint, at bigint"
    places = spark.createDataFrame([tuple(map(int, r)) for r in rows], schema) if rows else spark.createDataFrame([], schema)
    # one row of the plan per length, its runs in an array: the lookup is an equal join on a bounded table
    runs = places.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "many", "sequence", "at"))).alias("_runs"))
    ranked = numbered(parts, "length", columns, "_rank").join(F.broadcast(runs), "length")
    run = F.filter("_runs", lambda r: (r["first"] <= F.col("_rank")) & (F.col("_rank") < r["first"] + r["many"]))[0]
    return ranked.withColumn("_run", run).select(
        *columns, (F.col("_run.sequence") + F.col("_rank") - F.col("_run.first")).alias("sequence_id"), F.col("_run.at").alias("offset"))
