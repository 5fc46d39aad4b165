"""Repeated passages: seeds from winnowed anchors, extended to maximal repeats.

A window is ``WINDOW`` consecutive words.  In every window the run of ``GRAM`` words with
the smallest hash is its anchor, so equal windows have equal anchors at equal places.
Consecutive windows with one anchor make a span: the anchor with all words that its
windows reach to both sides.

1. Documents are joined on anchors.  Where the whole spans agree too, every occurrence but
   the first repeats all its windows.
2. Anchors with several different spans are extended word by word: the windows of the
   first occurrence of each span are compared on their own.
3. Repeated windows of a document are united to maximal passages.

Equal spans of one batch are folded before the shuffle: only the first goes to the others
of its anchor, so a passage that every document has costs a row per batch.  Rows of an
anchor pass a task as a sorted stream; nothing is gathered.

Hashes have 64 bits each; spans are compared together with their anchor, windows with a
second hash.  Words are byte runs without the six ASCII white-space bytes.

Edge cases: a null text has no words; a null doc_id comes after all others; rows that
repeat a doc_id and text are the same document and do not repeat each other; rows with one
doc_id and different texts are compared by their starts; texts shorter than a window stay
as they are; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from marketloom.functions.shared import scratch_table
from marketloom.llm.batches import encoded, runs, split_batches

WINDOW = 20
GRAM = 8
#: Stands for a null doc_id.
LAST = (1 << 63) - 1
_PIECE = 1 << 20
_BYTE, _WORD, _OTHER = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA0761D6478BD642F


# --- hashes ------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class _Powers:
    """Powers of an odd number modulo 2^64, and of its inverse."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            power = lambda b: np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)], dtype=np.uint64)
            self.up, self.down = power(self.base), power(self.inverse)
        return self.up, self.down


@lru_cache
def _powers(base: int) -> _Powers:
    return _Powers(base)


@lru_cache
def _byte_tables() -> tuple[np.ndarray, np.ndarray, bytes]:
    values = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BYTE))
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return values, space, bytes(32 if s else b for b, s in enumerate(space))


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of each range of ``values`` that depends on what is in it, not on where it is."""
    up, down = _powers(base).get(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * down[starts])


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in pieces so that long texts need no more memory."""
    values, space, spaced = _byte_tables()
    if len(text) > _PIECE:
        out, at, flat = [], 0, text.translate(spaced)
        while at < len(flat):
            end = at + _PIECE
            cut = len(flat) if end >= len(flat) else flat.rfind(b" ", at, end)
            if cut < 0:  # a word of a mebibyte or more
                cut = flat.find(b" ", end)
                cut = len(flat) if cut < 0 else cut
                out.append(np.array([xxhash.xxh64_intdigest(text[at:cut])], np.uint64))
            else:
                out.append(word_hashes(text[at:min(cut + 1, len(flat))][:_PIECE]))
            at = cut + 1
        return np.concatenate(out)
    raw = np.frombuffer(text, np.uint8)
    inside = np.r_[False, ~space[raw], False]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return _ranges(values[raw], edges[::2], edges[1::2], _BYTE)


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for j in range(size):
        out = out * np.uint64(_OTHER) + words[j:j + len(out)]
    return _mix(out)


def anchors(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of the words of several documents: row of ``doc``, first window, windows, anchor and span hash.

    ``doc`` tells the document of each word; first windows count within ``words``.
    """
    none = np.zeros(0, np.int64)
    if len(words) < WINDOW:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    grams = _grams(words, GRAM)
    places = WINDOW - GRAM + 1
    owner = np.lib.stride_tricks.sliding_window_view(grams, places).argmin(axis=1) + np.arange(len(words) - WINDOW + 1)
    whole = np.flatnonzero(doc[:len(owner)] == doc[WINDOW - 1:])
    if not len(whole):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    at = runs(owner[whole], doc[whole])
    first, count = whole[at[:-1]], np.diff(at)
    spans = _ranges(words, first, first + count - 1 + WINDOW, _WORD)
    return doc[first], first, count, grams[owner[first]], _mix(spans + count.astype(np.uint64))


# --- tasks -------------------------------------------------------------------


def _words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, the text of each, and the number of words before each text."""
    found = [word_hashes(t) for t in texts]
    n = np.array([len(f) for f in found], np.int64)
    words = np.concatenate(found) if found else np.zeros(0, np.uint64)
    return words, np.repeat(np.arange(len(found)), n), np.cumsum(n) - n


def _numbers(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, LAST).to_numpy(zero_copy_only=False)


def _first_of(*keys: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys, document and start; and which rows, so ordered, are the first of their keys (or equal it)."""
    order = np.lexsort((start, doc, *reversed(keys)))
    at = runs(*[k[order] for k in keys])
    lead = np.repeat(at[:-1], np.diff(at))
    d, s = doc[order], start[order]
    return order, (d == d[lead]) & (s == s[lead])


def _hashes(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return batch.column(column).to_numpy(zero_copy_only=False)


def _salt(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    return _mix(doc.astype(np.uint64) * np.uint64(_WORD) + start.astype(np.uint64))


def _anchor_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in split_batches(batches, "text"):
        docs, h1, h2 = _numbers(part.column(0)), _hashes(part, 1), _hashes(part, 2)
        words, of, before = _words_of(encoded(part.column(3)))
        row, first, count, anchor, span = anchors(words, of)
        if not len(row):
            continue
        start = first - before[row]
        order, lead = _first_of(anchor, span, doc=docs[row], start=start)
        row, start, count, anchor, span = row[order], start[order], count[order], anchor[order], span[order]
        # known repeats need no comparison: they are dealt anywhere
        key = np.where(lead, anchor, _salt(docs[row], start))
        yield pa.record_batch([
            pa.array(key.view(np.int64)), pa.array(span.view(np.int64)), pa.array(docs[row]), pa.array(h1[row]), pa.array(h2[row]),
            pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(~lead)], ["key", "span", "doc", "h1", "h2", "start", "n", "known"])


_MARK = ["doc", "h1", "h2", "start", "n", "repeated"]


def _marks(doc, h1, h2, start, n, repeated) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c) for c in (doc, h1, h2, start, n, repeated)], _MARK)


def _compare_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, span, document and start: mark repeats and what is left to extend.

    The last row that leads a span is carried into the next batch; a first span is
    held back until the anchor shows another one.
    """
    held = None  # leading rows of the last span; all of them until another span of the anchor comes
    several = False  # the anchor of ``held`` has shown several spans, and ``held`` is already marked
    for b in batches:
        known = b.column(7).to_numpy(zero_copy_only=False)
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns[:7]]
        if known.any():
            yield _marks(*[c[known] for c in cols[2:]], np.ones(int(known.sum()), bool))
            cols = [c[~known] for c in cols]
        if not len(cols[0]):
            continue
        n_held = 0 if held is None else len(held[0])
        if n_held:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
        key, span, doc, _, _, start, n = cols
        at = runs(key, span)
        lead_at = np.repeat(at[:-1], np.diff(at))
        lead = (doc == doc[lead_at]) & (start == start[lead_at])
        group = runs(key)
        spans_in = np.searchsorted(at, group[1:]) - np.searchsorted(at, group[:-1])
        multi = np.repeat(spans_in > 1, np.diff(group))
        if n_held and several:
            multi[:group[1]] = True
        fresh = np.ones(len(key), bool)
        fresh[:n_held] = False
        yield _marks(*[c[~lead] for c in cols[2:]], np.ones(int((~lead).sum()), bool))
        last = at[-2]
        final = np.zeros(len(key), bool)
        final[last:] = lead[last:]
        was_marked = ~fresh & several
        out = lead & multi & ~was_marked
        if out.any():
            yield _marks(*[c[out] for c in cols[2:]], np.zeros(int(out.sum()), bool))
        several = bool(multi[-1])
        held = [c[final] for c in cols]


def _window_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the marked spans; of those that are equal in a batch only the first is still to compare."""
    for part in split_batches(batches, "text"):
        part = part.filter(pc.is_valid(part.column(4)))
        if not part.num_rows:
            continue
        docs, h1, h2 = _numbers(part.column(0)), _hashes(part, 1), _hashes(part, 2)
        words, _, before = _words_of(encoded(part.column(3)))
        marks = part.column(4)
        flat = marks.flatten()
        row = np.repeat(np.arange(part.num_rows), np.diff(marks.offsets.to_numpy()))
        first, n = flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64), flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        row = np.repeat(row, n)
        at = start + before[row]
        one, two = _ranges(words, at, at + WINDOW, _WORD), _ranges(words, at, at + WINDOW, _OTHER)
        order, lead = _first_of(one, two, doc=docs[row], start=start)
        row, start, one, two = row[order], start[order], one[order], two[order]
        key = np.where(lead, one, _salt(docs[row], start))
        yield pa.record_batch([
            pa.array(key.view(np.int64)), pa.array((two >> np.uint64(33)).astype(np.int32)), pa.array(docs[row]), pa.array(h1[row]), pa.array(h2[row]),
            pa.array(start.astype(np.int32)), pa.array(~lead)], ["key", "more", "doc", "h1", "h2", "start", "known"])


def _later_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows sorted by hash, document and start: all but the first of each hash repeat it."""
    held = None
    for b in batches:
        known = b.column(6).to_numpy(zero_copy_only=False)
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns[:6]]
        one = lambda c: np.ones(len(c), np.int32)
        if known.any():
            doc, h1, h2, start = (c[known] for c in cols[2:])
            yield _marks(doc, h1, h2, start, one(doc), np.ones(len(doc), bool))
            cols = [c[~known] for c in cols]
        if not len(cols[0]):
            continue
        if held is not None:
            cols = [np.r_[h, c] for h, c in zip(held, cols)]
        key, more, doc, h1, h2, start = cols
        at = runs(key, more)
        lead_at = np.repeat(at[:-1], np.diff(at))
        later = (doc != doc[lead_at]) | (start != start[lead_at])
        if later.any():
            yield _marks(doc[later], h1[later], h2[later], start[later], one(doc[later]), np.ones(int(later.sum()), bool))
        held = [c[at[-2]:at[-2] + 1] for c in cols]


def _without(text: bytes, marks: list[dict] | None) -> tuple[int, list[bytes], list[tuple[int, int]]]:
    """Number of words, the words outside the marked windows, and the passages taken out."""
    words = text.split()
    out = passages(np.array([(m["start"], m["start"] + m["n"] - 1 + WINDOW) for m in marks or []], np.int64).reshape(-1, 2))
    keep, at = [], 0
    for a, b in out:
        keep += words[at:a]
        at = b
    return len(words), keep + words[at:] if out else words, out


def _cut_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in split_batches(batches, "text"):
        found = [_without(t, m) for t, m in zip(encoded(part.column(3)), part.column(4).to_pylist())]
        spans = [[{"start": a, "end": b} for a, b in out] for _, _, out in found]
        yield pa.record_batch([
            part.column(0), pa.array([n for n, _, _ in found], pa.int64()), pa.array([n - len(k) for n, k, _ in found], pa.int64()),
            pa.array([b" ".join(k) for _, k, _ in found], pa.binary()).cast(pa.string()),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "n_words", "n_removed", "kept", "spans"])


def _clean_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with something to remove become their kept words; the others stay as they are."""
    for part in split_batches(batches, "text"):
        old, new = part.column(3).to_pylist(), []
        for text, marks in zip(old, part.column(4).to_pylist()):
            new.append(b" ".join(_without(text.encode(), marks)[1]).decode() if marks else text)
        yield pa.record_batch([pa.array(new, pa.string()), pa.array([bool(m) for m in part.column(4).to_pylist()]), part.column(5)], ["text", "changed", "rest"])


def passages(ranges: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping and touching ranges united."""
    if not len(ranges):
        return []
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1])
    start = np.r_[0, np.flatnonzero(ranges[1:, 0] > reach[:-1]) + 1]
    return list(zip(ranges[start, 0].tolist(), np.maximum.reduceat(ranges[:, 1], start).tolist()))


# --- operator ----------------------------------------------------------------


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """Rows named by doc_id and two hashes of the text: texts under one doc_id, or without one, are told apart."""
    text = F.col("text").cast("string")
    known = F.coalesce(text, F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_doc"), F.xxhash64(known).alias("_h1"), F.xxhash64(F.lit(1), known).alias("_h2"), text.alias("text"), *more)


def _with_marks(docs: DataFrame, marks: DataFrame, *more: Column) -> DataFrame:
    """Documents with the marks of each as an array; the small side is the one that is built."""
    per = marks.groupBy("doc", "h1", "h2").agg(F.collect_list(F.struct("start", "n")).alias("marks"))
    same = (F.col("_doc") == per["doc"]) & (F.col("_h1") == per["h1"]) & (F.col("_h2") == per["h2"])
    joined = _keyed(docs, *more).join(per.hint("shuffle_hash"), same, "left")
    return joined.drop("doc", "h1", "h2").select("_doc", "_h1", "_h2", "text", "marks", *joined.columns[4:4 + len(more)])


def _shuffled(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), order[0]).sortWithinPartitions(*order)


def repeats(docs: DataFrame) -> DataFrame:
    """Runs of repeated windows: doc, two hashes of the text, start and number of windows.

    The comparison of anchors is written to the shared folder: two later steps read it.
    """
    mark = "doc bigint, h1 bigint, h2 bigint, start int, n int, repeated boolean"
    found = _keyed(docs).mapInArrow(_anchor_batches, "key bigint, span bigint, doc bigint, h1 bigint, h2 bigint, start int, n int, known boolean")
    marks = scratch_table(_shuffled(found, "key", "span", "doc", "start").mapInArrow(_compare_batches, mark), "repeats")
    open_ = _with_marks(docs, marks.filter("NOT repeated"))
    windows = open_.mapInArrow(_window_batches, "key bigint, more int, doc bigint, h1 bigint, h2 bigint, start int, known boolean")
    later = _shuffled(windows, "key", "more", "doc", "start").mapInArrow(_later_batches, mark)
    return marks.filter("repeated").unionByName(later).select("doc", "h1", "h2", "start", "n")


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, ``kept`` (the kept words joined by a space) and the removed ``spans`` of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = _with_marks(docs, repeats(docs))
    ids = F.when(F.col("_doc") != LAST, F.col("_doc")).cast(kind)
    schema = f"doc_id {kind}, n_words bigint, n_removed bigint, kept string, spans array<struct<start: bigint, end: bigint>>"
    return rows.select(ids.alias("doc_id"), "_h1", "_h2", "text", "marks").mapInArrow(_cut_batches, schema)


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``; the other columns stay, ``n_chars`` is counted anew.

    A text that loses words becomes its kept words, joined by a space; all others keep
    their white space.
    """
    rest = [c for c in docs.columns if c != "text"]
    rows = _with_marks(docs, repeats(docs), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"))
    kind = rows.schema["rest"].dataType
    schema = StructType([StructField("text", StringType()), StructField("changed", BooleanType()), StructField("rest", kind)])
    out = rows.select("_doc", "_h1", "_h2", "text", "marks", "rest").mapInArrow(_clean_batches, schema)

    def column(name: str) -> Column:
        if name == "text":
            return F.col("text")
        old = F.col("rest").getField(name)
        if name == "n_chars":
            return F.when(F.col("changed"), F.length("text").cast(docs.schema[name].dataType)).otherwise(old).alias(name)
        return old.alias(name)

    return out.select(*[column(c) for c in docs.columns])
