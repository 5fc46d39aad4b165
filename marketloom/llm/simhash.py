"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into three segments.  Two fingerprints that differ in two
bits at most agree in at least one segment (pigeonhole), and in the next segment differ by
two bits at most.  That next segment is decoded with the perfect (23, 12) Golay code: its
keys are the codewords within four bits, one or six of them.  Words at distance two or
less always share a key: a word half way between them is at most one bit from each, and
its codeword at most three bits further.  The agreeing segment and a shared codeword
index make the join key; candidates are then verified.

Equal fingerprints are one class.  Keys shared by many classes form no pairs: there,
fingerprints meet at every value one bit away (two fingerprints are within two bits
exactly if they share such a value), a value has at most 65 visitors, and each visitor is
linked with the first.  That is exact too, and grows with the rows, not with pairs.

Edge cases: a null text has no words, so its fingerprint is zero and links like any other;
equal rows get equal results; null doc_ids stay and never become a component's id unless
nothing else is there; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.shared import materialize
from marketloom.llm.batches import encoded, split_batches
from marketloom.operators.graph import connected_components

SEGMENTS = (22, 21, 21)
#: Generator polynomial of the binary (23, 12) Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
LENGTH, CHECK_BITS, REACH = 23, 11, 4
#: Bytes of text whose shingles a task unfolds to bits at a time.
SLICE = 1 << 20
#: Keys with at most so many classes compare them in pairs; others take the exact way without pairs.
PAIR_LIMIT = 32


# --- fingerprints ------------------------------------------------------------


def shingles(text: bytes, size: int = 3) -> list[bytes]:
    words = text.lower().split()  # bytes: lowers A-Z and splits at the six ASCII white-space bytes only
    if len(words) < size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    return [joined[a:b - 1] for a, b in zip(starts, ends[size - 1:])]


def signatures(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of ``counts`` hashes as unsigned 64-bit integers; of none: zero."""
    out = np.zeros(len(counts), np.uint64)
    n = np.asarray(counts, np.int64)
    some = np.flatnonzero(n)
    if len(some):
        bits = np.unpackbits(np.asarray(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = (np.cumsum(n) - n)[some]
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        out[some] = np.packbits(2 * ones > n[some][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints_of(texts: list[bytes], size: int = 3) -> np.ndarray:
    """The fingerprint of each text as unsigned 64-bit integers."""
    hashes, counts = [], []
    digest = xxhash.xxh64_intdigest
    for t in texts:
        found = [digest(s, 42) for s in shingles(t, size)]
        hashes += found
        counts.append(len(found))
    return signatures(np.array(hashes, "<u8"), np.array(counts, np.int64))


def _fingerprint_batches(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for part in split_batches(batches, "text", SLICE):
        found = fingerprints_of(encoded(part.column(2)), size)
        yield pa.record_batch([part.column(0), part.column(1), pa.array(found.view(np.int64))], ["doc_id", "text_hash", "fp"])


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, ``text_hash`` and text of every row; the first two tell rows apart whose doc_id is null or repeats."""
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, ``text_hash`` and ``fp``, the fingerprint as a signed long, of every row."""
    return hashed(docs).mapInArrow(lambda it: _fingerprint_batches(it, size), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash bigint, fp bigint")


# --- Golay keys --------------------------------------------------------------


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK_BITS)
    return word


@lru_cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the upper bits, and by remainder all errors of up to four bits (-1: no more)."""
    upper = np.array([_remainder(t << CHECK_BITS) for t in range(1 << (LENGTH - CHECK_BITS))], np.int64)
    single = [_remainder(1 << b) for b in range(LENGTH)]
    errors: list[list[int]] = [[] for _ in range(1 << CHECK_BITS)]
    for weight in range(REACH + 1):
        for bits in combinations(range(LENGTH), weight):
            rest = 0
            for b in bits:
                rest ^= single[b]
            errors[rest].append(sum(1 << b for b in bits))
    most = max(map(len, errors))
    return upper, np.array([e + [-1] * (most - len(e)) for e in errors], np.int64)


def golay_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and index of every codeword within four bits of each 23-bit word."""
    upper, errors = _tables()
    found = errors[upper[words >> CHECK_BITS] ^ (words & ((1 << CHECK_BITS) - 1))]
    row, col = np.nonzero(found >= 0)
    return row, (words[row] ^ found[row, col]) >> CHECK_BITS


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and join key of every key of each fingerprint."""
    parts, shift = [], 0
    for width in SEGMENTS:
        parts.append(((fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64))
        shift += width
    rows, keys = [], []
    for i, exact in enumerate(parts):
        row, index = golay_indices(parts[(i + 1) % len(parts)])
        rows.append(row)
        keys.append((i << 40) | (exact[row] << 12) | index)
    return np.concatenate(rows), np.concatenate(keys)


def _key_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(fps):
            row, key = keys_of(fps.view(np.uint64))
            yield pa.record_batch([pa.array(key), pa.array(fps[row])], ["key", "fp"])


# --- links -------------------------------------------------------------------


def links(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints ``fp`` whose connected components are those of all pairs within two bits."""
    keyed = classes.select("fp").mapInArrow(_key_batches, "key bigint, fp bigint")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = materialize(keyed.join(sizes, "key"))
    few = shared.filter(F.col("n") <= PAIR_LIMIT)
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").filter("a < b AND bit_count(a ^ b) <= 2").select("a", "b")
    many = shared.filter(F.col("n") > PAIR_LIMIT).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long") for b in range(64)])
    met = many.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("at")).groupBy("at").agg(F.sort_array(F.collect_list("fp")).alias("_all"))
    stars = met.filter(F.size("_all") > 1).select(F.col("_all")[0].alias("a"), F.explode("_all").alias("b")).filter("a != b")
    return pairs.union(stars).distinct()


def components(docs: DataFrame) -> DataFrame:
    """doc_id, ``fp`` and ``component_id``, the smallest doc_id reachable by links, of every row."""
    marked = materialize(fingerprints(docs))
    classes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = connected_components(links(classes)).withColumnRenamed("node", "fp")
    led = classes.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    heads = led.groupBy("label").agg(F.min("first").alias("component_id"))
    known = led.select("fp", "label").join(heads, "label").select("fp", "component_id")
    return marked.join(known, "fp").select("doc_id", "fp", "component_id")


def hexed(fp: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, marked: DataFrame, labels: DataFrame) -> DataFrame:
    """One row of ``docs`` per component, with the columns it came with: the smallest (doc_id, text hash), null doc_ids last.

    ``marked`` has ``doc_id``, ``text_hash`` and ``node`` of every row; ``labels`` has the ``label`` of the nodes that have
    links.  A row is named by its doc_id and its text, so rows without a doc_id, or with a repeated one, are judged each
    on its own; rows equal in both are copies.
    """
    named = marked.groupBy("node", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("_rows"))
    order = F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "text_hash", "_rows")
    first = named.groupBy("node").agg(F.min(order).alias("first")).join(labels, "node", "left")
    heads = first.groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("first").alias("h"))
    kept = heads.select(F.col("h.doc_id").alias("_id"), F.col("h.text_hash").alias("_hash"), F.col("h._rows").alias("_rows"))
    # a row travels as one struct: no column of ``docs`` can clash with a name used here
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_doc"), F.xxhash64(F.col("text").cast("string")).alias("_text"))
    found = rows.join(kept, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")))
    once = found.filter("_rows = 1").select("_row.*")
    return once.unionByName(found.filter("_rows > 1").dropDuplicates(["_id", "_hash"]).select("_row.*"))


def representatives(docs: DataFrame) -> DataFrame:
    """One document of each component: see ``one_of_each``."""
    marked = materialize(fingerprints(docs).withColumnRenamed("fp", "node"))
    labels = connected_components(links(marked.select(F.col("node").alias("fp")).distinct()))
    return one_of_each(docs, marked, labels)
