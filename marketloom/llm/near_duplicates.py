"""Near-duplicate documents: five-word shingle sets with a Jaccard index of at least 0.8.

Candidates come in two steps.  The SimHash operator (``simhash.links``) fingerprints the shingle
sets and brings together, by Golay keys, the fingerprints that differ in two bits at most.  Its
radius is too small for the index alone (pairs at 0.8 differ in five or six of 64 bits, many in
more), so MinHash bands find the rest: ``BANDS`` keys of ``ROWS`` minima each.  A pair of index j
shares a key with probability 1 - (1 - j^ROWS)^BANDS, which is 0.9999995 at 0.8 and more above.
Candidates of both are verified by the exact index of their shingle sets, so nothing below the
threshold is linked.

Equal shingle sets are one class, named by one hash; a second hash tells classes apart that share
it (``told_apart``).  A key with up to ``PAIR_LIMIT`` classes compares all pairs.  In a key with
more, each class is compared with the one whose keys are the most popular, which for copies of
one text is the one nearest to it.  Only classes that are then outside the key's largest
component are compared with the others there, and only where an exact bound leaves a chance: a
pair cannot share shingles that one of the two has alone, nor in any of ``BUCKETS`` hash buckets
more than the one with fewer there has.  Copies that differ from all others by words of their own
are ruled out by that without a comparison.  Other pairs left out lie in one component already,
so the components are those of all pairs that share a key.

Edge cases: a text of fewer than five words is one shingle; texts without words are one class;
null doc_ids and repeated ones are judged by row (``simhash.one_of_each``); repeated rows are
copies, of which one stays; a text of any length is one set; an empty table stays empty; other
columns are kept and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions.shared import materialize
from marketloom.llm import simhash
from marketloom.llm.batches import encoded, split_batches
from marketloom.llm.simhash import hashed, one_of_each, shingles
from marketloom.operators.graph import connected_components

SIZE = 5
BANDS, ROWS = 48, 6
#: Keys with at most so many classes compare them in pairs.
PAIR_LIMIT = 32
#: Hash buckets whose sizes bound what two classes share.
BUCKETS = 128
#: Bytes of text whose shingles a task holds at a time.
SLICE = 1 << 20
_MASKS, _FACTORS = np.random.default_rng(8).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
_FACTORS |= np.uint64(1)
#: Mixes the minima of a band into one key.
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes) -> np.ndarray:
    """The hashes of the distinct shingles, in order."""
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s) for s in shingles(text, SIZE)], np.uint64))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of keys, one per band, for each set; no set may be empty."""
    values = np.concatenate(sets)
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    keys = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), band, np.uint64)
        for i in range(band * ROWS, (band + 1) * ROWS):
            key = (key ^ (key >> np.uint64(29))) * _MIX + np.minimum.reduceat((values ^ _MASKS[i]) * _FACTORS[i], starts)
        keys[:, band] = key
    return keys


def _mark_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in split_batches(batches, "text", SLICE):
        sets = [shingle_set(t) for t in encoded(part.column(2))]
        nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        again = np.array([xxhash.xxh64_intdigest(s.tobytes(), 1) for s in sets], np.uint64).view(np.int64)
        sizes = np.array([len(s) for s in sets], np.int32)
        some = [s for s in sets if len(s)]
        fps = simhash.signatures(np.concatenate(sets), sizes).view(np.int64)
        keys = band_keys(some).view(np.int64).ravel() if some else np.empty(0, np.int64)
        ends = np.r_[0, np.cumsum((sizes > 0) * BANDS)].astype(np.int32)
        yield pa.record_batch([part.column(0), part.column(1), pa.array(nodes), pa.array(again), pa.array(sizes), pa.array(fps), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))], ["doc_id", "text_hash", "node", "again", "n", "fp", "keys"])


def marks(docs: DataFrame) -> DataFrame:
    """doc_id, ``text_hash``, ``node`` (the class), ``again`` (its second hash), ``n`` (distinct shingles), ``fp`` (their fingerprint) and band ``keys`` of every row."""
    return hashed(docs).mapInArrow(_mark_batches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash bigint, node bigint, again bigint, n int, fp bigint, keys array<bigint>")


def told_apart(marked: DataFrame) -> DataFrame:
    """``marked`` with another ``node`` for every class but one that shares its hash with a different class."""
    shared = materialize(marked.groupBy("node").agg(F.min("again").alias("_low"), F.max("again").alias("_high")).filter("_low != _high").select("node", "_low"))
    if shared.isEmpty():  # two of 64 bits that differ in 64 others: some in 10^10 classes
        return marked.drop("again")
    moved = F.when(F.col("again") != F.col("_low"), F.xxhash64("node", "again")).otherwise(F.col("node"))
    return materialize(marked.join(shared, "node", "left").withColumn("node", F.when(F.col("_low").isNull(), F.col("node")).otherwise(moved)).drop("again", "_low"))


def _set_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in split_batches(batches, "text", SLICE):
        sets = [shingle_set(t) for t in encoded(part.column(1))]
        ends = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
        yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], ["node", "shingles"])


def sets_of(docs: DataFrame, marked: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and ``shingles`` of the classes in ``nodes``."""
    # one row of each class lends its text
    named = marked.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("at")).join(nodes, "node").select("node", F.col("at.doc_id").alias("_id"), F.col("at.text_hash").alias("_hash"))
    rows = hashed(docs)
    texts = rows.join(named, rows["doc_id"].eqNullSafe(named["_id"]) & (rows["text_hash"] == named["_hash"])).select("node", "text")
    return materialize(texts.mapInArrow(_set_batches, "node bigint, shingles array<bigint>").dropDuplicates(["node"]))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose exact index is at least 0.8."""
    left = pairs.join(sets.toDF("a", "_x"), "a")
    both = left.join(sets.toDF("b", "_y"), "b").withColumn("_shared", F.size(F.array_intersect("_x", "_y")))
    # shared / (x + y - shared) >= 4 / 5 in whole numbers
    return materialize(both.filter(9 * F.col("_shared") >= 4 * (F.size("_x") + F.size("_y"))).select("a", "b"))


def _common(sets: DataFrame) -> DataFrame:
    """node and ``common``: how many of its shingles another class of ``sets`` has too."""
    alone = sets.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("_held"), F.min("node").alias("node")).filter("_held = 1")
    own = alone.groupBy("node").agg(F.count(F.lit(1)).alias("_own"))
    return sets.select("node", F.size("shingles").alias("_n")).join(own, "node", "left").select("node", (F.col("_n") - F.coalesce("_own", F.lit(0))).alias("common"))


def _bucket_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [np.bincount(s.values.to_numpy() & (BUCKETS - 1), minlength=BUCKETS) for s in b.column(1)]
        yield pa.record_batch([b.column(0), pa.array([r.tolist() for r in rows], pa.list_(pa.int32()))], ["node", "buckets"])


def _buckets(sets: DataFrame) -> DataFrame:
    """node and ``buckets``: how many of its shingles fall into each hash bucket."""
    return sets.select("node", "shingles").mapInArrow(_bucket_batches, "node bigint, buckets array<int>")


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


#: A pair with a smaller ratio of sizes cannot reach the index.
_SIZES = "5 * least(n, m) >= 4 * greatest(n, m)"


def close_pairs(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes that the SimHash operator links: fingerprints ``fp`` within two bits.

    Classes of one fingerprint meet the first of them, which meets those of other fingerprints.
    """
    first = materialize(classes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("_first")))
    heads = first.select("fp", F.col("_first.node").alias("head"), F.col("_first.n").alias("m"))
    same = classes.join(heads, "fp").filter(f"node != head AND {_SIZES}").select(*_ordered("node", "head"))
    met = simhash.links(heads.select("fp")).join(heads.toDF("a", "node", "n"), "a").join(heads.toDF("b", "head", "m"), "b")
    return same.union(met.filter(_SIZES).select(*_ordered("node", "head")))


def labels(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """node and ``label`` of every class that has a link."""
    classes = marked.dropDuplicates(["node"])
    close = close_pairs(classes.select("node", "n", "fp"))
    keyed = classes.select("node", "n", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    shared = materialize(keyed.join(sizes, "key"))
    few = shared.filter(F.col("classes") <= PAIR_LIMIT).select("key", "node", "n")
    many = shared.filter(F.col("classes") > PAIR_LIMIT)
    pairs = few.toDF("key", "a", "n").join(few.toDF("key", "b", "m"), "key").filter(f"a < b AND {_SIZES}").select("a", "b")
    popular = many.groupBy("node").agg(F.sum("classes").alias("popular"))
    heads = many.join(popular, "node").groupBy("key").agg(F.max(F.struct("popular", "node", "n")).alias("head"))
    stars = many.join(heads, "key").select("node", "n", F.col("head.node").alias("with"), F.col("head.n").alias("m")).filter(f"node != with AND {_SIZES}").select(*_ordered("node", "with"))
    wanted = materialize(close.union(pairs).union(stars).distinct())
    links = verified(wanted, sets_of(docs, marked, wanted.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
    found = connected_components(links)
    # what the stars left apart
    placed = many.select("key", "node", "n").join(found, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label"))
    counted = placed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("members"))
    main = counted.groupBy("key").agg(F.max(F.struct("members", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).filter("labels > 1").select("key", F.col("top.label").alias("main"))
    split = materialize(placed.join(main, "key"))
    if split.isEmpty():
        return found
    sets = sets_of(docs, marked, split.select("node").distinct())
    # with its own shingles taken off, a class must still reach the index with a class of its size or less
    able = split.join(_common(sets), "node").filter(F.col("common") >= F.ceil(0.8 * F.col("n"))).withColumn("inside", F.col("label") == F.col("main")).drop("main")
    # at most BANDS keys of a class; two classes are compared in the first key that they share
    keys = able.groupBy("node").agg(F.collect_list("key").alias("keys"), F.collect_list(F.when(~F.col("inside"), F.col("key"))).alias("outer"))
    able = able.join(keys, "node").join(_buckets(sets), "node")
    apart = able.filter("NOT inside").select("key", "node", "n", "label", "common", "outer", "buckets")
    others = able.select("key", F.col("node").alias("with"), F.col("n").alias("m"), F.col("label").alias("other"), F.col("common").alias("shared"), "keys", "inside", F.col("buckets").alias("theirs"))
    once = "(inside OR node < with) AND array_min(array_intersect(outer, keys)) = key"
    most = "9 * aggregate(zip_with(buckets, theirs, (x, y) -> least(x, y)), 0, (s, v) -> s + v) >= 4 * (n + m)"
    cross = apart.join(others, "key").filter(f"label != other AND 9 * least(common, shared) >= 4 * (n + m) AND {_SIZES} AND {once} AND {most}").select(*_ordered("node", "with"))
    return connected_components(links.union(verified(materialize(cross.distinct()), sets)))


def distinct(docs: DataFrame) -> DataFrame:
    """One document of each group that links of at least 0.8 connect, with the columns it came with."""
    marked = told_apart(materialize(marks(docs)))
    return one_of_each(docs, marked, labels(docs, marked))
