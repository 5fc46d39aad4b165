"""Shards of even size that keep linked documents together: balanced label propagation.

DataFrame operations only.  Documents with equal texts are linked.  Linked documents start
in a row that is cut where a shard is full.  In each round a linked document hears how many of its
neighbours are in every shard and asks to move to the one with the most; the shard
accepts as many as its quota of rows has left, larger requests first.  Groups travel as
rows (group, shard, count), so a group of any size is at most one row per shard.  What
cannot move is spread over shards that have room.  Documents without links fill every
shard to its quota at the end, so counts differ by one at most.

Edge cases: a null text is the empty text; equal rows are placed each; doc_id may be null
or repeat; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions.shared import materialize

#: Hash buckets per shuffle partition over which the rows of one key are numbered.
BUCKETS = 4


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, ``size`` (UTF-8 bytes plus 8), ``text_crc32`` and the ``_group`` of equal texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("_group"))


def _quota(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def _array(values: list[int]) -> Column:
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def _dealt(df: DataFrame, order: list[str]) -> DataFrame:
    width = BUCKETS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(width)).cast("int"))


def _bases(dealt: DataFrame, key: str, amount: Column) -> DataFrame:
    """What lies before each bucket of a key: a row per key and bucket."""
    sums = dealt.groupBy(key, "_b").agg(F.sum(amount).alias("_s"))
    return sums.select(key, "_b", (F.sum("_s").over(W.partitionBy(key).orderBy("_b")) - F.col("_s")).alias("_base"))


def _before(df: DataFrame, key: str, order: list[str], out: str, amount: Column | None = None, beside: DataFrame | None = None) -> DataFrame:
    """The sum of ``amount`` (or the number of rows) before each row of its key.

    A key may have any share of the rows: they are dealt to hash buckets that are summed on
    their own.  ``beside`` has columns per key; they come along with the buckets.
    """
    amount = F.lit(1) if amount is None else amount
    dealt = _dealt(df, order)
    bases = _bases(dealt, key, amount)
    bases = bases if beside is None else bases.join(beside, key)
    upto = F.sum(amount).over(W.partitionBy(key, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)) - amount
    return dealt.withColumn("_in", upto).join(bases, [key, "_b"]).withColumn(out, F.col("_base") + F.col("_in")).drop("_b", "_in", "_base")


def _cumulative(values: list[int]) -> list[int]:
    return [sum(values[: k + 1]) for k in range(len(values))]


def _at(cumulative: Column, rank: Column) -> Column:
    """Index of the first range that ends after ``rank``."""
    return F.size(F.filter(cumulative, lambda c: c <= rank))


def laid_out(groups: DataFrame, quotas: list[int], few: bool = False) -> DataFrame:
    """Start: the groups in a row, cut where a shard's quota ends, as rows (group, shard, n).

    ``few`` orders a bounded number of groups by size, the largest first.
    """
    if few:
        before = F.sum("n").over(W.orderBy(F.desc("n"), "_group").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
        placed = groups.select("_group", "n", before.alias("_first"))
    else:
        placed = _before(groups.withColumn("_all", F.lit(0)), "_all", ["_group", "n"], "_first", F.col("n"))
    ends = _array(_cumulative(quotas))
    rows = placed.select("_group", "n", "_first", F.posexplode(ends).alias("shard", "_end"))
    start = F.col("_end") - F.element_at(_array(quotas), F.col("shard") + 1)
    count = F.least(F.col("_first") + F.col("n"), F.col("_end")) - F.greatest(F.col("_first"), start)
    return rows.select("_group", "shard", count.alias("n")).filter("n > 0")


def _held(placed: DataFrame, shards: int) -> list[int]:
    rows = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row per shard
    return [rows.get(s, 0) for s in range(shards)]


def propagate(placed: DataFrame, quotas: list[int]) -> DataFrame:
    """Move the members of each group towards the shard that holds most of it.

    ``placed`` has rows (group, shard, n).  A shard never holds more than its quota.  In a
    round all members ask for one shard: of those with room, the one with most of the group.
    Members of a shard that has more of it, but no room, move together or not at all.
    So the sum of squares of a group's counts only grows, and the rounds end.
    """
    while True:
        placed = materialize(placed)
        room = [q - h for q, h in zip(quotas, _held(placed, len(quotas)))]
        order = W.partitionBy("_group").orderBy(F.desc("n"), F.xxhash64("_group", "shard"), "shard")  # a group has a row per shard at most
        ranked = placed.withColumn("_rank", F.row_number().over(order)).withColumn("_room", F.element_at(_array(room), F.col("shard") + 1))
        best = F.min(F.when(F.col("_room") > 0, F.struct("_rank", "shard"))).over(W.partitionBy("_group"))
        asked = ranked.withColumn("_best", best)
        moves = asked.filter("_best.shard != shard").select("_group", "shard", "n", F.col("_best.shard").alias("_to"), (F.col("_rank") < F.col("_best._rank")).alias("_together"))
        queued = _before(moves, "_to", ["_group", "shard", "n"], "_ahead", F.col("n"))
        left = F.element_at(_array(room), F.col("_to") + 1) - F.col("_ahead")
        some = F.greatest(F.lit(0), F.least("n", left))
        granted = materialize(queued.withColumn("_k", F.when(F.col("_together") & (some < F.col("n")), 0).otherwise(some)).filter("_k > 0").select("_group", "shard", "_to", "_k"))
        if granted.isEmpty():
            return placed
        change = placed.union(granted.select("_group", "shard", -F.col("_k"))).union(granted.select("_group", "_to", "_k"))
        placed = change.groupBy("_group", "shard").agg(F.sum("n").alias("n")).filter("n > 0")


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, ``shard`` and ``slot`` (from 0, without gaps) of every document."""
    rows = materialize(sized(docs))
    order = ["_group", "doc_id", "size", "text_crc32"]
    groups = rows.groupBy("_group").agg(F.count(F.lit(1)).alias("n"))
    linked = groups.filter("n > 1")
    total = rows.count()
    quotas = _quota(total, shards)
    # groups of more than an eighth of a shard come first: there are at most eight for each shard
    large = F.col("n") > max(1, total // (8 * shards))
    first = propagate(laid_out(linked.filter(large), quotas, few=True), quotas)
    left = [q - h for q, h in zip(quotas, _held(first, shards))]
    # the cast also keeps the union from inheriting its parts' partitioning, which the planner cannot resolve
    plain = lambda p: p.select("_group", F.col("shard").cast("long").alias("shard"), "n")
    placed = plain(first).union(plain(propagate(laid_out(linked.filter(~large), left), left)))
    held = _held(placed, shards)
    # members of a group take its shards in order; a group's places are a row per shard at most
    inside = W.partitionBy("_group").orderBy("shard")
    ends = placed.withColumn("_end", F.sum("n").over(inside))
    runs = ends.groupBy("_group").agg(F.sort_array(F.collect_list(F.struct("_end", "shard"))).alias("_runs"))
    sized_groups = groups.join(runs, "_group", "left").select("_group", "_runs")
    members = _before(rows, "_group", order, "_rank", beside=sized_groups)
    known = F.col("_runs").isNotNull()
    own = F.filter("_runs", lambda r: F.col("_rank") < r["_end"])[0]["shard"]
    ready = materialize(members.select(*order, F.when(known, own).alias("shard")))
    free = _cumulative([q - h for q, h in zip(quotas, held)])
    single = _before(ready.filter("shard IS NULL").withColumn("_all", F.lit(0)), "_all", order, "_rank")
    filled = single.select(*order, _at(_array(free), F.col("_rank")).cast("int").alias("shard"))
    whole = ready.filter("shard IS NOT NULL").unionByName(filled)
    return _before(whole, "shard", order, "slot").select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))
