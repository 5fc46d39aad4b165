"""Repair of conversations: the cheapest edits that make roles alternate, by a Viterbi search.

A repaired conversation has the role initials ``(s?(ua)+)?``.  Its rows are kept, deleted or
given another role, and empty rows are inserted; ``EDITS`` has the costs.  Rows are read in the
order of turn (nulls first), role and text hash; among the cheapest edits those whose initials
are the least in ASCII win.

The search knows four states (nothing, after s, after u, after a) and keeps the best way into
each as a leaf of a tree of back pointers.  Every node counts its children.  A way that lost
gives its nodes back up to the next fork; when all ways share a fork, the edits up to it are
final and leave.  A way that another can follow at less cost is dropped.  Ways of equal cost are
compared by all their edits since they parted.  So memory holds what is undecided only.

The rows travel as hashes and flags.  Equal rows of a turn are counted first, what is a duplicate
is ranked over ranges, and a conversation that spans several ranges is searched in fragments:
each fragment gives its cost from state to state, from these follow the costs to its right,
and with them each fragment finds its edits from every state it may start in.  Costs and edits
are those of one search over the whole, and no task needs a whole conversation.  Texts are
shuffled once, for the repaired rows; a conversation's digest is a single stream by nature, and
the task that makes it holds one row at a time and one letter an edit.

Edge cases: null role and text are one space; null conversations are one conversation; null
turns come first and have no gaps; repeated rows are duplicates of the first; texts are read
whole; other columns are not read; an empty table gives an empty table; ``gaps`` beyond a long
is null.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from marketloom.functions.ordered import running_totals
from marketloom.functions.shared import materialize, scratch_table
from marketloom.llm.batches import SLICE_BYTES

#: Keep, rerole, delete, insert, and what a row that breaks off adds unless it is deleted.
KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 2, 3, 2, 1
#: States: nothing yet, after s, after u, after a.  What an inserted or reroled row leads to, and the roles it takes.
STATES = range(4)
NEXT = (2, 2, 3, 2)
ROLES = ("user", "user", "assistant", "user")
_KEPT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
#: What each state pays at most to follow any way of another.
_FOLLOW = ((0, 0, 2, 0), (7, 0, 2, 4), (5, 2, 0, 2), (3, 0, 2, 0))
_FAR = 1 << 60
#: Inserts that end a conversation in each state.
ENDS = ("", "II", "I", "")
END_COSTS = tuple(INSERT * len(e) for e in ENDS)
WHITE = " \t\n\v\f\r"


# --- search ------------------------------------------------------------------


def _moves(initial: str, broken: bool, forced: bool) -> list[list[tuple[int, int, str]]]:
    """For each state after a row the (state before, cost, edits) that lead to it: inserts, then the row's own edit."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start in STATES:
        state, extra, cost = start, "", 0
        for _ in range(3):
            ways = [(state, DELETE, "D")]
            if not forced:
                ways.append((NEXT[state], REROLE + BROKEN * broken, "R"))
                if (initial, state) in _KEPT:
                    ways.append((_KEPT[initial, state], KEEP + BROKEN * broken, "K"))
            for end, price, edit in ways:
                best[start, end] = min(best.get((start, end), (_FAR, "")), (cost + price, extra + edit))
            state, extra, cost = NEXT[state], extra + "I", cost + INSERT
    return [[(s, *best[s, e]) for s in STATES if (s, e) in best] for e in STATES]


#: By kind of row: initial (anything else as ""), whether it breaks off, whether it must go.
MOVES = {(i, b, f): _moves(i, b, f) for i in ("s", "u", "a", "") for b in (False, True) for f in (False, True)}


def kind_of(initial: str, broken: bool, forced: bool) -> tuple[str, bool, bool]:
    return ("" if forced or initial not in ("s", "u", "a") else initial, broken and not forced, forced)


class _Node:
    __slots__ = ("parent", "edits", "children")

    def __init__(self, parent: "_Node | None", edits: str):
        self.parent, self.edits, self.children = parent, edits, 0


class Survivors:
    """The best way into each state; ``final`` takes edits as soon as all ways share them."""

    def __init__(self, state: int = 0):
        self.root = _Node(None, "")
        self.leaves: list[_Node | None] = [None] * 4
        self.costs = [_FAR] * 4
        self.leaves[state], self.costs[state] = self.root, 0
        self.final: list[str] = []

    @staticmethod
    def _less(a: _Node, after_a: str, b: _Node, after_b: str) -> bool:
        """Whether the whole way over ``a`` is less than that over ``b``: both are compared from where they parted."""
        left, right = [after_a], [after_b]
        while a is not b:
            left.append(a.edits)
            right.append(b.edits)
            a, b = a.parent, b.parent
        return "".join(reversed(left)) < "".join(reversed(right))

    def step(self, kind: tuple[str, bool, bool]) -> None:
        old, costs, fresh, prices = self.leaves, self.costs, [None] * 4, [_FAR] * 4
        for end, ways in enumerate(MOVES[kind]):
            at, price, chosen = None, _FAR, ""
            for start, cost, edits in ways:
                leaf = old[start]
                if leaf is not None:
                    total = costs[start] + cost
                    if total < price or total == price and self._less(leaf, edits, at, chosen):
                        at, price, chosen = leaf, total, edits
            fresh[end], prices[end] = (at, chosen) if at else None, price
        kept = []
        for end in STATES:
            leaf = None
            if fresh[end] and all(prices[end] <= prices[s] + _FOLLOW[s][end] for s in STATES):
                parent, edits = fresh[end]
                parent.children += 1
                leaf = _Node(parent, edits)
            kept.append(leaf)
        for leaf in old:  # lost ways return their nodes up to the next fork
            while leaf is not None and not leaf.children and leaf.parent is not None:
                leaf = leaf.parent
                leaf.children -= 1
        self.leaves, self.costs = kept, [p if leaf else _FAR for leaf, p in zip(kept, prices)]
        if self.root.children == 1:
            self._settle()

    def _settle(self) -> None:
        way, node = [], next(leaf for leaf in self.leaves if leaf)
        while node is not self.root:
            way.append(node)
            node = node.parent
        while way and self.root.children == 1:
            self.root = way.pop()
            self.root.parent = None
            self.final.append(self.root.edits)

    def end(self, costs: Iterable[int]) -> tuple[int, int, str]:
        """State, cost and edits of the best way, when going on from each state has the given costs."""
        best = None
        for state, rest in enumerate(costs):
            leaf = self.leaves[state]
            if leaf is not None and rest < _FAR:
                total = self.costs[state] + rest
                if best is None or total < best[1] or total == best[1] and self._less(leaf, "", self.leaves[best[0]], ""):
                    best = state, total
        state, total = best
        node, rest = self.leaves[state], []
        while node is not self.root:
            rest.append(node.edits)
            node = node.parent
        return state, total, "".join(self.final) + "".join(reversed(rest))


def solve(kinds: Iterable[tuple[str, bool, bool]]) -> tuple[int, str]:
    """Cost and edits of a whole conversation."""
    search = Survivors()
    for kind in kinds:
        search.step(kind)
    state, cost, edits = search.end(END_COSTS)
    return cost, edits + ENDS[state]


def _table_step(table: list[list[int]], kind: tuple[str, bool, bool]) -> list[list[int]]:
    moves = MOVES[kind]
    return [[min([row[s] + c for s, c, _ in ways], default=_FAR) for ways in moves] for row in table]


# --- rows --------------------------------------------------------------------

ORDER = ("conv_id", "turn", "role", "h1", "h2")


def rows_of(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and two hashes of the text; null role and text are one space."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    out = df.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    return out.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(1), "text"))


def flagged(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number ``n``, ``blank``, ``broken`` and ``seen`` (an earlier turn has the same role and text)."""
    last = F.substring(F.rtrim("text", F.lit(WHITE)), -1, 1)
    marked = rows.withColumn("blank", last == "").withColumn("broken", ~last.isin(".", "!", "?"))
    counted = marked.groupBy(*ORDER, "blank", "broken").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(counted, ["turn"], keys=["conv_id", "role", "h1", "h2"], rank="_rank")
    return ranked.withColumn("seen", F.col("_rank") > 1).drop("_rank")


def _counts(flags: DataFrame) -> DataFrame:
    """gaps, blank, duplicate and truncated rows of each conversation."""
    wide = [F.col(c).cast("decimal(38,0)") for c in ("_most", "_least")]
    span = F.when(F.col("_most").isNull(), 0).otherwise(wide[0] - wide[1] + 1 - F.col("_turns"))
    twice = F.when(F.col("blank"), 0).when(F.col("seen"), F.col("n")).otherwise(F.col("n") - 1)
    return flags.groupBy("conv_id").agg(
        F.max("turn").alias("_most"), F.min("turn").alias("_least"), F.count_distinct("turn").alias("_turns"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"), F.sum(twice).alias("duplicate"),
        F.count_if(F.col("broken") & ~F.col("blank") & ~F.col("seen")).alias("truncated"),
    ).select("conv_id", span.try_cast("bigint").alias("gaps"), "blank", "duplicate", "truncated")


def _kinds(role: str, blank: bool, broken: bool, seen: bool, n: int) -> Iterator[tuple[str, bool, bool]]:
    """The kinds of ``n`` equal rows: all must go if blank or seen before, else all but the first."""
    yield kind_of(role[:1], broken, blank or seen)
    for _ in range(n - 1):
        yield kind_of("", False, True)


def _fragments(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(conversation, its sorted rows) of a task, one row at a time."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
    return groupby(rows, lambda r: r[0])


class _Adjacent:
    """Counts neighbours whose role initials are none of su, ua and au."""

    def __init__(self):
        self.first = self.last = None
        self.illegal = 0

    def add(self, role: str, n: int) -> None:
        if self.last is None:
            self.first = role[:1]
        else:
            self.illegal += not legal(self.last, role[:1])
        self.illegal += n - 1  # equal neighbours are never legal
        self.last = role[:1]


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au") and len(a) == 1


# --- search by ranges --------------------------------------------------------


def _columns(names: list[str], types: list, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(names)
    return pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, types)], names)


def _whole_batches(batches: Iterable[pa.RecordBatch], cut: set, names: list[str], types: list) -> Iterator[pa.RecordBatch]:
    """Illegal pairs, cost and audit of the conversations that lie in one range."""
    out = []
    for conv, rows in _fragments(batches):
        if conv in cut:
            continue
        search, pairs = Survivors(), _Adjacent()
        for _, _, role, blank, broken, seen, n in rows:
            pairs.add(role, n)
            for k in _kinds(role, blank, broken, seen, n):
                search.step(k)
        state, cost, edits = search.end(END_COSTS)
        out.append((conv, pairs.illegal, cost, edits + ENDS[state]))
        if len(out) == 1024:
            yield _columns(names, types, out)
            out = []
    yield _columns(names, types, out)


def _table_batches(batches: Iterable[pa.RecordBatch], cut: set, names: list[str], types: list) -> Iterator[pa.RecordBatch]:
    """Of each fragment of a conversation in several ranges: costs from state to state, and its neighbours."""
    for conv, rows in _fragments(batches):
        if conv in cut:
            table, pairs, part = [[0 if s == e else _FAR for e in STATES] for s in STATES], _Adjacent(), None
            for _, part, role, blank, broken, seen, n in rows:
                pairs.add(role, n)
                for k in _kinds(role, blank, broken, seen, n):
                    table = _table_step(table, k)
            yield _columns(names, types, [(conv, part, [min(v, _FAR) for row in table for v in row], pairs.first, pairs.last, pairs.illegal)])


def _way_batches(batches: Iterable[pa.RecordBatch], rest: dict, names: list[str], types: list) -> Iterator[pa.RecordBatch]:
    """Of each such fragment and each state it may start in: where its best way stops, and the edits."""
    for conv, rows in _fragments(batches):
        if conv in rest:
            searches, part = [Survivors(s) for s in STATES], None
            for _, part, role, blank, broken, seen, n in rows:
                for k in _kinds(role, blank, broken, seen, n):
                    for search in searches:
                        search.step(k)
            for start, search in enumerate(searches):
                stop, _, edits = search.end(rest[conv][part])
                yield _columns(names, types, [(conv, part, start, stop, edits)])


def _mapped(rows: DataFrame, task, extra, columns: str) -> DataFrame:
    """``task`` over the sorted rows of each range; ``columns`` follow the conversation."""
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *T.StructType.fromDDL(columns).fields])
    names, types = schema.names, [to_arrow_type(f.dataType) for f in schema.fields]
    read = rows.select("conv_id", "part", "role", "blank", "broken", "seen", "n")
    return read.mapInArrow(lambda it: task(it, extra, names, types), schema)


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of every conversation in ``rows`` (of ``rows_of``)."""
    spark = rows.sparkSession
    order = [F.col(c).asc_nulls_first() for c in ORDER]
    ranged = materialize(flagged(rows).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    # one row per range: a conversation that ends one range and begins another is cut
    at = F.struct("conv_id")
    edges = ranged.groupBy("part").agg(F.min(at).alias("first"), F.max(at).alias("last")).collect()
    begins = {(e["first"][0], e["part"]) for e in edges}
    tails = {e["last"][0] for e in edges}
    cut = {conv for conv, part in begins if conv in tails and any(e["last"][0] == conv and e["part"] != part for e in edges)}

    whole = _mapped(ranged, _whole_batches, cut, "illegal bigint, cost bigint, audit string")
    if not cut:
        return _counts(ranged).join(whole.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")

    # at most two fragments per range, here and below
    tables: dict = defaultdict(dict)
    for r in _mapped(ranged, _table_batches, cut, "part int, costs array<bigint>, first string, last string, illegal bigint").collect():
        tables[r["conv_id"]][r["part"]] = r
    rest: dict = {}
    totals = []
    for conv, parts in tables.items():
        after, rest[conv] = list(END_COSTS), {}
        illegal, previous = 0, None
        for part in sorted(parts):
            illegal += parts[part]["illegal"] + (previous is not None and not legal(previous, parts[part]["first"]))
            previous = parts[part]["last"]
        for part in sorted(parts, reverse=True):
            rest[conv][part] = after
            costs = parts[part]["costs"]
            after = [min(min(costs[4 * s + e] + after[e] for e in STATES), _FAR) for s in STATES]
        totals.append((conv, illegal, after[0]))
    ways = scratch_table(_mapped(ranged, _way_batches, rest, "part int, start int, stop int, edits string"), "ways")
    stops = {(r["conv_id"], r["part"], r["start"]): r["stop"] for r in ways.select("conv_id", "part", "start", "stop").collect()}
    chosen = []
    for conv, illegal, cost in totals:
        state = 0
        for part in sorted(rest[conv]):
            chosen.append((conv, part, state, illegal, cost, part == max(rest[conv])))
            state = stops[conv, part, state]
        chosen[-1] = (*chosen[-1][:5], ENDS[state])
    chosen = [(*c[:5], c[5] or "") for c in chosen]
    kind = rows.schema["conv_id"].dataType.simpleString()
    taken = spark.createDataFrame(chosen, f"_conv {kind}, _part int, _start int, illegal bigint, cost bigint, tail string")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")) & (F.col("start") == F.col("_start"))
    pieces = ways.join(F.broadcast(taken), same).groupBy("conv_id", "illegal", "cost").agg(F.array_sort(F.collect_list(F.struct("part", F.concat("edits", "tail").alias("edits")))).alias("_parts"))
    joined = pieces.select("conv_id", "illegal", "cost", F.array_join(F.col("_parts.edits"), "").alias("audit"))
    found = whole.union(joined).withColumnRenamed("conv_id", "_conv")
    return _counts(ranged).join(found, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")


# --- repaired rows -----------------------------------------------------------


def _repaired(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple[str, str, str]]]]:
    """(conversation, its repaired rows as (edit, role, text)) in order; a conversation's first row has its audit as text."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))

    def repaired(own: Iterator[tuple]) -> Iterator[tuple[str, str, str]]:
        state = 0
        for edit in next(own)[3]:
            if edit == "I":
                role, text, end = ROLES[state], "", NEXT[state]
            else:
                _, _, role, text = next(own)
                if edit == "D":
                    continue
                end = NEXT[state] if edit == "R" else _KEPT[role[:1], state]
                role = ROLES[state] if edit == "R" else role
            yield edit, role, text
            state = end

    for conv, own in groupby(rows, lambda r: r[0]):
        yield conv, repaired(own)


def _row_batches(batches: Iterable[pa.RecordBatch], names: list[str], types: list) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for conv, rows in _repaired(batches):
        for place, (edit, role, text) in enumerate(rows):
            out.append((conv, place, edit, role, text))
            size += len(text) + 64
            if size > SLICE_BYTES:
                yield _columns(names, types, out)
                out, size = [], 0
    yield _columns(names, types, out)


def _digest_batches(batches: Iterable[pa.RecordBatch], names: list[str], types: list) -> Iterator[pa.RecordBatch]:
    out = []
    for conv, rows in _repaired(batches):
        digest, gap = hashlib.sha256(), b""
        for _, role, text in rows:
            digest.update(gap + role.encode() + b":")
            digest.update(text.encode())
            gap = b"\n"
        out.append((conv, digest.hexdigest()))
        if len(out) == 1024:
            yield _columns(names, types, out)
            out = []
    yield _columns(names, types, out)


def _streamed(rows: DataFrame, found: DataFrame, task, columns: str) -> DataFrame:
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *T.StructType.fromDDL(columns).fields])
    names, types = schema.names, [to_arrow_type(f.dataType) for f in schema.fields]
    empty = lambda c: F.lit(None).cast(rows.schema[c].dataType).alias(c)
    heads = found.select("conv_id", F.lit(0).alias("tag"), empty("turn"), empty("role"), empty("h1"), empty("h2"), F.col("audit").alias("text"))
    both = heads.union(rows.select("conv_id", F.lit(1), "turn", "role", "h1", "h2", "text"))
    # the order in which the audit was made; all rows of a conversation pass one task, one at a time
    ordered = both.repartition("conv_id").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in ("conv_id", "tag", "turn", "role", "h1", "h2")])
    return ordered.select("conv_id", "tag", "role", "text").mapInArrow(lambda it: task(it, names, types), schema)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit (K, R or I), role and text of the repaired conversations; ``found`` comes from ``audits``."""
    return _streamed(rows, found, _row_batches, "place bigint, edit string, role string, text string")


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id and ``repaired_sha256`` of the repaired rows ``role:text`` joined by line feeds."""
    return _streamed(rows, found, _digest_batches, "repaired_sha256 string")


def repair(df: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """Counts, cost, audit and digest of every conversation of ``every`` (of ``df`` itself, if not given)."""
    rows = rows_of(df)
    found = materialize(audits(rows))
    both = found.join(digests(rows, found).withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    wanted = (df if every is None else every).select(F.col("conv_id").alias("_conv")).distinct()
    joined = wanted.join(both, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    # only conversations without rows lack an audit
    none = F.col("audit").isNull()
    counts = [F.when(none, 0).otherwise(F.col(c)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(F.col("_conv").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def damaged(df: DataFrame) -> DataFrame:
    """Rows with planted faults, dealt by crc32(``conv_id:turn``) % 20: 0 is dropped, 1 loses its text, 2 its ``[.!?]``, 3 is repeated, 4 becomes the user's."""
    rows = rows_of(df).select("conv_id", "turn", "role", "text")
    named = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(c) for c in ("conv_id", ":", "turn")])
    deal = F.crc32(named.cast("binary")) % 20
    copies = F.when(deal == 0, 0).when(deal == 3, 2).otherwise(1)
    role = F.when(deal == 4, "user").otherwise(F.col("role"))
    text = F.when(deal == 1, "").when(deal == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), copies)).alias("_copy")).drop("_copy")
