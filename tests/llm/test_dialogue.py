import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from marketloom.llm import dialogue, queries

WHITE = " \t\n\v\f\r"


def cheapest(kinds):
    """Least (cost, audit) over all edits, by exhaustion with whole strings: kinds are (initial, broken, forced)."""
    ways = {0: (0, "")}

    def with_inserts(ways):
        out = dict(ways)
        for _ in range(3):
            for state, (cost, audit) in list(out.items()):
                end = 3 if state == 2 else 2
                out[end] = min(out.get(end, (10 ** 9, "")), (cost + 2, audit + "I"))
        return out

    for initial, broken, forced in kinds:
        new = {}
        for state, (cost, audit) in with_inserts(ways).items():
            steps = [(state, 3, "D")]
            if not forced:
                steps.append((3 if state == 2 else 2, 2 + broken, "R"))
                end = 1 if initial == "s" and state == 0 else 2 if initial == "u" and state != 2 else 3 if initial == "a" and state == 2 else None
                if end is not None:
                    steps.append((end, int(broken), "K"))
            for end, price, edit in steps:
                new[end] = min(new.get(end, (10 ** 9, "")), (cost + price, audit + edit))
        ways = new
    done = with_inserts(ways)
    return min(done[s] for s in (0, 3) if s in done)


def every_way(kinds, most):
    """The same by listing all edit strings with at most ``most`` inserts between rows; for few rows."""
    found = []

    def go(k, out, cost, audit):
        if k == len(kinds) and re.fullmatch("(s?(ua)+)?", out):
            found.append((cost, audit))
        if cost > 12:
            return
        if not audit.endswith("I" * most):
            for r in "ua":
                go(k, out + r, cost + 2, audit + "I")
        if k < len(kinds):
            initial, broken, forced = kinds[k]
            go(k + 1, out, cost + 3, audit + "D")
            if not forced:
                go(k + 1, out + (initial or "x"), cost + broken, audit + "K")
                for r in "ua":
                    go(k + 1, out + r, cost + 2 + broken, audit + "R")

    go(0, "", 0, "")
    return min(found)


def kinds_of(rng, n):
    initials = rng.choice(["sua", "ua", "uuaa", "suax", "ss", "a", "x"])
    return [dialogue.kind_of(rng.choice(initials), rng.random() < 0.2, rng.random() < 0.15) for _ in range(n)]


def test_search_equals_exhaustion():
    rng = random.Random(12)
    for _ in range(150):
        kinds = kinds_of(rng, rng.randint(0, 3))
        assert dialogue.solve(kinds) == every_way(kinds, 2) == cheapest(kinds)
    for _ in range(1500):
        kinds = kinds_of(rng, rng.randint(0, 30))
        assert dialogue.solve(kinds) == cheapest(kinds)


def test_edits_leave_once_all_ways_share_them():
    search = dialogue.Survivors()
    for k in range(10_000):
        search.step(dialogue.kind_of("ua"[k % 2], k % 7 == 0, k % 11 == 5))
    undecided, stack = 0, [leaf for leaf in search.leaves if leaf]
    seen = set()
    while stack:
        node = stack.pop()
        if id(node) not in seen:
            seen.add(id(node))
            stack += [node.parent] if node.parent else []
    assert len(seen) < 50 and len(search.final) > 9_900


def check(out, rows, every):
    got = {r.conv_id: r for r in out}
    assert len(out) == len(got) and set(got) == set(every)
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    for conv in every:
        r = got[conv]
        own = sorted(groups[conv], key=lambda m: (m[0] is not None, m[0] or 0, m[1]))
        turns = [t for t, _, _ in own if t is not None]
        assert r.gaps == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        kinds, seen, counts = [], set(), [0, 0, 0]
        for _, role, text in own:
            bare = text.strip(WHITE)
            blank, twice, broken = not bare, (role, text) in seen, bare[-1:] not in (".", "!", "?")
            for k, fault in enumerate((blank, twice and not blank, broken and not twice and not blank)):
                counts[k] += fault
            seen.add((role, text))
            kinds.append((role[:1], broken, blank or twice))
        assert [r.blank, r.duplicate, r.truncated] == counts
        assert r.illegal == sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip([k for k in kinds], kinds[1:]))
        assert (r.cost, r.audit) == cheapest([dialogue.kind_of(*k) for k in kinds])
        lines, left = [], iter(own)
        for edit in r.audit:
            _, role, text = (None, None, "") if edit == "I" else next(left)
            if edit != "D":
                if edit in "IR":
                    role = "user" if not lines or not lines[-1].startswith("u") else "assistant"
                lines.append(f"{role}:{text}")
        assert next(left, None) is None
        assert re.fullmatch("(s?(ua)+)?", "".join(line[:1] for line in lines))
        assert r.repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def planted(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        deal = zlib.crc32(name.encode()) % 20
        if deal == 0:
            continue
        text = "" if deal == 1 else re.sub("[.!?]", "", text) if deal == 2 else text
        out += [(conv, turn, "user" if deal == 4 else role, text)] * (2 if deal == 3 else 1)
    return out


def test_query_equals_brute_force(spark, data_path):
    table = [tuple(r) for r in spark.read.parquet(f"{data_path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(queries.QUERIES["op12_dialogue"](spark, data_path).collect(), planted(table), {r[0] for r in table})


def odd_rows(n, seed=4):
    """A conversation with most rows beside small ones, nulls, repeats at one turn and at others, and other roles."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        conv = rng.choice([7, 7, 7, 7, rng.randrange(8, 40), None])
        turn = rng.choice([None, *range(n // 2), *range(n // 2)])
        role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "unknown"])
        rows.append((conv, turn, role, rng.choice([None, "", " \n", "Yes.", "No", "Why? ", f"Word {rng.randrange(300)}.", "Long " * 50 + "!"])))
    # one row per turn, save for copies: the order of other rows of a turn is free
    once = {(r[0], r[1]): r for r in rows}
    return list(once.values()) + [rng.choice(list(once.values())) for _ in range(n // 6)]


@pytest.mark.parametrize("ranges", ["3", "40"])
def test_conversations_over_many_ranges(spark, ranges):
    rows = odd_rows(700)
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, part string").repartition(5)
        check(dialogue.repair(df).collect(), rows, {r[0] for r in rows})
        found = dialogue.audits(dialogue.rows_of(df))
        lines = dialogue.repaired(dialogue.rows_of(df), found).filter("conv_id = 7").orderBy("place").collect()
        assert [r.place for r in lines] == list(range(len(lines))) and re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in lines))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_rows_and_far_turns(spark):
    df = spark.createDataFrame([(1, -2 ** 63, "user", "A."), (1, 2 ** 63 - 1, "assistant", "B."), (2, None, None, None)], "conv_id bigint, turn bigint, role string, text string")
    out = {r.conv_id: r for r in dialogue.repair(df).collect()}
    assert (out[1].gaps, out[1].audit, out[2].audit, out[2].gaps, out[2].blank) == (None, "KK", "D", 0, 1)
    empty = dialogue.repair(df.limit(0), df).collect()
    assert sorted((r.conv_id, r.cost, r.audit, r.repaired_sha256) for r in empty) == [(i, 0, "", hashlib.sha256(b"").hexdigest()) for i in (1, 2)]
    assert dialogue.repair(df.limit(0)).count() == 0
