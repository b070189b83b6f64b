import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from quern.llm.conversation_repair import TURNS, UNIT, Product, best, conversation_digests, damage, digest_columns, power, repair_conversations, times

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
WHITE = " \t\n\x0b\x0c\r"
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def damaged(rows):
    """(conv_id, turn, role, text) after damage, by conversation and in order."""
    said = lambda x: " " if x is None else str(x)
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = said(role), said(text)
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        if kind:
            role = "user" if kind == 4 else role
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    place = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
    return {conv: sorted(x, key=place) for conv, x in out.items()}


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        if not text.strip(WHITE):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if text.strip(WHITE)[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """The first complete way, by cost and then by edits, of all ways in that order; cost, edits, turns."""
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, edits, k, state, turns = heapq.heappop(queue)
        if k == len(rows) and state in ("", "a"):
            return cost, edits, turns
        if (k, state) in done:
            continue
        done.add((k, state))
        for x in set(NEXT[state]) - {"s"}:
            heapq.heappush(queue, (cost + 5, edits + "I", k, x, (*turns, ("user" if x == "u" else "assistant", ""))))
        if k < len(rows):
            _, role, text = rows[k]
            heapq.heappush(queue, (cost + 2, edits + "D", k + 1, state, turns))
            if found[k] not in ("blank", "duplicate"):
                more = 5 * (found[k] == "truncated")
                if role[:1] and role[:1] in NEXT[state]:
                    heapq.heappush(queue, (cost + more, edits + "K", k + 1, role[0], (*turns, (role, text))))
                for x in set(NEXT[state]) - {"s"}:
                    heapq.heappush(queue, (cost + 1 + more, edits + "R", k + 1, x, (*turns, ("user" if x == "u" else "assistant", text))))
    raise AssertionError("there is always a way")


def brute(rows):
    left, out = damaged(rows), []
    for conv in {r[0] for r in rows}:
        own = left.get(conv, [])
        found = faults(own)
        cost, edits, turns = cheapest(own, found)
        at = {r[0] for r in own} - {None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        counts = [found.count(x) for x in ("blank", "duplicate", "truncated")]
        out.append((conv, max(at) - min(at) + 1 - len(at) if at else 0, *counts, illegal, cost, edits, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0]))


@pytest.fixture
def table_of(spark):
    return lambda rows: spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, said string, part int")


def got(df):
    rows = repair_conversations(damage(df), df)
    return sorted((tuple(r) for r in digest_columns(*rows).select(COLUMNS).collect()), key=lambda r: (r[0] is not None, r[0]))


def rows_of(seed, conversations=40, longest=9):
    """Roles of all kinds, white space, copies, ties and nulls."""
    rng = random.Random(seed)
    texts = ["One.", "Two!", "Three?  \n", "open end", "ends, ", "", " \t\r\n", None, "é. x", "Four.", "Five."]
    rows = []
    for conv in range(conversations):
        for k in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.75 else rng.choice(["system", "tool", None, "", "Useful", "apprentice"])
            rows.append((conv, rng.choice([k, k, k, k * 3, None]), role, rng.choice(texts)))
    return [*rows, *rows[:5], (None, 0, "user", "Hi."), (None, None, "assistant", "Yes."), (None, 2, "user", None)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repair_matches_brute_force(table_of, seed):
    rows = rows_of(seed)
    assert got(table_of(rows)) == brute(rows)


def test_test_table(table_of):
    rows = duckdb.sql("select conv_id, turn, role, text from '/root/testdata/sf0.01/conversations.parquet'").fetchall()
    assert got(table_of(rows)) == brute(rows)


def test_long_conversation_over_many_parts(spark, table_of):
    """Conversations of thousands of turns beside short ones, cut into parts wherever they fall, with one very long text and one line many times over."""
    rng = random.Random(7)
    rows = [(1, k, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"Turn {k}.", f"turn {k}", "", "Same."])) for k in range(4000)]
    rows += [(c, k, "user" if k % 2 == 0 else "assistant", f"{k}.") for c in (0, 2, 3) for k in range(4)] + [(4, None, "user", "Again.")] * 1500 + [(5, 0, "user", "x " * 100_000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(table_of(rows)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_product_is_associative():
    rng = random.Random(4)
    turns = [TURNS[rng.choice(list(TURNS))] for _ in range(60)]
    left = UNIT
    for x in turns:
        left = times(left, x)
    right = UNIT
    for x in reversed(turns):
        right = times(x, right)
    tree = Product()
    for x in turns:
        tree.add(x)
    assert left == right == tree.total()
    assert power(turns[0], 5) == times(times(turns[0], turns[0]), times(times(turns[0], turns[0]), turns[0]))
    assert best(None, (1, "K")) == (1, "K") == best((1, "K"), (1, "R"))


def test_repaired_turns_are_well_formed(table_of):
    df = table_of(rows_of(5))
    _, turns = repair_conversations(damage(df), df)
    by = defaultdict(list)
    for r in turns.collect():
        by[r.conv_id].append((r.position, r.role[0], r.edit))
    for x in by.values():
        assert sorted(p for p, *_ in x) == list(range(len(x)))
        assert re.fullmatch("s?(ua)+", "".join(i for _, i, _ in sorted(x)))
    assert conversation_digests(turns).count() == len(by)


def test_empty_table(table_of):
    assert got(table_of([])) == []
