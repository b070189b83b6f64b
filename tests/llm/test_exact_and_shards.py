import hashlib
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quern.llm.exact_dedup import drop_exact_copies, exact_groups
from quern.llm.sharding import interleaved_shards

ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b "), (6, "b"), (7, "ü" * 50_000), (8, "ü" * 50_000), (2, "a"), (None, "z"), (None, "z"), (9, "a\x00b")]


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = Counter()
    for i, t in rows:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        out[(i, keep, len(g), i == keep, hashlib.sha256((t or "").encode()).hexdigest())] += 1
    return out


def got(df):
    return Counter(tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


def test_exact_groups(docs_of):
    assert got(exact_groups(docs_of(ROWS))) == brute(ROWS)


def test_exact_groups_with_colliding_digests(docs_of):
    """A digest of one bit: full texts decide."""
    one_bit = lambda c: F.pmod(F.crc32(c.cast("binary")), F.lit(2))
    assert got(exact_groups(docs_of(ROWS), digest=one_bit, salts=3)) == brute(ROWS)


def test_exact_groups_empty(docs_of):
    assert exact_groups(docs_of([])).count() == 0


def test_drop_exact_copies_keeps_columns(docs_of):
    out = drop_exact_copies(docs_of([(1, "a"), (2, "a"), (3, "b")]))
    assert {r.doc_id for r in out.collect()} == {2, 3} and "digest" in out.columns


def test_shards_match_brute_force(docs_of):
    rows = [(k, "t" * (k % 9), "en", None if k % 10 == 0 else "hot" if k % 3 else f"s{k % 5}") for k in range(400)] + [(None, None, "en", "hot"), (5, "x", "en", "hot")]
    shards, seed = 7, 3
    found = interleaved_shards(docs_of(rows), shards=shards, seed=seed, window_rows=2).collect()
    by = defaultdict(list)
    for i, t, _, s in rows:
        body = (t or "").encode()
        by["-" if s is None else "+" + s].append((hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), -1 if i is None else i, zlib.crc32(body), len(body) + 16))
    placed = []
    for s, members in by.items():
        for k, m in enumerate(sorted(members)):
            placed.append(((2 * k + 1) / (2 * len(members)), s, *m))
    placed.sort()
    n = len(placed)
    want = Counter()
    for pos, (_, _, _, i, crc, size) in enumerate(placed):
        shard = pos * shards // n
        want[(None if i == -1 else i, size, crc, "rows", shard, pos - (shard * n + shards - 1) // shards)] += 1
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.slot) for r in found) == want


def test_shards_hold_the_mixture(docs_of):
    rows = [(k, "t", "en", "a" if k % 3 == 0 else "b") for k in range(900)]
    out = interleaved_shards(docs_of(rows), shards=10).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.collect_set("slot").alias("slots")).collect()
    assert [r.n for r in out] == [90] * 10 and all(sorted(r.slots) == list(range(90)) for r in out)


def test_shards_empty(docs_of):
    assert interleaved_shards(docs_of([])).count() == 0
