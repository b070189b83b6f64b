import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import near_dedup as nd
from quern.llm.components import components
from quern.llm.textkit import shingle_set, text_bytes, word_hashes


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


def test_groups_match_brute_force(docs_of):
    rng = random.Random(5)
    rows = []
    for g in range(12):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice([3, 8, 60, 400]))]
        rows += [(len(rows) + k, edited(rng, base, k % 5)) for k in range(8)]
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "Only Three WORDS"), (9004, "only  three\twords"), (9005, "one"), (9006, "ONE"), (9007, "x " * 30_000), (9008, "x " * 30_001)]
    rng.shuffle(rows)
    assert got(nd.near_groups(docs_of(rows))) == brute(rows)


def test_large_group_with_links_that_miss_the_hub(docs_of):
    """Copies of copies: many are linked to some members only."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(150)]
    rows = [(k, edited(rng, base, rng.randrange(9))) for k in range(250)]
    assert got(nd.near_groups(docs_of(rows))) == brute(rows)


def test_a_bucket_of_thousands_matches_brute_force(docs_of):
    """One bucket of 5,000 edited copies, in which many links have no hub; shared shingles are those of the base alone."""
    rng, n, length = np.random.default_rng(6), 5000, 60
    held = np.ones((n, length - 4), np.float32)
    rows = []
    for k in range(n):
        words = [f"w{x}" for x in range(length)]
        for at in rng.choice(length, rng.integers(0, 5), replace=False):
            words[at] = f"new{k}x{at}"
            held[k, max(0, at - 4) : at + 1] = 0
        rows.append((k, " ".join(words)))
    both = held @ held.T
    alike = (100 * both >= 75 * (2 * (length - 4) - both)) | np.eye(n, dtype=bool)
    root = np.arange(n)
    while True:
        least = np.where(alike, root[None, :], n).min(1)
        if (least == root).all():
            break
        root = least
    assert {k: v[1] for k, v in got(nd.near_groups(docs_of(rows))).items()} == dict(enumerate(root.tolist()))


def test_blocks_of_a_large_bucket(docs_of, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 16)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    rows = [(k, edited(rng, base, rng.randrange(7))) for k in range(120)]
    assert got(nd.near_groups(docs_of(rows))) == brute(rows)


def test_repeated_and_null_ids(docs_of):
    out = nd.near_groups(docs_of([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "q"), (2, "z")])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in out) == [(-1, -1, True), (-1, 1, False), (1, 1, True), (1, 1, True), (2, 2, True)]


def test_empty_and_kept_columns(docs_of):
    assert nd.near_groups(docs_of([])).count() == 0
    out = nd.drop_near_copies(docs_of([(3, "a b c d e f g"), (1, "a b c d e f g"), (2, None)]))
    assert sorted(r.doc_id for r in out.collect()) == [1, 2] and "node" in out.columns


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \t\n\x0b\x0c\r\x1c \U0001f4da", max_size=40)), max_size=8))
def test_word_hashes_cut_the_same_words(texts):
    import pyarrow as pa

    data, offsets = text_bytes(pa.array(texts, pa.string()))
    word, at = word_hashes(data, offsets)
    names = {}
    for k, t in enumerate(texts):
        want = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        own = word[at[k] : at[k + 1]].tolist()
        assert len(own) == len(want)
        for h, w in zip(own, want, strict=True):
            assert names.setdefault(h, w) == w


def test_signature_agrees_as_the_sets_do():
    """Over many pairs of sets, equal bins are as frequent as the common share, with few and with many shingles."""
    rng = np.random.default_rng(2)
    for size in (8, 60, 2000):
        share = []
        for _ in range(200):
            pool = rng.integers(0, 1 << 63, size + size // 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            a, b = np.unique(pool[:size]), np.unique(pool[size // 4 :])
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            share.append((nd.signature(a) == nd.signature(b)).mean() - true)
        assert abs(np.mean(share)) < 0.03


def test_short_text_is_one_shingle():
    word, _ = word_hashes(*text_bytes(__import__("pyarrow").array(["a b c"])))
    assert len(shingle_set(word)) == 1


def test_components_of_a_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, x) for x in range(200, 230)] + [(5, 5)]
    out = {r.node: r.component for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert out == {k: 0 for k in range(1, 41)} | {k: 100 for k in range(200, 230)}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
