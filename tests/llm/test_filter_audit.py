import itertools
import random
from collections import Counter

import duckdb
import pandas as pd
import pytest

from quern.llm.filter_audit import LETTERS, ORACLE, audit_filters, failures

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
PROSE = " ".join(f"word{k}" for k in range(250))


def split(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def judged(rows, labels):
    """Each row's part, failing letters, good and toxic, by the definition."""
    out = []
    for doc_id, text, lang, *_ in rows:
        t = text or ""
        words = split(t)
        smaller = [r for r in rows if (r[1] or "") == t and None not in (r[0], doc_id) and r[0] < doc_id]
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in t for c in "#$%&*|"), bool(smaller)]
        own = [x for x in labels if doc_id is not None and x[0] == doc_id]
        out.append((lang or "", {x for x, f in zip(LETTERS, fails, strict=True) if f}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    return out


def brute(rows, labels):
    docs, out = judged(rows, labels), []
    for part in {d[0] for d in docs}:
        mine, removed_by, lines = [d for d in docs if d[0] == part], Counter(), []
        for order in map("".join, itertools.permutations(LETTERS)):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                removed_by[x] += len(gone)
                redundant = sum(x in d[1] for d in mine) - len(gone)
                lines.append((part, order, step, len(left), len(gone), redundant, sum(d[1] == {x} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)))
        out += [(*x, removed_by[x[1][x[2] - 1]]) for x in lines]
    return sorted(out)


def rows_of(seed):
    """Texts that fail every set of filters, some of them copies, repeated rows, nulls and white space of all kinds."""
    rng = random.Random(seed)
    texts = [None, "", " \t\n\x0b\x0c\r", "a b", "Ünï code", PROSE, PROSE + " #", PROSE.upper(), "rep " * 300, "REP| " * 300, "x" * 200_000, " ".join(map(str, range(90_000)))]
    rows = [(k, rng.choice(texts), rng.choice([None, "", "en", "de"]), "s") for k in range(60)]
    return [*rows, (None, PROSE, "en", "s"), (None, None, None, "s"), (None, PROSE, "en", "s"), rows[3], rows[3], (4, "another text of id 4", "en", "s")]


LABELS = [(k, k % 2, int(k % 3 == 0)) for k in range(0, 60, 2)] + [(3, 0, None), (3, 1, 0), (None, 1, 1), (999, 1, 1)]


@pytest.fixture
def labels_of(spark):
    return lambda rows: spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, quality int, toxic int, part string")


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_matches_brute_force(docs_of, labels_of, seed):
    rows = rows_of(seed)
    assert sorted(tuple(r) for r in audit_filters(docs_of(rows), labels_of(LABELS)).select(COLUMNS).collect()) == brute(rows, LABELS)


def test_sql_matches_brute_force():
    """The SQL that the query is held to, on the same rows."""
    rows = rows_of(1)
    con = duckdb.connect()
    con.register("d", pd.DataFrame([(r[0], r[1], r[2]) for r in rows], columns=["doc_id", "text", "lang"]).astype({"doc_id": "Int64"}))
    con.register("l", pd.DataFrame(LABELS, columns=["doc_id", "quality", "toxic"]).astype("Int64"))
    con.sql("create view documents as select doc_id, text, lang from d")
    con.sql("create view labels as from l")
    assert sorted(con.sql(ORACLE).project(", ".join(COLUMNS)).fetchall()) == brute(rows, LABELS)


def test_repeated_rows_are_judged_one_by_one(docs_of, labels_of):
    rows = [(1, PROSE)] * 3 + [(2, PROSE), (1, "short")]
    assert Counter((r.doc_id, r.failed) for r in failures(docs_of(rows), labels_of([])).collect()) == {(1, 0): 3, (2, 16): 1, (1, 1): 1}


def test_empty_tables(docs_of, labels_of):
    assert audit_filters(docs_of([]), labels_of(LABELS)).count() == 0
    assert audit_filters(docs_of([(1, None)]), labels_of([])).count() == 600
