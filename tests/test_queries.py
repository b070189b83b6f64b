"""Every ledger query against its SQL, on the smallest test tables."""

import datetime
import decimal
import os

import pytest

from quern.plans import ledger_queries  # noqa: F401
from quern.plans.registry import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return f"{x:.9g}"
    return str(x) if isinstance(x, (datetime.date, decimal.Decimal)) else repr(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    if name in SQL:
        want = duck.sql(SQL[name])
        assert sorted(want.columns) == cols
        assert rows == sorted(tuple(map(plain, r)) for r in want.project(", ".join(f'"{c}"' for c in cols)).fetchall())


def test_pairs_are_candidates_once(spark):
    pairs = [tuple(r) for r in QUERIES["transfer_pairs"](spark, DATA).collect()]
    near = {(r.txn_id, r.candidate_id) for r in QUERIES["transfer_candidates"](spark, DATA).collect()}
    assert pairs and all(p in near for p in pairs) and len({x for p in pairs for x in p}) == 2 * len(pairs)


def test_no_money_is_a_double(spark):
    for name in QUERIES:
        for column, kind in QUERIES[name](spark, DATA).dtypes:
            assert not (column.endswith("_minor") and kind in ("double", "float")), (name, column)


def test_every_file_is_measured(spark):
    import hashlib

    got = {r.file: r for r in QUERIES["file_measure"](spark, DATA).collect()}
    assert set(got) == set(os.listdir(DATA)) and len(got) >= len(TABLES)
    for name, r in got.items():
        with open(f"{DATA}/{name}", "rb") as f:
            raw = f.read()
        assert (r.byte_length, r.file_sha256, r.failure_code) == (len(raw), hashlib.sha256(raw).hexdigest(), None)


def test_large_file_is_not_read(spark, tmp_path):
    from quern.sources import statements

    (tmp_path / "small.csv").write_bytes(b"a;b")
    with open(tmp_path / "large.csv", "wb") as f:
        f.truncate(3 << 30)  # more than one value can hold: reading it would fail
    got = {r.path.rpartition("/")[2]: (r.byte_length, r.file_sha256 is None, r.failure_code) for r in statements.measured_below(spark, str(tmp_path)).collect()}
    assert got == {"small.csv": (3, False, None), "large.csv": (3 << 30, True, "file_too_large")}
