"""How often queries go through the ledger, and what goes into one task."""

import os
import re

import duckdb
import pytest
from test_queries import plain

from quern.operators import validate
from quern.operators.evaluate import LabelIndex, LabelRule
from quern.plans import ledger_queries  # noqa: F401
from quern.plans.registry import QUERIES, SQL
from quern.sources import carrier

DATA = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def ledger_scans(df):
    return len(re.findall(r"FileScan parquet \[l_orderkey", plan_of(df)))


@needs_tables
@pytest.mark.parametrize(("name", "scans"), [("validate_file", 0), ("outcome", 0), ("overridden_batches", 1), ("tenant_isolation", 0)])
def test_sums_of_the_ledger_are_written_once(spark, name, scans):
    """What stays in the plan after the sums are written: rows of a period are looked up again, all else is not."""
    assert ledger_scans(QUERIES[name](spark, DATA)) == scans


@needs_tables
def test_line_items_go_through_two_shuffles(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = plan_of(carrier.transactions(spark, DATA)).splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    depth = lambda line: re.search(r"[A-Za-z]", line).start()
    at = next(k for k, line in enumerate(lines) if "FileScan parquet [l_orderkey" in line)
    above, shuffles = depth(lines[at]), 0
    for line in reversed([x for x in lines[:at] if re.search(r"[A-Za-z]", x)]):
        if depth(line) < above:
            above = depth(line)
            shuffles += "Exchange hashpartitioning" in line
    assert shuffles == 2


#: Queries on what stands for a transaction, and how often line items are read: decisions' keys are looked for among them once more.
HELD = {"batch_transactions": 1, "review_groups": 1, "review_group_rows": 1, "review_resolve": 2, "pnl_without_transfers": 1, "drill_rows": 1, "operands": 1, "operands_add_up": 1, "pnl_buckets": 1}


@needs_tables
@pytest.mark.parametrize("name", HELD)
def test_transactions_hold_what_stands_for_them(spark, name):
    """No second pass over the ledger for its own history, and no shuffle by an id, by the few categories or by vendors."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "5000")
    try:
        plan = plan_of(QUERIES[name](spark, DATA))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert len(re.findall(r"FileScan parquet \[l_orderkey", plan)) == HELD[name]
    assert not re.search(r"hashpartitioning\((txn_id|category_code)", plan)


@needs_tables
@pytest.mark.parametrize("name", HELD)
def test_rows_that_repeat_an_id_hold_what_all_say(spark, tmp_path, name):
    duck = duckdb.connect()
    for table in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        duck.execute(f"CREATE TABLE {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    duck.execute("INSERT INTO lineitem SELECT * REPLACE (l_quantity + 4 AS l_quantity) FROM lineitem WHERE l_orderkey % 3 = 0")
    duck.execute("INSERT INTO lineitem SELECT * REPLACE (NULL AS l_suppkey, NULL AS l_quantity) FROM lineitem WHERE l_orderkey % 7 = 0")
    for table in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        duck.execute(f"COPY {table} TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    df = QUERIES[name](spark, str(tmp_path))
    cols = sorted(df.columns)
    rows = sorted(repr(tuple(map(plain, r))) for r in df.select(*cols).collect())
    want = duck.sql(SQL[name]).project(", ".join(f'"{c}"' for c in cols)).fetchall()
    assert rows and rows == sorted(repr(tuple(map(plain, r))) for r in want)


def test_file_warnings_read_rows_once(spark, tmp_path):
    row = "batch_id long, booked_on date, document_no string, counterparty_account string, debit_minor long, credit_minor long, currency string"
    import datetime as d

    day = d.date(2024, 1, 5)
    made = [(1, day, "a", "x", 0, 5, "BYN"), (1, day, "a", "x", 0, 5, "BYN"), (1, day, "a", None, 3, 0, "EUR"), (2, day, "b", None, 0, 7, "BYN"), (3, day, "c", "x", 0, 2, "BYN"), (3, day, "c", "x", 0, 2, "EUR")]
    spark.createDataFrame(made, row).write.parquet(str(tmp_path / "rows"))
    files = spark.createDataFrame([(1, "BYN", 0, 7, day, day, 3), (2, "BYN", 0, 6, day, day, 2), (3, "BYN", 0, 4, day, day, None), (4, "BYN", 0, 1, day, day, 0)], "batch_id long, currency string, opening_minor long, closing_minor long, period_from date, period_to date, declared_rows long")
    found = validate.file_warnings(spark.read.parquet(str(tmp_path / "rows")), files)
    assert plan_of(found).count("FileScan parquet") == 1
    assert sorted(map(tuple, found.collect())) == [(1, "duplicate_bank_reference"), (1, "mixed_currency"), (2, "balance_mismatch"), (2, "row_count_mismatch"), (3, "duplicate_bank_reference"), (3, "mixed_currency"), (4, "balance_mismatch")]


def test_requests_without_a_file_do_not_meet_in_one_task(spark):
    from pyspark.sql import functions as F

    batches = spark.createDataFrame([(k, "o", "persisting", "f", 1, "t", None) for k in (1, 2)] + [(k, "o", "awaiting_upload", None, None, None, None) for k in (3, 4, 5)] + [(6, "o", "imported", "g", 1, "t", None), (7, "o", "persisting", "g", 1, "t", None), (8, None, "persisting", "f", 1, "t", None), (9, None, "persisting", "f", 1, "t", None)], "batch_id long, org_id string, status string, file_sha256 string, byte_length long, content_type string, failure_code string")
    asked = spark.createDataFrame([(k, "imported", None) for k in (1, 2, 7, 8, 9, 11)] + [(k, "failed", "late") for k in (3, 4)] + [(5, "uploaded", None), (12, "failed", "late")], "batch_id long, status string, failure_code string")
    done, refused = validate.moved(batches.withColumn("updated_at", F.lit(None).cast("timestamp")), asked, F.current_timestamp())
    assert sorted((r.batch_id, r.status) for r in done.collect()) == [(1, "imported"), (3, "failed"), (4, "failed"), (8, "imported")]
    assert sorted((r.batch_id, r.refused) for r in refused.collect()) == [(2, "already_imported"), (5, "not_measured"), (7, "already_imported"), (9, "already_imported"), (11, "not_found"), (12, "not_found")]
    assert "hashpartitioning(__to" not in plan_of(done)


def test_labels_remember_texts():
    rules = [LabelRule("A |; B", code="1"), LabelRule("A || B", code="2"), LabelRule("A", "C", code="3", field="purpose"), LabelRule("B", code="4"), LabelRule("7", code="5", field="account", direction="Income")]
    index = LabelIndex(rules)
    texts = ["", "A", "B", "A |", "C A", "B C", "A || B"]
    for _ in range(2):
        for p in texts:
            for c in texts:
                for account in ("", "7"):
                    for way in ("Income", "Expense"):
                        both = f"{p} || {c}"
                        held = lambda r: all(x in {"both": both, "purpose": p, "account": account, "counterparty": c}[f] for f, x in r.parts())  # noqa: E731, B023
                        assert index.first(p, c, account, way) == next((k for k, r in enumerate(rules) if held(r) and r.direction in ("", way)), -1)
    for seen in (index._purpose, index._counterparty):
        assert seen.cache_info().misses == len(texts)
