from datetime import date

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quern.functions.periods import calendar
from quern.operators import classify as c
from quern.operators import pnl, review, series, transfers, validate
from quern.sources import carrier, sinks
from quern.tenant import TenantContext

TXN = "txn_id string, org_id bigint, entity_id bigint, source_kind string, booked_on date, reported_minor bigint"
CLS = "classification_id string, txn_id string, org_id bigint, category_code string, engine_layer string, superseded_by string, retracted_on date"


def books(spark, rows):
    """Rows (category or None, amount, source_kind, day) as transactions and their classifications."""
    txn = spark.createDataFrame([(f"t{k}", 1, 1, kind, day, amount) for k, (_, amount, kind, day) in enumerate(rows)], TXN)
    said = spark.createDataFrame([(f"c{k}", f"t{k}", 1, code, "L1", None, None) for k, (code, *_) in enumerate(rows) if code], CLS)
    return txn, said, carrier.categories(spark)


DAY = date(2024, 1, 15)


def lines(report, period="2024-01"):
    return {r.line: (r.amount_minor, r.percent_of_revenue) for r in report.where(F.col("period") == period).collect()}


def test_chain_and_signs(spark):
    rows = [("0101", 1_000_000), ("02", -300_000), ("03", -50_000), ("0401010204", -200_000), ("05", -20_000), ("06", -10_000), ("07", -84_000)]
    out = lines(pnl.management_pnl(*books(spark, [(a, b, "bank", DAY) for a, b in rows]), calendar(spark, "2024-01", "2024-01")))
    assert [out[x][0] for x in ("91", "92", "93", "94", "95", "04")] == [700_000, 650_000, 430_000, 420_000, 336_000, 200_000]
    assert out["91"][1] == pytest.approx(70.0)


def test_buckets_conserve_every_row(spark):
    rows = [("0101", 900_000, "bank"), ("02", -100_000, "bank"), (None, -70_000, "bank"), ("08", -50_000, "bank"), ("0404", -30_000, "bank"), ("0101", 11_000, "ledger")]
    tagged = pnl.tag_lines(*books(spark, [(*r, DAY) for r in rows]))
    sums = {r.line: r.amount_minor for r in pnl.line_sums(tagged).collect()}
    assert sums == {"01": 900_000, "02": -100_000, "unclassified": -70_000, "non_pnl": -50_000, "unallocated": -30_000, "other_basis": 11_000}
    assert sum(sums.values()) == sum(r[1] for r in rows)


def test_precision_zero_revenue_and_empty_periods(spark):
    txn = books(spark, [("0101", 9_007_199_254_740_993, "bank", DAY)])
    report = pnl.management_pnl(*txn, calendar(spark, "2024-01", "2024-03"))
    assert lines(report)["01"][0] == 9_007_199_254_740_993
    assert lines(report, "2024-02")["01"] == (0, None)
    assert lines(report, "total")["01"][0] == 9_007_199_254_740_993


def test_unknown_section_and_row_outside_the_range_are_errors(spark):
    txn, said, dim = books(spark, [("0101", 5, "bank", DAY)])
    with pytest.raises(Exception, match="outside the range"):
        pnl.management_pnl(txn, said, dim, calendar(spark, "2025-01", "2025-01")).collect()
    with pytest.raises(Exception, match="unknown section"):
        pnl.line_sums(pnl.tag_lines(txn, said, dim.withColumn("section", F.lit("99")))).collect()


def test_cell_is_the_sum_of_its_rows_and_paging_loses_none(spark):
    rows = [("0101", k, "bank", date(2024, 1, 1 + k % 28)) for k in range(57)]
    tagged = pnl.tag_lines(*books(spark, rows))
    seen, after = [], None
    while True:
        page = pnl.drill_rows(tagged, "01", after, 10).collect()
        seen += page[:10]
        if len(page) <= 10:
            break
        after = (str(page[9].booked_on), page[9].txn_id)
    assert len({r.txn_id for r in seen}) == len(seen) == 57 and sum(r.reported_minor for r in seen) == sum(r[1] for r in rows)


def test_strip_with_split_and_dismissed_pairs(spark):
    moves = [(30_000, 2), (-12_000, 2), (50_000, 1), (-40_000, 3), (40_000, 4), (9_000, 3), (-9_000, 3), (60_000, 4)]
    txn = spark.createDataFrame([(f"t{k}", 1, 1, "bank", date(2024, m, 10), a) for k, (a, m) in enumerate(moves)], TXN)
    members = spark.createDataFrame([("t3", "p", False), ("t4", "p", False), ("t5", "q", True), ("t6", "q", True)], "txn_id string, transfer_id string, dismissed boolean")
    out = {r.period: r for r in pnl.reconciliation(txn, members, calendar(spark, "2024-02", "2024-05")).collect()}
    assert (out["2024-02"].opening_minor, out["2024-02"].inflow_minor, out["2024-02"].outflow_minor) == (50_000, 30_000, 12_000)
    assert (out["2024-03"].transfers_minor, out["2024-03"].transfer_rows, out["2024-03"].inflow_minor) == (40_000, 1, 9_000)
    assert out["2024-04"].transfers_minor == -40_000 and out["2024-05"].closing_minor == out["2024-05"].opening_minor == 128_000
    for r in out.values():
        assert r.opening_minor + r.inflow_minor - r.outflow_minor - r.transfers_minor == r.closing_minor


def test_operands():
    assert pnl.operands("91") == [("01", "plus"), ("02", "minus")] and pnl.operands("93")[0] == ("92", "plus")


def test_tenant_context(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "org_id bigint, x string")
    with pytest.raises(ValueError, match="organisation"):
        TenantContext(None, {})
    ctx = TenantContext(1, {"own": lambda: rows, "dim": lambda: rows}, frozenset({"dim"}))
    assert [r.x for r in ctx.table("own").collect()] == ["a"] and sorted(r.x for r in ctx.table("dim").collect()) == ["a", "c"]


# Transfers.

MOVE = "txn_id bigint, entity_id bigint, source_kind string, account_id bigint, booked_on date, amount_minor bigint"


def test_nearest_and_pairs(spark):
    rows = [(1, 1, "bank", 1, date(2024, 1, 9), -100), (2, 1, "bank", 1, date(2024, 1, 10), -100), (3, 1, "bank", 1, date(2024, 1, 11), -100), (4, 1, "bank", 2, date(2024, 1, 10), 100), (5, 2, "bank", 2, date(2024, 1, 10), 100), (6, 1, "ledger", 2, date(2024, 1, 10), 100), (7, 1, "bank", 3, date(2024, 1, 14), 100), (8, 1, "bank", 1, date(2024, 1, 14), 0)]
    txn = spark.createDataFrame(rows, MOVE)
    assert {r.txn_id: r.candidate_id for r in transfers.nearest(txn).collect()} == {1: 4, 2: 4, 3: 4, 4: 2, 7: 3}
    assert sorted((r.out_id, r.in_id) for r in transfers.pairs(txn).collect()) == [(2, 4), (3, 7)]


def test_pairs_match_one_sequential_pass(spark):
    import random

    rng = random.Random(2)
    rows = [(k, rng.randrange(2), "bank", rng.randrange(3), date(2024, 1 + rng.randrange(6), 1 + rng.randrange(28)), rng.choice([-5, 5, -7, 7])) for k in range(300)]
    got = {(r.out_id, r.in_id) for r in transfers.pairs(spark.createDataFrame(rows, MOVE)).collect()}
    want = set()
    for e in range(2):
        for size in (5, 7):
            seq = sorted((r[4].toordinal(), r[0], r[3], r[5]) for r in rows if r[1] == e and abs(r[5]) == size)
            want |= set(transfers.pair_in_order(seq))
    assert got == want and len({x for p in got for x in p}) == 2 * len(got)


@pytest.mark.parametrize(("seed", "accounts", "per_day"), [(1, 2, 1), (2, 3, 4), (3, 5, 9), (4, 1, 3)])
def test_a_dense_amount_is_paired_in_pieces(spark, seed, accounts, per_day):
    """One amount with rows on every day of two months, of which some are missed by all partners, and free rows that cross many borders."""
    import random

    rng = random.Random(seed)
    rows = [(k, 1, "bank", rng.randrange(accounts), date.fromordinal(date(2024, 1, 1).toordinal() + (k // per_day)), rng.choice([-5, 5]) if k // per_day % 20 < 12 else rng.choice([-5, 5, 5, 5])) for k in range(60 * per_day)]
    txn = spark.createDataFrame(rows, MOVE)
    want = set(transfers.pair_in_order(sorted((r[4].toordinal(), r[0], r[3], r[5]) for r in rows)))
    for piece_days in (4, 7):
        assert {(r.out_id, r.in_id) for r in transfers.pairs(txn, piece_days=piece_days).collect()} == want
    pieces = transfers.dated_pieces(txn, transfers.DAYS, 7, None).groupBy(*transfers.PIECE).count().collect()
    assert len(pieces) >= 9 and max(r["count"] for r in pieces) <= 7 * per_day
    with pytest.raises(ValueError):
        transfers.pairs(txn, piece_days=3)


def test_a_free_row_that_moves_every_pair_after_it(spark):
    """Rows of one account and the other by turns, each taking the row of the day before: the first one decides about all pieces."""
    turns = [(k, 1, "bank", 1 + k % 2, date.fromordinal(738000 + 2 * k), 5 if k % 2 else -5) for k in range(40)]
    for rows in (turns, turns[1:]):
        want = set(transfers.pair_in_order(sorted((r[4].toordinal(), r[0], r[3], r[5]) for r in rows)))
        assert {(r.out_id, r.in_id) for r in transfers.pairs(spark.createDataFrame(rows, MOVE), piece_days=4).collect()} == want and len(want) >= 19


def test_pairing_holds_the_last_days_only():
    """A row on each of many days, all of one sign: what is held doesn't grow with the sequence."""
    p = transfers.Pairing()
    for k in range(2000):
        assert p.take(k // 5, k, k % 3, 7) is None
        assert sum(len(q) for day in p.free[1].values() for q in day.values()) <= 5 * (transfers.DAYS + 1)
    assert p.take(399, 9999, 0, -7) == (9999, 1996)


def test_pairing_matches_a_scan_of_all_free_rows():
    import random

    rng = random.Random(8)
    for _ in range(50):
        seq = sorted((rng.randrange(30), k, rng.choice([None, 1, 2, 3]), rng.choice([-5, 5])) for k in range(150))
        free, want = [], []
        for day, k, account, amount in seq:
            fits = [(day - d, i, (d, i, a, m)) for d, i, a, m in free if m == -amount and a != account and day - d <= 3]
            if fits:
                free.remove(match := min(fits, key=lambda f: f[:2])[2])
                want.append((k, match[1]) if amount < 0 else (match[1], k))
            else:
                free.append((day, k, account, amount))
        assert transfers.pair_in_order(seq) == want


# Rules.


def one(spark, rules, vendors=(), threshold=0.0, **row):
    base = {"txn_id": "t", "batch_id": 1, "org_id": 1, "counterparty_key": "name:X", "description_norm": "RENT MAY", "amount_minor": -1000, "currency": "BYN", "regulated_code": None, "account_id": "a", "source_kind": "bank"} | row
    kinds = "txn_id string, batch_id int, org_id bigint, counterparty_key string, description_norm string, amount_minor bigint, currency string, regulated_code string, account_id string, source_kind string"
    txn = spark.createDataFrame([tuple(base.values())], kinds)
    memory = spark.createDataFrame(list(vendors), "org_id bigint, counterparty_key string, category_code string")
    out = c.classify(txn, rules, memory, threshold).collect()
    return (out[0].category_code, out[0].engine_layer, float(out[0].confidence), out[0].evidence) if out else None


def rule(code, priority, *conditions, **rest):
    return c.Rule(code, priority, tuple(c.Condition(*x) if isinstance(x, tuple) else x for x in conditions), **rest)


def test_layers_come_in_order(spark):
    textual, regulated = rule("02", 1, ("description", "contains_all", "RENT; MAY")), rule("03", 9, ("direction", "eq", "Expense"), ("regulated_code", "eq", "5"))
    assert one(spark, [textual, regulated]) == ("02", "L1", 0.95, "global")
    assert one(spark, [textual, regulated], regulated_code="5") == ("03", "L0.5", 0.99, "global")
    assert one(spark, [textual], [(1, "name:X", "04")]) == ("04", "L0", 1.0, "name")
    assert one(spark, [textual], [(2, "name:X", "04")]) == ("02", "L1", 0.95, "global")
    assert one(spark, [textual], [(1, "", "04")], counterparty_key="") == ("02", "L1", 0.95, "global")


def test_own_rules_first_then_priority(spark):
    rules = [rule("02", 1, ("description", "contains_all", "RENT")), rule("03", 50, ("description", "contains_all", "RENT"), org_owned=True), rule("04", 0, ("description", "contains_all", "RENT"), active=False)]
    assert one(spark, rules)[0] == "03"


@pytest.mark.parametrize(("condition", "row", "fits"), [
    (c.Condition("amount", "gte", currency="BYN", minor_units=-1000), {}, True),
    (c.Condition("amount", "lte", currency="BYN", minor_units=-1001), {}, False),
    (c.Condition("amount", "gte", currency="EUR", minor_units=-9999), {}, False),
    (c.Condition("amount", "gte", minor_units=-9999), {}, False),
    (c.Condition("account", "eq", "a"), {}, True),
    (c.Condition("counterparty_key", "eq", "name:Y"), {}, False),
    (c.Condition("direction", "eq", "income"), {"amount_minor": 0}, True),
    (c.Condition("description", "contains_all", " ; "), {}, True),
])
def test_conditions(spark, condition, row, fits):
    assert (one(spark, [rule("02", 1, condition)], **row) is not None) == fits


def test_source_kind_and_threshold(spark):
    r = rule("02", 1, ("description", "contains_all", "RENT"), source_kind="bank")
    assert one(spark, [r]) and one(spark, [r], source_kind="ledger") is None and one(spark, [r], threshold=0.96) is None


def test_requests_are_refused_whole(spark):
    none = spark.createDataFrame([], "category_code string")
    with pytest.raises(c.RequestRejected, match="unknown_category"):
        c.check_request([rule("77", 1, ("account", "eq", "a"))], none, ["01"])
    with pytest.raises(c.RequestRejected, match="unsupported_normalize_version"):
        c.check_request([], none, [], "v9")
    for bad, code in [(("description", "eq", "x"), "unsupported_operator"), (("amount", "eq", "x"), "unsupported_operator"), (("account", "gte", "x"), "unsupported_operator"), (("colour", "eq", "x"), "unsupported_field")]:
        with pytest.raises(c.RequestRejected, match=code):
            c.rule_matches(rule("02", 1, bad))
    with pytest.raises(c.RequestRejected, match="empty_matcher"):
        c.Rule.from_matcher('{"all": []}', category_code="02", priority=1)
    assert c.Rule.from_matcher('{"source_kind": "bank", "all": [{"field": "amount", "op": "gte", "amount": {"currency_code": "BYN", "minor_units": 5}}]}', category_code="02", priority=1).conditions[0].minor_units == 5


# Review.


def test_decision_classifies_remembers_and_is_undone(spark):
    txn = spark.createDataFrame([("t1", 1, 1, "k", "K", 5, date(2024, 1, 1)), ("t2", 1, 1, "k", "K", -7, date(2024, 1, 2)), ("t3", 1, 2, "k", "K", 9, date(2024, 1, 3))], "txn_id string, org_id bigint, entity_id bigint, counterparty_key string, counterparty_raw string, reported_minor bigint, booked_on date")
    said = spark.createDataFrame([("c2", "t2", 1, "02", "L1", None, None)], CLS)
    made = spark.createDataFrame([(1, 1, "k", "categorised", "05", date(2024, 2, 1))], "org_id bigint, entity_id bigint, counterparty_key string, outcome string, category_code string, decided_on date")
    new, vendors, log = review.resolve(txn, said, made)
    assert [(r.txn_id, r.category_code) for r in new.collect()] == [("t1", "05")] and vendors.count() == 1
    assert (log.first().covered_count, log.first().covered_minor) == (1, 5)
    after = review.supersede(said, new)
    assert pnl.live(after).where("txn_id = 't1'").count() == 1 and c.assert_live_once(after).count() == 0
    retract, stay = review.undo(txn, after, vendors, made)
    assert [r.txn_id for r in retract.collect()] == ["t1"] and stay.count() == 0


# Validation.


def test_one_row_per_fault(spark):
    fine = {"batch_id": 1, "line_no": 1, "currency": "BYN", "booked_on": "01.06.2024", "debit": "1,00", "credit": "0,00", "description": "x", "counterparty": "c", "document_no": "1"}
    faults = [({}, []), ({"booked_on": "31.02.2024"}, ["date_implausible"]), ({"booked_on": "01.01.2001"}, ["date_implausible"]), ({"booked_on": "01.07.2024"}, []), ({"booked_on": "02.07.2024"}, ["date_implausible"]),
              ({"debit": "x"}, ["amount_unparseable"]), ({"credit": "2,00"}, ["debit_and_credit_both_set"]), ({"counterparty": "�"}, ["replacement_character"]), ({"description": " "}, ["description_missing"]), ({"description": None}, ["description_missing"])]
    rows = spark.createDataFrame([tuple((fine | x | {"line_no": k}).values()) for k, (x, _) in enumerate(faults)], "batch_id int, line_no int, currency string, booked_on string, debit string, credit string, description string, counterparty string, document_no string")
    got = {}
    for r in validate.row_errors(rows, "2024-06-30").collect():
        got.setdefault(r.line_no, []).append(r.code)
    assert got == {k: codes for k, (_, codes) in enumerate(faults) if codes}


def test_report_is_capped_by_rank_not_by_row(spark):
    errors = spark.createDataFrame([(1, k, "f", "c", "é" * 300) for k in range(150)], "batch_id int, line_no int, field string, code string, raw string")
    import json

    out = json.loads(validate.report_json(errors).first().report)
    assert out["error_count"] == 150 and len(out["errors"]) == 100 and len(out["errors"][0]["raw"].encode()) <= 200


def test_override_needs_reason_role_and_warnings(spark):
    v = spark.createDataFrame([(1, "valid_with_warnings", None), (2, "rejected", None), (3, "valid_with_warnings", "u")], "batch_id int, outcome string, overridden_by string")
    asked = spark.createDataFrame([(1, "approver", "long enough reason", "u1"), (2, "approver", "long enough reason", "u1"), (3, "approver", "long enough reason", "u1"), (1, "viewer", "long enough reason", "u2")], "batch_id int, role string, reason string, user_id string")
    assert [(r.batch_id, r.overridden_by) for r in validate.override(v, asked).collect()] == [(1, "u1")]
    assert validate.override(v, asked.withColumn("reason", F.lit("short"))).count() == 0


# Series and sinks.


def test_top_n_fold(spark):
    rows = spark.createDataFrame([(1, f"l{k}", 10 - k) for k in range(12)], "g int, line string, v bigint")
    out = {r.line: r.v for r in series.fold_top_n(rows, ["g"], "line", "v").collect()}
    assert len(out) == 9 and out["other"] == 3 and out["l0"] == 10


def test_triangle_buckets_keep_ends_and_peaks():
    ys = [0.0] * 50
    ys[23] = 9.0
    kept = series.triangle_buckets(ys, 10)
    assert kept[0] == 0 and kept[-1] == 49 and 23 in kept and len(kept) == 10
    assert series.triangle_buckets([1.0, 2.0], 10) == [0, 1] and series.triangle_buckets(ys, 2) == list(range(50))


def test_projection_of_a_line_and_of_one_point(spark):
    rows = spark.createDataFrame([("a", x, 2 * x + 1) for x in range(5)] + [("b", 7, 3)], "s string, x bigint, y bigint")
    out = {(r.s, r.k): (r.x, r.y) for r in series.project_trend(rows, ["s"], "x", "y", 2).collect()}
    assert out[("a", 1)] == pytest.approx((5, 11)) and out[("a", 2)] == pytest.approx((6, 13)) and out[("b", 1)] == pytest.approx((8, 3))


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("t", 1, "BYN", 1, None, None, date(2024, 1, 1), 5)], "txn_id string, org_id bigint, currency string, line_no int, base_amount_minor bigint, base_currency string, booked_on date, amount_minor bigint")
    sinks.write_ledger(rows, f"{tmp_path}/l")
    back = spark.read.parquet(f"{tmp_path}/l")
    assert back.first().amount_minor == 5 and back.first().month == "2024-01"
    for bad in (rows.withColumn("currency", F.lit("???")), rows.withColumn("line_no", F.lit(0)), rows.withColumn("base_currency", F.lit("USD"))):
        with pytest.raises(PySparkException):
            sinks.checked_ledger(bad).collect()
    batch = spark.createDataFrame([(1, [1, 2], ["{}", '{"a":1}'])], "batch_id int, line_nos array<int>, payloads array<string>")
    assert [(r.line_no, r.payload) for r in sinks.zipped_payloads(batch).collect()] == [(1, "{}"), (2, '{"a":1}')]
    assert sinks.insert_statements(spark.createDataFrame([("a'b", None)], "x string, y string"), "t").first()[0] == "INSERT INTO t (x, y) VALUES ('a''b', NULL);"
    sinks.write_seed(rows, f"{tmp_path}/s")
    assert spark.read.option("header", True).csv(f"{tmp_path}/s").count() == 1


def test_lttb_streams_over_each_series(spark):
    """Points are those of the plain algorithm, and no series is one frame in one task."""
    import random

    rng = random.Random(5)
    sizes = [1, 2, 9, 10, 11, 12, 13, 50, 51, 97, 1000, 3001]
    rows = [(None if n == 13 else n, k, rng.randrange(1000)) for n in sizes for k in range(n)]
    df = spark.createDataFrame(rows, "s bigint, k bigint, y bigint").repartition(5)
    for most in (2, 3, 10, 30):
        out = series.lttb(df, ["s"], ["k"], "y", most)
        assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
        got = sorted((r.s or 0, r.place, r.y) for r in out.collect())
        want = []
        for s in {r[0] for r in rows}:
            ys = [r[2] for r in rows if r[0] == s]
            want += [(s or 0, p, ys[p]) for p in series.triangle_buckets(ys, most)]
        assert got == sorted(want)


def test_two_currencies_are_never_summed(spark):
    txn, said, dim = books(spark, [("0101", 100, "bank", DAY), ("02", -40, "bank", DAY)])
    txn = txn.withColumns({"currency": F.when(F.col("txn_id") == "t1", "PLN").otherwise("BYN"), "base_currency": F.when(F.col("txn_id") == "t1", "BYN")})
    month = calendar(spark, "2024-01", "2024-01")
    assert lines(pnl.management_pnl(txn, said, dim, month, base_currency="BYN"))["91"][0] == 60
    with pytest.raises(PySparkException, match="row in PLN, but the report is in BYN"):
        pnl.management_pnl(txn.withColumn("base_currency", F.lit(None).cast("string")), said, dim, month, base_currency="BYN").collect()


def test_versions_are_of_the_basis_and_the_days(spark):
    txn, said, _ = books(spark, [("02", 1, "bank", DAY), ("02", 1, "ledger", DAY), ("02", 1, "bank", date(2023, 12, 31))])
    said = said.withColumns({"taxonomy_version": F.col("txn_id"), "ruleset_version": F.lit("r"), "engine_version": F.lit("e"), "normalize_version": F.lit("n")})
    assert [r.taxonomy_version for r in pnl.used_versions(txn, said, "bank", "2024-01-01", "2024-01-15").collect()] == ["t0"]
    assert {r.taxonomy_version for r in pnl.used_versions(txn, said, "ledger").collect()} == {"t1"}


def test_drill_down_in_pages(spark):
    rows = spark.createDataFrame([(f"t{k:03d}", date(2024, 1, 30 + k // 200) if k < 400 else date(2024, 2, 1), "04", "04", True, False, k) for k in range(450)] + [("n1", date(2024, 1, 2), "non_pnl", "08", True, False, 5), ("n2", date(2024, 1, 2), "non_pnl", "08", False, False, 7), ("n3", date(2023, 12, 31), "04", "04", True, False, 9)], "txn_id string, booked_on date, line string, section string, is_pnl boolean, requires_allocation boolean, reported_minor bigint")
    ask = lambda label, line, *rest, **more: pnl.drill_down(rows, label, line, "month", "2024-01", "2024-03", *rest, **more)
    seen, cursor = [], ""
    while True:
        page = ask("2024-01", "04", cursor, limit=150)
        assert (page.kind, page.row_count, page.total_minor) == ("transactions", 400, sum(range(400)))
        seen += [r.txn_id for r in page.rows]
        cursor = page.next_cursor
        if not cursor:
            break
    assert seen == [f"t{k:03d}" for k in range(400)]
    first = ask("2024-01", "04", limit=501)
    assert len(first.rows) == 100 and first.next_cursor == "2024-01-30:t099" and len(ask("2024-01", "04", limit=-1).rows) == 100
    assert ask("2024-01", "93") == pnl.DrillDown("operands", (("92", "plus"), ("04", "minus"), ("05", "minus")))
    assert [r.txn_id for r in ask("2024-01", "08").rows] == ["n1"] and ask("2024-01", "non_pnl").row_count == 2 and ask("2024-03", "04").rows == []
    quarter = pnl.drill_down(rows, "2024-Q1", "04", "quarter", "2024-02", "2024-03")
    assert quarter.row_count == 50, "a quarter is clipped to the months that were asked for"
    for bad in (("2024-04", "04"), ("2024-1", "04"), ("2024-01", "section:04"), ("2024-01", "99"), ("2024-01", "04", "2024-01-30"), ("2024-01", "04", "2024-99-99:x"), ("2024-01", "04", "x:y"), ("2023-12", "93")):
        with pytest.raises(ValueError):
            ask(*bad)


def test_selections_and_cursors():
    s = pnl.selection_for("2024-Q1", "unclassified", "quarter", "2024-02", "2025-01")
    assert (s.first, s.last, s.line) == (date(2024, 2, 1), date(2024, 3, 31), "unclassified")
    assert pnl.selection_for("2024", "01", "year", "2023-01", "2025-01").last == date(2024, 12, 31)
    assert pnl.selection_for("2024-02", "09", "month", "2024-02", "2024-02").last == date(2024, 2, 29)
    for bad in (("2024-Q5", "01", "quarter"), ("2024-13", "01", "month"), ("24", "01", "year"), ("2024", "01", "week"), ("2026", "01", "year"), ("2024", "95", "year")):
        with pytest.raises(ValueError):
            pnl.selection_for(*bad, "2023-01", "2025-12")
    assert pnl.parse_cursor("") is None and pnl.parse_cursor("2024-02-29:a:b") == ("2024-02-29", "a:b")
    assert [pnl.line_ref(x)[0] for x in ("01", "08", "91", "other_basis")] == ["section", "section", "computed", "bucket"]


def test_paths_of_any_depth_and_cycles(spark):
    chain = [(k, k - 1 if k else None, f"n{k}") for k in range(21)] + [(100, 999, "orphan")]
    got = dict(c.taxonomy_paths(spark.createDataFrame(chain, "code int, parent_code int, name string")).collect())
    assert got[20] == " > ".join(f"n{k}" for k in range(21)) and got[0] == "n0" and got[100] == "orphan"
    with pytest.raises(ValueError, match="its own ancestor"):
        c.taxonomy_paths(spark.createDataFrame([(1, 3, "a"), (2, 1, "b"), (3, 2, "c"), (4, None, "d")], "code int, parent_code int, name string"))
    assert c.taxonomy_paths(spark.createDataFrame([], "code int, parent_code int, name string")).count() == 0


@pytest.mark.parametrize(
    ("rows", "code"),
    [
        ([("b", "x", "01", "L1", 0.9)], None),
        ([("b", "z", "01", "L1", 0.9)], "unknown_transaction"),
        ([("other", "x", "01", "L1", 0.9)], "unknown_transaction"),
        ([("b", "x", "01", "L1", 0.9), ("b", "x", "02", "L1", 0.9)], "repeated_transaction"),
        ([("b", "x", "", "L1", 0.9)], "incomplete_proposal"),
        ([("b", "x", "01", None, 0.9)], "incomplete_proposal"),
        ([("b", "x", "01", "L1", 1.5)], "bad_confidence"),
        ([("b", "x", "01", "L1", None)], "bad_confidence"),
    ],
)
def test_proposals_fit_what_was_sent(spark, rows, code):
    sent = spark.createDataFrame([("b", "x"), ("b", "y")], "batch_id string, txn_id string")
    proposals = spark.createDataFrame(rows, "batch_id string, txn_id string, category_code string, engine_layer string, confidence double")
    if code is None:
        assert c.checked_proposals(sent, proposals).count() == 1
    else:
        with pytest.raises(c.RequestRejected, match=code):
            c.checked_proposals(sent, proposals)


def test_transfers_pair_on_base_amounts_and_leave_members_out(spark):
    schema = "txn_id bigint, entity_id bigint, account_id bigint, source_kind string, booked_on date, amount_minor bigint, base_amount_minor bigint"
    txn = spark.createDataFrame([(1, 1, 1, "bank", DAY, -100, None), (2, 1, 2, "bank", DAY, 400, 100), (3, 1, 3, "bank", DAY, 100, 25), (4, 1, 4, "bank", DAY, 100, None)], schema)
    assert {tuple(r)[:2] for r in transfers.candidates(txn).collect()} == {(1, 2), (2, 1), (1, 4), (4, 1)}
    paired = spark.createDataFrame([(2,)], "txn_id bigint")
    assert {r.txn_id: r.candidate_id for r in transfers.nearest(txn, members=paired).collect()} == {1: 4, 4: 1}
    assert [tuple(r) for r in transfers.pairs(txn, members=paired).collect()] == [(1, 4)]


def test_nearest_is_the_least_of_all_candidates(spark):
    import random

    rng = random.Random(3)
    rows = [(k, 1, rng.randrange(3), "bank", date(2024, 1, 1 + rng.randrange(12)), rng.choice((-5, 5, -7, 7))) for k in range(120)]
    txn = spark.createDataFrame(rows, "txn_id bigint, entity_id bigint, account_id bigint, source_kind string, booked_on date, amount_minor bigint")
    best = {}
    for r in transfers.candidates(txn).collect():
        best[r.txn_id] = min(best.get(r.txn_id, (9, 0)), (r.days_apart, r.candidate_id))
    assert {r.txn_id: (r.days_apart, r.candidate_id) for r in transfers.nearest(txn).collect()} == best


@pytest.mark.parametrize("block", [1, 3, 256])
def test_candidates_in_blocks_are_all_pairs(spark, block):
    """Rows that repeat, and nulls in any column, an id's too, against all pairs."""
    import random

    rng = random.Random(4)
    maybe = lambda x: None if rng.random() < 0.04 else x
    rows = [(maybe(k), maybe(rng.randrange(2)), maybe(rng.choice(("bank", "ledger"))), maybe(rng.randrange(3)), maybe(date(2024, 1, 1 + rng.randrange(12))), maybe(rng.choice((-5, 5, -7, 7, 0)))) for k in range(300)]
    rows += rows[:40]
    want = [(a[0], b[0], abs((a[4] - b[4]).days)) for a in rows for b in rows if None not in a[1:] + b[1:] and a[1:3] == b[1:3] and a[3] != b[3] and a[5] == -b[5] != 0 and abs((a[4] - b[4]).days) <= 3]
    got = [tuple(r) for r in transfers.candidates(spark.createDataFrame(rows, MOVE), block=block).collect()]
    order = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(got, key=order) == sorted(want, key=order) and any(None in r for r in want)


def test_candidates_of_a_hot_amount_are_spread_over_tasks(spark):
    """One amount of one day, read as one part: its pairs are not made in one task."""
    rows = [(k, 1, "bank", k % 2, date(2024, 1, 9), 5 if k % 2 else -5) for k in range(800)]
    pairs = transfers.candidates(spark.createDataFrame(rows, MOVE).coalesce(1))
    tasks = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 2 * 400 * 400 and len(tasks) >= 3 and max(tasks) <= 160_000


def test_candidates_are_made_a_block_at_a_time(spark):
    """Who reads one row has the rows of one id and one block made, not all pairs of two blocks."""
    rows = [(k, 1, "bank", k % 2, date(2024, 1, 9), 5 if k % 2 else -5) for k in range(400)]
    one = transfers.candidates(spark.createDataFrame(rows, MOVE)).limit(1)
    assert len(one.collect()) == 1
    plan = one._jdf.queryExecution().executedPlan().executedPlan()
    while plan.nodeName() != "Generate":
        plan = plan.children().apply(0) if plan.children().nonEmpty() else plan.plan()
    assert 1 <= plan.metrics().apply("numOutputRows").value() <= transfers.BLOCK


def test_report_cuts_raw_text_to_whole_characters(spark):
    import json

    errors = spark.createDataFrame([("b", k, "f", "c", "a" * k + "ж" * 300) for k in range(2)] + [("b", 2, "f", "c", "x📚" * 100)], "batch_id string, line_no bigint, field string, code string, raw string")
    out = [e["raw"] for e in json.loads(validate.report_json(errors).first().report)["errors"]]
    assert out == ["ж" * 100, "a" + "ж" * 99, "x📚" * 40]


def test_unknown_currency_and_missing_account_are_row_errors(spark):
    rows = spark.createDataFrame([("b", 1, "XYZ", "01.02.2024", "1", "0", "d", "c", "n", "A"), ("b", 2, "BYN", "01.02.2024", "1", "0", "d", "c", "n", " "), ("b", 3, None, "01.02.2024", "1", "0", "d", "c", "n", None)], "batch_id string, line_no bigint, currency string, booked_on string, debit string, credit string, description string, counterparty string, document_no string, account string")
    assert {(r.line_no, r.code) for r in validate.row_errors(rows, "2024-06-30").collect()} == {(1, "currency_unknown"), (2, "account_unresolved"), (3, "currency_unknown"), (3, "account_unresolved")}


def test_accounts_without_a_reference_are_not_made(spark):
    rows = spark.createDataFrame([(1, 1, "A", "BYN"), (1, 1, "A", "EUR"), (1, 1, " ", "BYN"), (1, 1, None, "BYN"), (1, 1, "N", "BYN")], "org_id bigint, entity_id bigint, external_ref string, currency string")
    known = spark.createDataFrame([(1, 1, "A", "acc", "BYN")], "org_id bigint, entity_id bigint, external_ref string, account_id string, currency string")
    found, new = validate.resolve_accounts(rows, known)
    assert {(r.external_ref, r.currency): (r.account_id and r.account_id[:3], r.mixed_currency) for r in found.where("external_ref = 'A' OR account_id IS NULL").collect()} == {("A", "BYN"): ("acc", False), ("A", "EUR"): ("acc", True), (" ", "BYN"): (None, False), (None, "BYN"): (None, False)}
    assert [r.external_ref for r in new.collect()] == ["N"]
