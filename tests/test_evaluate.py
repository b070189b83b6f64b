"""Labels, agreement, coverage and residue, and what is left after the largest."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import classify as c
from quern.operators import evaluate, series
from quern.operators.evaluate import LabelIndex, LabelRule


def slow_first(rules, purpose, cp, acct, direction):
    """One rule after the other, as the file is read."""
    for k, r in enumerate(rules):
        held = {"account": acct, "purpose": purpose, "both": purpose + " || " + cp}[r.field]
        if r.counterparty and r.counterparty not in cp:
            continue
        if any(p.strip() and p.strip() not in held for p in r.purpose.split(";")):
            continue
        if r.direction and r.direction != direction:
            continue
        return k
    return -1


def test_first_rule_in_the_file_decides():
    rng = random.Random(2)
    words = ["A", "AB", "BA", "ABA", "C", "AC", "|", "|| C", ""]
    text = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(0, n)))
    for _ in range(300):
        rules = [LabelRule(" ; ".join(text(2) for _ in range(rng.randint(0, 3))), rng.choice(["", "", "AB", "C A"]), rng.choice(["", "Income", "Expense"]), None, rng.choice(["both", "both", "account", "purpose"])) for _ in range(rng.randint(0, 8))]
        index = LabelIndex(rules)
        for _ in range(5):
            row = (text(6), text(4), text(3), rng.choice(["Income", "Expense"]))
            assert index.first(*row) == slow_first(rules, *row), (rules, row)


def test_a_rule_is_compared_with_the_field_of_its_prefix():
    assert [LabelRule.of(x, "N").field for x in ("Rachunek kontrahenta: 1", "Tytuł: x", "TYTUL x", "Rachunek: 1", "")] == ["account", "purpose", "purpose", "both", "both"]


def test_labels_by_country(spark):
    rules = {"PL": [LabelRule("ZUS", code=None, direction="Income"), LabelRule("ZUS", code="0404"), LabelRule("12 34", field="account", code="05")], "BY": [LabelRule(code="09")]}
    rows = spark.createDataFrame(
        [(1, "PL", "ZUS", "", "", "Expense"), (2, "PL", "ZUS", "", "", "Income"), (3, "PL", "OWN 12 34", "12 34", "", "Expense"), (4, "PL", None, None, "A 12 34", "Expense"), (5, "BY", "", "", "", "Income"), (6, "XX", "ZUS", "", "", "Income")],
        "id int, country string, purpose_norm string, counterparty_norm string, account_norm string, direction string",
    )
    got = {r.id: (r.label_rule, r.label) for r in evaluate.label_rows(rows, rules).collect()}
    assert got == {1: (1, "0404"), 2: (0, None), 3: (None, None), 4: (2, "05"), 5: (0, "09"), 6: (None, None)}
    assert evaluate.label_rows(rows.where("false"), rules).count() == 0


def test_verdicts(spark):
    cases = [("0101", "0101", "agreed"), ("01", "0101", "less_specific"), ("0101", "01", "disagreed"), ("0404", "040402", "awaiting_allocation"), ("0199", "0101", "less_specific"), ("0199", "01", "disagreed"), ("02", "01", "disagreed"), (None, "01", "uncovered"), ("01", None, "unlabelled"), (None, None, "uncovered")]
    rows = spark.createDataFrame(cases, "p string, t string, want string").select("want", evaluate.verdict(F.col("p"), F.col("t"), ["0404"], ["0199"]).alias("got"))
    assert all(r.want == r.got for r in rows.collect())


def test_coverage_and_residue(spark):
    rows = [("KZ", v, a, k, k) for v, a, k in [("agreed", -100, "a"), ("disagreed", 50, "a"), ("unlabelled", 50, "b"), ("uncovered", -300, "c"), ("uncovered", 0, "c"), ("uncovered", 1, None)]] + [("PL", "uncovered", 0, "x" * 60, "x" * 60)]
    df = spark.createDataFrame(rows, "country string, verdict string, amount_minor bigint, key string, name string")
    got = {r.country: r for r in evaluate.coverage(df, ["country"], "amount_minor", "key").collect()}
    kz, pl = got["KZ"], got["PL"]
    assert (kz.row_count, kz.matched, kz.residue_keys, kz.rows_pct, kz.agreed_pct, kz.covered_minor) == (6, 3, 2, 50.0, 50.0, 200) and abs(kz.amount_pct - 200 / 501 * 100) < 1e-9
    assert (pl.amount_pct, pl.agreed_pct, pl.covered_minor) == (None, None, 0)
    assert sorted(tuple(r) for r in evaluate.residue(df, ["country"], F.col("name"), 1).collect()) == [("KZ", "c", 2, 1), ("PL", "x" * 52, 1, 1)]


def test_what_is_left_needs_no_sort_of_a_group(spark):
    """One group holds nearly all rows; its largest are found task by task, and a label named other stays apart."""
    rows = spark.range(20_000).select(F.lit(1).alias("g"), F.when(F.col("id") == 19_999, "other").otherwise(F.col("id").cast("string")).alias("label"), (F.col("id") - 5).alias("v"))
    few = spark.createDataFrame([(None, "a", 3), (None, "b", 2), (2, "c", 0)], "g int, label string, v bigint")
    folded = series.fold_top_n(rows.union(few), ["g"], "label", "v", 2)
    total = sum(range(1, 19_995))
    assert {tuple(r) for r in folded.collect()} == {(1, "other", 19_994, False), (1, "19998", 19_993, False), (1, "other", total - 19_994 - 19_993, True), (None, "a", 3, False), (None, "b", 2, False)}
    plan = folded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2, "a limit before the shuffle and one after it"


@pytest.mark.parametrize(
    ("condition", "row", "fits"),
    [
        (c.Condition("description", "contains", "A; B"), {"description_norm": "X A; B"}, True),
        (c.Condition("description", "contains", "A; B"), {"description_norm": "B A"}, False),
        (c.Condition("description", "contains_all", "A; B"), {"description_norm": "B A"}, True),
        (c.Condition("counterparty_account", "any", "12 34"), {"counterparty_account": "PL 12 34 99"}, True),
        (c.Condition("counterparty_account", "any", "12 34"), {"counterparty_account": None}, False),
        (c.Condition("regulated_code", "eq", "Fee"), {"regulated_code": "", "operation_type": "Fee"}, True),
        (c.Condition("regulated_code", "eq", "Fee"), {"regulated_code": "9", "operation_type": "Fee"}, False),
        (c.Condition("direction", "is", "Expense"), {"amount_minor": -1}, True),
        (c.Condition("colour", "eq", "red"), {}, False),
    ],
)
def test_conditions_of_an_evaluation(spark, condition, row, fits):
    base = {"description_norm": "", "counterparty_account": "", "regulated_code": "", "operation_type": "", "amount_minor": 1} | row
    df = spark.createDataFrame([tuple(base.values())], "description_norm string, counterparty_account string, regulated_code string, operation_type string, amount_minor bigint")
    rule = c.Rule("01", 1, (condition,))
    assert df.select(c.rule_matches(rule, evaluation=True)).first()[0] is fits
    if condition.field in ("counterparty_account", "colour") or condition.op in ("contains", "is"):
        with pytest.raises(c.RequestRejected):
            c.rule_matches(rule)
