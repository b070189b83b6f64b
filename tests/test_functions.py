import hashlib
import re
import unicodedata

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quern.functions import money, periods, text
from quern.operators.dedup import content_key, dedup_hash


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.x for r in df.select("k", make(F.col("v")).alias("x")).orderBy("k").collect()]


def test_exponents():
    assert len(money.EXPONENT) == 177 and {money.EXPONENT[c] for c in ("JPY", "BYN", "KWD", "CLF")} == {0, 2, 3, 4}


@pytest.mark.parametrize(("code", "minor", "shown"), [("BYN", -5, "-0.05"), ("BYN", 123456, "1234.56"), ("JPY", -7, "-7"), ("KWD", 1, "0.001"), ("CLF", 12345, "1.2345"), ("BYN", 9_007_199_254_740_993, "90071992547409.93")])
def test_money_round_trip(spark, code, minor, shown):
    assert column(spark, [minor], lambda c: money.format_money(F.lit(code), c), "bigint") == [shown]
    assert column(spark, [shown], lambda c: money.parse_money(F.lit(code), c)) == [minor]


def test_money_errors(spark):
    for make in (lambda c: money.parse_money(F.lit("BYN"), c), lambda c: money.parse_money(F.lit("XXX"), c)):
        with pytest.raises(PySparkException):
            column(spark, ["1.234"], make)
    assert column(spark, ["1.234", "x", "", ".5", "1.", None], lambda c: money.try_parse_money(F.lit("BYN"), c)) == [None, None, None, None, 100, None]
    assert column(spark, ["1.0"], lambda c: money.try_parse_money(F.lit("JPY"), c)) == [None]


def test_decimal_from_locale(spark):
    given = ["2 009,07", "2 009,07", "2.009,07", "2,009.07", "", " ", "0,00", "-5,5", "+5", "1.5", "abc", "1,2,3", "-", None]
    assert column(spark, given, money.try_decimal_from_locale) == ["2009.07", "2009.07", "2009.07", "2009.07", "0", "0", "0.00", "-5.5", "5", "1.5", None, None, None, None]


def test_percent_and_grouping(spark):
    df = spark.createDataFrame([(1, 3), (-1, 3), (1, 0), (2, -3), (-1, 2000)], "a bigint, b bigint")
    assert [r.p for r in df.select(money.percent_text("a", "b").alias("p")).collect()] == ["33.3", "-33.3", None, "-66.6", "0.0"]
    assert column(spark, [123456789, -5], lambda c: money.grouped_text(F.lit("BYN"), c), "bigint") == ["1\u00a0234\u00a0567,89", "\u22120,05"]


def norm(s):
    if not s:
        return ""
    s = unicodedata.normalize("NFKC", s).translate(str.maketrans(text.QUOTES_FROM, text.QUOTES_TO)).upper()
    for p in text.NOISE:
        s = s.replace(p, " ")
    return re.sub(r"\s+", " ", re.sub(r"(?<=\d)[\s\-]+(?=\d)", "", s)).strip()


TEXTS = [None, "", "  a  b ", "03 5954 0014-67", "1 2 3", "«Рога» и “копыта”", "Частичная оплата. 5", "/ROC/x/PURP/y", "Rachunek kontrahenta:1", "й", "Straße 1 - 2", "ﬁ ① 2 3", "a\tb\nc"]


def test_normalize_description(spark):
    assert column(spark, TEXTS, text.normalize_description) == [norm(t) for t in TEXTS]


def test_counterparty_key(spark):
    rows = [("ООО Ромашка", "190000001", "x"), ("ООО «Ромашка»", "0", ""), ("Ромашка, ООО", "12", ""), ("Acme LTD UL.Nowa 5", "", ""), ("1SERVICE 22 X", None, None), (None, None, "by-12 x"), ("", "", ""), ("000", "000000000", "")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, n string, t string, a string")
    key = text.counterparty_key(F.col("n"), F.col("t"), F.col("a"))
    got = [(r.key, r.tier) for r in df.select("k", key.alias("key"), text.key_tier(key).alias("tier")).orderBy("k").collect()]
    assert got == [("tax:190000001", "tax_id"), ("name:РОМАШКА", "name"), ("name:РОМАШКА", "name"), ("name:ACME", "name"), ("name:1SERVICE", "name"), ("acct:BY12X", "account"), ("", "none"), ("tax:000000000", "tax_id")]


def test_dates_and_periods(spark):
    assert [str(x) if x else x for x in column(spark, ["08.01.2024", "2024-01-08", "08/01/2024", "08-01-2024", " 08.01.2024 ", "31.02.2024", "1.1.2024", None], periods.try_parse_date)] == ["2024-01-08"] * 5 + [None] * 3
    assert [str(x) for x in column(spark, ["2024-02", "2024-Q3", "2024"], periods.period_end)] == ["2024-02-29", "2024-09-30", "2024-12-31"]
    assert column(spark, ["2024-13", "2024-Q5", "x"], periods.period_start) == [None] * 3
    assert [r.period for r in periods.calendar(spark, "2023-11", "2024-02", "quarter").orderBy("period").collect()] == ["2023-Q4", "2024-Q1"]
    with pytest.raises(ValueError, match="after"):
        periods.months_between(spark, "2024-02", "2024-01")
    with pytest.raises(ValueError, match="granularity"):
        periods.period_label(F.lit("x"), "week")


def test_content_hash_has_every_field(spark):
    none = F.lit(None).cast("string")
    key = content_key(F.lit("a"), F.lit("2024-01-08").cast("date"), F.lit(-5), F.lit("BYN"), F.lit("X"), none, none, F.lit(0))
    row = spark.range(1).select(key.alias("k"), dedup_hash(key, F.lit(2)).alias("h")).first()
    assert row.k == "\x1f".join(["a", "2024-01-08", "-5", "BYN", "X", "", "", "0"])
    assert row.h == hashlib.sha256((row.k + "\x1f2").encode()).hexdigest()
