"""Pseudonyms, by the definition and by fixed values."""

import hashlib
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.functions import pseudonyms as p
from quern.plans import ledger_queries  # noqa: F401
from quern.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"


def number(value, among):
    return int.from_bytes(hashlib.blake2s(b"salt" + value.encode("utf-8"), digest_size=8).digest(), "big") % among


def test_digits_keep_their_places():
    for value in ("BY13 PJCB 3012 0001", "190000001", "0", "x-12/3", "no digit", "", "٣٤"):
        n = len(re.sub(r"\D", "", value))
        want = str(number(value, 10**n)).rjust(n, "7") if n else ""
        got = p.digits(value, "salt")
        assert re.sub(r"\D", "", got) == want and [c for c in got if not c.isdecimal()] == [c for c in value if not c.isdecimal()] and len(got) == len(value)


def test_names_are_drawn_by_their_value():
    assert p.company("ООО Ромашка", "salt") == p.COMPANIES[number("ООО Ромашка", 20)]
    assert p.company("Acme ООО", "salt") == p.LATIN_COMPANIES[number("Acme ООО", 12)] and p.company(" ", "salt") == " "
    who = "ПЕТРОВ ИВАНОВИЧ"
    assert p.person(who, "salt") == " ".join((p.SURNAMES[number(who, 10)], p.GIVEN[number(who + "g", 8)], p.PATRONYMIC[number(who + "p", 6)]))
    assert p.company("ООО Ромашка", "salt") == p.company("ООО Ромашка", "salt") and p.digits("190000001", "other") != p.digits("190000001", "salt")


def test_texts_keep_what_parsers_read():
    text = "ВЫПИСКА С 01.02.2024 ПО 28.02.2024 счет BY13PJCB30120001 УНП 190000001 сумма 12345,67 Сидорову А. Б."
    got = p.preamble(text, "salt")
    assert "01.02.2024" in got and "28.02.2024" in got and "12345,67" in got and "190000001" not in got and "Сидорову" not in got and "BY13PJCB30120001" not in got
    assert p.digits("190000001", "salt") in got, "one value, one replacement, in a text and in a column"
    assert p.preamble("Наименование счета*** ООО Ромашка", "salt") == "Наименование счета*** " + p.company("ООО Ромашка", "salt")
    assert p.purpose("зарплата ПЕТРОВ ИВАНОВИЧ", "salt") == "зарплата " + p.person("ПЕТРОВ ИВАНОВИЧ", "salt") and p.purpose("оплата услуг", "salt") == "оплата услуг"


def test_columns(spark):
    df = spark.createDataFrame([("190000001", None), (None, "ПЕТРОВ ИВАНОВИЧ"), ("190000001", "x")], "a string, b string")
    got = df.select(p.pseudonymised(F.col("a"), "digits", "salt"), p.pseudonymised(F.col("b"), "purpose", "salt")).collect()
    d = p.digits("190000001", "salt")
    assert [tuple(r) for r in got] == [(d, None), (None, p.person("ПЕТРОВ ИВАНОВИЧ", "salt")), (d, "x")]
    for bad in (("colour", "salt"), ("digits", "")):
        with pytest.raises(ValueError):
            p.pseudonymised(F.col("a"), *bad)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_every_customer(spark):
    names = dict(duckdb.sql(f"select c_custkey, c_name from '{DATA}/customer.parquet'").fetchall())
    rows = QUERIES["pseudonymise"](spark, DATA).collect()
    assert len(rows) == len(names)
    for r in rows:
        account = f"BY13 PJCB {r.c_custkey:012d}"
        assert (r.name, r.account) == (p.company(names[r.c_custkey], "salt"), p.digits(account, "salt"))
        assert "ПЕТРОВ ИВАНОВИЧ" not in r.said and "Сидорову" not in r.said and f"{r.c_custkey:012d}" not in r.said and "01.02.2024" in r.said
