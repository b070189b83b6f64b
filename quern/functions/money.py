"""Money as whole minor units: exponents, parsing and formatting, never through a double."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ISO 4217 codes and the number of their minor-unit digits.
EXPONENT: dict[str, int] = {
    "AED": 2, "AFN": 2, "ALL": 2, "AMD": 2, "ANG": 2, "AOA": 2, "ARS": 2, "AUD": 2, "AWG": 2, "AZN": 2, "BAM": 2, "BBD": 2,
    "BDT": 2, "BGN": 2, "BHD": 3, "BIF": 0, "BMD": 2, "BND": 2, "BOB": 2, "BOV": 2, "BRL": 2, "BSD": 2, "BTN": 2, "BWP": 2,
    "BYN": 2, "BZD": 2, "CAD": 2, "CDF": 2, "CHE": 2, "CHF": 2, "CHW": 2, "CLF": 4, "CLP": 0, "CNY": 2, "COP": 2, "COU": 2,
    "CRC": 2, "CUC": 2, "CUP": 2, "CVE": 2, "CZK": 2, "DJF": 0, "DKK": 2, "DOP": 2, "DZD": 2, "EGP": 2, "ERN": 2, "ETB": 2,
    "EUR": 2, "FJD": 2, "FKP": 2, "GBP": 2, "GEL": 2, "GHS": 2, "GIP": 2, "GMD": 2, "GNF": 0, "GTQ": 2, "GYD": 2, "HKD": 2,
    "HNL": 2, "HTG": 2, "HUF": 2, "IDR": 2, "ILS": 2, "INR": 2, "IQD": 3, "IRR": 2, "ISK": 0, "JMD": 2, "JOD": 3, "JPY": 0,
    "KES": 2, "KGS": 2, "KHR": 2, "KMF": 0, "KPW": 2, "KRW": 0, "KWD": 3, "KYD": 2, "KZT": 2, "LAK": 2, "LBP": 2, "LKR": 2,
    "LRD": 2, "LSL": 2, "LYD": 3, "MAD": 2, "MDL": 2, "MGA": 2, "MKD": 2, "MMK": 2, "MNT": 2, "MOP": 2, "MRU": 2, "MUR": 2,
    "MVR": 2, "MWK": 2, "MXN": 2, "MXV": 2, "MYR": 2, "MZN": 2, "NAD": 2, "NGN": 2, "NIO": 2, "NOK": 2, "NPR": 2, "NZD": 2,
    "OMR": 3, "PAB": 2, "PEN": 2, "PGK": 2, "PHP": 2, "PKR": 2, "PLN": 2, "PYG": 0, "QAR": 2, "RON": 2, "RSD": 2, "RUB": 2,
    "RWF": 0, "SAR": 2, "SBD": 2, "SCR": 2, "SDG": 2, "SEK": 2, "SGD": 2, "SHP": 2, "SLE": 2, "SOS": 2, "SRD": 2, "SSP": 2,
    "STN": 2, "SVC": 2, "SYP": 2, "SZL": 2, "THB": 2, "TJS": 2, "TMT": 2, "TND": 3, "TOP": 2, "TRY": 2, "TTD": 2, "TWD": 2,
    "TZS": 2, "UAH": 2, "UGX": 0, "USD": 2, "USN": 2, "UYI": 0, "UYU": 2, "UYW": 4, "UZS": 2, "VED": 2, "VES": 2, "VND": 0,
    "VUV": 0, "WST": 2, "XAF": 0, "XAG": 0, "XAU": 0, "XBA": 0, "XBB": 0, "XBC": 0, "XBD": 0, "XCD": 2, "XDR": 0, "XOF": 0,
    "XPD": 0, "XPF": 0, "XPT": 0, "XSU": 0, "XUA": 0, "YER": 2, "ZAR": 2, "ZMW": 2, "ZWL": 2,
}


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it; keeps nested expressions small."""
    return F.transform(F.array(value), use)[0]


def exponent_of(code: Column) -> Column:
    """Minor-unit digits of a currency; null for a code that the table does not have."""
    out = F.lit(None).cast("int")
    for digits in sorted(set(EXPONENT.values())):
        out = F.when(code.isin([c for c, n in EXPONENT.items() if n == digits]), F.lit(digits)).otherwise(out)
    return out


def _known(code: Column, digits: Column, value: Column) -> Column:
    return F.when(digits.isNull(), F.raise_error(F.concat(F.lit("unknown currency: "), F.coalesce(code, F.lit("null"))))).otherwise(value)


def format_money(code: Column, minor: Column) -> Column:
    """A decimal string with the currency's digits; no point if it has none. An unknown currency is an error."""

    def shown(v: Column) -> Column:
        size = F.lpad(F.abs(v["minor"]).cast("string"), F.greatest(v["digits"] + 1, F.length(F.abs(v["minor"]).cast("string"))), F.lit("0"))
        cut = F.length(size) - v["digits"]
        text = F.when(v["digits"] == 0, size).otherwise(F.concat(F.substring(size, F.lit(1), cut), F.lit("."), F.substring(size, cut + 1, v["digits"])))
        return _known(code, v["digits"], F.concat(F.when(v["minor"] < 0, F.lit("-")).otherwise(F.lit("")), text))

    return bound(F.struct(exponent_of(code).alias("digits"), minor.alias("minor")), shown)


def try_parse_money(code: Column, text: Column) -> Column:
    """Minor units of a decimal string; null if the currency is unknown, a digit is out of place or there are too many.

    One compiled expression: the point goes, and zeros fill the digits that the text leaves out.
    """
    return _minor(exponent_of(code), text)


def _minor(digits: Column, text: Column) -> Column:
    point = F.instr(text, ".")
    given = F.when(point > 0, F.length(text) - point).otherwise(F.lit(0))
    fits = text.rlike(r"^-?[0-9]+(\.[0-9]*)?$") & (given <= digits) & ~((point > 0) & (digits == 0))
    return F.when(fits, F.concat(F.translate(text, ".", ""), F.repeat(F.lit("0"), F.greatest(digits - given, F.lit(0)).cast("int"))).try_cast("bigint"))


def parse_money(code: Column, text: Column) -> Column:
    """As ``try_parse_money``, but what cannot be read is an error."""
    wrong = F.raise_error(F.concat(F.lit("not an amount of "), F.coalesce(code, F.lit("null")), F.lit(": "), text))
    return F.when(text.isNotNull(), F.coalesce(try_parse_money(code, text), wrong))


def try_decimal_from_locale(text: Column) -> Column:
    """A plain decimal from a bank's spelling; empty is '0', and what is not a number is null.

    Spaces of three kinds go. Of comma and point, the last is the decimal mark
    and the other groups thousands; a lone comma is the mark.
    """
    return _plain(_bare(text))


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.translate(text, " \u00a0\u2007", "")), r"^(-?)\+", "$1")


def _plain(bare: Column) -> Column:
    # ``translate`` drops what has no counterpart, so the mark that groups goes as the other becomes the point.
    plain = F.when(bare.rlike(r"^-?[0-9.]*,[0-9]+$"), F.translate(bare, ",.", ".")).when(bare.rlike(r"^-?[0-9,]*\.[0-9]+$"), F.translate(bare, ",", "")).otherwise(bare)
    return F.when(bare == "", F.lit("0")).when(plain.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), plain)


def with_amounts(rows: DataFrame, digits: str, amounts: dict[str, str]) -> DataFrame:
    """``try_parse_amount`` for several columns at once, given the column of their currency's digits.

    Each step is a projection of its own: what the next one refers to more than
    once is worked out once.
    """
    steps = rows.withColumns({f"__b_{new}": _bare(F.col(old)) for new, old in amounts.items()})
    steps = steps.withColumns({f"__p_{new}": _plain(F.col(f"__b_{new}")) for new in amounts})
    steps = steps.withColumns({new: _minor(F.col(digits), F.col(f"__p_{new}")) for new in amounts})
    return steps.drop(*[f"__{k}_{new}" for new in amounts for k in "bp"])


def try_parse_amount(code: Column, text: Column) -> Column:
    """Minor units from a bank's spelling of an amount; null if it cannot be read."""
    return try_parse_money(code, try_decimal_from_locale(text))


def percent_text(amount: str, base: str) -> Column:
    """One column of whole numbers in percent of another, one decimal, cut off toward zero; null if the base is zero."""
    tenths = f"(({amount}) * 1000L div ({base}))"
    return F.expr(f"CASE WHEN ({base}) != 0 THEN concat(CASE WHEN {tenths} < 0 THEN '-' ELSE '' END, abs({tenths}) div 10, '.', abs({tenths}) % 10) END")


def one_currency(code: Column) -> Column:
    """An aggregate that is the group's only currency; two are an error."""
    return F.when(F.min(code) == F.max(code), F.min(code)).otherwise(F.raise_error(F.lit("mixed currencies in one sum")))


def grouped_text(code: Column, minor: Column, group: str = " ", point: str = ",") -> Column:
    """An amount for a reader: groups of three digits, a true minus sign, the currency's own digits."""
    text = format_money(code, F.abs(minor))
    whole = F.split_part(text, F.lit("."), F.lit(1))
    grouped = F.regexp_replace(whole, r"(?<=[0-9])(?=(?:[0-9]{3})+$)", group)
    fraction = F.when(F.contains(text, F.lit(".")), F.concat(F.lit(point), F.split_part(text, F.lit("."), F.lit(2)))).otherwise(F.lit(""))
    return F.concat(F.when(minor < 0, F.lit("−")).otherwise(F.lit("")), grouped, fraction)
