"""Normal forms of descriptions and counterparties, version v1."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NORMALIZE_VERSION = "v1"

# Bank boilerplate that carries no meaning.
NOISE = ["ЧАСТИЧНАЯ ОПЛАТА.", "RACHUNEK KONTRAHENTA:", "TYTUL:", "TYTUŁ:", "/ROC/", "/PURP/", "/URI/"]

# Quotation marks and the no-break space, and what they become.
QUOTES_FROM, QUOTES_TO = "«»“”„‘’ ", "\"\"\"\"\"'' "

# Stand-alone legal forms, tried in this order.
LEGAL_FORMS = [
    "ООО", "ОДО", "ЗАО", "ОАО", "УП", "ЧУП", "ИП", "ТОО", "АО", "ТОВ", "ПАО", "ИНДИВИДУАЛЬНЫЙ ПРЕДПРИНИМАТЕЛЬ",
    "ТОВАРИЩЕСТВО С ОГРАНИЧЕННОЙ ОТВЕТСТВЕННОСТЬЮ", "LLC", "LLP", "LTD", "LIMITED", r"INC\.?", r"CORP\.?", "GMBH", "AB", "OU", "OÜ",
    "SARL", "SRL", "PTY", "BV", "NV", "SA", "AG", "KG", "SPOLKA Z OGRANICZONA ODPOWIEDZIALNOSCIA",
    "SPÓŁKA Z OGRANICZONĄ ODPOWIEDZIALNOŚCIĄ", r"SP\.?\s?Z\.?\s?O\.?\s?O\.?", r"S\.A\.",
]

# Words that begin an address.
ADDRESS_WORDS = ["ADDRESS", "ADRESS", "ARDRESS", "ADRES", r"UL\.", r"STR\.", r"ST\.", "PLAZA", "ROAD"]

_ADDRESS = r"(?U)(?:^|\s)(?:" + "|".join(ADDRESS_WORDS) + r")\b|,|(?<=\s)\d{2,}"
_LEGAL = r"(?U)(?:^|\s)(?:" + "|".join(LEGAL_FORMS) + r")(?=\s|$)"


@F.pandas_udf(T.StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Compatibility composition; Spark has no function for it. ASCII text is in that form, so Python sees the other texts alone."""
    return F.coalesce(_composed(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def join_digits(text: Column) -> Column:
    """Spaces and hyphens between two digits go."""
    return F.regexp_replace(text, r"(?U)(?<=\d)[\s\-]+(?=\d)", "")


def fold_quotes(text: Column) -> Column:
    return F.translate(text, QUOTES_FROM, QUOTES_TO)


def normalize_description(text: Column, composed: bool = False) -> Column:
    """The form that rules are matched against; null and empty give ''.

    Set ``composed`` if the text is known to be in composed form; the plan then has no Python.
    """
    out = F.upper(fold_quotes(F.coalesce(text, F.lit("")) if composed else nfkc(F.coalesce(text, F.lit("")))))
    for noise in NOISE:
        out = F.replace(out, F.lit(noise), F.lit(" "))
    return F.trim(F.regexp_replace(join_digits(out), r"(?U)\s+", " "))


def strip_address(name: Column) -> Column:
    """The name before its address; the first token is never cut."""
    head = F.substring_index(name, " ", 1)
    rest = F.substring(name, F.length(head) + 1, F.length(name))
    at = F.regexp_instr(rest, F.lit(_ADDRESS))
    cut = F.when(at > 0, F.concat(head, F.substring(rest, F.lit(1), at - 1))).otherwise(name)
    return F.regexp_replace(cut, r"(?U)^\s+|\s+$", "")


def strip_legal_forms(name: Column) -> Column:
    return F.regexp_replace(name, _LEGAL, " ")


def counterparty_key(name: Column, tax_id: Column, account: Column, composed: bool = False) -> Column:
    """``tax:``, ``name:`` or ``acct:`` and the identity of a counterparty, or ''."""
    digits = F.regexp_replace(F.coalesce(tax_id, F.lit("")), r"(?U)\D", "")
    bare = strip_address(F.coalesce(name, F.lit("")))
    bare = F.upper(fold_quotes(bare if composed else nfkc(bare)))
    bare = strip_legal_forms(F.regexp_replace(bare, "[\"'`]", " "))
    bare = F.regexp_replace(F.regexp_replace(bare, r"[^\p{L}\p{N}_\s]", " "), r"(?U)\s+", "")
    acct = F.regexp_replace(F.upper(F.coalesce(account, F.lit(""))), r"[^\p{L}\p{N}_]", "")
    return (
        F.when(F.length(digits) >= 8, F.concat(F.lit("tax:"), digits))
        .when(bare != "", F.concat(F.lit("name:"), bare))
        .when(acct != "", F.concat(F.lit("acct:"), acct))
        .otherwise(F.lit(""))
    )


def key_tier(key: Column) -> Column:
    prefix = F.split_part(key, F.lit(":"), F.lit(1))
    return F.when(key == "", "none").when(prefix == "tax", "tax_id").when(prefix == "acct", "account").otherwise(prefix)


def has_replacement_char(text: Column) -> Column:
    return F.contains(text, F.lit("�"))
