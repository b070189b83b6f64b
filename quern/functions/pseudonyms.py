"""Pseudonyms for statements that leave the house: names, accounts and persons replaced, amounts and days kept.

A replacement is drawn by a salted digest of the value alone, so a value has
the same one in every column, text and file, without a table of pairs that could
be turned round. Digits keep their number and place, because parsers check them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The names that stand in, and the shapes that are looked for.
COMPANIES = ["ГРАНИТ ПЛЮС", "ВЕКТОР ТРЕЙД", "СЕВЕРНЫЙ ПУТЬ", "АЛЬФА СИСТЕМС", "БЕЛАЯ РЕКА", "ТЕХНОПАРК СИТИ", "МЕРИДИАН ГРУПП", "ЯНТАРЬ ЛОГИСТИК", "ЗЕЛЁНЫЙ ОСТРОВ", "ПЕРВАЯ СТУДИЯ", "КАСКАД ИНЖИНИРИНГ", "ОРИОН МЕДИА", "ДЕЛЬТА СЕРВИС", "СТРЕЛА КОНСАЛТ", "НОВЫЙ ФОРМАТ", "ПОЛЯРНАЯ ЗВЕЗДА", "КАМЕННЫЙ МОСТ", "ЛИНИЯ РОСТА", "СИНИЙ КИТ", "ТРИ СОСНЫ"]
LATIN_COMPANIES = ["NORTHWIND TRADING", "BLUEPINE SYSTEMS", "CEDAR POINT LLC", "HARBOUR SOFT", "MERIDIAN LABS", "STONEBRIDGE INC", "AMBERWAY GROUP", "FIRSTLIGHT OU", "GREENFIELD SP", "SILVERLAKE AB", "OAKROW LIMITED", "REDCLIFF CORP"]
SURNAMES = ["ИВАНОВ", "ПЕТРОВ", "СИДОРОВ", "КОЗЛОВ", "НОВИКОВ", "МОРОЗОВ", "ВОЛКОВ", "СОКОЛОВ", "ЛЕБЕДЕВ", "ЗАЙЦЕВ"]
GIVEN = ["АЛЕКСЕЙ", "МАРИЯ", "ДМИТРИЙ", "ЕЛЕНА", "СЕРГЕЙ", "ОЛЬГА", "АНДРЕЙ", "ИРИНА"]
PATRONYMIC = ["ВИКТОРОВИЧ", "ПЕТРОВНА", "СЕРГЕЕВИЧ", "ИВАНОВНА", "АНДРЕЕВИЧ", "ОЛЕГОВНА"]
FULL_NAME = re.compile(r"\b[А-ЯЁ]{3,}\s+[А-ЯЁ]{3,}(?:ИЧ|НА|ВНА|ОВИЧ|ЕВИЧ)\b")
SHORT_NAME = re.compile(r"\b[А-ЯЁ][А-ЯЁа-яё]{2,}У?\s+[А-ЯЁ]\.\s?[А-ЯЁ]\.")
IBAN = re.compile(r"\b[A-Z]{2}\d{2}[\sA-Z0-9]{10,32}\b")
LONG_DIGITS = re.compile(r"\b\d{6,}\b")
HOLDER = re.compile(r"(Наименование счета\**\s*)(.+)", re.DOTALL)


def drawn(value: str, salt: str, among: int) -> int:
    """A number below ``among``, by the value and the salt."""
    return int.from_bytes(hashlib.blake2s((salt + value).encode(), digest_size=8).digest(), "big") % among


def company(name: str, salt: str) -> str:
    """A company's name for another, Latin for one with a Latin letter; a blank stays."""
    if not name.strip():
        return name
    pool = LATIN_COMPANIES if re.search("[A-Za-z]", name) else COMPANIES
    return pool[drawn(name, salt, len(pool))]


def digits(value: str, salt: str) -> str:
    """The value with other digits in the same places."""
    n = sum(c.isdecimal() for c in value)
    new = iter(str(drawn(value, salt, 10**n)).rjust(n, "7")) if n else iter("")
    return "".join(next(new) if c.isdecimal() else c for c in value)


def person(name: str, salt: str) -> str:
    return f"{SURNAMES[drawn(name, salt, len(SURNAMES))]} {GIVEN[drawn(name + 'g', salt, len(GIVEN))]} {PATRONYMIC[drawn(name + 'p', salt, len(PATRONYMIC))]}"


def purpose(text: str, salt: str) -> str:
    """A text with the persons that it names, in full or by initials, replaced."""
    text = FULL_NAME.sub(lambda m: person(m[0], salt), text)
    return SHORT_NAME.sub(lambda m: f"{SURNAMES[drawn(m[0], salt, len(SURNAMES))]} А.А.", text)


def preamble(cell: str, salt: str) -> str:
    """A cell above a statement: the holder's name, accounts, long numbers and persons replaced; days stay."""
    if m := HOLDER.fullmatch(cell):
        return m[1] + company(m[2], salt)
    cell = IBAN.sub(lambda m: digits(m[0], salt), cell)
    return purpose(LONG_DIGITS.sub(lambda m: digits(m[0], salt), cell), salt)


KINDS: dict[str, Callable[[str, str], str]] = {"company": company, "digits": digits, "purpose": purpose, "preamble": preamble}


def pseudonymised(value: Column, kind: str, salt: str) -> Column:
    """``value`` with pseudonyms of that kind; each value of a batch is worked out once. Null stays."""
    if kind not in KINDS or not salt:
        raise ValueError("a kind of " + ", ".join(KINDS) + ", and a salt that is kept secret")
    replace = KINDS[kind]

    @F.pandas_udf("string")
    def replaced(values: pd.Series) -> pd.Series:
        known = {v: replace(v, salt) for v in values.dropna().unique()}
        return pd.Series([known.get(v) for v in values], dtype=object)

    return replaced(value)
