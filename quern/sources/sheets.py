"""Statements in old workbooks: a Kazakh bank's columns, a Polish bank's keyed cells; and rows to measure rules by.

Both are parsers of the registry of ``statements``. ``evaluation_rows`` gives
what rules look at, from these two and from the semicolon format.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date, timedelta
from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.money import EXPONENT
from quern.sources.statements import MOST_BYTES, Line, NotReadable, Profile, Statement, _minor_or_zero, parse_statement, register
from quern.sources.workbooks import MAGIC, Cell, sheet_names, sheet_rows

# The columns of the Kazakh sheet, the sheet of the Polish one, and the keys of its cells, longer ones first.
KZ_DAY, KZ_DOCUMENT, KZ_FLAG, KZ_DEBIT, KZ_CREDIT, KZ_CODE, KZ_PURPOSE, KZ_NAME, KZ_TAX, KZ_ACCOUNT = 0, 1, 3, 10, 12, 16, 17, 19, 20, 21
PL_SHEET, PL_DAY, PL_DETAILS, PL_TYPE, PL_AMOUNT, PL_CURRENCY = "Dane", 0, 2, 3, 4, "Waluta"
PL_KEYS = [
    "Rachunek kontrahenta",
    "Nazwa i adres Kontrahenta",
    "Tytuł",
    "Rachunek",
    "Lokalizacja",
    "Numer karty",
    "Numer referencyjny",
    "Oryginalna kwota operacji",
    "Identyfikator transakcji",
    "Data i czas operacji",
]


def cell_text(cell: Cell) -> str:
    """A cell as text; a number is spelled as one with a point."""
    return str(cell).strip()


def cell_day(cell: Cell) -> str:
    """A day as text; a number counts days."""
    return str(date(1899, 12, 30) + timedelta(days=int(cell))) if isinstance(cell, float) else cell_text(cell)


def cell_number(cell: Cell) -> Decimal:
    """An amount, with its sign; blanks are zero, a comma is a point."""
    text = repr(cell) if isinstance(cell, float) else re.sub(r"[\s\xa0]", "", cell).replace(",", ".")
    try:
        return Decimal(text or "0")
    except InvalidOperation as e:
        raise NotReadable(f"not an amount: {cell!r}") from e


def keyed_cell(cell: str, keys: list[str] = PL_KEYS) -> dict[str, str]:
    """A cell ``key: value | key: value`` by a list of keys; a part that begins with none of them is left out, a key's last value stays."""
    known = re.compile(r"\s*(" + "|".join(map(re.escape, keys)) + r")\s*:\s*(.*)$", re.DOTALL)
    return {m[1]: m[2].strip() for part in cell.split("|") if (m := known.match(part))}


def card_merchant(place: str) -> str:
    """The merchant of a card payment: what follows the last star, if there is one."""
    return place.rpartition("*")[2].strip() if "*" in place else ""


def _at(row: list[Cell], k: int) -> Cell:
    return row[k] if k < len(row) else ""


def _kz(rows: list[list[Cell]]) -> Iterator[tuple[int, list[Cell], bool, Decimal]]:
    """(line, row, is an expense, amount) of each row below the head; whatever is not marked as a debit comes in."""
    for k, row in enumerate(rows[1:], 2):
        yield k, row, cell_text(_at(row, KZ_FLAG)) == "DEBIT", max(cell_number(_at(row, KZ_DEBIT)), cell_number(_at(row, KZ_CREDIT)))


def _pl(rows: list[list[Cell]]) -> Iterator[tuple[int, list[Cell], bool, Decimal, dict[str, str]]]:
    """(line, row, is an expense, amount, keyed values) of each row below the head; one signed amount."""
    for k, row in enumerate(rows[1:], 2):
        signed = cell_number(_at(row, PL_AMOUNT))
        yield k, row, signed <= 0, abs(signed), keyed_cell(str(_at(row, PL_DETAILS)))


def _counterparty(said: dict[str, str]) -> str:
    return said.get("Nazwa i adres Kontrahenta", "") or card_merchant(said.get("Lokalizacja", ""))


def _line(line_no: int, currency: str, expense: bool, amount: Decimal, **named: str) -> Line:
    raw = f"{amount:f}"
    if "." in raw:
        raw = raw.rstrip("0").rstrip(".")
    minor = _minor_or_zero(currency, raw)
    return Line(line_no, debit_raw=raw if expense else "", credit_raw="" if expense else raw, debit_minor=minor if expense else 0, credit_minor=0 if expense else minor, currency=currency, **named)


def parse_kz(raw: bytes, profile: Profile = Profile()) -> Statement:
    out = Statement("columns-kz", currency="KZT")
    for k, row, expense, amount in _kz(sheet_rows(raw)):
        cell = lambda c: cell_text(_at(row, c))  # noqa: B023, E731
        out.lines.append(_line(k, "KZT", expense, amount, booked_on=cell_day(_at(row, KZ_DAY)), document_no=cell(KZ_DOCUMENT), counterparty_name=cell(KZ_NAME), counterparty_tax_id=cell(KZ_TAX), counterparty_account=cell(KZ_ACCOUNT), description=cell(KZ_PURPOSE), regulated_code=cell(KZ_CODE)))
    return out


def parse_pl(raw: bytes, profile: Profile = Profile()) -> Statement:
    """Other sheets of the file are passed over; each row has its own currency."""
    rows = sheet_rows(raw, PL_SHEET)
    place = [cell_text(c) for c in rows[0]].index(PL_CURRENCY) if rows and PL_CURRENCY in map(cell_text, rows[0]) else None
    out = Statement("keyed-pl", currency="PLN")
    for k, row, expense, amount, said in _pl(rows):
        currency = cell_text(_at(row, place)) if place is not None else "PLN"
        if currency not in EXPONENT:
            raise NotReadable(f"unknown currency {currency}")
        out.lines.append(_line(k, currency, expense, amount, booked_on=cell_day(_at(row, PL_DAY)), document_no=said.get("Numer referencyjny", ""), counterparty_name=_counterparty(said), counterparty_account=said.get("Rachunek kontrahenta", ""), description=said.get("Tytuł", "")))
    return out


def _is_pl(raw: bytes) -> bool:
    try:
        return raw.startswith(MAGIC) and PL_SHEET in sheet_names(raw)
    except NotReadable:
        return False


def _is_kz(raw: bytes) -> bool:
    try:
        return raw.startswith(MAGIC) and PL_SHEET not in sheet_names(raw) and any(cell_text(_at(r, KZ_FLAG)) in ("DEBIT", "CREDIT") for r in sheet_rows(raw)[1:])
    except NotReadable:
        return False


register("columns-kz", _is_kz, parse_kz)
register("keyed-pl", _is_pl, parse_pl)

EVALUATION_SCHEMA = "path string, line_no bigint, country string, counterparty string, tax_id string, account string, purpose string, payment_code string, operation_type string, direction string, amount decimal(24,6)"


def _evaluation(raw: bytes) -> Iterator[dict]:
    way = lambda expense: "Expense" if expense else "Income"
    if _is_pl(raw):
        for k, row, expense, amount, said in _pl(sheet_rows(raw, PL_SHEET)):
            yield {"line_no": k, "country": "PL", "counterparty": _counterparty(said), "tax_id": "", "account": said.get("Rachunek kontrahenta", ""), "purpose": said.get("Tytuł", ""), "payment_code": "", "operation_type": cell_text(_at(row, PL_TYPE)), "direction": way(expense), "amount": amount}
    elif _is_kz(raw):
        for k, row, expense, amount in _kz(sheet_rows(raw)):
            cell = lambda c: cell_text(_at(row, c))  # noqa: B023, E731
            yield {"line_no": k, "country": "KZ", "counterparty": cell(KZ_NAME), "tax_id": cell(KZ_TAX), "account": cell(KZ_ACCOUNT), "purpose": cell(KZ_PURPOSE), "payment_code": cell(KZ_CODE), "operation_type": "", "direction": way(expense), "amount": amount}
    else:
        for x in parse_statement(raw).lines:
            debit, credit = cell_number(x.debit_raw), cell_number(x.credit_raw)
            yield {"line_no": x.line_no, "country": "BY", "counterparty": x.counterparty_name, "tax_id": x.counterparty_tax_id, "account": x.counterparty_account, "purpose": x.description, "payment_code": "", "operation_type": "", "direction": way(debit > 0), "amount": max(debit, credit)}


def evaluation_rows(files: DataFrame) -> DataFrame:
    """The rows of all files as rules look at them, with the larger of two amounts or the size of a signed one; files are (path, length, content), and one that cannot be read has no rows."""
    names = [c.split()[0] for c in EVALUATION_SCHEMA.split(", ")]

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, raw in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows = [{"path": path} | r for r in _evaluation(bytes(raw))]
                except NotReadable:
                    rows = []
                yield pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype=object) for c in names})

    return files.where(F.col("length") <= MOST_BYTES).select("path", "content").mapInPandas(batches, EVALUATION_SCHEMA)
