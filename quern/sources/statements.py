"""Bank statement files: measuring, sniffing, decoding and parsing, one file a row.

Files are read by ``binaryFile`` and parsed where they lie, in Arrow batches; a
statement becomes a row with an array of its lines. Files are bounded by the
upload limit, so a row is.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator, Mapping
from dataclasses import asdict, dataclass, field
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.money import EXPONENT

MOST_BYTES = 25 * 1024 * 1024
SAMPLE = 8192


def object_key(org_id: str, batch_id: str) -> str:
    return f"org/{org_id}/batch/{batch_id}"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length and content of every file below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def measured(files: DataFrame) -> DataFrame:
    """path, file_sha256, byte_length, content_type, failure_code; JVM functions only."""
    head = F.substring("content", 1, SAMPLE)
    kind = F.when(F.hex(F.substring("content", 1, 4)) == "504B0304", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet").when(F.hex(head).rlike("^(?:..)*?00"), "application/octet-stream").otherwise("text/plain")
    return files.select("path", F.sha2("content", 256).alias("file_sha256"), F.col("length").alias("byte_length"), kind.alias("content_type"), F.when(F.col("length") > MOST_BYTES, "file_too_large").alias("failure_code"))


def measured_below(spark: SparkSession, path: str) -> DataFrame:
    """``measured`` for every file below ``path``; of a file over the limit only the length is read."""
    files = read_files(spark, path)
    large = files.where(F.col("length") > MOST_BYTES).select("path", F.lit(None).cast("string").alias("file_sha256"), F.col("length").alias("byte_length"), F.lit(None).cast("string").alias("content_type"), F.lit("file_too_large").alias("failure_code"))
    return measured(files.where(F.col("length") <= MOST_BYTES)).unionByName(large)


def sniff(raw: bytes) -> str:
    """The content type by the first bytes."""
    if raw.startswith(b"PK\x03\x04"):
        return "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
    return "application/octet-stream" if b"\0" in raw[:SAMPLE] else "text/plain"


def _cyrillic_score(raw: bytes, codec: str) -> int:
    text = raw[:SAMPLE].decode(codec, "replace")
    return sum(1 if "А" <= ch <= "я" or ch in "ёЁ" else -2 if "─" <= ch <= "◿" else 0 for ch in text)


def detect_charset(raw: bytes) -> str:
    """utf-8 if the bytes are that, else whichever Cyrillic page reads more like Russian; a tie is windows-1251."""
    try:
        raw.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        return "windows-1251" if _cyrillic_score(raw, "cp1251") >= _cyrillic_score(raw, "cp866") else "cp866"


def decode(raw: bytes, charset: str) -> str:
    if charset == "utf-8":
        return raw.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace")
    if charset in ("windows-1251", "cp866"):
        return raw.decode("cp1251" if charset == "windows-1251" else charset, "replace")
    raise ValueError(f"unknown charset {charset!r}")


def zip_name(name: str, is_utf8: bool) -> str:
    """A zip member's name; names not marked as UTF-8 were read as cp437 and are read again."""
    if is_utf8:
        return name
    raw = name.encode("cp437", "replace")
    return decode(raw, detect_charset(raw))


@dataclass
class Line:
    line_no: int
    booked_on: str = ""
    document_no: str = ""
    counterparty_name: str = ""
    counterparty_tax_id: str = ""
    counterparty_account: str = ""
    description: str = ""
    debit_raw: str = ""
    credit_raw: str = ""
    debit_minor: int = 0
    credit_minor: int = 0
    regulated_code: str = ""
    currency: str = ""


@dataclass
class Statement:
    parser: str
    account: str = ""
    holder: str = ""
    currency: str = ""
    period_from: str = ""
    period_to: str = ""
    opening_minor: int | None = None
    closing_minor: int | None = None
    declared_debit_minor: int = 0
    declared_credit_minor: int = 0
    declared_rows: int | None = None
    lines: list[Line] = field(default_factory=list)

    def balance_difference(self) -> int:
        """Opening plus credits less debits less closing; zero if no row was lost."""
        return (self.opening_minor or 0) + sum(x.credit_minor - x.debit_minor for x in self.lines) - (self.closing_minor or 0)


LINE_TYPE = "struct<line_no:bigint,booked_on:string,document_no:string,counterparty_name:string,counterparty_tax_id:string,counterparty_account:string,description:string,debit_raw:string,credit_raw:string,debit_minor:bigint,credit_minor:bigint,regulated_code:string,currency:string>"
STATEMENT_SCHEMA = (
    "path string, error string, parser string, account string, holder string, currency string, period_from string, period_to string, opening_minor bigint, closing_minor bigint, "
    f"declared_debit_minor bigint, declared_credit_minor bigint, declared_rows bigint, lines array<{LINE_TYPE}>"
)


@dataclass(frozen=True)
class Profile:
    """A customer's overrides; a blank one changes nothing. ``columns`` maps source names to canonical ones."""

    charset: str = ""
    delimiter: str = ""
    columns: Mapping[str, str] = field(default_factory=dict)
    decimal_sep: str = ""
    date_format: str = ""

    def source_of(self, canonical: str, built_in: str) -> str:
        return next((s for s, c in sorted(self.columns.items()) if c == canonical), built_in)


    def as_json(self) -> str:
        """What a batch keeps of the profile that it was read with; blank parts are left out."""
        said = {"charset": self.charset, "delimiter": self.delimiter, "decimal_sep": self.decimal_sep, "date_format": self.date_format, "column_map": dict(self.columns)}
        return json.dumps({k: v for k, v in said.items() if v}, ensure_ascii=False)


class NotReadable(ValueError):
    """A file that a parser cannot read."""


_PLAIN = re.compile(r"[0-9]+(?:\.[0-9]+)?")


def amount_minor(currency: str, text: str) -> int:
    """Minor units from a bank's spelling of an amount; ValueError if it cannot be read."""
    text = text.translate(dict.fromkeys(map(ord, "   "))).strip() or "0"
    negative = text.startswith("-")
    text = text.removeprefix("-").removeprefix("+")
    if "," in text:
        mark = "," if text.rfind(",") > text.rfind(".") else "."
        left, _, right = text.rpartition(mark)
        text = (left.replace("." if mark == "," else ",", "") if "." in text else left) + "." + right
    digits = EXPONENT[currency]
    whole, _, fraction = text.partition(".")
    if not _PLAIN.fullmatch(text) or len(fraction) > digits:
        raise ValueError(text)
    return int(whole + fraction.ljust(digits, "0")) * (-1 if negative else 1)


def _minor_or_zero(currency: str, text: str) -> int:
    try:
        return amount_minor(currency, text)
    except (ValueError, KeyError):
        return 0


Parser = Callable[[bytes, Profile], Statement]
_PARSERS: dict[str, tuple[Callable[[bytes], bool], Parser]] = {}


def register(name: str, detect: Callable[[bytes], bool], parse: Parser) -> None:
    if name in _PARSERS:
        raise ValueError(f"parser {name} is registered twice")
    _PARSERS[name] = (detect, parse)


def parse_statement(raw: bytes, profile: Profile = Profile()) -> Statement:
    """The statement by the one parser that claims the file; none or several is an error."""
    _parsers()
    claims = [name for name, (detect, _) in _PARSERS.items() if detect(raw)]
    if len(claims) != 1:
        raise NotReadable(f"unknown format; tried {', '.join(sorted(_PARSERS))}" if not claims else f"claimed by {', '.join(sorted(claims))}")
    return _PARSERS[claims[0]][1](raw, profile)


# The semicolon format of a Belarusian bank. The words it is known by.
_BANK, _HEADER = "Приорбанк", "Дата док"
_OPENING, _CLOSING, _TURNOVER = "Входящее сальдо", "Исходящее сальдо", "Обороты"
_DEBIT, _CREDIT, _EQUIVALENT = "Номинал.Дебет", "Номинал.Кредит", "Эквивалент.Дебет"
_COLUMNS = {
    "document_no": ("document_ref", "N док."),
    "counterparty_name": ("counterparty", "Корреспондент.Название"),
    "counterparty_tax_id": ("", "Корреспондент.УНП"),
    "counterparty_account": ("", "Корреспондент.Счет"),
    "description": ("description", "Назначение"),
}
_DAY = re.compile(r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}")
_SUM_CELL = re.compile(r"[0-9  ]+,[0-9]{2}")
_ACCOUNT = re.compile(r"Счет клиента\**\s*(\S+)(?:\s+([A-Z]{3}))?")
_HOLDER = re.compile(r"Наименование счета\**\s*(.+)$")
_PERIOD = re.compile(r"ВЫПИСКА ПО СЧЕТУ \S+ С ([0-9.]{10}) ПО ([0-9.]{10})")


def _is_semicolon_bank(raw: bytes) -> bool:
    head = raw[:4096]
    text = decode(head, detect_charset(head))
    return _BANK in text and _HEADER in text


def _summary(cells: list[str], currency: str, first_pair: bool) -> tuple[int, int]:
    found = [c for c in cells if _SUM_CELL.fullmatch(c.strip())]
    if len(found) < 2:
        raise NotReadable(f"expected two amounts, found {len(found)}")
    pair = found[:2] if first_pair else found[-2:]
    return amount_minor(currency, pair[0]), amount_minor(currency, pair[1])


def parse_semicolon_bank(raw: bytes, profile: Profile = Profile()) -> Statement:
    """Columns by name, ragged rows, lines numbered as in the file; quotation marks are prose and go."""
    text = decode(raw, profile.charset or detect_charset(raw)).replace('"', "")
    table = [(k, line.rstrip("\r").split(profile.delimiter or ";")) for k, line in enumerate(text.split("\n"), 1) if line.strip("\r")]
    head = next((k for k, (_, cells) in enumerate(table) if cells[0].strip().startswith(_HEADER)), None)
    if head is None:
        raise NotReadable("no header row")
    place = {name.strip(): k for k, name in enumerate(table[head][1])}
    debit, credit = (place.get(profile.source_of(c, b)) for c, b in (("debit", _DEBIT), ("credit", _CREDIT)))
    if debit is None or credit is None:
        raise NotReadable("no nominal debit and credit columns")
    foreign = _EQUIVALENT in place
    out = Statement("semicolon-by")
    for _, cells in table[:head]:
        first = cells[0].strip()
        if m := _ACCOUNT.match(first):
            out.account, out.currency = m[1], m[2] or out.currency
        elif m := _HOLDER.match(first):
            out.holder = m[1].strip()
        elif m := _PERIOD.match(first):
            out.period_from, out.period_to = m[1], m[2]
    out.currency = out.currency or "BYN"
    if out.currency not in EXPONENT:
        raise NotReadable(f"unknown currency {out.currency}")
    cell = lambda cells, k: cells[k] if k is not None and 0 <= k < len(cells) else ""
    for line_no, cells in table:
        first = cells[0].strip()
        if first.startswith(_OPENING):
            d, c = _summary(cells, out.currency, foreign)
            out.opening_minor = c - d
            out.currency = next((x.strip() for x in cells if re.fullmatch(r"[A-Z]{3}", x.strip())), out.currency)
        elif first.startswith(_CLOSING):
            d, c = _summary(cells, out.currency, foreign)
            out.closing_minor = c - d
        elif first.startswith(_TURNOVER):
            out.declared_debit_minor, out.declared_credit_minor = _summary(cells, out.currency, foreign)
        elif _DAY.fullmatch(first):
            d, c = cell(cells, debit), cell(cells, credit)
            named = {f: cell(cells, place.get(profile.source_of(canonical, name) if canonical else name)).strip() for f, (canonical, name) in _COLUMNS.items()}
            out.lines.append(Line(line_no, first, debit_raw=d.strip(), credit_raw=c.strip(), debit_minor=_minor_or_zero(out.currency, d), credit_minor=_minor_or_zero(out.currency, c), **named))
    if (out.opening_minor is None) != (out.closing_minor is None):
        out.opening_minor, out.closing_minor = out.opening_minor or 0, out.closing_minor or 0
    return out


register("semicolon-by", _is_semicolon_bank, parse_semicolon_bank)


def workbook_rows(raw: bytes) -> list[list[str]]:
    """The first sheet of a workbook as rows of strings."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        sheet = min(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet[0-9]+\.xml", n))
        rows = []
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{{{ns['m']}}}row"):
            cells: list[str] = []
            for c in row.findall("m:c", ns):
                letters = re.match(r"[A-Z]+", c.get("r", ""))
                k = sum((ord(ch) - 64) * 26**p for p, ch in enumerate(reversed(letters[0]))) - 1 if letters else len(cells)
                v = c.find("m:v", ns)
                text = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) if c.get("t") == "inlineStr" else (v.text or "" if v is not None else "")
                cells += [""] * (k - len(cells)) + [shared[int(text)] if c.get("t") == "s" and text else text]
            rows.append(cells)
        return rows


def statements(files: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """One row per file with its statement and lines; a file that no parser can read has ``error`` instead."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            names = [c.split()[0] for c in re.sub(r"<.*>", "", STATEMENT_SCHEMA).split(", ")]
            out = []
            for path, raw in zip(frame["path"], frame["content"], strict=True):
                try:
                    out.append({"path": path, "error": None} | asdict(parse_statement(bytes(raw), profile)))
                except (NotReadable, ValueError) as e:
                    out.append({"path": path, "error": str(e)})
            # Columns of objects: an absent number is null, not a float.
            yield pd.DataFrame({c: pd.Series([r.get(c) for r in out], dtype=object) for c in names})

    return files.where(F.col("length") <= MOST_BYTES).select("path", "content").mapInPandas(batches, STATEMENT_SCHEMA)


def statement_lines(parsed: DataFrame) -> DataFrame:
    """The lines of all statements as rows; a line's own currency goes before the statement's."""
    lines = parsed.where("error is null").select("path", "account", F.col("currency").alias("__currency"), F.explode("lines").alias("l")).select("path", "account", "__currency", "l.*")
    own = F.when(F.col("currency") != "", F.col("currency")).otherwise(F.col("__currency"))
    return lines.select("path", "account", own.alias("currency"), *[c for c in lines.columns if c not in ("path", "account", "__currency", "currency")])


def _parsers() -> None:
    """Parsers of other modules, which a worker process must know too."""
    from quern.sources import sheets  # noqa: F401
