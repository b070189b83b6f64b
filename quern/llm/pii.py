"""Personal data: expressions propose, checksums confirm, context words weigh."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Each expression starts only where a match of the plain form can start first,
# so a long run of digits or letters is read once, not once from every place.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=[ A-Z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_BARE_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{20,}={0,2}(?![A-Za-z0-9_+/=-])")
_NOT_DIGIT = re.compile(r"[^0-9]+")

# The length of an account number by country, of ISO 13616.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22,
    "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27,
    "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31,
    "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: Groups of four, each after a space or none, to the country's length.
_IBAN = {n: re.compile(rf"[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + "(?![A-Za-z0-9])") for n in set(IBAN_LENGTH.values())}

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "local_phone", "secret")
#: What a span is worth before its context is read, and after a checksum held.
WORTH = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "local_phone": 0.3, "secret": 0.3}
#: Whole words within ``REACH`` characters before a span that raise or lower it.
FOR = {
    "email": ("mail", "email", "contact", "write to"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security", "tax id"),
    "local_phone": ("phone", "call", "tel", "mobile", "fax"),
    "secret": ("token", "secret", "key", "apikey", "password", "passwd", "pwd", "credential", "credentials", "bearer"),
}
AGAINST = ("version", "example", "isbn", "order no", "serial", "part no")
REACH = 40
LEAST = 0.5
#: Bits a character that a secret's own characters must carry.
LEAST_BITS = 3.0


def _any_word(found: tuple[str, ...]) -> re.Pattern:
    return re.compile("(?<![^\\W_])(?:" + "|".join(map(re.escape, found)) + ")(?![^\\W_])")


_FOR, _AGAINST = {kind: _any_word(w) for kind, w in FOR.items()}, _any_word(AGAINST)


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float
    base: bool


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616: country and check digits to the end, letters as 10 to 35."""
    rest = 0
    for ch in iban[4:] + iban[:4]:
        v = int(ch, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each @ with the whole run of address characters before it."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            done = at = m.end()
        else:
            done, at = max(done, start), at + 1


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 2 * 19 and 16 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for head in _IBAN_HEAD.finditer(text):
        n = IBAN_LENGTH.get(head[0][:2])
        if n and head.start() >= done and (m := _IBAN[n].match(text, head.start())) and mod97(m[0].replace(" ", "")):
            yield m.span()
            done = m.end()


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield m.span()


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    """Long runs with letters and digits, drawn from many characters."""
    for m in _SECRET.finditer(text):
        run = m[0]
        if any(map(str.isdigit, run)) and any(map(str.isalpha, run)):
            share = [n / len(run) for n in Counter(run).values()]
            if -sum(p * math.log2(p) for p in share) >= LEAST_BITS:
                yield m.span()


_BASE = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones}
_ADDED = {"iban": _ibans, "ssn": _ssns, "local_phone": lambda text: (m.span() for m in _BARE_PHONE.finditer(text)), "secret": _secrets}


def _score(text: str, kind: str, start: int) -> float:
    near = text[max(0, start - REACH) : start].casefold()
    return WORTH[kind] + 0.3 * bool(_FOR[kind].search(near)) - 0.3 * bool(_AGAINST.search(near))


def find_spans(text: str) -> list[Span]:
    """All spans by kind, then start. Base kinds stay whatever their score; others need ``LEAST`` and no base span over them.

    Spans of two kinds may lie over each other or be equal; each kind keeps its own.
    """
    found = [Span(kind, a, b, round(min(1.0, max(0.0, _score(text, kind, a))), 2), True) for kind, f in _BASE.items() for a, b in f(text)]
    taken: list[list[int]] = []  # of base spans, merged where they meet
    for a, b in sorted((s.start, s.end) for s in found):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    for kind, f in _ADDED.items():
        k = 0
        for a, b in f(text):
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            clear = k == len(taken) or taken[k][0] >= b
            if clear and (score := _score(text, kind, a)) >= LEAST:
                found.append(Span(kind, a, b, round(min(1.0, score), 2), False))
    return found


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of spans that overlap, the first stays."""
    out, done = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= done:
            out += [text[done : s.start], f"[{s.kind.upper()}]"]
            done = s.end
    return "".join([*out, text[done:]])


_SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double,base:boolean>>"


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, spans, redacted.

    spans: array of (kind, start, end, score, base), by kind in the order of
    ``KINDS``, then by start; places are code points, the end is exclusive.
    No shuffle; each task reads its rows in Arrow batches. A null text counts
    as empty and has no spans; repeated rows are treated alike; further columns
    are ignored; an empty table gives an empty result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [t or "" for t in frame["text"]]
            spans = [find_spans(t) for t in texts]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "spans": [[s._asdict() for s in x] for x in spans], "redacted": [redact(t, s) if s else t for t, s in zip(texts, spans, strict=True)]})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(batches, f"doc_id {id_type}, spans {_SPANS}, redacted string")


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, all spans as text, and their number."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in _BASE], F.sha2(listed(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size("spans").cast("bigint").alias("n_spans"))
