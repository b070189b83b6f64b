"""Old workbooks, written here by the format's rules and read back."""

import struct
from decimal import Decimal

import pytest

from quern.sources import sheets, statements
from quern.sources.statements import NotReadable, parse_statement
from quern.sources.workbooks import MAGIC, _packed_number, sheet_names, sheet_rows

MOST = 8224  # bytes of a record


def record(kind, body=b""):
    return struct.pack("<HH", kind, len(body)) + body


def shared_texts(texts, most=MOST):
    """The records of shared texts: full records go on in others, within a text too; wide letters only where a text needs them."""
    parts, now = [], bytearray(struct.pack("<II", len(texts), len(texts)))
    for t in texts:
        wide = any(ord(c) > 255 for c in t)
        if len(now) + 3 > most:
            parts, now = [*parts, bytes(now)], bytearray()
        now += struct.pack("<HB", len(t), wide)
        for c in t:
            letter = c.encode("utf-16-le") if wide else c.encode("latin-1")
            if len(now) + len(letter) > most:
                parts, now = [*parts, bytes(now)], bytearray([wide])
            now += letter
    return b"".join(record(0x00FC if k == 0 else 0x003C, p) for k, p in enumerate([*parts, bytes(now)]))


def workbook(named_rows, most=MOST):
    """A workbook stream of sheets {name: rows}: texts are shared, whole numbers packed, others doubles."""
    texts = list(dict.fromkeys(v for rows in named_rows.values() for r in rows for v in r if isinstance(v, str) and v))
    bodies = []
    for rows in named_rows.values():
        out = [record(0x0809, struct.pack("<HHHHII", 0x0600, 0x0010, 0, 0, 0, 0))]
        for r, row in enumerate(rows):
            for c, v in enumerate(row):
                if isinstance(v, str):
                    out += [record(0x00FD, struct.pack("<HHHI", r, c, 0, texts.index(v)))] if v else []
                elif v == int(v) and abs(v) < 1 << 28:
                    out.append(record(0x027E, struct.pack("<HHHI", r, c, 0, (int(v) << 2) & 0xFFFFFFFF | 2)))
                else:
                    out.append(record(0x0203, struct.pack("<HHHd", r, c, 0, v)))
        bodies.append(b"".join(out) + record(0x000A))
    names = [(n, n.encode("utf-16-le")) for n in named_rows]
    head = record(0x0809, struct.pack("<HHHHII", 0x0600, 0x0005, 0, 0, 0, 0))
    listed = sum(4 + 8 + len(raw) for _, raw in names)
    tail = shared_texts(texts, most) + record(0x000A)
    at, directory = len(head) + listed + len(tail), b""
    for (n, raw), body in zip(names, bodies, strict=True):
        directory += record(0x0085, struct.pack("<IHBB", at, 0, len(n), 1) + raw)
        at += len(body)
    return head + directory + tail + b"".join(bodies)


def compound(stream, name="Workbook"):
    """A compound file with one stream: in sectors of 512 bytes, or of 64 if it is shorter than 4,096."""
    pad = lambda x, n: x.ljust(-(-len(x) // n) * n, b"\0")
    chain = lambda first, n: [*range(first + 1, first + n), 0xFFFFFFFE] if n else []
    short = len(stream) < 4096
    held = pad(stream, 64) if short else pad(stream, 512)
    data = pad(held, 512)
    short_table = pad(struct.pack(f"<{len(held) // 64}I", *chain(0, len(held) // 64)), 512) if short else b""
    entry = lambda n, kind, start, size: pad((n + "\0").encode("utf-16-le"), 64) + struct.pack("<HBBIII", 2 * len(n) + 2, kind, 1, 0xFFFFFFFF, 0xFFFFFFFF, 1 if kind == 5 else 0xFFFFFFFF) + bytes(36) + struct.pack("<IQ", start, size)
    n_data, n_short = len(data) // 512, len(short_table) // 512
    listed = entry("Root Entry", 5, 0 if short else 0xFFFFFFFE, len(held) if short else 0) + entry(name, 2, 0, len(stream))
    sectors = [*chain(0, n_data), *chain(n_data, 1), *chain(n_data + 1, n_short)]
    n_table = 1
    while n_table * 128 < len(sectors) + n_table:
        n_table += 1
    table_at = len(sectors)
    sectors += [0xFFFFFFFD] * n_table
    table = struct.pack(f"<{n_table * 128}I", *sectors, *[0xFFFFFFFF] * (n_table * 128 - len(sectors)))
    places = [*range(table_at, table_at + n_table)]
    head = MAGIC + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<III", 0, n_table, n_data) + bytes(4) + struct.pack("<IIIII", 4096, n_data + 1 if short else 0xFFFFFFFE, n_short, 0xFFFFFFFE, 0)
    return head + struct.pack("<109I", *places, *[0xFFFFFFFF] * (109 - len(places))) + data + pad(listed, 512) + short_table + table


def plain(rows):
    width = lambda r: max((k + 1 for k, v in enumerate(r) if v != ""), default=0)
    return [[float(v) if not isinstance(v, str) else v for v in r[: width(r)]] for r in rows]


@pytest.mark.parametrize("most", [MOST, 60])
@pytest.mark.parametrize("n", [3, 400])
def test_round_trip(n, most):
    """Short and long files; texts that go on in further records, narrow and wide."""
    rows = [["Day", "Płaca", "", "x" * 50]] + [[f"row {k}", f"Zażółć gęślą {k}" if k % 3 else f"plain {k}", k, k / 7, -k, ""] for k in range(n)]
    raw = compound(workbook({"First": rows, "Ünder": [["other", 5.0]]}, most))
    assert sheet_names(raw) == ["First", "Ünder"]
    assert sheet_rows(raw) == plain(rows) and sheet_rows(raw, "Ünder") == [["other", 5.0]]


def test_packed_numbers():
    assert _packed_number((12345 << 2) | 3) == 123.45 and _packed_number((-5 << 2) & 0xFFFFFFFF | 2) == -5
    assert _packed_number(struct.unpack("<II", struct.pack("<d", 1.5))[1]) == 1.5


def test_other_cells():
    body = struct.pack("<HHH", 0, 0, 0)
    cells = [
        record(0x0006, struct.pack("<HHH", 0, 0, 0) + b"\0" + bytes(5) + b"\xff\xff" + bytes(8)) + record(0x0207, struct.pack("<HB", 2, 0) + b"ok"),
        record(0x0006, struct.pack("<HHHd", 0, 1, 0, 2.5) + bytes(8)),
        record(0x0205, struct.pack("<HHHBB", 0, 2, 0, 1, 0)),
        record(0x00BD, struct.pack("<HH", 0, 3) + struct.pack("<HIHI", 0, (7 << 2) | 2, 0, (8 << 2) | 2) + struct.pack("<H", 4)),
        record(0x0204, struct.pack("<HHHHB", 0, 5, 0, 1, 0) + b"L"),
        record(0x0201, body),
    ]
    stream = workbook({"S": [[]]})
    assert sheet_rows(compound(stream[:-4] + b"".join(cells) + record(0x000A))) == [["ok", 2.5, 1.0, 7.0, 8.0, "L"]]


def test_damage_is_told():
    raw = compound(workbook({"S": [["a" * 5000, 1.0]]}))
    for bad in (b"", b"PK\x03\x04", raw[:600], raw[:512] + b"\xff" * 512 + raw[1024:], raw.replace(b"W\0o\0r\0k\0", b"X\0o\0r\0k\0")):
        with pytest.raises(NotReadable):
            sheet_rows(bad)
    with pytest.raises(NotReadable, match="no sheet"):
        sheet_rows(raw, "T")
    with pytest.raises(NotReadable, match="encrypted"):
        sheet_rows(compound(record(0x0809, struct.pack("<HH", 0x0600, 5)) + record(0x002F, bytes(6)) + bytes(5000)))


def kz_row(day, flag, debit, credit, **more):
    row = [""] * 40
    row[0], row[1], row[3], row[10], row[12] = day, "17", flag, debit, credit
    row[16], row[17], row[19], row[20], row[21] = more.get("code", "852"), " Оплата за услуги ", "ТОО Альфа", "123456789012", "KZ01"
    return row


KZ = [["Дата", "", "", "Вид"] + [""] * 36, kz_row("01.02.2024", "DEBIT", 1000.5, 0.0), kz_row(45324.0, "CREDIT", "", "2 000,25"), kz_row("03.02.2024", "REVERSAL", 7.0, 3.0, code=911.0)]
PL = [
    ["Data operacji", "Data waluty", "Dane operacji", "Typ", "Kwota", "Waluta"],
    ["2024-02-01", "", "Rachunek kontrahenta: 11 22 | Nazwa i adres Kontrahenta: Alfa Sp. z o.o. | Tytuł : Faktura: 1 | ciąg dalszy | Rachunek: 9", "Przelew", -12.5, "PLN"],
    ["2024-02-02", "", "Lokalizacja: Adres: DNH*SHOP*ZABKA |Numer karty: 4 | Numer referencyjny: R7", "Karta", -3.0, "EUR"],
    ["2024-02-03", "", "Tytuł: a | Tytuł: zwrot", "Wpływ", 8.0, "USD"],
    ["2024-02-04", "", "Lokalizacja: bez gwiazdki", "Opłata", 0.0, "PLN"],
]


def test_kazakh_sheet():
    s = parse_statement(compound(workbook({"1": KZ})))
    assert (s.parser, s.currency) == ("columns-kz", "KZT")
    assert [(x.line_no, x.booked_on, x.debit_minor, x.credit_minor, x.regulated_code) for x in s.lines] == [(2, "01.02.2024", 100050, 0, "852"), (3, "2024-02-02", 0, 200025, "852"), (4, "03.02.2024", 0, 700, "911.0")]
    assert (s.lines[0].description, s.lines[0].counterparty_tax_id) == ("Оплата за услуги", "123456789012")


def test_polish_sheet():
    s = parse_statement(compound(workbook({"Info": [["x"]], "Dane": PL, "Suma": [["y", 1.0]]})))
    assert [(x.counterparty_name, x.counterparty_account, x.description, x.debit_minor, x.credit_minor, x.currency) for x in s.lines] == [
        ("Alfa Sp. z o.o.", "11 22", "Faktura: 1", 1250, 0, "PLN"),
        ("ZABKA", "", "", 300, 0, "EUR"),
        ("", "", "zwrot", 0, 800, "USD"),
        ("", "", "", 0, 0, "PLN"),
    ]


def test_keyed_cells():
    assert sheets.keyed_cell("x | Tytuł: a\nb | c | Rachunek kontrahenta:1") == {"Tytuł": "a\nb", "Rachunek kontrahenta": "1"}
    assert sheets.keyed_cell("") == {} and sheets.card_merchant("no star") == "" and sheets.card_merchant("PAY*SHOP* Zabka ") == "Zabka"


def test_all_files_through_spark(spark, tmp_path):
    """Three formats and a broken file in one folder: statements by the registry, and rows to measure rules by."""
    from test_statements import ROWS, sample

    for name, raw in {"a.csv": sample(ROWS), "b.xls": compound(workbook({"1": KZ})), "c.xls": compound(workbook({"Dane": PL})), "d.xls": MAGIC + bytes(600)}.items():
        (tmp_path / name).write_bytes(raw)
    files = statements.read_files(spark, str(tmp_path))
    parsed = statements.statements(files)
    assert {r.path[-5:]: (r.parser, r.error is None) for r in parsed.collect()} == {"a.csv": ("semicolon-by", True), "b.xls": ("columns-kz", True), "c.xls": ("keyed-pl", True), "d.xls": (None, False)}
    assert {(r.path[-5:], r.currency) for r in statements.statement_lines(parsed).collect()} == {("a.csv", "BYN"), ("b.xls", "KZT"), ("c.xls", "PLN"), ("c.xls", "EUR"), ("c.xls", "USD")}
    rows = {(r.country, r.line_no): (r.counterparty, r.payment_code, r.operation_type, r.direction, r.amount) for r in sheets.evaluation_rows(files).collect()}
    assert rows["KZ", 2] == ("ТОО Альфа", "852", "", "Expense", Decimal("1000.5")) and rows["KZ", 4][3:] == ("Income", Decimal(7)) and rows["KZ", 3][3:] == ("Income", Decimal("2000.25"))
    assert rows["PL", 3] == ("ZABKA", "", "Karta", "Expense", Decimal(3)) and rows["PL", 4][3] == "Income" and rows["PL", 5][3:] == ("Expense", Decimal(0))
    assert rows["BY", 7][3:] == ("Expense", Decimal(50)) and rows["BY", 8][3:] == ("Income", Decimal(10)) and len(rows) == 9
