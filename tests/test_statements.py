import zipfile

import pytest

from quern.sources import statements as s


def sample(rows: str, opening="0,00;100,00", closing="0,00;60,00", currency="") -> bytes:
    text = f'''"Приорбанк" ОАО
Счет клиента* BY13X {currency}
Наименование счета* ООО "Ромашка"
ВЫПИСКА ПО СЧЕТУ BY13X С 01.01.2024 ПО 31.01.2024

Дата док.;N док.;Номинал.Дебет;Номинал.Кредит;Корреспондент.Название;Корреспондент.УНП;Корреспондент.Счет;Назначение
{rows}
Входящее сальдо;;;{opening}
Обороты;;50,00;10,00
Исходящее сальдо;{closing}
'''
    return text.encode("cp1251")


ROWS = "05.01.2024;1;50,00;0,00;A;190000001;BY1;Оплата\n06.01.2024;2;0,00;10,00;B;190000002;BY2;Возврат"


def test_parse_semicolon_statement():
    st = s.parse_statement(sample(ROWS))
    assert (st.account, st.currency, st.period_from, st.period_to) == ("BY13X", "BYN", "01.01.2024", "31.01.2024")
    assert st.holder == "ООО Ромашка"
    assert [(x.line_no, x.debit_minor, x.credit_minor) for x in st.lines] == [(7, 5000, 0), (8, 0, 1000)]
    assert (st.opening_minor, st.closing_minor, st.balance_difference()) == (10000, 6000, 0)


def test_bad_amount_keeps_its_text_and_the_rest():
    st = s.parse_statement(sample("05.01.2024;1;5x;0,00;A;;;t"))
    assert (st.lines[0].debit_raw, st.lines[0].debit_minor) == ("5x", 0)


def test_foreign_account_takes_the_nominal_pair():
    raw = sample(ROWS, "0,00;100,00;0,00;330,00", "0,00;60,00;0,00;198,00", "EUR").decode("cp1251").replace("Номинал.Кредит;", "Номинал.Кредит;Эквивалент.Дебет;")
    st = s.parse_semicolon_bank(raw.encode())
    assert (st.currency, st.opening_minor, st.closing_minor) == ("EUR", 10000, 6000)


def test_unknown_format_names_what_was_tried():
    with pytest.raises(s.NotReadable, match="semicolon-by"):
        s.parse_statement(b"a,b\n1,2\n")


def test_profile_overrides_a_column():
    raw = sample(ROWS).decode("cp1251").replace("Назначение", "Цель").encode("cp1251")
    assert s.parse_statement(raw).lines[0].description == ""
    assert s.parse_statement(raw, s.Profile(columns={"Цель": "description"})).lines[0].description == "Оплата"


@pytest.mark.parametrize(("raw", "charset"), [("Привет".encode(), "utf-8"), ("Приход".encode("cp1251"), "windows-1251"), ("Приход и расход".encode("cp866"), "cp866"), (b"abc", "utf-8"), (b"", "utf-8")])
def test_charset(raw, charset):
    assert s.detect_charset(raw) == charset


def test_sniff():
    assert s.sniff(b"PK\x03\x04x").endswith("sheet")
    assert s.sniff(b"a\0b") == "application/octet-stream"
    assert s.sniff(b"abc") == "text/plain"


def test_unknown_charset_is_an_error():
    with pytest.raises(ValueError, match="koi8"):
        s.decode(b"", "koi8")


def test_workbook(tmp_path):
    path = tmp_path / "a.xlsx"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>x</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row></sheetData></worksheet>')
    assert s.workbook_rows(path.read_bytes()) == [["x", "", "5"]]


def test_files_through_spark(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(sample(ROWS))
    (tmp_path / "b.csv").write_bytes(b"nothing")
    files = s.read_files(spark, str(tmp_path))
    parsed = s.statements(files)
    assert {r.path.rpartition("/")[2]: r.error is None for r in parsed.collect()} == {"a.csv": True, "b.csv": False}
    assert [(r.line_no, r.debit_minor) for r in s.statement_lines(parsed).orderBy("line_no").collect()] == [(7, 5000), (8, 0)]
    seen = {r.path.rpartition("/")[2]: r for r in s.measured(files).collect()}
    assert seen["b.csv"].byte_length == 7 and seen["b.csv"].content_type == "text/plain"


def test_stream_imports_each_row_once(spark, tmp_path):
    from quern.streaming.ingest import imported, stream_files

    inbox = tmp_path / "in"
    inbox.mkdir()
    where = [str(tmp_path / x) for x in ("ledger", "files", "cp")]
    (inbox / "a.csv").write_bytes(sample(ROWS))
    stream_files(spark, str(inbox), *where).awaitTermination(120)
    (inbox / "same.csv").write_bytes(sample(ROWS))
    (inbox / "next.csv").write_bytes(sample(ROWS + "\n07.01.2024;3;0,00;1,00;C;190000003;BY3;x"))
    stream_files(spark, str(inbox), *where).awaitTermination(120)
    rows = imported(spark, *where[:2])["ledger"].orderBy("booked_on").collect()
    assert [r.amount_minor for r in rows] == [-5000, 1000, 100]
    assert rows[0].counterparty_key == "tax:190000001"


def streamed(spark, tmp_path, contents, **options):
    """The tables after one run over files of the given contents: rows, files, skips, errors."""
    from quern.streaming.ingest import imported, stream_files

    inbox = tmp_path / "in"
    inbox.mkdir(exist_ok=True)
    for name, raw in contents.items():
        (inbox / name).write_bytes(raw)
    ledger, files, cp = (str(tmp_path / x) for x in ("ledger", "files", "cp"))
    stream_files(spark, str(inbox), ledger, files, cp, **options).awaitTermination(180)
    read = {name: table.collect() for name, table in imported(spark, ledger, files).items()}
    return read["ledger"], {r.path.rpartition("/")[2]: r for r in read["files"]}, read["skips"], read["errors"]


def test_stream_keeps_one_row_of_two_overlapping_files(spark, tmp_path):
    longer = sample(ROWS + "\n07.01.2024;3;0,00;1,00;C;190000003;BY3;x")
    rows, files, skips, _ = streamed(spark, tmp_path, {"a.csv": sample(ROWS), "b.csv": longer})
    assert sorted(r.amount_minor for r in rows) == [-5000, 100, 1000] and len({r.dedup_hash for r in rows}) == 3
    assert [(s.level, s.batch_id.rpartition("/")[2], s.matched_batch_id.rpartition("/")[2]) for s in skips] == [("D3", "b.csv", "a.csv")] * 2
    assert all(f.failure_code is None for f in files.values())


def test_stream_records_what_it_cannot_import(spark, tmp_path):
    bad = sample("32.01.2024;1;12x;0,00;A;190000001;BY1;Оплата\n06.01.2024;2;0,00;10,00;B;190000002;BY2;Возврат")
    rows, files, _, errors = streamed(spark, tmp_path, {"good.csv": sample(ROWS), "bad.csv": bad, "noise.csv": b"nothing at all"})
    assert len(rows) == 2 and all(r.booked_on is not None for r in rows)
    assert {k: f.failure_code for k, f in files.items()} == {"good.csv": None, "bad.csv": "rejected", "noise.csv": "unreadable"}
    assert "unknown format" in files["noise.csv"].detail and files["bad.csv"].error_count == len(errors) > 0


def test_stream_holds_back_warnings_if_asked(spark, tmp_path):
    rows = sample(ROWS, closing="0,00;61,00")
    from quern.sources.statements import read_files
    from quern.streaming.ingest import import_batch, imported

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "w.csv").write_bytes(rows)
    files = read_files(spark, str(tmp_path / "in"))
    where = [str(tmp_path / x) for x in ("ledger", "files")]
    import_batch(files, *where, accept_warnings=False)
    assert [r.failure_code for r in imported(spark, *where)["files"].collect()] == ["needs_override"]
    import_batch(files, *where)
    assert imported(spark, *where)["ledger"].count() == 2
