"""Batches and profiles as versioned tables."""

import hashlib
import itertools
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quern.operators.validate import MOVES, illegal_moves
from quern.sources.control import Batches, ProfileInput, Profiles, Refused, uploads
from quern.sources.statements import MOST_BYTES

NOW = datetime(2024, 5, 1, 12, tzinfo=timezone.utc)
#: All moves there are, apart from the library's table.
LEGAL = {
    *[("awaiting_upload", x) for x in ("uploaded", "abandoned", "failed")],
    *[("uploaded", x) for x in ("parsing", "failed")],
    *[("parsing", x) for x in ("parsed", "failed")],
    *[("parsed", x) for x in ("validating", "failed")],
    *[("validating", x) for x in ("validated", "rejected", "failed")],
    *[("validated", x) for x in ("persisting", "failed")],
    *[("persisting", x) for x in ("imported", "failed")],
}


@pytest.fixture
def batches(spark, tmp_path):
    return Batches(spark, str(tmp_path / "batches"), "o1")


@pytest.fixture
def found(spark):
    return lambda *rows: spark.createDataFrame(list(rows), "batch_id string, file_sha256 string, byte_length bigint, content_type string, failure_code string")


@pytest.fixture
def ids(spark):
    return lambda *x: spark.createDataFrame([(i,) for i in x], "batch_id string")


def test_every_pair_of_states(spark):
    pairs = list(itertools.product([*MOVES, "measured"], repeat=2))
    history = spark.createDataFrame([(f"{a} {b}", a, b) for a, b in pairs], "batch_id string, state string, next_state string")
    assert {(r.state, r.next_state) for r in illegal_moves(history).collect()} == set(pairs) - LEGAL


def test_a_batch_from_upload_to_ledger(batches, found, ids):
    b = batches.create("e1", "bank", "u1", "may.csv", 10, now=NOW)
    row = batches.get(b)
    assert (row.status, row.file_key) == ("awaiting_upload", f"org/o1/batch/{b}") and row.upload_expires_at - row.created_at == timedelta(minutes=15)
    with pytest.raises(Refused, match="illegal_transition"):
        batches.set_status(b, "parsing")
    with pytest.raises(Refused, match="not_measured"):
        batches.set_status(b, "uploaded")
    for _ in range(2):  # measuring again is no harm
        batches.measure(ids(b), found((b, "5a", 10, "text/plain", None)), NOW)
    for state in ("parsing", "parsed", "validating", "validated", "persisting", "imported"):
        batches.set_status(b, state, "ignored", NOW + timedelta(hours=1))
    row = batches.get(b)
    assert (row.status, row.failure_code, row.byte_length) == ("imported", None, 10) and row.updated_at > row.created_at
    assert batches.holding("5a") == b and batches.holding("5b") is None
    batches.set_resolved_parameters(b, '{"charset": "cp866"}')
    assert batches.get(b).resolved_parameters == '{"charset": "cp866"}'
    batches.measure(ids(b), found((b, "ff", 1, "text/plain", None)))
    assert batches.get(b).file_sha256 == "5a", "a batch past its upload is not measured"
    with pytest.raises(Refused, match="illegal_transition"):
        batches.set_status(b, "failed")


def test_what_measuring_finds(spark, batches, ids, tmp_path):
    """Uploads below their keys: one that is there, one that is not, one too large, one that is not asked for."""
    there, missing, large, waiting = (batches.create("e1", "bank", "u1", f"{k}.csv", 3, now=NOW + timedelta(seconds=k)) for k in range(4))
    folder = tmp_path / "store" / "org" / "o1" / "batch"
    folder.mkdir(parents=True)
    (folder / there).write_bytes(b"a;b")
    (folder / waiting).write_bytes(b"a;c")
    with open(folder / large, "wb") as f:
        f.truncate(MOST_BYTES + 1)
    batches.measure(ids(there, missing, large), uploads(spark, str(tmp_path / "store"), "o1"), NOW)
    got = {r.batch_id: (r.status, r.failure_code, r.file_sha256) for r in batches.of_entity("e1").collect()}
    assert got == {there: ("uploaded", None, hashlib.sha256(b"a;b").hexdigest()), missing: ("failed", "upload_missing", None), large: ("failed", "file_too_large", None), waiting: ("awaiting_upload", None, None)}
    assert [r.batch_id for r in batches.of_entity("e1").collect()] == [waiting, large, missing, there]
    assert batches.of_entity("e2").isEmpty() and uploads(spark, str(tmp_path / "store"), "o2").isEmpty()


def test_a_file_is_imported_once(spark, batches, found, ids):
    a, b, c = (batches.create("e1", "bank", "u1", "x.csv", 3) for _ in range(3))
    batches.measure(ids(a, b), found((a, "5a", 3, "text/plain", None), (b, "5a", 3, "text/plain", None)))
    all_of = lambda state, *which: batches.move(spark.createDataFrame([(i, state, None) for i in which], "batch_id string, status string, failure_code string"))
    for state in ("parsing", "parsed", "validating", "validated", "persisting"):
        all_of(state, a, b)
    with pytest.raises(Refused, match="already_imported"):
        all_of("imported", a, b)
    assert {batches.get(x).status for x in (a, b)} == {"persisting"}, "a request is met whole or not at all"
    all_of("imported", b)
    with pytest.raises(Refused, match="already_imported"):
        all_of("imported", a)
    batches.measure(ids(c), found((c, "5a", 3, "text/plain", None)))
    assert (batches.get(c).status, batches.get(c).failure_code) == ("failed", "already_imported")
    with pytest.raises(Refused, match="asked_twice"):
        all_of("failed", a, a)


def test_two_writers_of_one_batch(spark, batches, tmp_path):
    """An expiry that races an upload: whoever is second reads what the first has done."""
    b = batches.create("e1", "bank", "u1", "x.csv", 3, now=NOW)
    other = Batches(spark, str(tmp_path / "batches"), "o1")
    real, calls = batches.table.read, []

    def read(version=None):
        rows = real(version)
        if not calls:
            calls.append(rows.collect())
            other.set_status(b, "failed", "upload_missing", NOW)
        return rows

    batches.table.read = read
    assert not batches.abandon(b) and batches.get(b).status == "failed"
    c = batches.create("e1", "bank", "u1", "y.csv", 3, now=NOW)
    assert batches.abandon(c) and batches.get(c).status == "abandoned"
    with pytest.raises(Refused, match="illegal_transition"):
        batches.set_status(c, "uploaded")


def test_late_uploads_are_given_up(batches):
    old, new = (batches.create("e1", "bank", "u1", "x.csv", 3, now=NOW + timedelta(minutes=m)) for m in (0, 10))
    batches.abandon_expired(NOW + timedelta(minutes=16))
    assert (batches.get(old).status, batches.get(new).status) == ("abandoned", "awaiting_upload")


def test_organisations_see_their_own(spark, batches, tmp_path):
    b = batches.create("e1", "bank", "u1", "x.csv", 3)
    other = Batches(spark, str(tmp_path / "batches"), "o2")
    for ask in (lambda: other.get(b), lambda: other.set_status(b, "failed"), lambda: other.abandon(b)):
        with pytest.raises(Refused, match="not_found"):
            ask()
    with pytest.raises(ValueError):
        Batches(spark, str(tmp_path / "batches"), "")
    for bad in (("e1", "cash", "u1", "x", 1), ("e1", "bank", "u1", " ", 1), ("e1", "bank", "u1", "x", 0)):
        with pytest.raises(Refused, match="invalid_argument"):
            batches.create(*bad)


def test_profiles(spark, batches, tmp_path):
    profiles = Profiles(spark, str(tmp_path / "profiles"), "o1", batches)
    given = ProfileInput("Bank B", "bank", {"Datum": "booked_on", "Betrag": "amount"}, delimiter=",", date_fmt="yyyy/MM/dd")
    p = profiles.create(given, NOW)
    q = profiles.create(ProfileInput("Bank A", "ledger", {"D": "debit"}), NOW)
    assert [r.name for r in profiles.all().collect()] == ["Bank A", "Bank B"]
    for bad, code in ((ProfileInput(" ", "bank", {"a": "amount"}), "invalid_argument"), (ProfileInput("x", "bank", {}), "invalid_argument"), (ProfileInput("x", "cash", {"a": "amount"}), "invalid_argument"), (ProfileInput("x", "bank", {"a": "sum"}), "invalid_canonical_field: sum"), (ProfileInput("x", "bank", {"a": "amount"}, delimiter=";;"), "invalid_argument"), (ProfileInput("Bank A", "bank", {"a": "amount"}), "name_taken")):
        with pytest.raises(Refused, match=code):
            profiles.create(bad)
    profiles.update(p, ProfileInput("Bank C", "ledger", {"T": "booked_on"}), NOW + timedelta(days=1))
    row = profiles.get(p)
    assert (row.name, row.source_kind, row.column_map, row.delimiter, row.date_fmt) == ("Bank C", "bank", {"T": "booked_on"}, None, None)
    assert (row.created_at, row.updated_at) == tuple(t.replace(tzinfo=None) for t in (NOW, NOW + timedelta(days=1))) or row.updated_at - row.created_at == timedelta(days=1)
    with pytest.raises(Refused, match="name_taken"):
        profiles.update(p, ProfileInput("Bank A", "bank", {"a": "amount"}))
    batches.create("e1", "bank", "u1", "x.csv", 3, profile_id=p)
    with pytest.raises(Refused, match="profile_in_use"):
        profiles.delete(p)
    profiles.delete(q)
    for ask in (lambda: profiles.delete(q), lambda: profiles.get(q), lambda: profiles.update(q, given)):
        with pytest.raises(Refused, match="not_found"):
            ask()
    assert Profiles(spark, str(tmp_path / "profiles"), "o2", batches).all().isEmpty()
    assert profiles.parameters(p).columns == {"T": "booked_on"} and profiles.parameters(p).as_json() == '{"column_map": {"T": "booked_on"}}'


def test_a_profile_has_its_own_date_format(spark):
    from quern.functions.periods import try_parse_date

    rows = spark.createDataFrame([("2024/05/01",), ("01.05.2024",)], "d string")
    assert [str(r[0]) for r in rows.select(try_parse_date(F.col("d"), "yyyy/MM/dd")).collect()] == ["2024-05-01", "None"]
