"""Versions, commits, and imports that stop half way."""

import pytest
from pyspark.sql import functions as F
from test_statements import ROWS, sample

from quern.sources import versions
from quern.sources.versions import Commits, LostRace, Versioned, put_if_absent

SCHEMA = "id string, n bigint"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_name_is_given_once(spark, tmp_path):
    path = f"{tmp_path}/a b%20/x.json"
    assert put_if_absent(spark, path, "first é") and not put_if_absent(spark, path, "second")
    assert versions.read_text(spark, path) == "first é" and versions.names_in(spark, f"{tmp_path}/a b%20") == ["x.json"]


def test_changes_make_versions(spark, tmp_path):
    t = Versioned(spark, str(tmp_path / "t"), SCHEMA, ["id"])
    assert rows(t.read()) == [] and t.version() == 0
    put = lambda *new: t.change(lambda _: spark.createDataFrame(list(new), SCHEMA))
    assert put(("a", 1), ("b", 2)) == 1 and put(("b", 3), (None, 4)) == 2
    assert t.change(lambda now: now.where("id = 'a'").withColumn("gone", F.lit(True))) == 3
    assert {tuple(r) for r in t.read().collect()} == {("b", 3), (None, 4)}
    assert rows(t.read(1)) == [("a", 1), ("b", 2)] and t.change(lambda _: None) == 3


def test_folders_are_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "MOST_FOLDERS", 3)
    t = Versioned(spark, str(tmp_path / "t"), SCHEMA, ["id"])
    for k in range(5):
        t.change(lambda _, k=k: spark.createDataFrame([(str(k % 2), k)], SCHEMA))
    assert rows(t.read()) == [("0", 4), ("1", 3)] and len(t.folders(t.version())) <= 3


def test_of_two_writers_one_reads_again(spark, tmp_path):
    """Both add one to what they read; the second to write finds its version taken and adds to the new one."""
    path = str(tmp_path / "t")
    mine, other = (Versioned(spark, path, SCHEMA, ["id"]) for _ in range(2))
    mine.change(lambda _: spark.createDataFrame([("a", 0)], SCHEMA))
    add = lambda now: now.withColumn("n", F.col("n") + 1)
    tries = []

    def slow(now):
        tries.append(now.first().n)
        if len(tries) == 1:
            other.change(add)
        return add(now)

    assert mine.change(slow) == 3 and tries == [0, 1] and rows(mine.read()) == [("a", 2)]
    with pytest.raises(LostRace):
        mine.change(lambda now: (other.change(add), add(now))[1], attempts=2)


def test_half_a_commit_is_not_seen(spark, tmp_path):
    commits, table = Commits(spark, str(tmp_path / "c")), str(tmp_path / "t")
    frame = spark.createDataFrame([("a", 1)], SCHEMA)

    def fail(_):
        raise OSError("stopped")

    with pytest.raises(OSError):
        commits.append("x", {"t": (table, frame.write.parquet), "u": (table, fail)})
    assert rows(commits.read("t", table, SCHEMA)) == [] and not commits.done("x")
    assert commits.append("x", {"t": (table, frame.write.parquet)}, {"months": ["2024-01"]}) and not commits.append("x", {"t": (table, fail)})
    assert rows(commits.read("t", table, SCHEMA)) == [("a", 1)] and rows(commits.read("t", table, SCHEMA, "false")) == []


class Stopped(Exception):
    pass


STOPS = ["ledger", "skips", "errors", "files", "commit", "noted"]


def test_import_that_stops_after_each_write(spark, tmp_path, monkeypatch):
    """A stream whose second epoch stops after each of its four writes in turn, before its commit and after it, ends with the tables of one that never stopped."""
    from quern.streaming import ingest

    second = {
        "next.csv": sample(ROWS + "\n07.01.2024;3;0,00;1,00;C;190000003;BY3;x"),
        "over.csv": sample(ROWS + "\n08.01.2024;4;0,00;2,00;D;190000004;BY4;y"),
        "bad.csv": sample("32.01.2024;1;12x;0,00;A;190000001;BY1;Оплата"),
    }
    real = Commits.append

    def stopping(stop):
        def append(self, commit, writes, facts=None):
            def then_stop(table, write):
                def go(at):
                    write(at)
                    if table == stop:
                        raise Stopped(table)

                return go

            if stop == "commit":
                with monkeypatch.context() as m:
                    m.setattr(versions, "put_if_absent", lambda *_: (_ for _ in ()).throw(Stopped(stop)))
                    return real(self, commit, writes, facts)
            assert real(self, commit, {t: (p, then_stop(t, w)) for t, (p, w) in writes.items()}, facts)
            raise Stopped(stop)

        return append

    def run(name, stops):
        inbox, where = tmp_path / name, [str(tmp_path / f"{name}-{x}") for x in ("ledger", "files", "cp")]
        inbox.mkdir()
        (inbox / "a.csv").write_bytes(sample(ROWS))
        ingest.stream_files(spark, str(inbox), *where).awaitTermination(180)
        for file, raw in second.items():
            (inbox / file).write_bytes(raw)
        for stop in stops:
            before = ingest.imported(spark, *where[:2])["files"].count()
            with monkeypatch.context() as m:
                m.setattr(Commits, "append", stopping(stop))
                with pytest.raises(Exception, match="Stopped"):
                    ingest.stream_files(spark, str(inbox), *where).awaitTermination(180)
            assert ingest.imported(spark, *where[:2])["files"].count() == before + (3 if stop == "noted" else 0)
        ingest.stream_files(spark, str(inbox), *where).awaitTermination(180)
        tables = ingest.imported(spark, *where[:2])
        plain = lambda x: str(x).replace(f"/{name}/", "/")
        return {t: sorted(tuple(plain(v) for c, v in r.asDict().items() if c != "created_on") for r in df.collect()) for t, df in tables.items()}

    whole, resumed = run("whole", []), run("stopped", STOPS)
    for t in whole:
        assert resumed[t] == whole[t], t
    assert {t: len(x) for t, x in whole.items()} | {"errors": 0} == {"ledger": 4, "skips": 4, "errors": 0, "files": 4} and whole["errors"]


HISTORY = "classification_id string, txn_id string, month string, category_code string, superseded_by string, retracted_on date, retracted_by string"


def files_below(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def stored_history(spark, tmp_path):
    table = versions.Partitioned(spark, str(tmp_path / "h"), HISTORY, "month")
    old = spark.createDataFrame([(f"c{m}{k}", f"t{m}{k}", f"2024-0{m}", "01", None, None, None) for m in (1, 2, 3) for k in range(4)], HISTORY)
    table.rewrite(["2024-01", "2024-02", "2024-03"], lambda _: old)
    return table, old


def test_a_change_rewrites_its_own_partitions(spark, tmp_path):
    from quern.operators import review

    table, old = stored_history(spark, tmp_path)
    before, folders = files_below(tmp_path / "h" / "rows"), table.parts()
    new = spark.createDataFrame([("n1", "t21", "2024-02", "05", None, None, None), ("n2", "t99", "2024-02", "05", None, None, None)], HISTORY)
    review.supersede_stored(table, new)
    assert rows(table.read().na.fill("-")) == rows(review.supersede(old, new).select(old.columns).na.fill("-"))
    after = table.parts()
    assert {m: after[m] == folders[m] for m in folders} == {"2024-01": True, "2024-02": False, "2024-03": True}
    assert {f: t for f, t in files_below(tmp_path / "h" / "rows").items() if f in before} == before, "files that were there are as they were"
    read = table.read(["2024-02"]).inputFiles()
    assert read and all("month=2024-02" in f for f in read)

    review.retract_stored(table, table.read().where("classification_id IN ('c30', 'c21')").select("classification_id", "month"), F.lit("2024-05-01").cast("date"), "u1")
    said = {r.classification_id: (r.superseded_by, r.retracted_by) for r in table.read().collect()}
    assert said["c30"] == (None, "u1") and said["c21"] == ("n1", None) and table.parts()["2024-01"] == folders["2024-01"]
    assert rows(table.read(version=1).na.fill("-")) == rows(old.na.fill("-")), "earlier versions can be read"


def test_vendor_memory_by_organisation(spark, tmp_path):
    from quern.operators import review

    schema = "org_id string, counterparty_key string, category_code string, decided_on date"
    table = versions.Partitioned(spark, str(tmp_path / "v"), schema, "org_id")
    of = lambda *x: spark.createDataFrame(list(x), "org_id string, counterparty_key string, category_code string, decided_on string").withColumn("decided_on", F.to_date("decided_on"))
    review.upsert_vendors_stored(table, of(("a/b", "k", "01", "2024-01-01"), ("o2", "k", "02", "2024-01-01")))
    kept = table.parts()["o2"]
    review.upsert_vendors_stored(table, of(("a/b", "k", "03", "2024-02-01"), ("a/b", "l", "04", "2024-02-01")))
    assert sorted(r[:3] for r in rows(table.read())) == [("a/b", "k", "03"), ("a/b", "l", "04"), ("o2", "k", "02")] and table.parts()["o2"] == kept
    review.forget_stored(table, of(("a/b", "k", "", "2024-01-01"), ("a/b", "l", "", "2024-01-01")))
    assert [r[:3] for r in rows(table.read())] == [("o2", "k", "02")] and list(table.parts()) == ["o2"]
    assert table.rewrite([], lambda old: old) == table.version()
    with pytest.raises(Exception, match="another partition"):
        table.rewrite(["o2"], lambda old: of(("o3", "k", "01", "2024-01-01")))


def test_two_changes_at_once(spark, tmp_path):
    """Changes of different months both stand, each computed once; of one month's, the second sees the first."""
    from quern.operators import review

    table, _ = stored_history(spark, tmp_path)
    other = versions.Partitioned(spark, str(tmp_path / "h"), HISTORY, "month")
    one = lambda i, m: spark.createDataFrame([(f"n{i}", f"t{m}0", f"2024-0{m}", "05", None, None, None)], HISTORY)
    for first, second, tries in ((1, 2, 1), (3, 3, 2)):
        calls = []

        def changed(old, first=first, second=second, calls=calls):
            calls.append(1)
            if len(calls) == 1:
                review.supersede_stored(other, one(f"a{first}", first))
            return review.supersede(old, one(f"b{second}", second))

        table.rewrite([f"2024-0{second}"], changed)
        assert len(calls) == tries
    said = {r.classification_id: r.superseded_by for r in table.read().collect()}
    assert (said["c10"], said["c20"], said["c30"], said["na3"], said["nb3"]) == ("na1", "nb2", "na3", "nb3", None)


def test_decisions_stand_once_and_are_undone_once(spark, tmp_path):
    from quern.operators import review

    table = Versioned(spark, str(tmp_path / "d"), review.DECISIONS, ["decision_id"])
    of = lambda *ids: spark.createDataFrame([(i, "o", "v1", k, "skipped", None, "u", None, None, None) for i, k in ids], review.DECISIONS)
    review.decide_stored(table, of(("1", "a"), ("2", "b")))
    for bad in (of(("3", "a")), of(("3", "c"), ("4", "c"))):
        with pytest.raises(review.DecisionRefused, match="has a decision"):
            review.decide_stored(table, bad)
    review.undo_stored(table, "1", "u2", F.lit("2024-01-01").cast("timestamp"))
    for again in ("1", "9"):
        with pytest.raises(review.DecisionRefused, match="not a decision that stands"):
            review.undo_stored(table, again, "u2", F.current_timestamp())
    review.decide_stored(table, of(("3", "a")))
    assert sorted(r.decision_id for r in review.live_decisions(table.read()).collect()) == ["2", "3"] and table.read().count() == 3
