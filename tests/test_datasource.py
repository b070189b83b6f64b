"""Statements read as a Spark data source."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringEndsWith, StringStartsWith
from test_sheets import KZ, compound, workbook
from test_statements import ROWS, sample

from quern.sources import datasource, statements
from quern.sources.datasource import StatementReader


@pytest.fixture
def inbox(spark, tmp_path):
    datasource.register(spark)
    folder = tmp_path / "in"
    (folder / "2024").mkdir(parents=True)
    (folder / "2023").mkdir()
    (folder / "2024" / "a.csv").write_bytes(sample(ROWS))
    (folder / "2024" / "b.xls").write_bytes(compound(workbook({"1": KZ})))
    (folder / "2023" / "c.csv").write_bytes(sample(ROWS))
    (folder / "2023" / "d.txt").write_bytes(b"nothing")
    (folder / "2023" / "_e.csv").write_bytes(sample(ROWS))
    return folder


def test_lines_as_the_registry_reads_them(spark, inbox):
    got = spark.read.format("statements").load(str(inbox))
    lines = [c for c in got.columns if c not in ("path", "byte_length", "error", "parser")]
    want = statements.statement_lines(statements.statements(statements.read_files(spark, str(inbox)).where("path NOT LIKE '%/!_e%' ESCAPE '!'")))
    assert sorted(map(str, got.where("error IS NULL").select(lines).collect())) == sorted(map(str, want.select(lines).collect()))
    assert {(r.path.rpartition("/")[2], r.parser, r.line_no is None, (r.error or "")[:14]) for r in got.collect()} == {("a.csv", "semicolon-by", False, ""), ("b.xls", "columns-kz", False, ""), ("c.csv", "semicolon-by", False, ""), ("d.txt", None, True, "unknown format")}


def test_conditions_on_the_path_rule_out_files(spark, inbox):
    """A file that cannot be opened is no harm to a query that rules it out."""
    reader = StatementReader({"path": str(inbox), "taskBytes": "1"})
    kept = [GreaterThan(("line_no",), 1), EqualTo(("account",), "x")]
    assert list(reader.pushFilters([*kept, StringStartsWith(("path",), f"{inbox}/2024"), StringEndsWith(("path",), ".csv")])) == kept
    assert [f.path for p in reader.partitions() for f in p.files] == [f"{inbox}/2024/a.csv"]
    only = StatementReader({"path": str(inbox)})
    assert list(only.pushFilters([In(("path",), (f"{inbox}/2023/c.csv", "elsewhere"))])) == [] and len(only.partitions()) == 1

    os.symlink("/proc/1/mem", inbox / "2023" / "secret.csv")
    rows = spark.read.format("statements").option("taskBytes", "1").load(str(inbox)).where(F.col("path").contains("/2024/") & (F.col("line_no") > 2))
    assert {r.path.rpartition("/")[2] for r in rows.collect()} == {"a.csv", "b.xls"} and rows.rdd.getNumPartitions() == 2


def test_files_are_dealt_by_size(inbox):
    sizes = lambda most: [len(p.files) for p in StatementReader({"path": str(inbox), "taskBytes": most}).partitions()]
    assert sizes("1") == [1, 1, 1, 1] and sizes(str(1 << 30)) == [4] and sum(sizes("900")) == 4
    assert StatementReader({"path": f"{inbox}/absent"}).partitions()[0].files == ()
    with pytest.raises(ValueError):
        StatementReader({})


def test_large_files_are_not_read(spark, inbox):
    with open(inbox / "big.csv", "wb") as f:
        f.truncate(statements.MOST_BYTES + 1)
    rows = spark.read.format("statements").load(str(inbox)).where(F.endswith("path", F.lit("big.csv")))
    assert [(r.error, r.byte_length) for r in rows.collect()] == [("file_too_large", statements.MOST_BYTES + 1)]


def test_a_stream_reads_each_file_once(spark, inbox, tmp_path):
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        lines = spark.readStream.format("statements").load(str(inbox)).where("error IS NULL").select("path", "line_no")
        lines.writeStream.format("parquet").option("checkpointLocation", cp).trigger(availableNow=True).start(out).awaitTermination(120)
        return spark.read.parquet(out).groupBy(F.element_at(F.split("path", "/"), -1).alias("f")).count().collect()

    assert dict(run()) == {"a.csv": 2, "b.xls": 3, "c.csv": 2}
    late = inbox / "2024" / "late.csv"
    late.write_bytes(sample(ROWS))
    assert dict(run()) == {"a.csv": 2, "b.xls": 3, "c.csv": 2, "late.csv": 2}
