"""Statement lines as a Spark data source: ``spark.read.format("statements").load(folder)``, and as a stream.

    register(spark)
    spark.read.format("statements").load("/inbox").where("path LIKE '%/2024/%'")

Files are listed once on the driver and dealt to tasks by size; a task reads and
parses its own. Conditions on ``path`` are pushed down, so files that they rule
out are never opened. Listing and reading go through Arrow's file systems, which
know local paths, HDFS and object stores by their URI; for folders that only
Spark's own readers can open there is ``statements.read_files``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith

from quern.sources.statements import MOST_BYTES, NotReadable, Profile, parse_statement

NAME = "statements"
LINE_FIELDS = ["line_no", "booked_on", "document_no", "counterparty_name", "counterparty_tax_id", "counterparty_account", "description", "debit_raw", "credit_raw", "debit_minor", "credit_minor", "regulated_code"]
SCHEMA = (
    "path string, byte_length bigint, error string, parser string, account string, currency string, line_no bigint, booked_on string, document_no string, counterparty_name string, "
    "counterparty_tax_id string, counterparty_account string, description string, debit_raw string, credit_raw string, debit_minor bigint, credit_minor bigint, regulated_code string"
)
#: Bytes of files that a task is given, about; a larger file is a task of its own.
TASK_BYTES = 32 << 20


@dataclass(frozen=True)
class _File:
    path: str
    size: int
    changed: int


@dataclass
class _Files(InputPartition):
    files: tuple[_File, ...]

    def __init__(self, files: Iterable[_File]):
        self.files = tuple(files)


class _Folder:
    """The files below a folder, and the lines of each."""

    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.path = options.get("path", "")
        if not self.path:
            raise ValueError("which folder? load(path) names it")
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))
        self.profile = Profile(charset=options.get("charset", ""), delimiter=options.get("delimiter", ""))

    def _system(self) -> tuple[fs.FileSystem, str, str]:
        """The file system, the folder in it, and what its paths are spelled with."""
        system, folder = fs.FileSystem.from_uri(self.path)
        return system, folder, self.path.split("://")[0] + "://" if "://" in self.path else ""

    def listed(self, wanted: Callable[[str], bool] = lambda path: True) -> list[_File]:
        system, folder, prefix = self._system()
        found = system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        files = [_File(prefix + f.path, f.size, f.mtime_ns or 0) for f in found if f.is_file and not f.base_name.startswith(("_", "."))]
        return sorted((f for f in files if wanted(f.path)), key=lambda f: f.path)

    def dealt(self, files: Sequence[_File]) -> list[_Files]:
        """Neighbouring files together, up to the bytes of a task."""
        out, now, size = [], [], 0
        for f in files:
            if now and size + f.size > self.task_bytes:
                out, now, size = [*out, _Files(now)], [], 0
            now.append(f)
            size += f.size
        return [*out, _Files(now)] if now else out

    def rows(self, files: Iterable[_File]) -> Iterator[tuple]:
        """A row for each line; for a file that cannot be read, one with its ``error``."""
        system, _, prefix = self._system()
        for f in files:
            try:
                if f.size > MOST_BYTES:
                    raise NotReadable("file_too_large")
                with system.open_input_stream(f.path.removeprefix(prefix)) as stream:
                    said = parse_statement(stream.read(), self.profile)
            except (NotReadable, ValueError) as e:
                yield (f.path, f.size, str(e), *[None] * (3 + len(LINE_FIELDS)))
                continue
            for x in said.lines:
                yield (f.path, f.size, None, said.parser, said.account, x.currency or said.currency, *[getattr(x, c) for c in LINE_FIELDS])


def path_test(condition: Filter) -> Callable[[str], bool] | None:
    """A condition on ``path`` alone, as a test of a path; None for any other."""
    if getattr(condition, "attribute", None) != ("path",):
        return None
    if isinstance(condition, IsNotNull):
        return lambda path: True
    value = getattr(condition, "value", None)
    if value is None:
        return None
    if isinstance(condition, (EqualTo, EqualNullSafe)):
        return lambda path: path == value
    if isinstance(condition, In):
        among = set(value)
        return lambda path: path in among
    if isinstance(condition, StringStartsWith):
        return lambda path: path.startswith(value)
    if isinstance(condition, StringEndsWith):
        return lambda path: path.endswith(value)
    if isinstance(condition, StringContains):
        return lambda path: value in path
    return None


class StatementReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.pushed = _Folder(options), []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for condition in filters:
            if path_test(condition) is not None:
                self.pushed.append(condition)
            else:
                yield condition

    def partitions(self) -> Sequence[InputPartition]:
        tests = [path_test(x) for x in self.pushed]
        return self.folder.dealt(self.folder.listed(lambda path: all(t(path) for t in tests))) or [_Files(())]

    def read(self, partition: _Files) -> Iterator[tuple]:
        return self.folder.rows(partition.files)


class StatementStream(DataSourceStreamReader):
    """New files in the order of their change and path; a file has to come with a change time after those that were read."""

    def __init__(self, options: dict):
        self.folder = _Folder(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"changed": 0, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        last = max(((f.changed, f.path) for f in self.folder.listed()), default=(0, ""))
        return {"changed": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        first, last = ((x["changed"], x["path"]) for x in (start, end))
        return self.folder.dealt([f for f in self.folder.listed() if first < (f.changed, f.path) <= last])

    def read(self, partition: _Files) -> Iterator[tuple]:
        return self.folder.rows(partition.files)


class StatementSource(DataSource):
    """Lines of bank statements of all formats that ``statements`` knows.

    Options: ``path``; ``charset`` and ``delimiter`` of a customer's files;
    ``taskBytes``. Names that begin with a point or an underscore are passed over.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return StatementReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return StatementStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, with conditions pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StatementSource)
