"""Tables that change by whole versions, and appends of several tables that are seen together or not at all.

A version is a small file under a number that must not exist yet, which names
the folders that hold its rows. Whoever writes that name first has made the
change; whoever comes second reads again. Folders that no version names were
left by writers that stopped or lost, and are never read.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Folders of changes that are read together before one writer folds them.
MOST_FOLDERS = 16


class LostRace(RuntimeError):
    """Other writers came first as often as it was tried."""


def _hadoop(spark: SparkSession, path: str):
    """A path and its file system; a mounted one is followed to where it lies."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _hadoop(spark, path)
    return fs.exists(at)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder that may not exist."""
    fs, at = _hadoop(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _hadoop(spark, path)
    stream = fs.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file whole under a name that nobody has taken; false if somebody has.

    The text is written beside it and then given the name: by a hard link on a
    local disk, by a rename elsewhere, which a file system such as HDFS refuses
    if the name is taken.
    """
    fs, at = _hadoop(spark, path)
    aside = at.suffix(f".{uuid.uuid4().hex}.tmp")
    stream = fs.create(aside, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    try:
        if fs.getUri().getScheme() == "file":
            try:
                os.link(*(fs.makeQualified(x).toUri().getPath() for x in (aside, at)))
            except FileExistsError:
                return False
            return True
        return not fs.exists(at) and bool(fs.rename(aside, at))
    finally:
        fs.delete(aside, False)


class Versioned:
    """A keyed table whose changes are versions; for tables of control, such as batches and profiles.

    ``change`` computes what a change makes of the table as it is, and takes
    effect only if the table is still that one; otherwise it is computed again.
    A version adds a folder of changed rows; past ``MOST_FOLDERS`` of them, the
    whole table is written as one.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: Sequence[str]):
        self.spark, self.path, self.key = spark, path.rstrip("/"), list(key)
        self.schema = StructType.fromDDL(schema)

    def version(self) -> int:
        """The newest version; 0 if there is none."""
        return max((int(n.removesuffix(".json")) for n in names_in(self.spark, f"{self.path}/versions") if n.endswith(".json")), default=0)

    def folders(self, version: int) -> list[str]:
        return json.loads(read_text(self.spark, f"{self.path}/versions/{version:012d}.json"))["folders"] if version else []

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest one if none is named."""
        folders = self.folders(self.version() if version is None else version)
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        stored = StructType.fromJson(self.schema.jsonValue()).add("gone", "boolean")
        parts = [self.spark.read.schema(stored).parquet(f"{self.path}/rows/{x}").withColumn("at", F.lit(k)) for k, x in enumerate(folders)]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        last = rows.groupBy(*self.key).agg(F.max_by(F.struct(*[c for c in stored.fieldNames() if c not in self.key]), "at").alias("r"))
        return last.where("not r.gone").select(*[F.col(c) if c in self.key else F.col(f"r.{c}").alias(c) for c in self.schema.fieldNames()])

    def _put(self, version: int, rows: DataFrame, folders: list[str]) -> bool:
        name = uuid.uuid4().hex
        rows.select(*self.schema.fieldNames(), "gone").write.parquet(f"{self.path}/rows/{name}")
        return put_if_absent(self.spark, f"{self.path}/versions/{version:012d}.json", json.dumps({"folders": [*folders, name]}))

    def change(self, changed: Callable[[DataFrame], DataFrame | None], attempts: int = 20) -> int:
        """Makes a version of what ``changed`` returns for the table: rows by key, new or in place of others, with a column ``gone`` true for rows that go.

        ``None`` changes nothing, and an error leaves the table as it is.
        Returns the version that holds the change.
        """
        for _ in range(attempts):
            version = self.version()
            rows = changed(self.read(version))
            if rows is None:
                return version
            if "gone" not in rows.columns:
                rows = rows.withColumn("gone", F.lit(False))
            folders = self.folders(version)
            if len(folders) >= MOST_FOLDERS:
                same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.key]
                kept = self.read(version).alias("o").join(rows.select(*self.key).alias("n"), same, "left_anti").withColumn("gone", F.lit(False))
                rows, folders = kept.unionByName(rows.where("not gone")), []
            if self._put(version + 1, rows, folders):
                return version + 1
        raise LostRace(f"{self.path}: {attempts} attempts, each of which came second")


class Commits:
    """Appends of several tables under one name, seen when all are written.

    Each attempt writes folders of its own, ``<table>/commit=<name>.<attempt>``.
    The commit is the file that names them: it is written last, and once. An
    attempt that ends before leaves folders that ``read`` does not look at, and
    a second attempt under a name that is taken does nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def done(self, name: str) -> bool:
        return exists(self.spark, f"{self.path}/{name}.json")

    def append(self, name: str, writes: dict[str, tuple[str, Callable[[str], None]]], facts: dict | None = None) -> bool:
        """Calls each write with its folder, in order, and commits; ``writes`` maps a table's name to its path and its write. False if the name was taken."""
        if self.done(name):
            return False
        folder = f"commit={name}.{uuid.uuid4().hex[:12]}"
        for path, write in writes.values():
            write(f"{path}/{folder}")
        return put_if_absent(self.spark, f"{self.path}/{name}.json", json.dumps({"folder": folder, "tables": list(writes), **(facts or {})}))

    def read(self, table: str, path: str, schema: str, where: Column | str = "true") -> DataFrame:
        """A table's committed rows; ``where`` is a condition on the facts of commits, so that commits without such rows are left alone.

        The driver learns the names of the commits that are read, one each.
        """
        if not names_in(self.spark, self.path):
            return self.spark.createDataFrame([], schema)
        known = self.spark.read.schema("folder string, tables array<string>, months array<string>").json(f"{self.path}/*.json")
        folders = [f"{path}/{r.folder}" for r in known.where(F.array_contains("tables", F.lit(table))).where(where).select("folder").collect()]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", path).parquet(*folders).drop("commit")


class Partitioned:
    """A table in partitions of one column, of which a change rewrites those that it touches and no others.

    A version names the folder of each partition. A change reads its own
    partitions, writes them anew and puts a version in which they lie elsewhere;
    all other partitions stay the files that they were. Of two changes at once
    the second puts its folders into the first one's version if they have no
    partition in common, and is computed again otherwise. The column is text and
    never null, and coarse: the driver holds the names of all partitions.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, by: str):
        self.spark, self.path, self.by = spark, path.rstrip("/"), by
        self.schema = StructType.fromDDL(schema)

    def version(self) -> int:
        return max((int(n.removesuffix(".json")) for n in names_in(self.spark, f"{self.path}/versions") if n.endswith(".json")), default=0)

    def parts(self, version: int | None = None) -> dict[str, str]:
        """The folder of each partition."""
        version = self.version() if version is None else version
        return json.loads(read_text(self.spark, f"{self.path}/versions/{version:012d}.json")) if version else {}

    def read(self, values: Sequence[str] | None = None, version: int | None = None) -> DataFrame:
        """The rows, of some partitions only if they are named; no other partition's files are listed."""
        return self._of({v: f for v, f in self.parts(version).items() if values is None or v in values})

    def _of(self, parts: dict[str, str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        base = f"{self.path}/rows"
        rows = self.spark.read.schema(self.schema).option("basePath", base).parquet(*[f"{base}/{f}" for f in parts.values()])
        return rows.select(*self.schema.fieldNames())

    def rewrite(self, values: Sequence[str], changed: Callable[[DataFrame], DataFrame], attempts: int = 20) -> int:
        """Puts what ``changed`` returns for the rows of these partitions in their place; rows of other partitions are an error."""
        values = sorted(set(values))
        if not values:
            return self.version()
        seen, written = None, {}
        for _ in range(attempts):
            version = self.version()
            parts = self.parts(version)
            own = {v: parts[v] for v in values if v in parts}
            if own != seen:  # for the first time, or somebody has changed these
                seen, written = own, self._write(changed(self._of(own)), values)
            rest = {v: f for v, f in parts.items() if v not in values}
            if put_if_absent(self.spark, f"{self.path}/versions/{version + 1:012d}.json", json.dumps(rest | written)):
                return version + 1
        raise LostRace(f"{self.path}: {attempts} attempts, each of which came second")

    def _write(self, rows: DataFrame, values: Sequence[str]) -> dict[str, str]:
        folder, value = f"version={uuid.uuid4().hex}", F.col(self.by)
        stray = F.raise_error(F.concat(F.lit("row of another partition: "), F.coalesce(value, F.lit("null")))).cast("string")
        checked = rows.select(*self.schema.fieldNames()).withColumn(self.by, F.when(value.isin(list(values)), value).otherwise(stray))
        checked.write.partitionBy(self.by).parquet(f"{self.path}/rows/{folder}")
        names = [n for n in names_in(self.spark, f"{self.path}/rows/{folder}") if n.startswith(f"{self.by}=")]
        return {unquote(n.split("=", 1)[1]): f"{folder}/{n}" for n in names}
