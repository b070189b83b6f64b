"""The tables that steer imports: batches and import profiles of one organisation.

Both are versioned tables: a change is computed from the table as it is and
takes effect only if nobody changed it meanwhile, so of two writers that move
one batch the second sees where the first has put it.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quern.operators.validate import moved
from quern.sources.statements import Profile, measured_below, object_key
from quern.sources.versions import Versioned, exists

BATCHES = (
    "org_id string, batch_id string, entity_id string, source_kind string, status string, uploaded_by string, file_name string, declared_bytes bigint, declared_type string, file_key string, file_sha256 string, "
    "byte_length bigint, content_type string, row_count bigint, failure_code string, upload_expires_at timestamp, created_at timestamp, updated_at timestamp, profile_id string, resolved_parameters string"
)
PROFILES = "org_id string, profile_id string, name string, source_kind string, column_map map<string,string>, charset string, delimiter string, decimal_sep string, date_fmt string, created_at timestamp, updated_at timestamp"
#: The fields that a column of a file can stand for.
CANONICAL = ("booked_on", "value_on", "amount", "debit", "credit", "currency", "description", "counterparty", "bank_ref", "document_ref", "posting_no", "opening_balance", "closing_balance", "row_count_declared")
SOURCE_KINDS = ("ledger", "bank")
UPLOAD_LIFE = timedelta(minutes=15)


class Refused(ValueError):
    """A request that the tables do not allow; ``code`` says why."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


def _now() -> datetime:
    return datetime.now(timezone.utc)


def uploads(spark: SparkSession, root: str, org_id: str) -> DataFrame:
    """batch_id, file_sha256, byte_length, content_type and failure_code of each object at an organisation's keys below ``root``; of one over the limit only the length is read."""
    folder = f"{root}/{object_key(org_id, '')}".rstrip("/")
    if not exists(spark, folder):
        return spark.createDataFrame([], "batch_id string, file_sha256 string, byte_length bigint, content_type string, failure_code string")
    found = measured_below(spark, folder)
    return found.select(F.regexp_extract("path", r"/batch/([^/]+)$", 1).alias("batch_id"), "file_sha256", "byte_length", "content_type", "failure_code")


class Batches:
    """An organisation's import batches."""

    def __init__(self, spark: SparkSession, path: str, org_id: str):
        if not org_id:
            raise ValueError("batches belong to an organisation")
        self.spark, self.org_id = spark, org_id
        self.table = Versioned(spark, path, BATCHES, ["org_id", "batch_id"])

    def _own(self, rows: DataFrame) -> DataFrame:
        return rows.where(F.col("org_id") == self.org_id)

    def create(self, entity_id: str, source_kind: str, uploaded_by: str, file_name: str, declared_bytes: int, declared_type: str = "", profile_id: str | None = None, now: datetime | None = None) -> str:
        """A new batch that waits for its upload; its id."""
        if source_kind not in SOURCE_KINDS or not file_name.strip() or declared_bytes <= 0:
            raise Refused("invalid_argument")
        now, batch_id = now or _now(), str(uuid.uuid4())
        row = (self.org_id, batch_id, entity_id, source_kind, "awaiting_upload", uploaded_by, file_name, declared_bytes, declared_type, object_key(self.org_id, batch_id), None, None, None, None, None, now + UPLOAD_LIFE, now, now, profile_id, None)
        self.table.change(lambda _: self.spark.createDataFrame([row], BATCHES))
        return batch_id

    def get(self, batch_id: str) -> Row:
        found = self._own(self.table.read()).where(F.col("batch_id") == batch_id).first()
        if found is None:
            raise Refused("not_found", batch_id)
        return found

    def of_entity(self, entity_id: str) -> DataFrame:
        """An entity's batches, the newest first."""
        return self._own(self.table.read()).where(F.col("entity_id") == entity_id).orderBy(F.desc("created_at"), "batch_id")

    def holding(self, file_sha256: str) -> str | None:
        """The imported batch that has this file."""
        found = self._own(self.table.read()).where((F.col("file_sha256") == file_sha256) & (F.col("status") == "imported")).select("batch_id").first()
        return found and found.batch_id

    def move(self, asked: DataFrame, now: datetime | None = None) -> int:
        """Moves all batches of ``asked`` (batch_id, status, failure_code), or none: one that is refused raises."""
        now = now or _now()

        def changed(rows: DataFrame) -> DataFrame:
            done, refused = moved(self._own(rows), asked, F.lit(now))
            for r in refused.limit(1).collect():
                raise Refused(r.refused, f"{r.batch_id}: {r.status} to {r.next_status}")
            return done

        return self.table.change(changed)

    def set_status(self, batch_id: str, status: str, failure_code: str | None = None, now: datetime | None = None) -> int:
        return self.move(self.spark.createDataFrame([(batch_id, status, failure_code)], "batch_id string, status string, failure_code string"), now)

    def _with(self, batch_id: str, now: datetime | None, check: str, **values) -> bool:
        """Sets values of a batch if the check holds of it; whether it did."""
        fits = []

        def changed(rows: DataFrame) -> DataFrame | None:
            own = self._own(rows).where(F.col("batch_id") == batch_id)
            state = own.select(F.expr(check).alias("fits")).first()
            if state is None:
                raise Refused("not_found", batch_id)
            fits.append(state.fits)
            return own.withColumns({c: F.lit(v).cast(own.schema[c].dataType) for c, v in values.items()} | {"updated_at": F.lit(now or _now())}) if state.fits else None

        self.table.change(changed)
        return fits[-1]

    def measure(self, asked: DataFrame, found: DataFrame, now: datetime | None = None) -> int:
        """Records what was found of the uploads of the batches of ``asked`` (batch_id).

        ``found`` is of ``uploads``. A batch without a row there fails as upload_missing, one whose file an imported batch has as
        already_imported, one with a failure code as that. All others are
        uploaded. A batch is measured as often as it is asked for, until it is
        past that state; then it is left alone.
        """
        now = now or _now()
        new = found.select(F.col("batch_id").alias("__id"), *[F.col(c).alias(f"__{c}") for c in ("file_sha256", "byte_length", "content_type", "failure_code")])

        def changed(rows: DataFrame) -> DataFrame:
            own = self._own(rows)
            held = own.where("status = 'imported'").select(F.col("file_sha256").alias("__held")).distinct()
            waiting = own.where("status IN ('awaiting_upload', 'uploaded')").join(asked.select("batch_id").distinct(), "batch_id", "left_semi")
            met = waiting.join(new, F.col("batch_id") == F.col("__id"), "left").join(held, F.col("__file_sha256") == F.col("__held"), "left")
            code = F.when(F.col("__id").isNull(), "upload_missing").when(F.col("__failure_code").isNotNull(), F.col("__failure_code")).when(F.col("__held").isNotNull(), "already_imported")
            kept = lambda c: F.when(code.isNull(), F.col(f"__{c}"))
            return met.withColumns({c: kept(c) for c in ("file_sha256", "byte_length", "content_type")} | {"status": F.when(code.isNull(), "uploaded").otherwise("failed"), "failure_code": code, "updated_at": F.lit(now)}).select(*own.columns)

        return self.table.change(changed)

    def abandon(self, batch_id: str, now: datetime | None = None) -> bool:
        """Gives up a batch if its upload has still not come; says whether it has."""
        return self._with(batch_id, now, "status = 'awaiting_upload'", status="abandoned")

    def abandon_expired(self, now: datetime | None = None) -> int:
        """Gives up all batches whose upload has not come in time."""
        now = now or _now()
        late = (F.col("status") == "awaiting_upload") & (F.col("upload_expires_at") < F.lit(now))
        return self.table.change(lambda rows: self._own(rows).where(late).withColumns({"status": F.lit("abandoned"), "updated_at": F.lit(now)}))

    def set_resolved_parameters(self, batch_id: str, parameters: str, now: datetime | None = None) -> None:
        """What a batch was read with, as JSON, whatever becomes of its profile."""
        self._with(batch_id, now, "true", resolved_parameters=parameters)


@dataclass(frozen=True)
class ProfileInput:
    """What a customer says of their files; what is blank is left to detection."""

    name: str
    source_kind: str = "bank"
    column_map: Mapping[str, str] = field(default_factory=dict)
    charset: str = ""
    delimiter: str = ""
    decimal_sep: str = ""
    date_fmt: str = ""

    def check(self) -> None:
        if not self.name.strip() or self.source_kind not in SOURCE_KINDS or not self.column_map:
            raise Refused("invalid_argument")
        if len(self.delimiter) > 1 or self.decimal_sep not in ("", ",", "."):
            raise Refused("invalid_argument")
        for canonical in sorted(set(self.column_map.values()) - set(CANONICAL)):
            raise Refused("invalid_canonical_field", canonical)


class Profiles:
    """An organisation's import profiles, each name once."""

    def __init__(self, spark: SparkSession, path: str, org_id: str, batches: Batches):
        if not org_id:
            raise ValueError("profiles belong to an organisation")
        self.spark, self.org_id, self.batches = spark, org_id, batches
        self.table = Versioned(spark, path, PROFILES, ["org_id", "profile_id"])

    def _own(self, rows: DataFrame) -> DataFrame:
        return rows.where(F.col("org_id") == self.org_id)

    def _row(self, profile_id: str, given: ProfileInput, source_kind: str, created_at: datetime, now: datetime) -> DataFrame:
        rest = [x or None for x in (given.charset, given.delimiter, given.decimal_sep, given.date_fmt)]
        return self.spark.createDataFrame([(self.org_id, profile_id, given.name, source_kind, dict(given.column_map), *rest, created_at, now)], PROFILES)

    def _free(self, rows: DataFrame, name: str, but: str) -> None:
        if not rows.where((F.col("name") == name) & (F.col("profile_id") != but)).isEmpty():
            raise Refused("name_taken", name)

    def create(self, given: ProfileInput, now: datetime | None = None) -> str:
        given.check()
        profile_id, now = str(uuid.uuid4()), now or _now()

        def changed(rows: DataFrame) -> DataFrame:
            self._free(self._own(rows), given.name, profile_id)
            return self._row(profile_id, given, given.source_kind, now, now)

        self.table.change(changed)
        return profile_id

    def get(self, profile_id: str) -> Row:
        found = self._own(self.table.read()).where(F.col("profile_id") == profile_id).first()
        if found is None:
            raise Refused("not_found", profile_id)
        return found

    def all(self) -> DataFrame:
        """All profiles by name."""
        return self._own(self.table.read()).orderBy("name")

    def update(self, profile_id: str, given: ProfileInput, now: datetime | None = None) -> None:
        """All but the source kind, which a profile keeps."""
        given.check()

        def changed(rows: DataFrame) -> DataFrame:
            own = self._own(rows)
            old = own.where(F.col("profile_id") == profile_id).first()
            if old is None:
                raise Refused("not_found", profile_id)
            self._free(own, given.name, profile_id)
            return self._row(profile_id, given, old.source_kind, old.created_at, now or _now())

        self.table.change(changed)

    def delete(self, profile_id: str) -> None:
        """Removes a profile that no batch has used."""

        def changed(rows: DataFrame) -> DataFrame:
            own = self._own(rows).where(F.col("profile_id") == profile_id)
            if own.isEmpty():
                raise Refused("not_found", profile_id)
            if not self.batches._own(self.batches.table.read()).where(F.col("profile_id") == profile_id).isEmpty():
                raise Refused("profile_in_use", profile_id)
            return own.withColumn("gone", F.lit(True))

        self.table.change(changed)

    def parameters(self, profile_id: str) -> Profile:
        """The profile as the statement parsers take it."""
        p = self.get(profile_id)
        return Profile(p.charset or "", p.delimiter or "", dict(p.column_map), p.decimal_sep or "", p.date_fmt or "")
