"""Statement files as a stream: each new file is measured, parsed, checked and appended once.

The stages of one batch run inside ``foreachBatch`` with an ``availableNow``
trigger. A file whose digest was imported is not read again; a file that failed
is recorded with the reason, and is tried again when it comes again.

A batch's four tables are one commit, named by stream and epoch. A run that
stops between two writes has written nothing that a reader sees, and the epoch
is imported again as if for the first time; a run that stops after the commit,
before the stream has noted the epoch, finds it done.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.functions.periods import try_parse_date
from quern.functions.text import counterparty_key, normalize_description
from quern.operators.dedup import content_key, dedup_hash, split_reimports, with_occurrence
from quern.operators.validate import file_warnings, outcomes, row_errors
from quern.sources.sinks import write_ledger
from quern.sources.statements import Profile, measured, statement_lines, statements
from quern.sources.versions import Commits

FILES_SCHEMA = "path string, file_sha256 string, byte_length bigint, content_type string, failure_code string, detail string, error_count bigint, warning_count bigint"
HASH_SCHEMA = "dedup_hash string, txn_id string, batch_id string, created_on timestamp, org_id string, month string"
LEDGER_SCHEMA = (
    "batch_id string, line_no bigint, account string, currency string, booked_on date, amount_minor bigint, counterparty_raw string, counterparty_key string, description_raw string, description_norm string, "
    "posting_no int, txn_id string, content_key string, occurrence int, dedup_hash string, created_on timestamp, base_amount_minor bigint, base_currency string, org_id string, month string"
)
SKIPS_SCHEMA = "dedup_hash string, batch_id string, line_no bigint, level string, matched_txn_id string, matched_batch_id string"
ERRORS_SCHEMA = "batch_id string, line_no bigint, field string, code string, raw string"
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def ledger_rows(lines: DataFrame, date_format: str = "") -> DataFrame:
    """Ledger rows of statement lines: signed amounts, normal forms and content hashes."""
    none = F.lit(None).cast("string")
    amount = F.when(F.col("debit_minor") != 0, -F.col("debit_minor")).otherwise(F.col("credit_minor"))
    rows = lines.select(
        F.col("path").alias("batch_id"),
        "line_no",
        "account",
        "currency",
        try_parse_date(F.col("booked_on"), date_format).alias("booked_on"),
        amount.alias("amount_minor"),
        F.col("counterparty_name").alias("counterparty_raw"),
        counterparty_key(F.col("counterparty_name"), F.col("counterparty_tax_id"), F.col("counterparty_account")).alias("counterparty_key"),
        F.col("description").alias("description_raw"),
        normalize_description(F.col("description")).alias("description_norm"),
        F.lit(0).alias("posting_no"),
        F.concat_ws("#", "path", "line_no").alias("txn_id"),
    )
    return rows.withColumn("content_key", content_key(F.col("account"), F.col("booked_on"), F.col("amount_minor"), F.col("currency"), F.col("description_norm"), none, none, F.col("posting_no")))


def errors_of(lines: DataFrame, today: str, date_format: str = "") -> DataFrame:
    """The row checks over statement lines, whose amounts are read again from the file's own text."""
    typed = lines.select(
        F.col("path").alias("batch_id"),
        "line_no",
        "currency",
        "account",
        "booked_on",
        F.coalesce("debit_raw", F.lit("")).alias("debit"),
        F.coalesce("credit_raw", F.lit("")).alias("credit"),
        "description",
        F.col("counterparty_name").alias("counterparty"),
        "document_no",
    )
    return row_errors(typed, today, date_format)


def warnings_of(parsed: DataFrame, lines: DataFrame, date_format: str = "") -> DataFrame:
    """The checks of whole statements."""
    files = parsed.select(F.col("path").alias("batch_id"), "currency", "opening_minor", "closing_minor", try_parse_date(F.col("period_from")).alias("period_from"), try_parse_date(F.col("period_to")).alias("period_to"), "declared_rows")
    rows = lines.select(F.col("path").alias("batch_id"), "currency", try_parse_date(F.col("booked_on"), date_format).alias("booked_on"), "document_no", "counterparty_account", "debit_minor", "credit_minor")
    return file_warnings(rows, files)


def import_batch(files: DataFrame, ledger_path: str, files_path: str, org_id: str = "org", today: str | None = None, accept_warnings: bool = True, commit: str | None = None, profile: Profile = Profile()) -> bool:
    """Imports the files not imported before, as the commit of that name; false if there is one already.

    A file that is too large, that no parser reads, or of which a row fails a
    check is recorded with ``failure_code`` file_too_large, unreadable or
    rejected, and none of its rows is written; the errors go to
    ``<files_path>-errors``. Files with warnings alone are imported, unless
    ``accept_warnings`` is false; then they are recorded as needs_override.

    Rows, skips, errors and files are written to ``ledger_path``,
    ``<files_path>-skips``, ``<files_path>-errors`` and ``files_path`` and become
    visible together; ``imported`` reads them.

    Of rows of one batch that share a hash the one of the smallest path and line
    stays; that one is skipped as well if the ledger has its hash. Skips are
    recorded as level D3 in ``<files_path>-skips``. Only the months that the
    batch touches are read of the ledger: a hash holds the day, so a copy lies in
    its own month.
    """
    spark = files.sparkSession
    commits, commit = Commits(spark, f"{files_path}-commits"), commit or uuid.uuid4().hex
    if commits.done(commit):
        return False
    today = today or str(spark.sql("SELECT current_date()").first()[0])
    seen = commits.read("files", files_path, FILES_SCHEMA).where("failure_code IS NULL").select("file_sha256")
    first = measured(files).withColumn("__rn", F.row_number().over(Window.partitionBy("file_sha256").orderBy("path"))).where("__rn = 1").drop("__rn")
    new = first.join(seen, "file_sha256", "left_anti").persist()
    parsed = statements(files.join(new.where("failure_code IS NULL").select("path"), "path", "left_semi"), profile).persist()
    lines = statement_lines(parsed)
    errors = errors_of(lines, today, profile.date_format).persist()
    readable = parsed.where("error IS NULL")
    judged = outcomes(readable.select(F.col("path").alias("batch_id")), errors, warnings_of(readable, lines, profile.date_format)).withColumnRenamed("batch_id", "path")
    judged = judged.join(parsed.select("path", "error"), "path", "full")
    refused = F.col("outcome") == "valid_with_warnings" if not accept_warnings else F.lit(False)
    code = F.when(F.col("error").isNotNull(), "unreadable").when(F.col("outcome") == "rejected", "rejected").when(refused, "needs_override")
    judged = judged.withColumn("said", code).persist()

    rows = with_occurrence(ledger_rows(lines.join(judged.where("said IS NULL").select("path"), "path", "left_semi"), profile.date_format))
    rows = rows.withColumn("dedup_hash", dedup_hash(F.col("content_key"), F.col("occurrence"))).withColumn("created_on", F.current_timestamp())
    months = [r[0] for r in rows.select(F.date_format("booked_on", "yyyy-MM")).distinct().collect()]  # as many as a statement spans
    held_months = F.arrays_overlap("months", F.array(*map(F.lit, months))) if months else F.lit(False)
    stored = commits.read("ledger", ledger_path, HASH_SCHEMA, held_months).where((F.col("org_id").cast("string") == org_id) & F.col("month").isin(months))
    copies = Window.partitionBy("dedup_hash").orderBy("batch_id", "line_no")
    numbered = rows.withColumn("__rn", F.row_number().over(copies)).withColumns({"__txn": F.first("txn_id").over(copies), "__batch": F.first("batch_id").over(copies)})
    insert, known = split_reimports(numbered.where("__rn = 1").drop("__rn", "__txn", "__batch"), stored.select("dedup_hash", "created_on", "txn_id", "batch_id"))
    insert, known = insert.persist(), known.persist()
    again = numbered.where("__rn > 1").select("dedup_hash", "batch_id", "line_no", F.lit("D3").alias("level"), F.col("__txn").alias("matched_txn_id"), F.col("__batch").alias("matched_batch_id"))
    skips = known.select("dedup_hash", "batch_id", "line_no", "level", "matched_txn_id", "matched_batch_id").unionByName(again).persist()
    skips.count()  # told apart before the ledger grows
    record = new.join(judged.select("path", "said", F.col("error").alias("detail"), "error_count", "warning_count"), "path", "left")
    record = record.withColumn("failure_code", F.coalesce("failure_code", "said")).select("path", "file_sha256", "byte_length", "content_type", "failure_code", "detail", "error_count", "warning_count")

    none = F.lit(None)
    checked = insert.withColumns({"org_id": F.lit(org_id), "base_amount_minor": none.cast("bigint"), "base_currency": none.cast("string")})
    appended = {"ledger": (ledger_path, lambda at: write_ledger(checked, at))} if not insert.isEmpty() else {}
    appended |= {name: (path, rows.write.parquet) for name, path, rows in (("skips", f"{files_path}-skips", skips), ("errors", f"{files_path}-errors", errors), ("files", files_path, record))}
    done = commits.append(commit, appended, {"months": months})
    for held in (skips, insert, known, judged, errors, parsed, new):
        held.unpersist()
    return done


def imported(spark: SparkSession, ledger_path: str, files_path: str) -> dict[str, DataFrame]:
    """The tables ``ledger``, ``skips``, ``errors`` and ``files`` with the rows of all commits."""
    commits = Commits(spark, f"{files_path}-commits")
    tables = {"ledger": (ledger_path, LEDGER_SCHEMA), "skips": (f"{files_path}-skips", SKIPS_SCHEMA), "errors": (f"{files_path}-errors", ERRORS_SCHEMA), "files": (files_path, FILES_SCHEMA)}
    return {name: commits.read(name, path, schema) for name, (path, schema) in tables.items()}


def stream_files(spark: SparkSession, inbox: str, ledger_path: str, files_path: str, checkpoint: str, **options) -> StreamingQuery:
    """Imports every file that is there and ends; ``options`` are those of ``import_batch``. The checkpoint's place is the stream's name."""
    source = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).load(inbox).select("path", "length", "content")
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    run = lambda batch, epoch: import_batch(batch, ledger_path, files_path, commit=f"{stream}-{epoch}", **options)
    return source.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(run).start()
