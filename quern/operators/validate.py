"""Checks of statement rows and statements, and what they mean for a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.money import exponent_of, with_amounts
from quern.functions.periods import try_parse_date
from quern.functions.text import has_replacement_char

#: The states of a batch and the moves between them. The last four states end a batch.
MOVES = {
    "awaiting_upload": ("uploaded", "abandoned", "failed"),
    "uploaded": ("parsing", "failed"),
    "parsing": ("parsed", "failed"),
    "parsed": ("validating", "failed"),
    "validating": ("validated", "rejected", "failed"),
    "validated": ("persisting", "failed"),
    "persisting": ("imported", "failed"),
    "abandoned": (),
    "rejected": (),
    "imported": (),
    "failed": (),
}


def row_errors(rows: DataFrame, today: str, date_format: str = "") -> DataFrame:
    """batch_id, line_no, field, code, raw: an error for each check that a statement row fails.

    rows: batch_id, line_no, currency, booked_on, debit, credit, description,
    counterparty, document_no as text, and account if accounts are checked. A day
    is plausible within ten times 365 days before ``today`` and one day after it;
    a profile's ``date_format`` is the only one it may be written in.
    In an unknown currency no amount can be read, so that is the one error of the
    amounts. An account that is missing or blank is not resolved.
    """
    day, now = try_parse_date(F.col("booked_on"), date_format), F.lit(today).cast("date")
    read = rows.withColumns({"__digits": exponent_of(F.col("currency")), "__day": day})
    read = with_amounts(read, "__digits", {f"__{c}": c for c in ("debit", "credit")})

    def error(bad: Column, field: str, code: str, raw: Column) -> Column:
        return F.when(F.coalesce(bad, F.lit(True)), F.struct(F.lit(field).alias("field"), F.lit(code).alias("code"), raw.alias("raw")))

    known = F.col("__digits").isNotNull()
    both = (F.coalesce("__debit", F.lit(0)) != 0) & (F.coalesce("__credit", F.lit(0)) != 0)
    checks = [
        error(F.col("__day").isNull() | (F.col("__day") < F.date_sub(now, 3650)) | (F.col("__day") > F.date_add(now, 1)), "booked_on", "date_implausible", F.col("booked_on")),
        error(~known, "currency", "currency_unknown", F.coalesce("currency", F.lit(""))),
        error(known & F.col("__debit").isNull(), "debit", "amount_unparseable", F.col("debit")),
        error(known & F.col("__credit").isNull(), "credit", "amount_unparseable", F.col("credit")),
        error(both, "debit", "debit_and_credit_both_set", F.concat("debit", F.lit(" / "), "credit")),
        *[error(F.coalesce(has_replacement_char(F.col(c)), F.lit(False)), f, "replacement_character", F.col(c)) for f, c in (("booked_on", "booked_on"), ("document_no", "document_no"), ("counterparty_name", "counterparty"), ("description", "description"))],
        error(F.trim(F.coalesce("description", F.lit(""))) == "", "description", "description_missing", F.coalesce("description", F.lit(""))),
    ]
    if "account" in rows.columns:
        checks.append(error(F.trim(F.coalesce("account", F.lit(""))) == "", "account", "account_unresolved", F.coalesce("account", F.lit(""))))
    found = F.array_compact(F.array(*checks))
    return read.select("batch_id", "line_no", F.explode(found).alias("e")).select("batch_id", "line_no", "e.field", "e.code", "e.raw")


def statement_sums(rows: DataFrame) -> DataFrame:
    """Of each batch_id: n, movement, first_on, last_on, c_lo, c_hi (currencies), and whether a row is ``repeated``.

    Rows are met once: equal rows are counted first, and those counts are summed.
    """
    equal = rows.groupBy("batch_id", "booked_on", "document_no", "counterparty_account", "debit_minor", "credit_minor").agg(F.count(F.lit(1)).alias("n"), F.min("currency").alias("c_lo"), F.max("currency").alias("c_hi"))
    return equal.groupBy("batch_id").agg(
        F.sum("n").alias("n"),
        F.sum((F.col("credit_minor") - F.col("debit_minor")) * F.col("n")).alias("movement"),
        F.min("booked_on").alias("first_on"),
        F.max("booked_on").alias("last_on"),
        F.min("c_lo").alias("c_lo"),
        F.max("c_hi").alias("c_hi"),
        F.bool_or(F.col("n") > 1).alias("repeated"),
    )


def file_warnings(rows: DataFrame, files: DataFrame) -> DataFrame:
    """batch_id, code: warnings about whole statements.

    files: batch_id, currency, opening_minor, closing_minor (null if not
    declared), period_from, period_to, declared_rows. rows: typed, with
    debit_minor and credit_minor.
    """
    return warnings_of(statement_sums(rows), files)


def warnings_of(sums: DataFrame, files: DataFrame) -> DataFrame:
    """``file_warnings`` by the ``statement_sums`` of the rows."""
    j = files.join(sums, "batch_id", "left")
    say = lambda bad, code: F.when(F.coalesce(bad, F.lit(False)), F.lit(code))
    found = F.array_compact(
        F.array(
            say(F.col("opening_minor") + F.coalesce("movement", F.lit(0)) != F.col("closing_minor"), "balance_mismatch"),
            say(F.coalesce("n", F.lit(0)) != F.col("declared_rows"), "row_count_mismatch"),
            say((F.col("first_on") < F.col("period_from")) | (F.col("last_on") > F.col("period_to")), "period_gap"),
            say(F.col("c_lo") != F.col("c_hi"), "mixed_currency"),
            say(F.col("repeated"), "duplicate_bank_reference"),
        )
    )
    return j.select("batch_id", F.explode(found).alias("code"))


def unknown_currencies(files: DataFrame) -> DataFrame:
    return files.where(exponent_of(F.col("currency")).isNull()).select("batch_id", F.lit("currency_unknown").alias("code"))


def outcomes(files: DataFrame, errors: DataFrame, warnings: DataFrame) -> DataFrame:
    """batch_id, error_count, warning_count, outcome: any error rejects, a warning alone does not."""
    e = errors.groupBy("batch_id").agg(F.count(F.lit(1)).alias("error_count"))
    w = warnings.groupBy("batch_id").agg(F.count(F.lit(1)).alias("warning_count"))
    j = files.select("batch_id").join(e, "batch_id", "left").join(w, "batch_id", "left").na.fill(0)
    return j.withColumn("outcome", F.when(F.col("error_count") > 0, "rejected").when(F.col("warning_count") > 0, "valid_with_warnings").otherwise("valid"))


def report_json(errors: DataFrame, most: int = 100, raw_bytes: int = 200) -> DataFrame:
    """batch_id, report: the first ``most`` errors by line as JSON, with their whole number; raw text cut to whole characters within ``raw_bytes``.

    Each batch keeps a bounded list: errors are ranked first, so a batch of
    millions of errors never meets in one row.
    """
    w = Window.partitionBy("batch_id").orderBy("line_no", "field", "code")
    total = errors.groupBy("batch_id").agg(F.count(F.lit(1)).alias("error_count"))
    # A character has four bytes at most: of the cuts that leave off none to three, the longest that is whole text.
    data = F.encode("raw", "UTF-8")
    cut = F.coalesce(*[F.try_validate_utf8(F.substring(data, 1, raw_bytes - k).cast("string")) for k in range(4)])
    first = errors.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    listed = first.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("rn", "line_no", "field", "code", cut.alias("raw")))).alias("errors"))
    return listed.join(total, "batch_id").select("batch_id", F.to_json(F.struct(F.lit(1).alias("schema"), "error_count", "errors")).alias("report"))


def may_move(state: Column, next_state: Column) -> Column:
    """Whether a batch may go from one state to the other; unknown states go nowhere."""
    steps = F.create_map(*[x for a, to in MOVES.items() for x in (F.lit(a), F.array(*map(F.lit, to)) if to else F.array().cast("array<string>"))])
    return F.coalesce(F.array_contains(F.try_element_at(steps, state), next_state), F.lit(False))


def illegal_moves(history: DataFrame) -> DataFrame:
    """Moves (batch_id, state, next_state) that no batch may make."""
    return history.where(~may_move(F.col("state"), F.col("next_state")))


def moved(batches: DataFrame, asked: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(batches in their new state, requests that are refused) of requests batch_id, status, failure_code.

    A failure has a code and no other state does: a code that was there before is
    cleared. Refused are requests for a batch that has several (``asked_twice``),
    for one that is not there (``not_found``), from a state
    that cannot be left that way (``illegal_transition``), for a state past the
    upload without a measurement (``not_measured``), and to import a file that is
    imported already, in this or an earlier request (``already_imported``).
    """
    want = asked.select(F.col("batch_id").alias("__id"), F.col("status").alias("__to"), F.col("failure_code").alias("__code"))
    seen = batches.where("status = 'imported'").select(F.col("org_id").alias("__org"), F.col("file_sha256").alias("__sha")).distinct()
    # By file go only requests to import one: all that have no file, or ask for another state, would meet in a task.
    measured = batches.where("file_sha256 IS NOT NULL").select("batch_id", "org_id", "file_sha256")
    imports = want.where("__to = 'imported'").join(measured, F.col("__id") == F.col("batch_id")).select("__id", "org_id", "file_sha256")
    imports = imports.withColumn("__n", F.row_number().over(Window.partitionBy("org_id", "file_sha256").orderBy("__id")))
    imports = imports.join(seen, (F.col("org_id") == F.col("__org")) & (F.col("file_sha256") == F.col("__sha")), "left")
    again = imports.where("__n > 1 OR __sha IS NOT NULL").select(F.col("__id").alias("__again")).distinct()
    joined = want.join(batches, F.col("__id") == F.col("batch_id"), "left").join(again, F.col("__id") == F.col("__again"), "left")
    unmeasured = F.col("file_sha256").isNull() | F.col("byte_length").isNull() | F.col("content_type").isNull()
    refused = (
        F.when(F.count(F.lit(1)).over(Window.partitionBy("__id")) > 1, "asked_twice")
        .when(F.col("batch_id").isNull(), "not_found")
        .when(~may_move(F.col("status"), F.col("__to")), "illegal_transition")
        .when(unmeasured & ~F.col("__to").isin("awaiting_upload", "abandoned", "failed"), "not_measured")
        .when(F.col("__again").isNotNull(), "already_imported")
    )
    judged = joined.withColumn("refused", refused)
    new = {"status": F.col("__to"), "failure_code": F.when(F.col("__to") == "failed", F.col("__code")), "updated_at": now}
    done = judged.where("refused IS NULL").withColumns(new).select(*batches.columns)
    return done, judged.where("refused IS NOT NULL").select(F.col("__id").alias("batch_id"), "status", F.col("__to").alias("next_status"), "refused")


def expired(batches: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    """The control table with uploads that never came marked abandoned."""
    late = (F.col("state") == "awaiting_upload") & (F.col("created_at") < now - F.expr(f"interval {minutes} minutes"))
    return batches.withColumn("state", F.when(late, "abandoned").otherwise(F.col("state")))


def override(validations: DataFrame, asked: DataFrame, least_reason: int = 10) -> DataFrame:
    """Overridden batches: asked for by an approver with a reason, of warnings only, once."""
    ok = asked.where(F.col("role").isin("owner", "admin", "approver") & (F.length(F.trim("reason")) >= least_reason))
    fresh = validations.where((F.col("outcome") == "valid_with_warnings") & F.col("overridden_by").isNull())
    return fresh.drop("overridden_by").join(ok.groupBy("batch_id").agg(F.min("user_id").alias("overridden_by")), "batch_id")


def resolve_accounts(rows: DataFrame, accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with account_id and mixed_currency, accounts to create): known by (org, entity, external_ref), or new under a stable id.

    A row without an external_ref resolves to no account and creates none. An
    account on file in another currency than the row's is flagged, if both tables
    have a currency.
    """
    key = ["org_id", "entity_id", "external_ref"]
    has_currency = "currency" in rows.columns and "currency" in accounts.columns
    on_file = accounts.select(*key, "account_id", *[F.col("currency").alias("__currency")] * has_currency)
    given = F.trim(F.coalesce(F.col("external_ref").cast("string"), F.lit(""))) != ""
    j = rows.join(on_file, key, "left")
    fresh = F.sha2(F.concat_ws("\x1f", *[F.col(k).cast("string") for k in key]), 256)
    new = j.where(F.col("account_id").isNull() & given).select(*key).distinct().withColumn("account_id", fresh)
    mixed = F.coalesce(F.col("__currency") != F.col("currency"), F.lit(False)) if has_currency else F.lit(False)
    out = j.withColumn("mixed_currency", mixed).withColumn("account_id", F.coalesce(F.col("account_id").cast("string"), F.when(given, fresh)))
    return out.drop("__currency"), new
