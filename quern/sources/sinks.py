"""Sinks: raw rows as JSON payloads, the ledger, and seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.money import exponent_of


def payloads(rows: DataFrame, keys: tuple[str, ...] = ("batch_id", "line_no")) -> DataFrame:
    """The keys and all other columns as one JSON text."""
    return rows.select(*keys, F.to_json(F.struct(*[c for c in rows.columns if c not in keys])).alias("payload"))


def read_payloads(stored: DataFrame, schema: str) -> DataFrame:
    """Payloads read back with a declared schema."""
    return stored.select(*[c for c in stored.columns if c != "payload"], F.from_json("payload", schema).alias("p")).select(*[c for c in stored.columns if c != "payload"], "p.*")


def zipped_payloads(batch: DataFrame, lines: str = "line_nos", bodies: str = "payloads") -> DataFrame:
    """Parallel arrays of line numbers and payloads as rows, paired by place."""
    return batch.select("batch_id", F.explode(F.arrays_zip(F.col(lines).alias("line_no"), F.col(bodies).alias("payload"))).alias("z")).select("batch_id", "z.line_no", "z.payload")


def checked_ledger(txn: DataFrame) -> DataFrame:
    """Rows fit for the ledger; an unknown currency, a line number below 1 or half a conversion is an error."""
    bad = (
        F.when(exponent_of(F.col("currency")).isNull(), F.concat(F.lit("unknown currency: "), F.coalesce("currency", F.lit("null"))))
        .when(F.col("line_no") <= 0, "line_no must be positive")
        .when(F.col("base_amount_minor").isNull() != F.col("base_currency").isNull(), "a conversion is whole or absent")
        .when(F.col("base_currency") == F.col("currency"), "a conversion needs two currencies")
    )
    return txn.withColumn("line_no", F.when(bad.isNull(), F.col("line_no")).otherwise(F.raise_error(bad).cast("bigint")))


def write_ledger(txn: DataFrame, path: str) -> None:
    """Appends checked rows, laid out by organisation and month so that reports read only their own; under a folder of ``Commits`` too."""
    checked_ledger(txn).withColumn("month", F.date_format("booked_on", "yyyy-MM")).write.mode("append").partitionBy("org_id", "month").parquet(path)


def write_seed(table: DataFrame, path: str, kind: str = "csv") -> None:
    """A small table as CSV with a header, or as JSON lines, in one file."""
    out = table.coalesce(1).write.mode("overwrite")
    out.option("header", True).csv(path) if kind == "csv" else out.json(path)


def insert_statements(table: DataFrame, name: str) -> DataFrame:
    """One SQL insert per row, values quoted."""
    quoted = [F.when(F.col(c).isNull(), "NULL").otherwise(F.concat(F.lit("'"), F.replace(F.col(c).cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))) for c in table.columns]
    return table.select(F.concat(F.lit(f"INSERT INTO {name} ({', '.join(table.columns)}) VALUES ("), F.concat_ws(", ", *quoted), F.lit(");")).alias("statement"))
