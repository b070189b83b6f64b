"""Duplicates of files and of ledger rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def content_key(account: Column, booked_on: Column, minor: Column, currency: Column, description_norm: Column, bank_ref: Column, document_ref: Column, posting_no: Column) -> Column:
    """The eight fields that two copies of a row share; a missing field is empty, never left out."""
    fields = [account.cast("string"), F.date_format(booked_on, "yyyy-MM-dd"), minor.cast("string"), currency, description_norm, bank_ref, document_ref, posting_no.cast("string")]
    return F.concat_ws(SEPARATOR, *[F.coalesce(f, F.lit("")) for f in fields])


def with_occurrence(rows: DataFrame, key: str = "content_key") -> DataFrame:
    """Which repeat of its content a row is, in file order within its batch; copies within one file are real rows."""
    order = Window.partitionBy("batch_id", key).orderBy("line_no", "posting_no", "txn_id")
    return rows.withColumn("occurrence", F.row_number().over(order))


def dedup_hash(key: Column, occurrence: Column) -> Column:
    return F.sha2(F.concat(key, F.lit(SEPARATOR), occurrence.cast("string")), 256)


def split_reimports(incoming: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, rows to skip): a row whose hash the ledger holds is skipped and names the latest match.

    Matches are folded to one row per hash before the join.
    """
    latest = ledger.groupBy("dedup_hash").agg(F.max(F.struct("created_on", "txn_id", "batch_id")).alias("m"))
    latest = latest.select("dedup_hash", F.col("m.txn_id").alias("matched_txn_id"), F.col("m.batch_id").alias("matched_batch_id"))
    joined = incoming.join(latest, "dedup_hash", "left")
    skips = joined.where(F.col("matched_txn_id").isNotNull()).withColumn("level", F.lit("D3"))
    return joined.where(F.col("matched_txn_id").isNull()).drop("matched_txn_id", "matched_batch_id"), skips


def known_files(files: DataFrame, imported: DataFrame) -> DataFrame:
    """Files whose digest was imported before."""
    return files.join(imported.select("file_sha256").distinct(), "file_sha256", "left_semi")


def batch_summary(txn: DataFrame, skips: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of each batch: rows kept, rows skipped at each level, pairs that stand."""
    kept = txn.groupBy("batch_id").agg(F.count(F.lit(1)).alias("transactions"))
    skipped = skips.groupBy("batch_id").agg(F.count_if(F.col("level") == "D2").alias("skipped_d2"), F.count_if(F.col("level") == "D3").alias("skipped_d3"))
    paired = pairs.where(~F.col("dismissed")).groupBy("batch_id").agg(F.countDistinct("transfer_id").alias("active_pairs"))
    return kept.join(skipped, "batch_id", "full").join(paired, "batch_id", "full").na.fill(0)
