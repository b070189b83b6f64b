"""Exact deduplication that stays balanced when one text fills a third of all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut_lineage, whole_text


def sha256_bytes(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64, digest: Callable[[Column], Column] = sha256_bytes) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are equal when their texts are identical; of equal rows the one with
    the largest id stays. Three stages compare digest and full text:

    1. every task folds its own equal rows before it sends anything,
    2. rows of one digest are merged within each of ``salts`` salts,
    3. the winners of the salts, at most ``salts`` a text, are merged.

    The outcome returns to the rows by digest alone as long as no digest stands
    for two texts; that is looked at on the merged groups. If one does, digest
    and text are joined. The hot side of that join is left to adaptive
    execution, which splits it.

    A null text counts as empty. A null id never wins over another id; a group
    of null ids only has keep_id null, and kept is true. Rows that repeat both
    id and text are counted one by one and share their fate. Further columns
    are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("content"))
    keyed = rows.withColumn("digest", digest(F.col("content")))
    salted = (
        keyed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
        .groupBy("digest", "salt", "content")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    winners = salted.groupBy("digest", "content").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    heads = cut_lineage(winners.drop("content"))
    if heads.groupBy("digest").count().where("count > 1").isEmpty():
        joined = keyed.select("doc_id", "digest", F.sha2("content", 256).alias("text_sha256")).join(heads, "digest")
    else:
        joined = keyed.select("doc_id", "digest", "content", F.sha2("content", 256).alias("text_sha256")).join(winners, ["digest", "content"])
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = exact_groups(docs, id_col, text_col, **options).where("kept").select(F.col("doc_id").alias("__kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["__kept_id"]), "left_semi")
