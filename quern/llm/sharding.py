"""Shards that each hold the corpus's mixture of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import cut_lineage, whole_text


def interleaved_shards(docs: DataFrame, shards: int = 40, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", window_rows: int = 65_536) -> DataFrame:
    """Proportional stratified interleaving: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The rows of each source are shuffled by a seeded digest of their id and
    ranked; a row's place is the fraction ``(rank - 1/2) / rows of its source``.
    All rows are put in the order of these fractions and cut into ``shards``
    runs whose row counts differ by one at most (law ``rows``), so each run
    holds every source in the corpus's proportion.

    No source is ever in one task: rows are ranked within (source, bucket of
    the digest), and counts of the buckets give what lies before. The order of
    all rows is found in the same way, over equal ranges of the fraction, which
    are even by construction. The buckets are a power of 16, so many that a
    window holds ``window_rows`` rows or fewer on average, at any number of rows.

    Under the law ``rows`` equal texts are rows like others and are spread over
    the shards. A null source is a source of its own; a null id sorts as empty; a null text
    has no bytes. Rows equal in every used column are interchangeable. Further
    columns are ignored; an empty table gives an empty result.
    """
    n, digits = docs.count(), 1
    while 16**digits * window_rows < n:
        digits += 1
    buckets = 16**digits
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    text = whole_text(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.when(F.col(source_col).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(source_col).cast("string"))).alias("stratum"),
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        key.alias("key"),
        F.substring(key, 1, digits).alias("bucket"),
    )
    counts = rows.groupBy("stratum", "bucket").agg(F.count(F.lit(1)).alias("n"))
    of_stratum = Window.partitionBy("stratum")
    before = counts.select(
        "stratum",
        "bucket",
        (F.sum("n").over(of_stratum.orderBy("bucket")) - F.col("n")).alias("before"),
        F.sum("n").over(of_stratum).alias("in_stratum"),
    )
    by_key = Window.partitionBy("stratum", "bucket").orderBy("key", "doc_id", "text_crc32", "size")
    rank = F.row_number().over(by_key).cast("bigint")
    place = (2 * F.col("rank") - 1) / (2 * F.col("in_stratum"))
    ranked = rows.withColumn("own", rank).join(before, ["stratum", "bucket"]).withColumn("rank", F.col("own") + F.col("before"))
    ranked = cut_lineage(ranked.select("doc_id", "stratum", "size", "text_crc32", "key", place.alias("place")).withColumn("stretch", F.floor(F.col("place") * buckets).cast("int")))
    # One row a stretch: a row for each ``window_rows`` / 16 rows of the input at most, so the planner decides how it is joined.
    stretches = ranked.groupBy("stretch").agg(F.count(F.lit(1)).alias("n"))
    stretches = stretches.select(
        "stretch",
        (F.sum("n").over(Window.orderBy("stretch")) - F.col("n")).alias("ahead"),
        F.sum("n").over(Window.partitionBy()).alias("total"),
    )
    by_place = Window.partitionBy("stretch").orderBy("place", "stratum", "key", "doc_id", "text_crc32", "size")
    placed = ranked.withColumn("within", F.row_number().over(by_place).cast("bigint")).join(stretches, "stretch")
    position = F.col("ahead") + F.col("within") - 1
    return (
        placed.withColumn("position", position)
        .withColumn("shard", F.expr(f"int(position * {shards} div total)"))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            "shard",
            F.expr(f"position - (shard * total + {shards - 1}) div {shards}").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
