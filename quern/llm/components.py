"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut_lineage


#: Links a partition holds between rounds; a table of few links has few partitions, whatever the shuffles' number.
ROWS = 50_000


def _large_star(links: DataFrame, parts: int) -> DataFrame:
    """Each larger neighbour of a node is tied to the node's smallest neighbour."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut_lineage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(parts))
    return both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of them; a node has few of those, so none is hot."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least.hint("merge"), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(links: DataFrame) -> tuple[int, int]:
    """How many links there are, and how many nodes keep them from being stars: a node has one smaller end, or is one."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    row = nodes.agg(F.coalesce(F.sum("up"), F.lit(0)).alias("n"), F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).alias("open")).first()
    return row["n"], row["open"]


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """node, component (its smallest node) for every node of ``links`` (u, v: bigint) but the smallest ones.

    The table stays on the executors; the driver sees two sums a round. Each
    round is written to the checkpoint folder, and so are the large star's sums
    by node: joined from there, the many neighbours of a hub can be split over
    tasks. The joins stay merges, so no round builds a table on the driver. Null
    ends and loops are ignored; no links give an empty table. Links that are no
    stars after ``most_rounds`` rounds are an error; a round shortens a chain by
    half or more.
    """
    now = cut_lineage(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(most_rounds + 1):
        n, open_ = _state(now)
        if not open_:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        parts = 1 + n // ROWS
        now = now.coalesce(parts)
        now = cut_lineage(_small_star(_large_star(now, parts)).coalesce(parts))
    raise RuntimeError(f"no stars after {most_rounds} rounds")
