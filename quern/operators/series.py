"""Operators on series: top-n with the rest folded, downsampling, trends."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.evaluate import top_of


def fold_top_n(totals: DataFrame, by: list[str], label: str, value: str, n: int = 8) -> DataFrame:
    """Of each group the ``n`` largest positive values, and what all others come to as ``other`` with ``folded`` true.

    Others are the group's sum less its largest, so no task sorts a group: each
    keeps its own ``n`` largest, and those meet. A label that is itself ``other``
    stays apart, not folded.
    """
    used = totals.where(F.col(value) > 0)
    top = top_of(used, by, [F.desc(value), F.col(label)], n).select(*by, label, value)
    whole = used.groupBy(*by).agg(F.sum(value).alias("__whole"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") > n)
    held = top.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.sum(value).alias("__top"))
    same = [whole[c].eqNullSafe(held[f"__{c}"]) for c in by]
    rest = whole.join(held, same).select(*by, F.lit("other").alias(label), (F.col("__whole") - F.col("__top")).alias(value))
    return top.withColumn("folded", F.lit(False)).unionByName(rest.withColumn("folded", F.lit(True)))


def trend_facets(periods: DataFrame, by: list[str], label: str, value: str, n: int = 8) -> DataFrame:
    """The ``n`` labels of the largest absolute total in each group that have any value, with their total."""
    totals = periods.groupBy(*by, label).agg(F.sum(value).alias("total"), F.sum((F.col(value) != 0).cast("bigint")).alias("used")).where("used > 0")
    return top_of(totals, by, [F.desc(F.abs("total")), F.col(label)], n).select(*by, label, "total", "rank")


def ohlc_buckets(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """Candles of each series folded to ``most`` at most: first open, highest high, lowest low, last close.

    rows: ``by``, position (0, 1, ... in a series), count (of its series), open, high, low, close.
    """
    bucket = F.when(F.col("count") <= most, F.col("position")).otherwise(F.expr(f"((position + 1) * {most} - 1) div count"))
    out = rows.withColumn("bucket", bucket.cast("bigint")).groupBy(*by, "bucket")
    return out.agg(F.min_by("open", "position").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "position").alias("close"))


def net_split(amount: Column) -> tuple[Column, Column]:
    """A result as profit and as loss, both at least zero."""
    return F.greatest(amount, F.lit(0)), F.greatest(-amount, F.lit(0))


def money_flow(chained: DataFrame, by: list[str], costs: Sequence[str]) -> DataFrame:
    """Edges source, target, amount_minor from revenue to the total and on to costs and what remains; nothing without revenue."""
    edges = [F.struct(F.lit("01").alias("source"), F.lit("total").alias("target"), F.col("s_01").alias("amount_minor"))]
    edges += [F.struct(F.lit("total").alias("source"), F.lit(s).alias("target"), (-F.col(f"s_{s}")).alias("amount_minor")) for s in costs]
    edges += [F.struct(F.lit("total").alias("source"), F.lit("remainder").alias("target"), F.col("s_95").alias("amount_minor"))]
    return chained.where("s_01 > 0").select(*by, F.explode(F.array(*edges)).alias("e")).select(*by, "e.*").where("amount_minor > 0")


def within(domain: tuple[Column, Column], x: Column) -> Column:
    """A closed filter of a time axis."""
    return (x >= domain[0]) & (x <= domain[1])


def project_trend(rows: DataFrame, by: list[str], x: str, y: str, ahead: int) -> DataFrame:
    """``ahead`` points on the least-squares line of each series, at its mean step; a flat line if it has one x only."""
    n, sx, sy = F.count(F.lit(1)), F.sum(F.col(x).cast("double")), F.sum(F.col(y).cast("double"))
    sxy, sxx = F.sum(F.col(x).cast("double") * F.col(y)), F.sum(F.col(x).cast("double") * F.col(x))
    sums = rows.groupBy(*by).agg(n.alias("n"), sx.alias("sx"), sy.alias("sy"), sxy.alias("sxy"), sxx.alias("sxx"), F.min(x).alias("x0"), F.max(x).alias("x1"))
    below = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(below != 0, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / below).otherwise(0.0)
    step = F.when(F.col("n") > 1, (F.col("x1") - F.col("x0")) / (F.col("n") - 1)).otherwise(F.lit(1.0))
    line = sums.withColumn("slope", slope).withColumn("step", step).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(ahead))))
    at = F.col("x1") + F.col("k") * F.col("step")
    return line.select(*by, F.col("k").cast("bigint").alias("k"), at.alias("x"), (F.col("sy") / F.col("n") + F.col("slope") * (at - F.col("sx") / F.col("n"))).alias("y"))


def triangle_buckets(ys: Sequence[float], most: int) -> list[int]:
    """Places that largest-triangle-three-buckets keeps of a series.

    The first bucket begins one place after the first bucket's width, and the
    last bucket is empty, so the final point comes twice; both are kept as they are.
    """
    n = len(ys)
    if most >= n or most < 3:
        return list(range(n))
    width = (n - 2) / (most - 2)
    edge = lambda k: math.floor(k * width) + 1
    kept = [0]
    for i in range(most - 2):
        inside = range(edge(i + 1), min(edge(i + 2), n - 1))
        after = range(edge(i + 2), min(edge(i + 3), n))
        cx, cy = (sum(after) / len(after), sum(ys[j] for j in after) / len(after)) if len(after) else (n - 1, ys[n - 1])
        ax, ay = kept[-1], ys[kept[-1]]
        area = lambda j: abs((ax - cx) * (ys[j] - ay) - (ax - j) * (cy - ay)) / 2  # noqa: B023, E731
        kept.append(max(inside, key=area) if len(inside) else edge(i + 1))
    return [*kept, n - 1]


def lttb(rows: DataFrame, by: list[str], order: list[str], y: str, most: int) -> DataFrame:
    """Each series downsampled as by ``triangle_buckets``: ``by``, place, and the value there.

    Places and counts come from windows, whose rows go to disk beyond memory, and
    the middle of each bucket from a sum by bucket. Each choice depends on the
    one before it, so a series is one sequence; a task streams over its sorted
    rows and holds two points, however long the series is.
    """
    series, kind = Window.partitionBy(*by), rows.schema[y].dataType.simpleString()
    placed = rows.select(*by, F.col(y).alias("__y"), (F.row_number().over(series.orderBy(*[F.asc_nulls_last(c) for c in [*order, y]])) - 1).cast("bigint").alias("place"))
    placed = placed.withColumn("__n", F.count(F.lit(1)).over(series))
    width = (F.col("__n") - 2).cast("double") / float(max(most - 2, 1))
    edge = lambda k: F.floor(k * width) + 1
    near = F.floor((F.col("place") - 1) / width)
    bucket = near + (edge(near + 1) <= F.col("place")).cast("bigint") - (edge(near) > F.col("place")).cast("bigint")
    # The first bucket that is chosen from is 1; series short enough to stay whole have none.
    placed = placed.withColumn("__k", F.when((F.col("__n") > most) & (F.lit(most) >= 3) & (F.col("place") > 0), bucket))
    middle = placed.where("__k is not null").groupBy(*[F.col(c).alias(f"__{c}") for c in by], (F.col("__k") - 1).alias("__before"))
    middle = middle.agg(F.avg("place").alias("__cx"), F.avg(F.coalesce(F.col("__y").cast("double"), F.lit(float("nan")))).alias("__cy"))
    same = F.col("__k") == F.col("__before")
    for c in by:
        same = same & placed[c].eqNullSafe(F.col(f"__{c}"))
    met = placed.join(middle, same, "left").where("__k is null or __k > 0 or place = __n - 1").select(*by, "place", F.col("__y").alias(y), "__n", "__k", "__cx", "__cy")

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = best = None  # (place, row) of the point chosen last, and of the best of the bucket so far
        now = area = None
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False, name=None):
                *group, place, value, n, k, cx, cy = row
                if most >= n or most < 3:
                    out.append((*group, place, value))
                    continue
                point, at = (*group, place, value), float("nan") if value is None else float(value)
                if place == 0:
                    before, best, now = (0, at), None, None
                    out.append(point)
                    continue
                if best is not None and (place == n - 1 or k != now):
                    out.append(best)
                    before, best = (best[-2], float("nan") if best[-1] is None else float(best[-1])), None
                if place == n - 1:
                    # The last bucket is the final point's own, or has the one point before it.
                    out += [point] * (1 if now == most - 2 else 2)
                    continue
                now, (ax, ay) = k, before
                mine = abs((ax - cx) * (at - ay) - (ax - place) * (cy - ay)) / 2
                if best is None or mine > area:
                    best, area = point, mine
            yield pd.DataFrame(out, columns=[*by, "place", y])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
    return met.repartition(*by).sortWithinPartitions(*by, "place").mapInPandas(choose, f"{kinds}, place bigint, {y} {kind}")


def project_last_segment(rows: DataFrame, by: list[str], x: str, y: str, ahead: int) -> DataFrame:
    """``ahead`` points on from each series' last one, along its last segment and at that segment's step.

    A series of one point stays level, at steps of one. Of points that share an
    x the larger y counts as the later.
    """
    order = Window.partitionBy(*by).orderBy(F.desc(x), F.desc(y))
    two = rows.select(*by, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"), F.row_number().over(order).alias("__rn")).where("__rn <= 2")
    pick = lambda c, k: F.max(F.when(F.col("__rn") == k, F.col(c)))
    ends = two.groupBy(*by).agg(pick("__x", 1).alias("x1"), pick("__y", 1).alias("y1"), pick("__x", 2).alias("x0"), pick("__y", 2).alias("y0"))
    step = F.coalesce(F.col("x1") - F.col("x0"), F.lit(1.0))
    rise = F.coalesce(F.when(F.col("x1") != F.col("x0"), F.col("y1") - F.col("y0")), F.lit(0.0))
    line = ends.withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(ahead).cast("bigint"))))
    return line.select(*by, "k", (F.col("x1") + F.col("k") * step).alias("x"), (F.col("y1") + F.col("k") * rise).alias("y"))
