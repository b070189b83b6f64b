"""Months, quarters and years as labels and as closed ranges of dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRANULARITIES = ("month", "quarter", "year")


def period_label(day: Column, granularity: str = "month") -> Column:
    """``YYYY-MM``, ``YYYY-Qn`` or ``YYYY``; within one granularity the order of labels is that of time."""
    if granularity == "month":
        return F.date_format(day, "yyyy-MM")
    if granularity == "quarter":
        return F.concat(F.date_format(day, "yyyy"), F.lit("-Q"), F.quarter(day).cast("string"))
    if granularity == "year":
        return F.date_format(day, "yyyy")
    raise ValueError(f"granularity {granularity!r} is none of {GRANULARITIES}")


def period_start(label: Column) -> Column:
    """The first day of a label's period; a label of no known form gives null."""
    year = F.substring(label, 1, 4).try_cast("int")
    month = (
        F.when(label.rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])$"), F.substring(label, 6, 2).try_cast("int"))
        .when(label.rlike(r"^[0-9]{4}-Q[1-4]$"), F.substring(label, 7, 1).try_cast("int") * 3 - 2)
        .when(label.rlike(r"^[0-9]{4}$"), F.lit(1))
    )
    return F.make_date(year, month, F.lit(1))


def period_end(label: Column) -> Column:
    """The last day of a label's period."""
    months = F.when(F.length(label) == 4, 11).when(F.contains(label, F.lit("Q")), 2).otherwise(0)
    return F.last_day(F.add_months(period_start(label), months))


def months_between(spark: SparkSession, first: str, last: str) -> DataFrame:
    """month_start for every month of a closed range ``YYYY-MM`` to ``YYYY-MM``; from after to is an error."""
    if first > last:
        raise ValueError(f"{first} is after {last}")
    return spark.range(1).select(F.explode(F.sequence(F.lit(f"{first}-01").cast("date"), F.lit(f"{last}-01").cast("date"), F.expr("interval 1 month"))).alias("month_start"))


def calendar(spark: SparkSession, first: str, last: str, granularity: str = "month") -> DataFrame:
    """period, period_from, period_to for every period that the months touch, clipped to them."""
    months = months_between(spark, first, last)
    return months.groupBy(period_label(F.col("month_start"), granularity).alias("period")).agg(F.min("month_start").alias("period_from"), F.last_day(F.max("month_start")).alias("period_to"))


def try_parse_date(text: Column, layout: str = "") -> Column:
    """A day from the four known layouts, tried in order, or from the one that is named; null if none fits."""
    bare = F.trim(text)
    if layout:
        return F.try_to_date(bare, layout)
    layouts = [(r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$", "dd.MM.yyyy"), (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "yyyy-MM-dd"), (r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$", "dd/MM/yyyy"), (r"^[0-9]{2}-[0-9]{2}-[0-9]{4}$", "dd-MM-yyyy")]
    return F.coalesce(*[F.when(bare.rlike(shape), F.try_to_date(bare, layout)) for shape, layout in layouts])
