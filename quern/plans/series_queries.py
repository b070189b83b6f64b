"""Queries on series of figures and of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import pnl, series
from quern.plans.registry import query
from quern.plans.report_queries import WITH, report, report_sql, tagged, tagged_sql, whole_calendar, wide_sql
from quern.sources import carrier

COSTS = ("02", "03", "04", "05", "06", "07")
_COSTS_SQL = "(" + ", ".join(f"'{c}'" for c in COSTS) + ")"


def cost_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, sf_dir, "year").where((F.col("period") == "total") & F.col("line").isin(*COSTS)).select(*pnl.REPORT, "line", "amount_minor")


@query(
    "top_n_fold",
    f"""WITH t AS (SELECT org_id, entity_id, line, amount_minor FROM ({report_sql('year')}) WHERE period = 'total' AND line IN {_COSTS_SQL} AND amount_minor > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY org_id, entity_id ORDER BY amount_minor DESC, line) AS rn FROM t)
SELECT org_id, entity_id, CASE WHEN rn <= 1 THEN line ELSE 'other' END AS line, rn > 1 AS folded, sum(amount_minor)::BIGINT AS amount_minor FROM r GROUP BY 1, 2, 3, 4""",
)
def top_n_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.fold_top_n(cost_totals(spark, sf_dir), pnl.REPORT, "line", "amount_minor", 1)


@query(
    "top_counterparties",
    f"""{WITH}, t AS (SELECT org_id, entity_id, CASE WHEN counterparty_key LIKE '%11' THEN 'other' ELSE counterparty_key END AS counterparty_key, sum(abs(reported_minor))::BIGINT AS volume FROM txn GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY org_id, entity_id ORDER BY volume DESC, counterparty_key) AS rn FROM t)
SELECT org_id, entity_id, CASE WHEN rn <= 8 THEN counterparty_key ELSE 'other' END AS counterparty_key, rn > 8 AS folded, sum(volume)::BIGINT AS volume FROM r GROUP BY 1, 2, 3, 4""",
)
def top_counterparties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some counterparties are called ``other`` here, as what is folded is."""
    named = F.when(F.endswith("counterparty_key", F.lit("11")), "other").otherwise(F.col("counterparty_key")).alias("counterparty_key")
    totals = carrier.transactions(spark, sf_dir).groupBy(*pnl.REPORT, named).agg(F.sum(F.abs("reported_minor")).alias("volume"))
    return series.fold_top_n(totals, pnl.REPORT, "counterparty_key", "volume")


@query(
    "trend_facets",
    f"""{WITH}, {tagged_sql()}, t AS (SELECT org_id, entity_id, line, sum(amount)::BIGINT AS total FROM (SELECT org_id, entity_id, line, period, sum(reported_minor) AS amount FROM tagged GROUP BY ALL) GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE amount <> 0) > 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY org_id, entity_id ORDER BY abs(total) DESC, line) AS rank FROM t) WHERE rank <= 4""",
)
def trend_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.trend_facets(pnl.line_sums(tagged(spark, sf_dir)), pnl.REPORT, "line", "amount_minor", 4)


@query("net_split", f"{wide_sql()} SELECT org_id, entity_id, period, greatest(s_95, 0) AS profit, greatest(-s_95, 0) AS loss FROM chained")
def net_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = pnl.with_chain(pnl.zero_filled(pnl.line_sums(tagged(spark, sf_dir)), whole_calendar(spark)))
    profit, loss = series.net_split(F.col("s_95"))
    return wide.select(*pnl.REPORT, "period", profit.alias("profit"), loss.alias("loss"))


@query(
    "money_flow",
    f"""{wide_sql()}, tot AS (SELECT org_id, entity_id, -s_01 AS r, -s_01 + s_02 + s_03 + s_04 + s_05 + s_06 + s_07 AS rest, s_02, s_03, s_04, s_05, s_06, s_07 FROM chained WHERE period = 'total' AND -s_01 > 0)
SELECT org_id, entity_id, '01' AS source, 'total' AS target, r AS amount_minor FROM tot
UNION ALL SELECT org_id, entity_id, 'total', v.line, v.amount FROM tot, LATERAL (VALUES ('02', -s_02), ('03', -s_03), ('04', -s_04), ('05', -s_05), ('06', -s_06), ('07', -s_07), ('remainder', rest)) AS v(line, amount) WHERE v.amount > 0""",
)
def money_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales of this carrier are booked as outflows, so their sign is turned before edges are drawn."""
    wide = pnl.zero_filled(pnl.line_sums(tagged(spark, sf_dir)), whole_calendar(spark)).withColumn("s_01", -F.col("s_01"))
    return series.money_flow(pnl.with_chain(wide).where("period = 'total'"), pnl.REPORT, COSTS)


def candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as candles: each value opens, and the next one of its type closes."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts", "value")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.withColumns({"position": (F.row_number().over(order) - 1).cast("bigint"), "count": F.count(F.lit(1)).over(Window.partitionBy("user_id"))}).select("user_id", "position", "count", F.col("value").alias("open"), (F.col("value") + 1).alias("high"), (F.col("value") - 1).alias("low"), F.col("value").alias("close"))


CANDLE_SQL = "c AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position, count(*) OVER (PARTITION BY user_id) AS n, value FROM events)"


@query(
    "ohlc_bucket",
    f"WITH {CANDLE_SQL}, b AS (SELECT *, CASE WHEN n <= 5 THEN position ELSE (SELECT max(i) FROM range(5) r(i) WHERE floor(i * n / 5.0) <= position) END AS bucket FROM c) SELECT user_id, bucket, min_by(value, position) AS open, max(value + 1) AS high, min(value - 1) AS low, max_by(value, position) AS close FROM b GROUP BY 1, 2",
)
def ohlc_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.ohlc_buckets(candles(spark, sf_dir), ["user_id"], 5)


@query("lttb")
def lttb(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return series.lttb(e, ["user_id"], ["ts", "event_id"], "value", 10)


@query("x_domain", "SELECT event_type, count(*) AS row_count, min(ts) AS first_ts, max(ts) AS last_ts FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1")
def x_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = lambda day: F.lit(f"2024-01-{day} 00:00:00").cast("timestamp_ntz")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where(series.within((edge("05"), edge("20")), F.col("ts")))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("row_count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(
    "projection",
    f"""{WITH}, m AS (SELECT org_id, entity_id, (year(booked_on) * 12 + month(booked_on))::BIGINT AS x, sum(reported_minor)::BIGINT AS y FROM txn GROUP BY 1, 2, 3),
s AS (SELECT org_id, entity_id, count(*) AS n, sum(x)::DOUBLE AS sx, sum(y)::DOUBLE AS sy, sum(x::DOUBLE * y) AS sxy, sum(x::DOUBLE * x) AS sxx, min(x) AS x0, max(x) AS x1 FROM m GROUP BY 1, 2)
SELECT org_id, entity_id, k, round(x1 + k * (x1 - x0)::DOUBLE / (n - 1), 6) AS x, round((sy / n + (n * sxy - sx * sy) / (n * sxx - sx * sx) * (x1 + k * (x1 - x0)::DOUBLE / (n - 1) - sx / n)) / 10) AS y_tens FROM s CROSS JOIN (SELECT unnest([1, 2, 3])::BIGINT AS k)""",
)
def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("booked_on")
    months = carrier.transactions(spark, sf_dir).groupBy(*pnl.REPORT, (F.year(day) * 12 + F.month(day)).cast("bigint").alias("x")).agg(F.sum("reported_minor").alias("y"))
    ahead = series.project_trend(months, pnl.REPORT, "x", "y", 3)
    return ahead.select(*pnl.REPORT, "k", F.round("x", 6).alias("x"), F.round(F.col("y") / 10).alias("y_tens"))


@query(
    "projection_last_segment",
    f"""{WITH}, m AS (SELECT org_id, entity_id, (year(booked_on) * 12 + month(booked_on))::BIGINT AS x, sum(reported_minor)::BIGINT AS y FROM txn GROUP BY 1, 2, 3),
s AS (SELECT *, row_number() OVER (PARTITION BY org_id, entity_id ORDER BY x DESC) AS rn, lead(x) OVER w AS x0, lead(y) OVER w AS y0 FROM m WINDOW w AS (PARTITION BY org_id, entity_id ORDER BY x DESC))
SELECT org_id, entity_id, k, (x + k * coalesce(x - x0, 1))::DOUBLE AS x, (y + k * coalesce(y - y0, 0))::DOUBLE AS y FROM s CROSS JOIN (SELECT unnest([1, 2, 3])::BIGINT AS k) WHERE rn = 1""",
)
def projection_last_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("booked_on")
    months = carrier.transactions(spark, sf_dir).groupBy(*pnl.REPORT, (F.year(day) * 12 + F.month(day)).cast("bigint").alias("x")).agg(F.sum("reported_minor").alias("y"))
    return series.project_last_segment(months, pnl.REPORT, "x", "y", 3)
