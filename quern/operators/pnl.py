"""The management profit and loss, its drill-down and its reconciliation.

Every figure and every list of rows behind it come from one tagged table: each
transaction has exactly one ``line``. So a cell is the sum of its own rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.periods import period_end, period_label, period_start

# Sections, buckets, and the lines that are computed from others.
SECTIONS = ("01", "02", "03", "04", "05", "06", "07")
OFF_PNL = ("08", "09")
BUCKETS = ("unclassified", "non_pnl", "unallocated", "other_basis")
#: Computed lines: the line they start from and the sections they add.
CHAIN = {"91": (None, ("01", "02")), "92": ("91", ("03",)), "93": ("92", ("04", "05")), "94": ("93", ("06",)), "95": ("94", ("07",))}
PRINTED = ("01", "02", "91", "03", "92", "04", "05", "93", "06", "94", "07", "95")
REVENUE = "01"
REPORT = ["org_id", "entity_id"]


def live(classifications: DataFrame) -> DataFrame:
    """The classifications that stand: neither superseded nor retracted."""
    return classifications.where(F.col("superseded_by").isNull() & F.col("retracted_on").isNull())


def standing(history: Column) -> Column:
    """``live`` of a history that is an array in a row."""
    return F.filter(history, lambda c: c["superseded_by"].isNull() & c["retracted_on"].isNull())


def with_answers(txn: DataFrame, classifications: DataFrame | str) -> DataFrame:
    """``txn`` with the category_code and engine_layer that stand, a row for each; nulls if there are none.

    ``classifications`` is the history, or names a column in which each row holds
    an array of what stands for it; nothing is joined then.
    """
    if isinstance(classifications, str):
        rows = txn.select(*[c for c in txn.columns if c != classifications], F.explode_outer(classifications).alias("__c"))
        return rows.select("*", "__c.category_code", "__c.engine_layer").drop("__c")
    return txn.join(live(classifications).select("txn_id", "category_code", "engine_layer"), "txn_id", "left")


def line_of(basis: str) -> Column:
    """The one bucket or section of a row; a section beyond the known ones is an error."""
    section = F.col("section")
    return (
        F.when(F.col("source_kind") != basis, "other_basis")
        .when(F.col("category_code").isNull(), "unclassified")
        .when(~F.col("is_pnl"), "non_pnl")
        .when(F.col("requires_allocation"), "unallocated")
        .when(section.isin(*SECTIONS), section)
        .when(section.isin(*OFF_PNL), "non_pnl")
        .otherwise(F.raise_error(F.concat(F.lit("unknown section: "), F.coalesce(section, F.lit("null")))))
    )


def in_currency(txn: DataFrame, base_currency: str) -> DataFrame:
    """``txn`` with reported amounts of one currency only: amounts are summed in one currency or not at all."""
    code = F.coalesce("base_currency", "currency")
    wrong = F.raise_error(F.concat(F.lit("row in "), F.coalesce(code, F.lit("null")), F.lit(f", but the report is in {base_currency}"))).cast("bigint")
    return txn.withColumn("reported_minor", F.when(code == base_currency, F.col("reported_minor")).otherwise(wrong))


def report_rows(txn: DataFrame, basis: str, first: str, last: str) -> DataFrame:
    """The rows that reports of one basis and a closed range of days are computed from, by entity in the order of (booked_on, txn_id)."""
    days = F.col("booked_on").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return txn.where((F.col("source_kind") == basis) & days).orderBy(*REPORT, "booked_on", "txn_id")


def tag_lines(txn: DataFrame, classifications: DataFrame | str, categories: DataFrame, basis: str = "bank", granularity: str = "month", transfers: DataFrame | str | None = None, base_currency: str | None = None) -> DataFrame:
    """Transactions with category_code, section, line and period.

    ``transfers`` (txn_id, dismissed) removes the members of pairs that stand;
    without it paired rows stay on their lines. ``classifications`` and
    ``transfers`` can name columns of arrays in which each row holds its own, of
    classifications those that stand. ``categories`` is a small fixed
    tree and is left to the planner's own size check. With ``base_currency`` an
    amount that is not of it, converted or not, is an error.
    """
    if base_currency is not None:
        txn = in_currency(txn, base_currency)
    if isinstance(transfers, str):
        txn = txn.where(~F.exists(transfers, lambda t: F.coalesce(~t["dismissed"], F.lit(False)))).drop(transfers)
    elif transfers is not None:
        txn = txn.join(transfers.where(~F.col("dismissed")).select("txn_id"), "txn_id", "left_anti")
    dim = categories.select(F.col("code").alias("category_code"), "section", "is_pnl", "requires_allocation")
    rows = with_answers(txn, classifications).join(dim, "category_code", "left")
    return rows.withColumn("line", line_of(basis)).withColumn("period", period_label(F.col("booked_on"), granularity))


def line_sums(tagged: DataFrame) -> DataFrame:
    """Stored sums and row counts by report, period and line: one shuffle, after partial sums."""
    return tagged.groupBy(*REPORT, "period", "line").agg(F.sum("reported_minor").alias("amount_minor"), F.count(F.lit(1)).alias("row_count"))


def zero_filled(sums: DataFrame, calendar: DataFrame) -> DataFrame:
    """Stored sums of each section and bucket as columns: a row for every report and period of the calendar, and ``total``.

    A report's periods are folded into one map, bounded by the calendar, beside
    the sums over them; the calendar is then laid over the map. So the ledger is
    read once, without a join of the report to itself.
    """
    lines = [f"s_{x}" for x in SECTIONS + BUCKETS]
    wide = sums.groupBy(*REPORT, "period").agg(*[F.sum(F.when(F.col("line") == c[2:], F.col("amount_minor")).otherwise(0)).alias(c) for c in lines])
    cells = F.map_from_entries(F.collect_list(F.struct("period", F.struct(*lines))))
    folded = wide.groupBy(*REPORT).agg(cells.alias("cells"), *[F.sum(c).alias(c) for c in lines])
    zero = F.struct(*[F.lit(0).cast("bigint").alias(c) for c in lines])
    periods = F.array(*[F.lit(p) for p in sorted(r["period"] for r in calendar.select("period").collect())])
    rows = F.transform(periods, lambda p: F.struct(p.alias("period"), F.coalesce(F.try_element_at(F.col("cells"), p), zero).alias("v")))
    total = F.array(F.struct(F.lit("total").alias("period"), F.struct(*lines).alias("v")))
    return folded.select(*REPORT, F.explode(F.concat(rows, total)).alias("r")).select(*REPORT, "r.period", "r.v.*")


def with_chain(wide: DataFrame) -> DataFrame:
    """The computed lines in stored signs; costs are negative, so all are additions."""
    for line, (start, sections) in CHAIN.items():
        parts = ([F.col(f"s_{start}")] if start else []) + [F.col(f"s_{s}") for s in sections]
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        wide = wide.withColumn(f"s_{line}", total)
    return wide


def presented(chained: DataFrame) -> DataFrame:
    """Printed lines and buckets as rows: costs turned positive, percent of revenue absent if there is none."""
    shown = lambda x: -F.col(f"s_{x}") if x in SECTIONS and x != REVENUE else F.col(f"s_{x}")
    rows = F.array(*[F.struct(F.lit(k + 1).alias("position"), F.lit(x).alias("line"), shown(x).alias("amount_minor")) for k, x in enumerate(PRINTED + BUCKETS)])
    out = chained.select(*REPORT, "period", F.col(f"s_{REVENUE}").alias("revenue"), F.explode(rows).alias("r")).select(*REPORT, "period", "revenue", "r.*")
    percent = F.when((F.col("revenue") != 0) & F.col("line").isin(*PRINTED), F.col("amount_minor") / F.col("revenue") * 100)
    return out.select(*REPORT, "period", "position", "line", "amount_minor", percent.alias("percent_of_revenue"))


def management_pnl(txn: DataFrame, classifications: DataFrame | str, categories: DataFrame, calendar: DataFrame, basis: str = "bank", granularity: str = "month", transfers: DataFrame | str | None = None, base_currency: str | None = None) -> DataFrame:
    """The whole report: every period of the calendar, zero-filled, and the total.

    A row outside the calendar is an error, as is a section nobody knows, and,
    with ``base_currency``, a row in another currency.
    """
    sums = line_sums(tag_lines(txn, classifications, categories, basis, granularity, transfers, base_currency))
    known = sorted(r["period"] for r in calendar.select("period").collect())
    sums = sums.withColumn("period", F.when(F.col("period").isin(known), F.col("period")).otherwise(F.raise_error(F.concat(F.lit("row outside the range: "), F.col("period")))))
    return presented(with_chain(zero_filled(sums, calendar)))


#: Rows of a page of the drill-down: if none is asked for, and at most.
PAGE, MOST_PAGE = 100, 500


def cursor_of(row) -> str:
    """The place of a row in the drill-down's order, as text: its day and its id."""
    return f"{row['booked_on']}:{row['txn_id']}"


def parse_cursor(text: str) -> tuple[str, str] | None:
    """The day and id of a cursor; None is the start, which is written as nothing; anything else is an error."""
    if not text:
        return None
    day, _, txn_id = text.partition(":")
    if not txn_id or not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", day):
        raise ValueError(f"not a cursor: {text!r}")
    date.fromisoformat(day)
    return day, txn_id


def line_ref(text: str) -> tuple[str, str]:
    """A line's kind (bucket, section, computed) and name; the names are closed lists, also of sections off the report."""
    for kind, names in (("bucket", BUCKETS), ("section", SECTIONS + OFF_PNL), ("computed", tuple(CHAIN))):
        if text in names:
            return kind, text
    raise ValueError(f"not a line of this report: {text!r}")


@dataclass(frozen=True)
class Selection:
    """What one figure was summed from: a closed range of days, the cell's own, and a line."""

    first: date
    last: date
    line: str


def _months(label: str, granularity: str) -> tuple[str, str]:
    shape = {"month": r"[0-9]{4}-(?:0[1-9]|1[0-2])", "quarter": r"[0-9]{4}-Q[1-4]", "year": r"[0-9]{4}"}.get(granularity)
    if shape is None or not re.fullmatch(shape, label):
        raise ValueError(f"not a {granularity}: {label!r}")
    if granularity == "month":
        return label, label
    last = 3 * int(label[-1]) if granularity == "quarter" else 12
    return f"{label[:4]}-{last - 2 if granularity == 'quarter' else 1:02d}", f"{label[:4]}-{last:02d}"


def selection_for(label: str, line: str, granularity: str, asked_from: str, asked_to: str) -> Selection:
    """The selection of one cell of a report over the months ``asked_from`` to ``asked_to``.

    The cell's days are clipped to what was asked for, as its figure was. A
    period outside of it is an error, and so is a computed line, which has
    operands and no rows.
    """
    kind, name = line_ref(line)
    if kind == "computed":
        raise ValueError(f"{name} is computed from {', '.join(part for part, _ in operands(name))} and has no rows of its own")
    for month in (asked_from, asked_to):
        _months(month, "month")
    first, last = _months(label, granularity)
    first, last = max(first, asked_from), min(last, asked_to)
    if first > last:
        raise ValueError(f"period {label} lies outside of {asked_from} to {asked_to}")
    year, month = int(last[:4]), int(last[5:])
    return Selection(date.fromisoformat(f"{first}-01"), date(year + month // 12, month % 12 + 1, 1) - timedelta(days=1), name)


def selections(labels: Column, asked_from: str, asked_to: str) -> tuple[Column, Column]:
    """First and last day of each label's cell of a report over some months; null outside of it."""
    start, end = F.lit(f"{asked_from}-01").cast("date"), F.last_day(F.lit(f"{asked_to}-01").cast("date"))
    first, last = F.greatest(period_start(labels), start), F.least(period_end(labels), end)
    return F.when(first <= last, first), F.when(first <= last, last)


@dataclass(frozen=True)
class DrillDown:
    """What a cell opens to: ``operands`` of a computed line, or a page of rows with the number and sum of all."""

    kind: str
    operands: tuple[tuple[str, str], ...] = ()
    rows: list = field(default_factory=list)
    row_count: int = 0
    total_minor: int = 0
    next_cursor: str = ""


def drill_down(tagged: DataFrame, label: str, line: str, granularity: str, asked_from: str, asked_to: str, cursor: str = "", limit: int = 0) -> DrillDown:
    """Opens a cell of one report (the rows of ``tagged`` are those of one entity and basis).

    A computed line answers with its operands. Other lines answer with the rows
    of the cell's own days after the cursor, ``limit`` of them, 100 if that is
    none or over 500, and with a cursor if there are more. A period that the
    report does not have, or a line or cursor of no known form, is an error.
    """
    kind, name = line_ref(line)
    after = parse_cursor(cursor)
    selected = selection_for(label, name if kind != "computed" else REVENUE, granularity, asked_from, asked_to)
    if kind == "computed":
        return DrillDown("operands", tuple(operands(name)))
    page = limit if 0 < limit <= MOST_PAGE else PAGE
    cell = tagged.where(F.col("booked_on").between(F.lit(selected.first), F.lit(selected.last)))
    whole = rows_of_line(cell, name).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("reported_minor"), F.lit(0)).alias("total")).first()
    rows = drill_rows(cell, name, after, page).collect()  # a page and one row
    return DrillDown("transactions", (), rows[:page], whole.n, whole.total, cursor_of(rows[page - 1]) if len(rows) > page else "")


def rows_of_line(tagged: DataFrame, line: str) -> DataFrame:
    """The rows behind a line; those of a section off the report are the ones in its bucket that say of themselves that they belong on it."""
    if line in OFF_PNL:
        return tagged.where((F.col("line") == "non_pnl") & (F.col("section") == line) & F.col("is_pnl") & ~F.col("requires_allocation"))
    return tagged.where(F.col("line") == line)


def drill_rows(tagged: DataFrame, line: str, after: tuple | None = None, limit: int | None = None) -> DataFrame:
    """The rows behind a cell in (booked_on, txn_id) order, after a cursor, with one more than ``limit`` to look ahead."""
    rows = rows_of_line(tagged, line)
    if after is not None:
        day, txn_id = F.lit(after[0]).cast("date"), F.lit(after[1])
        rows = rows.where((F.col("booked_on") > day) | ((F.col("booked_on") == day) & (F.col("txn_id") > txn_id)))
    return rows if limit is None else rows.orderBy("booked_on", "txn_id").limit(limit + 1)


def operands(line: str) -> list[tuple[str, str]]:
    """What a computed line is made of: the line it starts from and the sections it takes off as costs."""
    start, sections = CHAIN[line]
    parts = ([(start, "plus")] if start else []) + [(s, "plus" if s == REVENUE else "minus") for s in sections]
    return parts


def operand_rows(report: DataFrame) -> DataFrame:
    """Of each computed line of a presented report its operands and their amounts: REPORT, period, line, place, operand, sign, amount_minor."""
    parts = F.array(*[F.struct(F.lit(line).alias("line"), F.lit(k).alias("place"), F.lit(part).alias("operand"), F.lit(sign).alias("sign")) for line in CHAIN for k, (part, sign) in enumerate(operands(line))])
    wanted = sorted({part for line in CHAIN for part, _ in operands(line)})
    used = report.where(F.col("line").isin(wanted)).withColumn("o", F.explode(F.filter(parts, lambda o: o["operand"] == F.col("line"))))
    return used.select(*REPORT, "period", F.col("o.line").alias("line"), F.col("o.place").alias("place"), F.col("o.operand").alias("operand"), F.col("o.sign").alias("sign"), "amount_minor")


def reconciliation(txn: DataFrame, transfers: DataFrame, calendar: DataFrame, granularity: str = "month", basis: str = "bank") -> DataFrame:
    """opening + in - out - transfers = closing, for every report and period of the calendar.

    Money of pairs that stand is kept apart from in and out; a dismissed pair
    counts as ordinary movement. The opening balance is what was booked before
    the period: a running sum over period totals, one shuffle by report.
    """
    paired = transfers.where(~F.col("dismissed")).select("txn_id", F.lit(True).alias("is_transfer"))
    rows = txn.where(F.col("source_kind") == basis).join(paired, "txn_id", "left").withColumn("is_transfer", F.coalesce("is_transfer", F.lit(False)))
    amount = F.col("reported_minor")
    flow = rows.groupBy(*REPORT, period_label(F.col("booked_on"), granularity).alias("period")).agg(
        F.sum(F.when(~F.col("is_transfer") & (amount > 0), amount).otherwise(0)).alias("inflow_minor"),
        F.sum(F.when(~F.col("is_transfer") & (amount < 0), -amount).otherwise(0)).alias("outflow_minor"),
        F.sum(F.when(F.col("is_transfer"), -amount).otherwise(0)).alias("transfers_minor"),
        F.sum(F.col("is_transfer").cast("bigint")).alias("transfer_rows"),
    )
    periods = F.array(*[F.lit(p) for p in sorted(r["period"] for r in calendar.select("period").collect())])
    every = flow.select(*REPORT).distinct().withColumn("period", F.explode(periods))
    # Movements before the calendar count for its first opening balance.
    filled = every.join(flow, [*REPORT, "period"], "full").na.fill(0)
    net = F.col("inflow_minor") - F.col("outflow_minor") - F.col("transfers_minor")
    upto = F.sum(net).over(Window.partitionBy(*REPORT).orderBy("period").rowsBetween(Window.unboundedPreceding, 0))
    out = filled.withColumn("closing_minor", upto).withColumn("opening_minor", F.col("closing_minor") - net).withColumn("derived", F.lit(True))
    return out.where(F.array_contains(periods, F.col("period"))).select(*REPORT, "period", "opening_minor", "inflow_minor", "outflow_minor", "transfers_minor", "transfer_rows", "closing_minor", "derived")


def used_versions(txn: DataFrame, classifications: DataFrame, basis: str = "bank", first: str | None = None, last: str | None = None) -> DataFrame:
    """The versions behind a report's figures: those of its basis and its days, both ends included."""
    rows = txn.where(F.col("source_kind") == basis)
    rows = rows.where(F.col("booked_on") >= F.lit(first).cast("date")) if first else rows
    rows = rows.where(F.col("booked_on") <= F.lit(last).cast("date")) if last else rows
    said = live(classifications).join(rows.select("txn_id", "entity_id"), "txn_id")
    return said.select(*REPORT, "taxonomy_version", "ruleset_version", "engine_version", "normalize_version").distinct()
