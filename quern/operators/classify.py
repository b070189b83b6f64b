"""The rule engine: vendor memory, then regulated codes, then all other rules; the first match wins.

Rules number in the hundreds, so a rule set compiles to one CASE expression:
classification is a projection, without a join or a shuffle of transactions.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import NORMALIZE_VERSION, key_tier, normalize_description
from quern.operators.evaluate import verdict
from quern.session import cut_lineage

#: Confidence of each layer.
CONFIDENCE = {"L0": "1.000", "L0.5": "0.990", "L1": "0.950"}
DEFAULT_THRESHOLD = 0.80
DIRECT = {"regulated_code": "regulated_code", "counterparty_key": "counterparty_key", "account": "account_id"}


class RequestRejected(ValueError):
    """A whole batch refused, with a code."""

    def __init__(self, code: str, detail: str):
        super().__init__(f"{code}: {detail}")
        self.code = code


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: str = ""
    currency: str = ""
    minor_units: int = 0


@dataclass(frozen=True)
class Rule:
    category_code: str
    priority: int
    conditions: tuple[Condition, ...]
    scope: str = "global"
    source_kind: str = ""
    org_owned: bool = False
    rule_id: str = ""
    active: bool = field(default=True)

    @classmethod
    def from_matcher(cls, matcher: str, **rest) -> Rule:
        """A rule from its matcher JSON; no conditions, or one without field or operator, is an error."""
        m = json.loads(matcher)
        conditions = tuple(
            Condition(c.get("field", ""), c.get("op", ""), c.get("value", "") or "", (c.get("amount") or {}).get("currency_code", ""), int((c.get("amount") or {}).get("minor_units", 0))) for c in m.get("all") or []
        )
        if not conditions or any(not c.field or not c.op for c in conditions):
            raise RequestRejected("empty_matcher", matcher)
        return cls(conditions=conditions, source_kind=m.get("source_kind", "") or "", **rest)


def effective(rules: Iterable[Rule]) -> list[Rule]:
    """Active rules in the order they are tried: the organisation's own first, then priority, then id."""
    return sorted((r for r in rules if r.active), key=lambda r: (not r.org_owned, r.priority, r.rule_id))


def ranked_rules(rules: DataFrame, by: list[str]) -> DataFrame:
    """The same order over a table of rules (rule_id, priority, org_owned, active): ``rank`` within each of ``by``, active rules alone."""
    order = Window.partitionBy(*by).orderBy(F.col("org_owned").cast("int").desc(), "priority", "rule_id")
    return rules.where("active").withColumn("rank", F.row_number().over(order).cast("bigint"))


def is_regulated(rule: Rule) -> bool:
    return any(c.field == "regulated_code" for c in rule.conditions)


def condition(c: Condition, evaluation: bool = False) -> Column:
    """One condition over the columns of a transaction; an unknown field or operator refuses the batch.

    In an evaluation a description may also have to contain one text whole, a
    ``counterparty_account`` may have to hold a text, a bank's own operation type
    stands in where there is no state code, and what is unknown holds for no row.
    """
    if evaluation:
        return _evaluated(c)
    if c.field == "description":
        if c.op != "contains_all":
            raise RequestRejected("unsupported_operator", f"description: {c.op}")
        out = F.lit(True)
        for part in filter(None, (p.strip() for p in c.value.split(";"))):
            out = out & F.contains(F.col("description_norm"), F.lit(part))
        return out
    if c.field == "amount":
        if c.op not in ("gte", "lte"):
            raise RequestRejected("unsupported_operator", f"amount: {c.op}")
        fits = F.col("amount_minor") >= c.minor_units if c.op == "gte" else F.col("amount_minor") <= c.minor_units
        return (F.lit(bool(c.currency)) & (F.col("currency") == c.currency)) & fits
    if c.field not in (*DIRECT, "direction"):
        raise RequestRejected("unsupported_field", c.field)
    if c.op != "eq":
        raise RequestRejected("unsupported_operator", f"{c.field}: {c.op}")
    if c.field == "direction":
        return F.when(F.col("amount_minor") >= 0, "income").otherwise("expense") == c.value.lower()
    return F.coalesce(F.col(DIRECT[c.field]).cast("string"), F.lit("")) == c.value


def _evaluated(c: Condition) -> Column:
    if c.field == "description" and c.op != "contains_all":
        return F.contains(F.col("description_norm"), F.lit(c.value))
    if c.field == "description":
        return condition(c)
    if c.field == "direction":
        return condition(Condition("direction", "eq", c.value))
    if c.field == "regulated_code":
        first = F.when(F.coalesce("regulated_code", F.lit("")) != "", F.col("regulated_code")).otherwise(F.coalesce("operation_type", F.lit("")))
        return first == c.value
    if c.field == "counterparty_account":
        return F.contains(normalize_description(F.coalesce("counterparty_account", F.lit(""))), normalize_description(F.lit(c.value)))
    if c.field == "counterparty_key":
        return F.coalesce("counterparty_key", F.lit("")) == c.value
    return F.lit(False)


def rule_matches(rule: Rule, evaluation: bool = False) -> Column:
    if not rule.conditions:
        raise RequestRejected("empty_matcher", f"priority {rule.priority}")
    out = F.lit(True) if not rule.source_kind else F.col("source_kind") == rule.source_kind
    for c in rule.conditions:
        out = out & F.coalesce(condition(c, evaluation), F.lit(False))
    return out


def first_match(rules: Iterable[Rule], evaluation: bool = False) -> Column:
    """A struct of category_code, engine_layer, evidence, matched_rule_priority; null if no rule matches. ``evaluation``: see ``condition``."""
    ordered = effective(rules)
    out = None
    for rule in [r for r in ordered if is_regulated(r)] + [r for r in ordered if not is_regulated(r)]:
        layer = "L0.5" if is_regulated(rule) else "L1"
        answer = F.struct(F.lit(rule.category_code).alias("category_code"), F.lit(layer).alias("engine_layer"), F.lit(rule.scope).alias("evidence"), F.lit(rule.priority).alias("matched_rule_priority"))
        fits = rule_matches(rule, evaluation)
        out = F.when(fits, answer) if out is None else out.when(fits, answer)
    return out if out is not None else F.lit(None).cast("struct<category_code:string,engine_layer:string,evidence:string,matched_rule_priority:int>")


def check_request(rules: Iterable[Rule], vendors: DataFrame, known: Iterable[str], normalize_version: str = NORMALIZE_VERSION) -> None:
    """Refuses a batch with an unsupported version or a category that nobody knows."""
    if normalize_version != NORMALIZE_VERSION:
        raise RequestRejected("unsupported_normalize_version", normalize_version)
    known = set(known)
    if bad := sorted({r.category_code for r in rules} - known):
        raise RequestRejected("unknown_category", f"rule: {bad}")
    if bad := vendors.where(~F.col("category_code").isin(*known)).select("category_code").limit(1).collect():
        raise RequestRejected("unknown_category", f"vendor: {bad[0][0]}")


def classify(txn: DataFrame, rules: Iterable[Rule], vendors: DataFrame, threshold: float = 0.0) -> DataFrame:
    """txn_id, category_code, engine_layer, confidence, evidence, matched_rule_priority of the rows that get an answer.

    ``vendors`` (org_id, counterparty_key, category_code) is joined, one row per
    key; its size decides how, not a hint. A threshold of 0 means the default.
    """
    memory = vendors.select("org_id", "counterparty_key", F.col("category_code").alias("remembered"))
    rows = txn.join(memory, ["org_id", "counterparty_key"], "left").withColumn("rule", first_match(rules))
    known = F.col("remembered").isNotNull() & (F.col("counterparty_key") != "")
    layer = F.when(known, "L0").otherwise(F.col("rule.engine_layer"))
    confidence = F.lit(None).cast("decimal(4,3)")
    for name, value in CONFIDENCE.items():
        confidence = F.when(layer == name, F.lit(value).cast("decimal(4,3)")).otherwise(confidence)
    out = rows.select(
        "txn_id",
        "batch_id",
        F.when(known, F.col("remembered")).otherwise(F.col("rule.category_code")).alias("category_code"),
        layer.alias("engine_layer"),
        confidence.alias("confidence"),
        F.when(known, key_tier(F.col("counterparty_key"))).otherwise(F.col("rule.evidence")).alias("evidence"),
        F.when(known, 0).otherwise(F.col("rule.matched_rule_priority")).alias("matched_rule_priority"),
    )
    return out.where(F.col("engine_layer").isNotNull() & (F.col("confidence") >= (threshold or DEFAULT_THRESHOLD)))


def checked_proposals(sent: DataFrame, proposals: DataFrame) -> DataFrame:
    """The proposals, if they fit what was sent in a chunk: batch_id and txn_id on both sides.

    Refused whole, as the classifier's fault, are proposals for a row that was
    not sent (``unknown_transaction``), more than one for a row
    (``repeated_transaction``), a category or a layer that is missing
    (``incomplete_proposal``) and a confidence outside of zero to one
    (``bad_confidence``).
    """
    known = sent.select(F.col("batch_id").alias("__batch"), F.col("txn_id").alias("__txn"), F.lit(True).alias("__sent")).distinct()
    same = proposals["batch_id"].eqNullSafe(known["__batch"]) & proposals["txn_id"].eqNullSafe(known["__txn"])
    counted = proposals.groupBy("batch_id", "txn_id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("batch_id", "txn_id", F.lit("repeated_transaction").alias("code"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    fault = (
        F.when(F.col("__sent").isNull(), "unknown_transaction")
        .when(blank("category_code") | blank("engine_layer"), "incomplete_proposal")
        .when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "bad_confidence")
    )
    faults = proposals.join(known, same, "left").select("batch_id", "txn_id", fault.alias("code")).where("code IS NOT NULL").unionByName(counted)
    for bad in faults.orderBy("code", "batch_id", "txn_id").limit(1).collect():
        raise RequestRejected(bad.code, f"batch {bad.batch_id}: {bad.txn_id}")
    return proposals


def run_log(txn: DataFrame, proposals: DataFrame) -> DataFrame:
    """Of each batch: rows seen, classified and left to review."""
    seen = txn.groupBy("batch_id").agg(F.count(F.lit(1)).alias("rows"))
    done = proposals.groupBy("batch_id").agg(F.count(F.lit(1)).alias("classified"))
    return seen.join(done, "batch_id", "left").na.fill(0, ["classified"]).withColumn("to_review", F.col("rows") - F.col("classified"))


def compare_labels(predicted: DataFrame, labels: DataFrame, needs_allocation: Iterable[str] = ()) -> DataFrame:
    """How predictions agree with an accountant's labels: rows and absolute amounts by ``evaluate.verdict``."""
    both = labels.join(predicted.select("txn_id", F.col("category_code").alias("predicted")), "txn_id", "left")
    said = verdict(F.col("predicted"), F.col("label"), needs_allocation)
    return both.groupBy(said.alias("verdict")).agg(F.count(F.lit(1)).alias("row_count"), F.sum(F.abs("amount_minor")).alias("volume_minor"))


def dead_rules(rules: Iterable[Rule], proposals: DataFrame) -> DataFrame:
    """Priorities of rules that never won."""
    spark = proposals.sparkSession
    every = spark.createDataFrame([(r.priority,) for r in effective(rules)], "matched_rule_priority int")
    return every.join(proposals.select("matched_rule_priority").distinct(), "matched_rule_priority", "left_anti")


def taxonomy_paths(categories: DataFrame) -> DataFrame:
    """code and its path of names from the root, at any depth; categories: code, parent_code, name.

    Each round joins what is known of a category to what is known of the
    ancestor where that ends, which doubles both: as many rounds as the depth has
    binary digits. A parent that is not there is passed over. Categories that are
    their own ancestors are an error.
    """
    held = categories.select(F.col("code").alias("parent_code"), F.lit(True).alias("there")).distinct()
    now = cut_lineage(categories.join(held, "parent_code", "left").select("code", F.when(F.col("there"), F.col("parent_code")).alias("up"), F.col("name").alias("path")))
    for _ in range(now.count().bit_length() + 1):
        if now.where("up IS NOT NULL").isEmpty():
            return now.select("code", "path")
        above = now.select(F.col("code").alias("up"), F.col("up").alias("next"), F.col("path").alias("above"))
        now = cut_lineage(now.join(above, "up", "left").select("code", F.col("next").alias("up"), F.when(F.col("above").isNotNull(), F.concat("above", F.lit(" > "), "path")).otherwise(F.col("path")).alias("path")))
    raise ValueError(f"a category is its own ancestor: {now.where('up IS NOT NULL').first().code}")


def assert_live_once(classifications: Mapping | DataFrame) -> DataFrame:
    """Transactions that break the rule of one standing classification at most; empty if all is well."""
    from quern.operators.pnl import live

    return live(classifications).groupBy("txn_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
