"""The review queue, decisions and what follows from them, as deltas of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.pnl import live, with_answers
from quern.sources.versions import Partitioned, Versioned

#: An outcome and the category it writes; ``categorised`` brings its own.
OUTCOMES = {"categorised": None, "transfer": "09", "non_pnl": "09", "skipped": None}


def unanswered(txn: DataFrame, classifications: DataFrame | str) -> DataFrame:
    """Transactions without a classification that stands; ``classifications`` is the history, or as in ``with_answers``."""
    if isinstance(classifications, str):
        return txn.where(F.size(classifications) == 0).drop(classifications)
    return txn.join(live(classifications).select("txn_id"), "txn_id", "left_anti")


def review_groups(txn: DataFrame, classifications: DataFrame | str, by: tuple[str, ...] = ("org_id", "counterparty_key")) -> DataFrame:
    """Unanswered rows by counterparty: a name, count, sum, first and last day."""
    return unanswered(txn, classifications).groupBy(*by).agg(
        F.max("counterparty_raw").alias("counterparty"), F.count(F.lit(1)).alias("row_count"), F.sum("reported_minor").alias("amount_minor"), F.min("booked_on").alias("first_on"), F.max("booked_on").alias("last_on")
    )


def review_page(groups: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of groups, largest amount first."""
    return groups.orderBy(F.desc(F.abs("amount_minor")), F.desc("row_count"), "counterparty_key").offset(offset).limit(min(limit, 200))


def review_totals(txn: DataFrame, classifications: DataFrame | str) -> DataFrame:
    return unanswered(txn, classifications).groupBy("org_id").agg(F.count(F.lit(1)).alias("row_count"), F.countDistinct("counterparty_key").alias("counterparties"), F.sum(F.abs("reported_minor")).alias("volume_minor"))


def resolve(txn: DataFrame, classifications: DataFrame | str, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new classifications, vendor rows, decision rows) of decisions (org_id, entity_id, counterparty_key, outcome, category_code, decided_on).

    A decision covers its entity's unanswered rows of the counterparty. All
    outcomes but ``skipped`` classify them; ``categorised`` is remembered for
    the vendor. Decisions carry what they covered.
    """
    rows = unanswered(txn, classifications)
    decided = decisions.withColumn("target", F.when(F.col("outcome") == "categorised", F.col("category_code")).when(F.col("outcome").isin("transfer", "non_pnl"), "09"))
    covered = rows.join(decided, ["org_id", "entity_id", "counterparty_key"])
    new = covered.where("target is not null").select(F.concat("txn_id", F.lit("#h")).alias("classification_id"), "txn_id", "org_id", F.col("target").alias("category_code"), F.lit("human").alias("engine_layer"), "decided_on")
    vendors = decided.where(F.col("outcome") == "categorised").select("org_id", "counterparty_key", F.col("target").alias("category_code"), "decided_on")
    volume = covered.groupBy("org_id", "entity_id", "counterparty_key").agg(F.count(F.lit(1)).alias("covered_count"), F.sum(F.abs("reported_minor")).alias("covered_minor"))
    log = decided.join(volume, ["org_id", "entity_id", "counterparty_key"], "left").na.fill(0, ["covered_count", "covered_minor"])
    return new, vendors, log.select("org_id", "entity_id", "counterparty_key", "outcome", "target", "covered_count", "covered_minor")


DECISIONS = "decision_id string, org_id string, key_version string, counterparty_key string, outcome string, category_code string, decided_by string, decided_on timestamp, undone_on timestamp, undone_by string"


def live_decisions(decisions: DataFrame) -> DataFrame:
    """The decisions that were not undone; one of a counterparty at most."""
    return decisions.where(F.col("undone_on").isNull())


class DecisionRefused(ValueError):
    """A decision that cannot be made or undone."""


def decide_stored(decisions: Versioned, new: DataFrame) -> int:
    """Adds decisions; a counterparty that has one that stands cannot get another."""
    who = ["org_id", "key_version", "counterparty_key"]

    def changed(old: DataFrame) -> DataFrame:
        twice = live_decisions(old).select(*who).unionByName(new.select(*who)).groupBy(*who).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        for r in twice.limit(1).collect():
            raise DecisionRefused(f"{r.counterparty_key} has a decision")
        return new

    return decisions.change(changed)


def undo_stored(decisions: Versioned, decision_id: str, who: str, on: Column) -> int:
    """Marks a decision as undone; one that is not there, or was undone before, is an error."""

    def changed(old: DataFrame) -> DataFrame:
        found = live_decisions(old).where(F.col("decision_id") == decision_id)
        if found.isEmpty():
            raise DecisionRefused(f"{decision_id} is not a decision that stands")
        return found.withColumns({"undone_on": on, "undone_by": F.lit(who)})

    return decisions.change(changed)


def undo(txn: DataFrame, classifications: DataFrame, vendors: DataFrame, undone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(human classifications to retract, vendors that stay) for undone decisions (org_id, counterparty_key, outcome)."""
    keys = undone.select("org_id", "counterparty_key").distinct()
    rows = txn.select("txn_id", "org_id", "counterparty_key").join(keys, ["org_id", "counterparty_key"], "left_semi").select("txn_id")
    retract = live(classifications).where(F.col("engine_layer") == "human").join(rows, "txn_id", "left_semi")
    forget = undone.where(F.col("outcome") == "categorised").select("org_id", "counterparty_key").distinct()
    return retract, vendors.join(forget, ["org_id", "counterparty_key"], "left_anti")


def supersede(classifications: DataFrame, new: DataFrame) -> DataFrame:
    """The history with new rows (classification_id, txn_id, ...): the live row of each transaction points at its successor."""
    successor = new.select("txn_id", F.col("classification_id").alias("successor"))
    old = classifications.join(successor, "txn_id", "left")
    stands = F.col("superseded_by").isNull() & F.col("retracted_on").isNull()
    old = old.withColumn("superseded_by", F.when(stands, F.col("successor")).otherwise(F.col("superseded_by"))).drop("successor")
    return old.unionByName(new, allowMissingColumns=True)


def touched(rows: DataFrame, by: str) -> list[str]:
    """The partitions that rows lie in; there are as many as months or organisations of one change."""
    return [r[0] for r in rows.select(by).distinct().collect()]


def supersede_stored(history: Partitioned, new: DataFrame) -> int:
    """``supersede`` on a stored history: only the partitions of new rows, which lie with those they replace, are read and written."""
    return history.rewrite(touched(new, history.by), lambda old: supersede(old, new))


def retract_stored(history: Partitioned, retract: DataFrame, on: Column, who: str) -> int:
    """Marks rows (classification_id and the history's partition) as retracted, in their own partitions; rows that do not stand are left as they are."""
    ids = retract.select("classification_id").distinct().withColumn("__gone", F.lit(True))

    def changed(old: DataFrame) -> DataFrame:
        met = old.join(ids, "classification_id", "left")
        now = F.coalesce("__gone", F.lit(False)) & F.col("superseded_by").isNull() & F.col("retracted_on").isNull()
        return met.withColumns({"retracted_on": F.when(now, on).otherwise(F.col("retracted_on")), "retracted_by": F.when(now, who).otherwise(F.col("retracted_by"))}).drop("__gone")

    return history.rewrite(touched(retract, history.by), changed)


def upsert_vendors_stored(vendors: Partitioned, new: DataFrame) -> int:
    """``upsert_vendors`` on a stored memory: only the organisations of new rows are read and written."""
    return vendors.rewrite(touched(new, vendors.by), lambda old: upsert_vendors(old, new))


def forget_stored(vendors: Partitioned, forget: DataFrame) -> int:
    """Removes vendors (the partition and counterparty_key) from a stored memory."""
    keys = [vendors.by, "counterparty_key"]
    return vendors.rewrite(touched(forget, vendors.by), lambda old: old.join(forget.select(*keys).distinct(), keys, "left_anti"))


def upsert_vendors(vendors: DataFrame, new: DataFrame) -> DataFrame:
    """Vendor memory after an upsert: the latest decision of each (org, key) stays."""
    every = vendors.withColumn("is_new", F.lit(0)).unionByName(new.withColumn("is_new", F.lit(1)))
    latest = Window.partitionBy("org_id", "counterparty_key").orderBy(F.desc("decided_on"), F.desc("is_new"), "category_code")
    return every.withColumn("rn", F.row_number().over(latest)).where("rn = 1").drop("rn", "is_new")


def batch_transactions(txn: DataFrame, classifications: DataFrame | str, categories: DataFrame) -> DataFrame:
    """Rows of all batches with their category and layer, if any."""
    names = categories.select(F.col("code").alias("category_code"), F.col("name").alias("category_name"))
    return with_answers(txn, classifications).join(names, "category_code", "left").select("batch_id", "line_no", "txn_id", "booked_on", "amount_minor", "category_code", "category_name", "engine_layer")
