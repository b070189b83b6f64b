"""Building a tree of categories and a list of rules from labelled paths."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import normalize_description

GLUE = " > "


def canonical_path(parts: Column, renamed: Mapping[str, str] | None = None) -> Column:
    """A path from its parts: trimmed, blanks left out, names replaced."""
    kept = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p.isNotNull() & (p != ""))
    if renamed:
        names = F.create_map(*[F.lit(x) for pair in renamed.items() for x in pair])
        kept = F.transform(kept, lambda p: F.coalesce(F.try_element_at(names, p), p))
    return F.array_join(kept, GLUE)


def with_ancestors(paths: DataFrame, path: str = "path") -> DataFrame:
    """A row for each path and each of its prefixes: prefix and level, beside the columns there are."""
    parts = F.split(path, GLUE)
    levels = paths.withColumn("level", F.explode(F.sequence(F.lit(1), F.size(parts))))
    return levels.withColumn("prefix", F.array_join(F.slice(parts, F.lit(1), F.col("level")), GLUE))


def build_taxonomy(used: DataFrame, first_level: list[str] | None = None) -> DataFrame:
    """path, code, level, name, is_leaf, rules: every path of ``used`` (path) and its ancestors.

    rules counts the rows below a node. A code has two digits for each level,
    the node's rank among its siblings by name; ``first_level`` fixes the order
    of the roots. A tree of categories is small, but nothing here needs it to be:
    ranks are taken within a parent.
    """
    nodes = with_ancestors(used.where("path is not null and path != ''")).groupBy("prefix", "level").agg(F.count(F.lit(1)).alias("rules"))
    nodes = nodes.withColumn("name", F.element_at(F.split("prefix", GLUE), -1))
    nodes = nodes.withColumn("parent", F.when(F.col("level") > 1, F.expr(f"left(prefix, length(prefix) - length(name) - {len(GLUE)})")))
    place = F.lit(0)
    for k, root in enumerate(first_level or []):
        place = F.when((F.col("level") == 1) & (F.col("name") == root), k - len(first_level or [])).otherwise(place)
    ranked = nodes.withColumn("rank", F.row_number().over(Window.partitionBy("parent").orderBy(place, "name")))
    steps = with_ancestors(ranked.select(F.col("prefix").alias("path"))).select("path", "prefix", "level")
    steps = steps.join(ranked.select("prefix", "rank"), "prefix")
    codes = steps.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("level", F.lpad(F.col("rank").cast("string"), 2, "0").alias("digits")))).alias("d"))
    codes = codes.select("path", F.array_join(F.transform("d", lambda x: x["digits"]), "").alias("code"))
    parents = nodes.select(F.col("parent").alias("path")).distinct().withColumn("has_children", F.lit(True))
    out = ranked.withColumnRenamed("prefix", "path").join(codes, "path").join(parents, "path", "left")
    return out.select("path", "code", "level", "name", F.col("has_children").isNull().alias("is_leaf"), "rules")


def assign_scopes(taxonomy: DataFrame, targeted: DataFrame, own: DataFrame | None = None, skeleton: int = 2) -> DataFrame:
    """taxonomy with scope: ``global`` for the first levels, what shared rules target and all above it; ``org`` otherwise.

    targeted: path, of the shared rules. own: paths that belong to an
    organisation wherever they stand.
    """
    shared = with_ancestors(targeted.select("path").distinct()).select(F.col("prefix").alias("path")).distinct().withColumn("hit", F.lit(True))
    out = taxonomy.join(shared, "path", "left")
    scope = F.when((F.col("level") <= skeleton) | F.col("hit"), "global").otherwise("org")
    if own is not None:
        out = out.join(own.select("path").distinct().withColumn("mine", F.lit(True)), "path", "left")
        scope = F.when(F.col("mine"), "org").otherwise(scope)
        return out.withColumn("scope", scope).drop("hit", "mine")
    return out.withColumn("scope", scope).drop("hit")


def prepare_rules(rules: DataFrame, composed: bool = False) -> DataFrame:
    """Rules (country, field, value, direction, path, place) normalised, without repeats, with their priority.

    Specific beats general: more parts first, then longer, then the place in
    the source. A description is stored in its normal form; of rules that are
    equal then, the first stays. A rule set is bounded (hundreds), so one order
    over all of it is no load.
    """
    stored = F.when(F.col("field") == "description", normalize_description(F.col("value"), composed)).otherwise(F.col("value"))
    parts = F.size(F.filter(F.split("value", ";"), lambda p: F.trim(p) != ""))
    own = Window.partitionBy("country", "field", "stored_value", "direction", "path").orderBy(F.desc("parts"), F.desc(F.length("value")), "place")
    kept = rules.withColumns({"stored_value": stored, "parts": parts}).withColumn("rn", F.row_number().over(own)).where("rn = 1")
    order = Window.partitionBy("country").orderBy(F.desc("parts"), F.desc(F.length("value")), "place")
    return kept.withColumn("priority", F.row_number().over(order)).drop("rn", "parts")


#: Fixed value: what joins the names of a folded chain.
CHAIN_GLUE = " › "


def folded_trails(paths: DataFrame, path: str = "path") -> DataFrame:
    """Of each path, ``trail``: the labels from its section down to itself, chains of single children folded into one label.

    A section (the first level) is never folded into what it holds. A path that
    also is the beginning of others is a leaf beside that branch. Repeated paths
    count once; null and empty paths are left out. Rows of one path are as many
    as it has levels, so no group grows with the table.
    """
    leaves = paths.select(F.col(path).alias("path")).where("path != ''").distinct()
    nodes = with_ancestors(leaves).withColumn("parts", F.split("path", GLUE)).withColumn("name", F.get("parts", F.col("level") - 1))
    above = F.array_join(F.slice("parts", F.lit(1), F.greatest(F.col("level") - 1, F.lit(1))), GLUE)
    nodes = nodes.withColumn("above", above).withColumn("is_leaf", F.col("level") == F.size("parts"))
    held = nodes.where("level > 1").select("above", "prefix", "is_leaf").distinct().groupBy("above").agg(F.count(F.lit(1)).alias("children"))
    begins = (F.col("level") <= 2) | (F.col("children") > 1)
    numbered = nodes.join(held, "above", "left").withColumn("g", F.sum(begins.cast("int")).over(Window.partitionBy("path").orderBy("level")))
    in_order = lambda names: F.transform(F.array_sort(F.collect_list(names)), lambda x: x["name"])
    labels = numbered.groupBy("path", "g").agg(F.array_join(in_order(F.struct("level", "name")), CHAIN_GLUE).alias("name"))
    return labels.groupBy("path").agg(in_order(F.struct("g", "name")).alias("trail"))
