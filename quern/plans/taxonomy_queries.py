"""Queries that build trees and rules from the parts table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import taxonomy as t
from quern.plans.registry import query
from quern.sources.sinks import insert_statements, zipped_payloads

USED_SQL = "u AS (SELECT p_type || ' > ' || p_brand || CASE WHEN p_size % 3 = 0 THEN '' ELSE ' > Size ' || (p_size % 3) END AS path FROM part)"
BUILD_SQL = f"""WITH {USED_SQL}, s AS (SELECT string_split(path, ' > ') AS parts FROM u),
n AS (SELECT list_slice(parts, 1, k) AS p, k AS level, count(*) AS rules FROM s, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS k) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY list_slice(p, 1, level - 1) ORDER BY p[level]) AS rank FROM n),
built AS (SELECT array_to_string(a.p, ' > ') AS path, a.level::INT AS level, a.p[a.level] AS name, a.rules,
  (SELECT string_agg(lpad(b.rank::VARCHAR, 2, '0'), '' ORDER BY b.level) FROM r b WHERE b.level <= a.level AND b.p = list_slice(a.p, 1, b.level)) AS code,
  NOT EXISTS (SELECT 1 FROM n c WHERE c.level = a.level + 1 AND list_slice(c.p, 1, a.level) = a.p) AS is_leaf FROM r a)"""


def used(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.col("p_size") % 3
    parts = F.array("p_type", F.concat(F.lit(" "), "p_brand"), F.when(third != 0, F.concat(F.lit("Size "), third.cast("string"))).otherwise(""))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(t.canonical_path(parts).alias("path"), "p_partkey", "p_name")


@query("taxonomy_build", f"{BUILD_SQL} SELECT path, code, level, name, is_leaf, rules FROM built")
def taxonomy_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.build_taxonomy(used(spark, sf_dir))


@query(
    "category_tree",
    f"""WITH {USED_SQL}, leaf AS (SELECT DISTINCT path, string_split(path, ' > ') AS parts FROM u),
node AS (SELECT path, i, parts[i] AS name, list_slice(parts, 1, i - 1) AS above, list_slice(parts, 1, i) AS own, i = len(parts) AS is_leaf FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM leaf)),
held AS (SELECT above, count(*) AS children FROM (SELECT DISTINCT above, own, is_leaf FROM node WHERE i > 1) GROUP BY above),
cut AS (SELECT n.*, sum((i <= 2 OR children > 1)::INT) OVER (PARTITION BY path ORDER BY i) AS g FROM node n LEFT JOIN held h ON h.above = n.above),
label AS (SELECT path, g, string_agg(name, ' › ' ORDER BY i) AS name FROM cut GROUP BY path, g)
SELECT path, string_agg(name, ' / ' ORDER BY g) AS trail, count(*) AS depth FROM label GROUP BY path""",
)
def category_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    trails = t.folded_trails(used(spark, sf_dir))
    return trails.select("path", F.array_join("trail", " / ").alias("trail"), F.size("trail").cast("bigint").alias("depth"))


@query("taxonomy_scopes", f"{BUILD_SQL}, hit AS (SELECT DISTINCT path FROM u JOIN part ON true WHERE false UNION SELECT DISTINCT path FROM u WHERE path LIKE '%Size 1'), up AS (SELECT path FROM hit UNION SELECT array_to_string(list_slice(string_split(path, ' > '), 1, 2), ' > ') FROM hit) SELECT path, CASE WHEN path LIKE 'SMALL%Size 1' THEN 'org' WHEN level <= 2 OR path IN (SELECT path FROM up) THEN 'global' ELSE 'org' END AS scope FROM built".replace("SELECT DISTINCT path FROM u JOIN part ON true WHERE false UNION ", ""))
def taxonomy_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = used(spark, sf_dir).select("path")
    hit = paths.where(F.endswith("path", F.lit("Size 1")))
    return t.assign_scopes(t.build_taxonomy(paths), hit, hit.where(F.startswith("path", F.lit("SMALL")))).select("path", "scope")


@query(
    "rules_prepared",
    f"""WITH {USED_SQL}, r AS (SELECT p_partkey AS place, CASE p_partkey % 2 WHEN 0 THEN 'BY' ELSE 'KZ' END AS country, p_type || ';' || p_brand || CASE WHEN p_size % 2 = 0 THEN '; ' ELSE ';' || p_size END AS value, p_type AS path FROM part),
s AS (SELECT *, upper(trim(value)) AS stored_value, CASE WHEN value LIKE '%; ' THEN 2 ELSE 3 END AS parts FROM r),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY country, stored_value, path ORDER BY parts DESC, length(value) DESC, place) AS rn FROM s) WHERE rn = 1)
SELECT country, stored_value, path, place, row_number() OVER (PARTITION BY country ORDER BY parts DESC, length(value) DESC, place) AS priority FROM k""",
)
def rules_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    tail = F.when(F.col("p_size") % 2 == 0, "; ").otherwise(F.concat(F.lit(";"), F.col("p_size").cast("string")))
    rules = part.select(F.col("p_partkey").alias("place"), F.when(F.col("p_partkey") % 2 == 0, "BY").otherwise("KZ").alias("country"), F.lit("description").alias("field"), F.concat("p_type", F.lit(";"), "p_brand", tail).alias("value"), F.lit("").alias("direction"), F.col("p_type").alias("path"))
    return t.prepare_rules(rules, composed=True).select("country", "stored_value", "path", "place", "priority")


@query("ordinal_zip", "SELECT l_orderkey AS batch_id, l_linenumber AS line_no, 'p' || l_partkey || '-' || l_suppkey AS payload FROM lineitem")
def ordinal_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines gathered into parallel arrays of one order, as a parser hands them over, and paired again by place."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("batch_id"), F.struct(F.col("l_linenumber").alias("line_no"), F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string")).alias("payload")).alias("x"))
    arrays = lines.groupBy("batch_id").agg(F.collect_list("x").alias("x")).select("batch_id", F.transform("x", lambda x: x["line_no"]).alias("line_nos"), F.transform("x", lambda x: x["payload"]).alias("payloads"))
    return zipped_payloads(arrays)


@query("seed_statements", "SELECT 'INSERT INTO region (r_regionkey, r_name) VALUES (''' || r_regionkey || ''', ''' || replace(r_name, '''', '''''') || ''');' AS statement FROM region")
def seed_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insert_statements(spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", "r_name"), "region")


@query("tenancy_reads", "SELECT r_regionkey::BIGINT AS org_id, r_name AS organisation, count(n_nationkey) AS entities FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2")
def tenancy_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    orgs = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("bigint").alias("org_id"), F.col("r_name").alias("organisation"))
    entities = spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy(F.col("n_regionkey").cast("bigint").alias("org_id")).agg(F.count("n_nationkey").alias("entities"))
    return orgs.join(entities, "org_id", "left").na.fill(0, ["entities"])


@query(
    "tenancy_accounts",
    "SELECT c_nationkey::BIGINT AS entity_id, n_regionkey::BIGINT AS org_id, 'acc-' || c_custkey AS external_ref, c_name AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name, c_custkey) AS place FROM customer JOIN nation ON n_nationkey = c_nationkey",
)
def tenancy_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accounts of each entity by name; customers stand for accounts."""
    customer, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation"))
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_name", "c_custkey")).cast("bigint")
    rows = customer.join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.select(F.col("c_nationkey").cast("bigint").alias("entity_id"), F.col("n_regionkey").cast("bigint").alias("org_id"), F.concat(F.lit("acc-"), F.col("c_custkey").cast("string")).alias("external_ref"), F.col("c_name").alias("name"), place.alias("place"))


@query("file_measure")
def file_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test tables' own files, measured and sniffed as uploads are."""
    from quern.sources.statements import measured_below

    return measured_below(spark, sf_dir).select(F.element_at(F.split("path", "/"), -1).alias("file"), "file_sha256", "byte_length", "content_type", "failure_code")
