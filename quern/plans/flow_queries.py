"""Queries of normalisation, dedup, transfers, classification, review and validation, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import money, pseudonyms, text
from quern.functions.periods import try_parse_date
from quern.operators import classify as c
from quern.operators import dedup, evaluate, review, taxonomy, transfers, validate
from quern.plans.registry import query
from quern.plans.report_queries import WITH, answered, ledger
from quern.session import cut_lineage
from quern.sources import carrier

QUOTE = "'"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# Normal forms. DuckDB has no look-around, so its digit joining is a capturing form applied twice;
# it upper-cases sharp s to a capital of its own, Spark and Python to SS.
def norm_sql(column: str) -> str:
    out = f"upper(replace(translate(coalesce({column}, ''), '«»“”„‘’' || chr(160), '\"\"\"\"\"' || '''''' || ' '), 'ß', 'ss'))"
    for noise in text.NOISE:
        out = f"replace({out}, '{noise}', ' ')"
    for _ in range(2):
        out = rf"regexp_replace({out}, '([0-9])[\s\x0B\x1C-\x1F\x{{85}}\x{{A0}}-]+([0-9])', '\1\2', 'g')"
    return rf"trim(regexp_replace({out}, '[\s\x0B]+', ' ', 'g'))"


@query("norm_description", f"SELECT doc_id, {norm_sql('text')} AS description_norm FROM documents")
def norm_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.normalize_description(F.col("text")).alias("description_norm"))


@query("norm_digits_join", r"SELECT doc_id, regexp_replace(regexp_replace(text, '([0-9])[\s-]+([0-9])', '\1\2', 'g'), '([0-9])[\s-]+([0-9])', '\1\2', 'g') AS joined FROM documents")
def norm_digits_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.join_digits(F.col("text")).alias("joined"))


@query(
    "counterparty_key",
    """WITH n AS (SELECT c_custkey, 'tax:' || lpad(c_custkey::VARCHAR, 9, '0') AS by_tax, 'name:' || upper(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) AS by_name FROM customer)
SELECT c_custkey, by_tax, by_name, 'acct:' || 'BY' || c_custkey AS by_account, '' AS by_nothing, 'tax_id,name,account,none' AS tiers,
  'name:РОГА' || c_custkey AS by_quoted_name, 'tax:000000000' AS by_zeroes, 'name:ФИРМА' || c_custkey AS by_short_tax, 'tax:190' || lpad(c_custkey::VARCHAR, 6, '0') AS by_spaced_tax, 'acct:BY' || c_custkey AS by_form_only FROM n""",
)
def counterparty_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    none, number = F.lit(None).cast("string"), F.col("c_custkey").cast("string")
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        "c_custkey",
        text.counterparty_key(F.col("c_name"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"), none).alias("by_tax"),
        text.counterparty_key(F.concat(F.lit("ООО "), F.col("c_name"), F.lit(" UL.X 1")), F.lit("0"), none).alias("by_name"),
        text.counterparty_key(none, none, F.concat(F.lit("by-"), F.col("c_custkey").cast("string"))).alias("by_account"),
        text.counterparty_key(none, none, none).alias("by_nothing"),
        text.counterparty_key(F.concat(F.lit("«Рога-"), number, F.lit("» ООО, Минск")), F.lit(" - "), none).alias("by_quoted_name"),
        text.counterparty_key(F.col("c_name"), F.lit("000000000"), none).alias("by_zeroes"),
        text.counterparty_key(F.concat(F.lit("ЗАО Фирма-"), number), F.lit("1234567"), none).alias("by_short_tax"),
        text.counterparty_key(F.col("c_name"), F.concat(F.lit("190-"), F.lpad(number, 6, "0")), none).alias("by_spaced_tax"),
        text.counterparty_key(F.lit("ООО"), F.lit("0"), F.concat(F.lit("BY "), number)).alias("by_form_only"),
    )
    tiers = F.concat_ws(",", *[text.key_tier(F.col(k)) for k in ("by_tax", "by_name", "by_account", "by_nothing")])
    return keys.withColumn("tiers", tiers)


# What is put behind a name, and what of it stays: written out by the rules, beside the library.
ADDRESSES = [" UL.Nowa 5", " UL. Nowa", " UL. Nowa 15", ", Minsk", " , Minsk", " 220030 Minsk", " 7 Minsk", " ROAD 7", " ROADSIDE", " ROADЯ x", " BROAD 1", " PLAZA", " ADRES,x", " A1 22", "", " ", " х. 12-3"]
ADDRESSES_SQL = "['', ' UL. Nowa', ' UL. Nowa', ', Minsk', '', '', ' 7 Minsk', '', ' ROADSIDE', ' ROADЯ x', ' BROAD 1', '', '', ' A1', '', '', ' х.']"


@query("strip_address", f"SELECT c_custkey, c_name || {ADDRESSES_SQL}[c_custkey % 17 + 1] AS bare FROM customer")
def strip_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    addressed = F.concat(F.col("c_name"), F.element_at(F.array(*[F.lit(x) for x in ADDRESSES]), (F.col("c_custkey") % 17 + 1).cast("int")))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", text.strip_address(addressed).alias("bare"))


FORMS = ["ООО {} LTD", "LTDX {}", "{} INC. LLC", "{} AB SA", "SP. Z O.O. {}", "SPZOO {}", "{} S.A.", "ТОВАРИЩЕСТВО С ОГРАНИЧЕННОЙ ОТВЕТСТВЕННОСТЬЮ {}", "{}-LTD", "ЧУП {} УПАК"]
FORMS_SQL = "['  {} ', 'LTDX {}', '{}  ', '{}  ', '  {}', '  {}', '{} ', '  {}', '{}-LTD', '  {} УПАК']"


@query("strip_legal_forms", f"SELECT c_custkey, replace({FORMS_SQL}[c_custkey % 10 + 1], '{{}}', upper(c_name)) AS bare FROM customer")
def strip_legal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.replace(F.element_at(F.array(*[F.lit(x) for x in FORMS]), (F.col("c_custkey") % 10 + 1).cast("int")), F.lit("{}"), F.upper("c_name"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", text.strip_legal_forms(named).alias("bare"))


@query("replacement_char", "SELECT doc_id, contains(text || CASE WHEN doc_id % 3 = 0 THEN chr(65533) ELSE '' END, chr(65533)) AS bad FROM documents")
def replacement_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.has_replacement_char(F.concat("text", F.when(F.col("doc_id") % 3 == 0, "�").otherwise(""))).alias("bad"))


# Money.
_CODES = {"0": "JPY", "1": "BYN", "2": "KWD", "3": "CLF"}
CODE_SQL = "CASE l_suppkey % 4 WHEN 0 THEN 'JPY' WHEN 1 THEN 'BYN' WHEN 2 THEN 'KWD' ELSE 'CLF' END"
DIGITS_SQL = "CASE l_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END"


def amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.element_at(F.array(*[F.lit(x) for x in _CODES.values()]), (F.col("l_suppkey") % 4 + 1).cast("int"))
    minor = F.round(F.col("l_extendedprice") * 100).cast("bigint") * F.when(F.col("l_returnflag") == "N", 1).otherwise(-1)
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", code.alias("code"), minor.alias("minor"))


FORMAT_SQL = f"""m AS (SELECT l_orderkey, l_linenumber, {CODE_SQL} AS code, {DIGITS_SQL} AS d, round(l_extendedprice * 100)::BIGINT * CASE WHEN l_returnflag = 'N' THEN 1 ELSE -1 END AS minor FROM lineitem),
f AS (SELECT *, CASE WHEN minor < 0 THEN '-' ELSE '' END || (abs(minor) // (10 ** d)::BIGINT) || CASE WHEN d = 0 THEN '' ELSE '.' || lpad((abs(minor) % (10 ** d)::BIGINT)::VARCHAR, d, '0') END AS formatted FROM m)"""


@query("money_format", f"WITH {FORMAT_SQL} SELECT l_orderkey, l_linenumber, code, minor, formatted FROM f")
def money_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return amounts(spark, sf_dir).withColumn("formatted", money.format_money(F.col("code"), F.col("minor")))


@query("money_parse", f"WITH {FORMAT_SQL} SELECT l_orderkey, l_linenumber, code, formatted, minor AS parsed, NULL::BIGINT AS too_long FROM f")
def money_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = amounts(spark, sf_dir).withColumn("formatted", money.format_money(F.col("code"), F.col("minor")))
    longer = F.concat("formatted", F.when(F.contains("formatted", F.lit(".")), "0").otherwise(".0"))
    return shown.select("l_orderkey", "l_linenumber", "code", "formatted", money.parse_money(F.col("code"), F.col("formatted")).alias("parsed"), money.try_parse_money(F.col("code"), longer).alias("too_long"))


_SPELL = "CASE l_partkey % 5 WHEN 0 THEN replace(x, '.', ',') WHEN 1 THEN '1.000.' || replace(x, '.', ',') WHEN 2 THEN '2,' || x WHEN 3 THEN '3 ' || chr(160) || replace(x, '.', ',') ELSE x || 'x' END"


@query(
    "decimal_from_locale",
    f"WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * 100)::BIGINT AS cents FROM lineitem), t AS (SELECT *, (cents // 100) || '.' || lpad((cents % 100)::VARCHAR, 2, '0') AS x FROM s) "
    f"SELECT l_orderkey, l_linenumber, {_SPELL} AS spelled, CASE l_partkey % 5 WHEN 0 THEN x WHEN 1 THEN '1000' || x WHEN 2 THEN '2' || x WHEN 3 THEN '3' || x END AS plain FROM t",
)
def decimal_from_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    x = money.format_money(F.lit("BYN"), cents)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", x.alias("x"))
    rows = rows.select("l_orderkey", "l_linenumber", F.expr(_SPELL.replace("chr(160)", "' '")).alias("spelled"))
    return rows.withColumn("plain", money.try_decimal_from_locale(F.col("spelled")))


@query("parse_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN o_orderdate::DATE END AS booked_on FROM orders")
def parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate")
    spelled = [F.date_format(day, x) for x in ("dd.MM.yyyy", "yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy")] + [F.concat(F.lit("31.02."), F.date_format(day, "yyyy"))]
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", try_parse_date(F.element_at(F.array(*spelled), (F.col("o_orderkey") % 5 + 1).cast("int"))).alias("booked_on"))


@query("direction", f"{WITH} SELECT txn_id, CASE WHEN amount_minor >= 0 THEN 'income' ELSE 'expense' END AS direction FROM txn")
def direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carrier.transactions(spark, sf_dir).select("txn_id", F.when(F.col("amount_minor") >= 0, "income").otherwise("expense").alias("direction"))


# Duplicates. Texts repeat, so documents stand for rows of statements.
KEY_SQL = "concat_ws(chr(31), lang, '2024-01-01', n_chars::VARCHAR, 'BYN', text, '', '', '0')"


def statement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    key = dedup.content_key(F.col("lang"), F.lit("2024-01-01").cast("date"), F.col("n_chars"), F.lit("BYN"), F.col("text"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(0))
    # The key is shuffled as its digest: two rows share a digest as they share a key.
    rows = d.select(F.col("doc_id").alias("txn_id"), F.concat_ws("-", "lang", F.col("doc_id") % 2).alias("batch_id"), F.col("doc_id").alias("line_no"), F.lit(0).alias("posting_no"), F.sha2(key, 256).alias("content_key"))
    return dedup.with_occurrence(rows)


OCC_SQL = f"occ AS (SELECT doc_id AS txn_id, lang || '-' || (doc_id % 2) AS batch_id, sha256({KEY_SQL}) AS content_key, row_number() OVER (PARTITION BY lang, doc_id % 2, sha256({KEY_SQL}) ORDER BY doc_id) AS occurrence FROM documents)"


@query("occurrence", f"WITH {OCC_SQL} SELECT txn_id, batch_id, occurrence FROM occ")
def occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statement_rows(spark, sf_dir).select("txn_id", "batch_id", "occurrence")


HASHED_SQL = f"{OCC_SQL}, hashed AS (SELECT *, sha256(content_key || chr(31) || occurrence) AS dedup_hash FROM occ)"


def hashed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statement_rows(spark, sf_dir).withColumn("dedup_hash", dedup.dedup_hash(F.col("content_key"), F.col("occurrence")))


@query("content_hash", f"{WITH} SELECT txn_id, sha256(concat_ws(chr(31), account_id::VARCHAR, strftime(booked_on, '%Y-%m-%d'), amount_minor::VARCHAR, 'BYN', description_raw, '', '', '0') || chr(31) || '1') AS dedup_hash FROM txn")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    key = dedup.content_key(F.col("account_id"), F.col("booked_on"), F.col("amount_minor"), F.lit("BYN"), F.col("description_raw"), none, none, F.lit(0))
    return carrier.transactions(spark, sf_dir).select("txn_id", dedup.dedup_hash(key, F.lit(1)).alias("dedup_hash"))


@query("dedup_d1", "SELECT source, lang, count(*) AS files FROM documents d WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE lang = 'en') GROUP BY ALL")
def dedup_d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = documents(spark, sf_dir).select("source", "lang", F.sha2("text", 256).alias("file_sha256"))
    return dedup.known_files(files, files.where("lang = 'en'")).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("files"))


D3_SQL = f"{HASHED_SQL}, latest AS (SELECT dedup_hash, max_by(txn_id, txn_id) AS matched_txn_id, max_by(batch_id, txn_id) AS matched_batch_id FROM hashed WHERE txn_id % 2 = 0 GROUP BY dedup_hash), skips AS (SELECT i.txn_id, i.batch_id, l.matched_txn_id, l.matched_batch_id FROM hashed i JOIN latest l USING (dedup_hash) WHERE i.txn_id % 2 = 1)"


def _d3(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = hashed_rows(spark, sf_dir).select("txn_id", "batch_id", "dedup_hash")
    stored = rows.where("txn_id % 2 = 0").withColumn("created_on", F.col("txn_id"))
    return dedup.split_reimports(rows.where("txn_id % 2 = 1"), stored)


@query("dedup_d3", f"WITH {D3_SQL} SELECT txn_id, batch_id, matched_txn_id, matched_batch_id, 'D3' AS level FROM skips")
def dedup_d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _d3(spark, sf_dir)[1].select("txn_id", "batch_id", "matched_txn_id", "matched_batch_id", "level")


@query("dedup_inserts", f"WITH {D3_SQL} SELECT txn_id, batch_id FROM hashed WHERE txn_id % 2 = 1 AND txn_id NOT IN (SELECT txn_id FROM skips)")
def dedup_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _d3(spark, sf_dir)[0].select("txn_id", "batch_id")


@query(
    "dedup_summary",
    f"""{WITH}, skip AS (SELECT batch_id, CASE WHEN quantity % 2 = 0 THEN 'D3' ELSE 'D2' END AS level FROM txn WHERE quantity % 5 = 0)
SELECT t.batch_id, t.transactions, coalesce(s.d2, 0) AS skipped_d2, coalesce(s.d3, 0) AS skipped_d3, coalesce(p.n, 0) AS active_pairs FROM (SELECT batch_id, count(*) AS transactions FROM txn GROUP BY 1) t
LEFT JOIN (SELECT batch_id, count(*) FILTER (WHERE level = 'D2') AS d2, count(*) FILTER (WHERE level = 'D3') AS d3 FROM skip GROUP BY 1) s USING (batch_id)
LEFT JOIN (SELECT batch_id, count(DISTINCT transfer_id) AS n FROM transfer JOIN txn USING (txn_id) WHERE NOT dismissed GROUP BY 1) p USING (batch_id)""",
)
def dedup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    txn = carrier.transactions(spark, sf_dir)
    skips = txn.where("quantity % 5 = 0").select("batch_id", F.when(F.col("quantity") % 2 == 0, "D3").otherwise("D2").alias("level"))
    return dedup.batch_summary(txn, skips, carrier.transfer_members(txn).join(txn.select("txn_id", "batch_id"), "txn_id"))


# Transfers.
CANDIDATE_SQL = f"""WITH {carrier.MOVEMENTS_SQL}, free AS (SELECT txn_id, entity_id, account_id, source_kind, booked_on, coalesce(base_amount_minor, amount_minor) AS base FROM movement WHERE txn_id % 17 <> 0),
 cand AS (SELECT a.txn_id, b.txn_id AS candidate_id, abs(datediff('day', a.booked_on, b.booked_on)) AS days_apart FROM free a JOIN free b
  ON a.entity_id = b.entity_id AND a.source_kind = b.source_kind AND a.base = -b.base WHERE a.account_id <> b.account_id AND a.base <> 0 AND abs(datediff('day', a.booked_on, b.booked_on)) <= 3)"""


@query("transfer_candidates", f"{CANDIDATE_SQL} SELECT * FROM cand")
def transfer_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    txn = carrier.movements(spark, sf_dir)
    return transfers.candidates(txn, members=carrier.movement_members(txn))


@query("transfer_nearest", f"{CANDIDATE_SQL} SELECT txn_id, candidate_id, days_apart FROM (SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY days_apart, candidate_id) AS rn FROM cand) WHERE rn = 1")
def transfer_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    txn = carrier.movements(spark, sf_dir)
    return transfers.nearest(txn, members=carrier.movement_members(txn))


@query("transfer_pairs")
def transfer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    txn = carrier.movements(spark, sf_dir)
    return transfers.pairs(txn, members=carrier.movement_members(txn))


@query("transfer_active", f"{WITH} SELECT entity_id, count(*) AS members FROM transfer JOIN txn USING (txn_id) WHERE NOT dismissed GROUP BY 1")
def transfer_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    txn = carrier.transactions(spark, sf_dir)
    return transfers.active_members(carrier.transfer_members(txn)).join(txn.select("txn_id", "entity_id"), "txn_id").groupBy("entity_id").agg(F.count(F.lit(1)).alias("members"))


@query("transfer_dismiss", f"{WITH} SELECT transfer_id, txn_id, dismissed OR txn_id IN (SELECT txn_id FROM txn WHERE quantity % 3 = 0) AS dismissed FROM transfer")
def transfer_dismiss(spark: SparkSession, sf_dir: str) -> DataFrame:
    txn = carrier.transactions(spark, sf_dir)
    return transfers.dismiss(carrier.transfer_members(txn), txn.where("quantity % 3 = 0").select(F.concat(F.lit("t-"), "txn_id").alias("transfer_id"))).select("transfer_id", "txn_id", "dismissed")


# Classification. p_name gives descriptions; the quantity's remainder stands for a state payment code.
def _rule(code: str, priority: int, *conditions: c.Condition, **rest) -> c.Rule:
    return c.Rule(code, priority, conditions, rule_id=f"r{priority:03d}", **rest)


RULES = [
    _rule("0404", 1, c.Condition("regulated_code", "eq", "7"), c.Condition("direction", "eq", "EXPENSE")),
    _rule("0101", 2, c.Condition("regulated_code", "eq", "3"), source_kind="bank"),
    _rule("02", 10, c.Condition("description", "contains_all", "1; 2"), source_kind="bank"),
    _rule("0401010204", 11, c.Condition("description", "contains_all", "5")),
    _rule("06", 12, c.Condition("amount", "gte", currency="BYN", minor_units=5_000_000)),
    _rule("03", 13, c.Condition("amount", "gte", currency="EUR", minor_units=0)),
    _rule("05", 14, c.Condition("counterparty_key", "eq", "name:NOBODY")),
    _rule("08", 90, c.Condition("description", "contains_all", "7"), org_owned=True, scope="org"),
    _rule("01", 3, c.Condition("description", "contains_all", "PART"), active=False),
]
ROWS_SQL = "r AS (SELECT txn.* EXCLUDE (currency), upper(description_raw) AS description_norm, (quantity % 9)::VARCHAR AS regulated_code, 'BYN' AS currency FROM txn)"
VENDORS_SQL = "vendor AS (SELECT DISTINCT org_id, counterparty_key, '09' AS category_code FROM txn WHERE counterparty_key LIKE '%7')"
RULE_CASE = """CASE WHEN regulated_code = '7' AND amount_minor < 0 THEN ['0404', 'L0.5', 'global', '1'] WHEN regulated_code = '3' AND source_kind = 'bank' THEN ['0101', 'L0.5', 'global', '2']
 WHEN contains(description_norm, '7') THEN ['08', 'L1', 'org', '90'] WHEN source_kind = 'bank' AND contains(description_norm, '1') AND contains(description_norm, '2') THEN ['02', 'L1', 'global', '10']
 WHEN contains(description_norm, '5') THEN ['0401010204', 'L1', 'global', '11'] WHEN amount_minor >= 5000000 THEN ['06', 'L1', 'global', '12'] END"""
CLASSIFIED_SQL = f"""{WITH}, {ROWS_SQL}, {VENDORS_SQL}, hit AS (SELECT r.*, v.category_code AS remembered, {RULE_CASE} AS rule FROM r LEFT JOIN vendor v ON v.org_id = r.org_id AND v.counterparty_key = r.counterparty_key),
answer AS (SELECT txn_id, batch_id, coalesce(remembered, rule[1]) AS category_code, CASE WHEN remembered IS NOT NULL THEN 'L0' ELSE rule[2] END AS engine_layer,
  CASE WHEN remembered IS NOT NULL THEN 'name' ELSE rule[3] END AS evidence, CASE WHEN remembered IS NOT NULL THEN 0 ELSE rule[4]::INT END AS matched_rule_priority FROM hit WHERE remembered IS NOT NULL OR rule IS NOT NULL)"""
CONFIDENCE_SQL = "CASE engine_layer WHEN 'L0' THEN 1.000 WHEN 'L0.5' THEN 0.990 ELSE 0.950 END::DECIMAL(4,3)"


def proposals(spark: SparkSession, sf_dir: str, threshold: float = 0.0) -> DataFrame:
    txn = carrier.transactions(spark, sf_dir)
    rows = txn.withColumns({"description_norm": F.upper("description_raw"), "regulated_code": (F.col("quantity") % 9).cast("string"), "currency": F.lit("BYN")})
    vendors = txn.where(F.endswith("counterparty_key", F.lit("7"))).select("org_id", "counterparty_key").distinct().withColumn("category_code", F.lit("09"))
    c.check_request(RULES, vendors, [x[0] for x in carrier.CATEGORIES])
    return c.classify(rows, RULES, vendors, threshold)


@query("classify_batch", f"{CLASSIFIED_SQL} SELECT *, {CONFIDENCE_SQL} AS confidence FROM answer")
def classify_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proposals(spark, sf_dir)


@query("classify_threshold", f"{CLASSIFIED_SQL} SELECT txn_id, engine_layer FROM answer WHERE engine_layer <> 'L1'")
def classify_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proposals(spark, sf_dir, 0.96).select("txn_id", "engine_layer")


def _register_layer(name: str, layer: str) -> None:
    @query(name, f"{CLASSIFIED_SQL} SELECT txn_id, category_code, evidence FROM answer WHERE engine_layer = '{layer}'")
    def of_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
        return proposals(spark, sf_dir).where(F.col("engine_layer") == layer).select("txn_id", "category_code", "evidence")


for _name, _layer in (("classify_l0", "L0"), ("classify_l05", "L0.5"), ("classify_l1", "L1")):
    _register_layer(_name, _layer)


@query("classify_run_counts", f"{CLASSIFIED_SQL} SELECT t.batch_id, t.n AS rows, coalesce(a.n, 0) AS classified, t.n - coalesce(a.n, 0) AS to_review FROM (SELECT batch_id, count(*) AS n FROM txn GROUP BY 1) t LEFT JOIN (SELECT batch_id, count(*) AS n FROM answer GROUP BY 1) a USING (batch_id)")
def classify_run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.run_log(carrier.transactions(spark, sf_dir), proposals(spark, sf_dir))


@query(
    "effective_rules",
    """SELECT p_brand AS org_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 5 <> 0, p_size, p_partkey::VARCHAR) AS rank, p_partkey::VARCHAR AS rule_id, p_size::BIGINT AS priority
FROM part WHERE p_partkey % 7 <> 0""",
)
def effective_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts stand for rules of the organisation of their brand."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    rules = part.select(F.col("p_brand").alias("org_id"), F.col("p_partkey").cast("string").alias("rule_id"), F.col("p_size").cast("bigint").alias("priority"), (F.col("p_size") % 5 == 0).alias("org_owned"), (F.col("p_partkey") % 7 != 0).alias("active"))
    return c.ranked_rules(rules, ["org_id"]).select("org_id", "rank", "rule_id", "priority")


@query(
    "eval_agreement",
    f"""{CLASSIFIED_SQL}, v AS (SELECT CASE WHEN a.category_code IS NULL THEN 'uncovered' WHEN a.category_code = type_code THEN 'agreed' WHEN a.category_code = '0404' THEN 'awaiting_allocation'
 WHEN starts_with(type_code, a.category_code) THEN 'less_specific' ELSE 'disagreed' END AS verdict, amount_minor FROM txn LEFT JOIN answer a USING (txn_id) WHERE type_code IS NOT NULL)
SELECT verdict, count(*) AS row_count, sum(abs(amount_minor))::BIGINT AS volume_minor FROM v GROUP BY 1""",
)
def eval_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = carrier.transactions(spark, sf_dir).where("type_code is not null").select("txn_id", F.col("type_code").alias("label"), "amount_minor")
    return c.compare_labels(proposals(spark, sf_dir), labels, ["0404"])


@query("eval_dead_rules", f"{CLASSIFIED_SQL}, rules AS (SELECT unnest([90, 1, 2, 10, 11, 12, 13, 14])::INT AS matched_rule_priority) SELECT matched_rule_priority FROM rules WHERE matched_rule_priority NOT IN (SELECT matched_rule_priority FROM answer)")
def eval_dead_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.dead_rules(RULES, proposals(spark, sf_dir))


# An accountant's file of rules: a line a part, with texts of its name, of customers' names and of accounts.
LABEL_LINES_SQL = """line AS (
  SELECT p_partkey AS ord, p_name AS spelled, upper(p_name) AS normal, CASE WHEN p_partkey % 5 = 0 THEN 'CUSTOMER#0000' || lpad((p_partkey % 40)::VARCHAR, 5, '0') ELSE '' END AS cp,
         CASE p_partkey % 3 WHEN 0 THEN 'Expense' WHEN 1 THEN 'Income' ELSE '' END AS dir, CASE WHEN p_partkey % 7 > 0 THEN ['0101', '02', '0404', '08'][p_partkey % 4 + 1] END AS code, p_partkey % 4 AS kind
  FROM part WHERE p_partkey <= 120),
rule AS (SELECT ord, cp, dir, code, CASE kind WHEN 1 THEN 'Tytuł: ' || spelled WHEN 2 THEN 'Rachunek kontrahenta' ELSE spelled END AS spelled,
         CASE kind WHEN 1 THEN normal WHEN 2 THEN 'ACC' || (ord % 10) || ';' || (ord % 4) WHEN 3 THEN ord % 10 || '; CUST ;PART' ELSE normal END AS normal,
         CASE kind WHEN 1 THEN 'purpose' WHEN 2 THEN 'account' ELSE 'both' END AS field FROM line),
seen AS (SELECT txn_id, type_code, reported_minor, org_id::VARCHAR AS country, upper(description_raw) AS purpose, upper(counterparty_raw) AS cp, 'ACC' || account_id || '-' || (account_id % 4) AS acct, CASE WHEN amount_minor >= 0 THEN 'Income' ELSE 'Expense' END AS dir, counterparty_key FROM txn)"""
LABELLED_SQL = f"""{LABEL_LINES_SQL},
first_rule AS (
  SELECT s.txn_id, min(r.ord) AS ord FROM seen s JOIN rule r
    ON (r.dir = '' OR r.dir = s.dir) AND (r.cp = '' OR contains(s.cp, r.cp))
   AND len(list_filter(string_split(r.normal, ';'), lambda p: trim(p) <> '' AND NOT contains(CASE r.field WHEN 'account' THEN s.acct WHEN 'purpose' THEN s.purpose ELSE s.purpose || ' || ' || s.cp END, trim(p)))) = 0
   AND (s.country <> '0' OR r.ord % 2 = 0)
  GROUP BY s.txn_id),
labelled AS (SELECT s.*, r.code AS label, r.ord FROM seen s LEFT JOIN first_rule f USING (txn_id) LEFT JOIN rule r ON r.ord = f.ord)"""


def label_rules(spark: SparkSession, sf_dir: str) -> dict[str, list[evaluate.LabelRule]]:
    """The file's lines by country; one country's file has every second line."""
    lines = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey <= 120").select("p_partkey", "p_name").orderBy("p_partkey").collect()  # a file of 120 lines
    out: dict[str, list[evaluate.LabelRule]] = {str(c): [] for c in range(5)}
    for k, name in lines:
        kind, normal = k % 4, name.upper()
        spelled = {1: f"Tytuł: {name}", 2: "Rachunek kontrahenta"}.get(kind, name)
        normal = {2: f"ACC{k % 10};{k % 4}", 3: f"{k % 10}; CUST ;PART"}.get(kind, normal)
        code = ["0101", "02", "0404", "08"][k % 4] if k % 7 else None
        rule = evaluate.LabelRule.of(spelled, normal, counterparty=f"CUSTOMER#0000{k % 40:05d}" if k % 5 == 0 else "", direction=["Expense", "Income", ""][k % 3], code=code)
        for country, rules in out.items():
            if country != "0" or k % 2 == 0:
                rules.append(rule)
    return out


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    txn = carrier.transactions(spark, sf_dir)
    rows = txn.select(
        "txn_id",
        "reported_minor",
        "counterparty_key",
        F.col("org_id").cast("string").alias("country"),
        F.upper("description_raw").alias("purpose_norm"),
        F.upper("counterparty_raw").alias("counterparty_norm"),
        F.concat(F.lit("ACC"), "account_id", F.lit("-"), (F.col("account_id") % 4).cast("string")).alias("account_norm"),
        F.when(F.col("amount_minor") >= 0, "Income").otherwise("Expense").alias("direction"),
    )
    return evaluate.label_rows(rows, label_rules(spark, sf_dir))


@query("label_rows", f"{WITH}, {LABELLED_SQL} SELECT txn_id, label FROM labelled")
def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each transaction's label by the first line of the accountant's file that fits."""
    return labelled(spark, sf_dir).select("txn_id", "label")


VERDICTS_SQL = f"""{CLASSIFIED_SQL}, {LABELLED_SQL}, bare AS (SELECT l.*, a.category_code AS predicted, CASE WHEN a.category_code = '0101' THEN '01' ELSE a.category_code END AS b FROM labelled l LEFT JOIN answer a USING (txn_id)),
v AS (SELECT *, CASE WHEN predicted IS NULL THEN 'uncovered' WHEN label IS NULL THEN 'unlabelled' WHEN predicted = label THEN 'agreed' WHEN predicted = '0404' THEN 'awaiting_allocation'
  WHEN starts_with(label, b) AND length(b) < length(label) THEN 'less_specific' ELSE 'disagreed' END AS verdict FROM bare)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = proposals(spark, sf_dir).select("txn_id", F.col("category_code").alias("predicted"))
    return labelled(spark, sf_dir).join(answers, "txn_id", "left").withColumn("verdict", evaluate.verdict(F.col("predicted"), F.col("label"), ["0404"], ["0101"]))


@query(
    "eval_report",
    f"""{VERDICTS_SQL}, s AS (SELECT country, count(*) AS row_count, count(*) FILTER (verdict <> 'uncovered') AS matched, count(*) FILTER (verdict = 'agreed') AS agreed, count(*) FILTER (verdict = 'awaiting_allocation') AS awaiting_allocation,
  count(*) FILTER (verdict = 'less_specific') AS less_specific, count(*) FILTER (verdict = 'disagreed') AS disagreed, count(*) FILTER (verdict = 'unlabelled') AS unlabelled, count(*) FILTER (verdict = 'uncovered') AS uncovered,
  count(DISTINCT counterparty_key) FILTER (verdict = 'uncovered') AS residue_keys, coalesce(sum(abs(reported_minor)) FILTER (verdict <> 'uncovered'), 0)::BIGINT AS covered_minor, sum(abs(reported_minor))::BIGINT AS volume_minor FROM v GROUP BY country)
SELECT *, matched * 100.0::DOUBLE / row_count AS rows_pct, covered_minor * 100.0::DOUBLE / nullif(volume_minor, 0) AS amount_pct,
  agreed * 100.0::DOUBLE / nullif(agreed + awaiting_allocation + less_specific + disagreed, 0) AS agreed_pct, disagreed * 100.0::DOUBLE / nullif(agreed + awaiting_allocation + less_specific + disagreed, 0) AS disagreed_pct FROM s""",
)
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage, accuracy and residue of the rules in each country."""
    return evaluate.coverage(judged(spark, sf_dir), ["country"], "reported_minor", "counterparty_key")


@query(
    "eval_residue",
    f"""{VERDICTS_SQL}, c AS (SELECT country, left(CASE WHEN cp <> '' THEN cp ELSE purpose END, 52) AS name, count(*) AS row_count FROM v WHERE verdict = 'uncovered' GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY row_count DESC, name) AS rank FROM c) WHERE rank <= 4""",
)
def eval_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counterparties that most rows without an answer have, four a country."""
    name = F.when(F.col("counterparty_norm") != "", F.col("counterparty_norm")).otherwise(F.col("purpose_norm"))
    return evaluate.residue(judged(spark, sf_dir), ["country"], name)


# A tree as deep as the table is large: each part hangs below the one of half its number.
PATH_SQL = "WITH RECURSIVE t AS (SELECT p_partkey AS code, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent_code, p_name AS name FROM part), p AS (SELECT code, name AS path FROM t WHERE parent_code IS NULL OR parent_code NOT IN (SELECT code FROM t) UNION ALL SELECT t.code, p.path || ' > ' || t.name FROM t JOIN p ON t.parent_code = p.code)"


@query("category_path", f"{PATH_SQL} SELECT code, path FROM p")
def category_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return c.taxonomy_paths(part.select(F.col("p_partkey").alias("code"), F.expr("CASE WHEN p_partkey > 1 THEN p_partkey div 2 END").alias("parent_code"), F.col("p_name").alias("name")))


# Codes of a tree built from the table, two digits a level: types, brands, sizes.
TREE_SQL = """word AS (SELECT DISTINCT [p_type, p_brand, 'Size ' || (p_size % 3)] AS w FROM part), a AS (SELECT w[1] AS x, row_number() OVER (ORDER BY w[1]) AS r FROM (SELECT DISTINCT [w[1]] AS w FROM word)),
b AS (SELECT w[1] AS x, w[2] AS y, row_number() OVER (PARTITION BY w[1] ORDER BY w[2]) AS r FROM (SELECT DISTINCT [w[1], w[2]] AS w FROM word)),
d AS (SELECT w[1] AS x, w[2] AS y, w[3] AS z, row_number() OVER (PARTITION BY w[1], w[2] ORDER BY w[3]) AS r FROM word),
tree AS (SELECT lpad(a.r::VARCHAR, 2, '0') AS code, x AS name, false AS is_leaf FROM a
  UNION ALL SELECT lpad(a.r::VARCHAR, 2, '0') || lpad(b.r::VARCHAR, 2, '0'), y, false FROM a JOIN b USING (x)
  UNION ALL SELECT lpad(a.r::VARCHAR, 2, '0') || lpad(b.r::VARCHAR, 2, '0') || lpad(d.r::VARCHAR, 2, '0'), z, true FROM a JOIN b USING (x) JOIN d USING (x, y))"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat_ws(" > ", "p_type", "p_brand", F.expr("concat('Size ', p_size % 3)")).alias("path"))
    return taxonomy.build_taxonomy(paths).select("code", "name", "is_leaf")


@query("section_by_prefix", f"WITH {TREE_SQL} SELECT c.code, left(c.code, 2) AS section, p.name AS parent_name FROM tree c LEFT JOIN tree p ON p.code = left(c.code, length(c.code) - 2)")
def section_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = tree(spark, sf_dir)
    parents = dim.select(F.col("code").alias("parent_code"), F.col("name").alias("parent_name"))
    return dim.withColumn("parent_code", F.expr("left(code, length(code) - 2)")).join(parents, "parent_code", "left").select("code", F.left("code", F.lit(2)).alias("section"), "parent_name")


@query("taxonomy_classifiable", f"WITH {TREE_SQL} SELECT code, name FROM tree WHERE is_leaf AND code NOT LIKE '05%'")
def taxonomy_classifiable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves that rows can be put in; one section stands for computed lines."""
    dim = tree(spark, sf_dir).withColumn("is_computed", F.startswith("code", F.lit("05")))
    return dim.where("is_leaf AND NOT is_computed").select("code", "name")


#: Prefixes and the side of the ledger they belong to, the first that fits counts.
SIDES = [("01", "income"), ("0502", "income"), ("0602", "income"), ("02", "expense"), ("03", "expense"), ("04", "expense"), ("0501", "expense"), ("07", "expense"), ("08", "expense")]


@query(
    "side_of",
    f"""WITH {TREE_SQL} SELECT code, CASE WHEN left(code, 2) = '01' THEN 'income' WHEN left(code, 2) IN ('02', '03', '04', '07', '08') THEN 'expense'
  WHEN left(code, 4) IN ('0502', '0602') THEN 'income' WHEN left(code, 4) = '0501' THEN 'expense' ELSE 'both' END AS side FROM tree""",
)
def side_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.startswith("code", F.lit(SIDES[0][0])), SIDES[0][1])
    for prefix, name in SIDES[1:]:
        side = side.when(F.startswith("code", F.lit(prefix)), name)
    return tree(spark, sf_dir).select("code", side.otherwise("both").alias("side"))


@query(
    "adopt_template",
    f"WITH {carrier.CATEGORIES_SQL}, orgs AS (SELECT r_regionkey::BIGINT AS org_id FROM region), own AS (SELECT org_id, code, org_id || ':' || code AS category_id, parent_code, name FROM orgs, category WHERE level > 1) "
    "SELECT o.org_id, o.code, o.category_id, coalesce(p.category_id, 'shared:' || s.code) AS parent_id FROM own o LEFT JOIN own p ON p.org_id = o.org_id AND p.code = o.parent_code LEFT JOIN category s ON s.code = o.parent_code",
)
def adopt_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The template's rows for every organisation; a parent is the organisation's own, else the shared one."""
    dim = carrier.categories(spark)
    orgs = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("bigint").alias("org_id"))
    # A template has a fixed number of rows: each organisation gets its copy by exploding it.
    template = [(x.code, x.parent_code) for x in dim.where("level > 1").select("code", "parent_code").collect()]
    copies = F.explode(F.array(*[F.struct(F.lit(a).alias("code"), F.lit(b).alias("parent_code")) for a, b in template]))
    own = orgs.select("org_id", copies.alias("t")).select("org_id", "t.*").withColumn("category_id", F.concat_ws(":", F.col("org_id").cast("string"), "code"))
    parents = own.select("org_id", F.col("code").alias("parent_code"), F.col("category_id").alias("own_parent"))
    shared = dim.select(F.col("code").alias("parent_code"), F.concat(F.lit("shared:"), "code").alias("shared_parent"))
    j = own.join(parents, ["org_id", "parent_code"], "left").join(shared, "parent_code", "left")
    return j.select("org_id", "code", "category_id", F.coalesce("own_parent", "shared_parent").alias("parent_id"))


# Review.
@query(
    "review_groups",
    f"{WITH} SELECT org_id, counterparty_key, max(counterparty_raw) AS counterparty, count(*) AS row_count, sum(reported_minor)::BIGINT AS amount_minor, min(booked_on) AS first_on, max(booked_on) AS last_on FROM txn WHERE txn_id NOT IN (SELECT txn_id FROM live) GROUP BY 1, 2",
)
def review_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review_groups(*answered(spark, sf_dir)[:2])


@query(
    "review_page",
    f"{WITH} SELECT counterparty_key, count(*) AS row_count, sum(reported_minor)::BIGINT AS amount_minor FROM txn WHERE txn_id NOT IN (SELECT txn_id FROM live) GROUP BY 1 ORDER BY abs(sum(reported_minor)) DESC, count(*) DESC, counterparty_key LIMIT 50 OFFSET 50",
)
def review_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = review.review_groups(*answered(spark, sf_dir)[:2], by=("counterparty_key",))
    return review.review_page(groups, 50, 50).select("counterparty_key", "row_count", "amount_minor")


@query("review_group_rows", f"{WITH} SELECT org_id, counterparty_key, txn_id, booked_on, reported_minor FROM txn WHERE txn_id NOT IN (SELECT txn_id FROM live)")
def review_group_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.unanswered(*answered(spark, sf_dir)[:2]).select("org_id", "counterparty_key", "txn_id", "booked_on", "reported_minor")


@query("review_totals", f"{WITH} SELECT org_id, count(*) AS row_count, count(DISTINCT counterparty_key) AS counterparties, sum(abs(reported_minor))::BIGINT AS volume_minor FROM txn WHERE txn_id NOT IN (SELECT txn_id FROM live) GROUP BY 1")
def review_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review_totals(*answered(spark, sf_dir)[:2])


@query("unclassified_page", f"{WITH} SELECT txn_id, booked_on FROM txn WHERE batch_id = 1997 AND txn_id NOT IN (SELECT txn_id FROM live) ORDER BY booked_on, txn_id LIMIT 201")
def unclassified_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review.unanswered(*answered(spark, sf_dir)[:2]).where("batch_id = 1997")
    return rows.orderBy("booked_on", "txn_id").limit(201).select("txn_id", "booked_on")


DECISION_SQL = """decision AS (SELECT org_id, entity_id, counterparty_key, ['categorised', 'transfer', 'non_pnl', 'skipped'][(length(counterparty_key) + entity_id) % 4 + 1] AS outcome, DATE '2002-01-01' AS decided_on
  FROM (SELECT DISTINCT org_id, entity_id, counterparty_key FROM txn)), target AS (SELECT *, CASE outcome WHEN 'categorised' THEN '05' WHEN 'skipped' THEN NULL ELSE '09' END AS target FROM decision),
covered AS (SELECT t.*, outcome, target FROM txn t JOIN target USING (org_id, entity_id, counterparty_key) WHERE txn_id NOT IN (SELECT txn_id FROM live))"""


def decisions(txn: DataFrame) -> DataFrame:
    pick = F.element_at(F.array(*[F.lit(x) for x in ("categorised", "transfer", "non_pnl", "skipped")]), ((F.length("counterparty_key") + F.col("entity_id")) % 4 + 1).cast("int"))
    return txn.select("org_id", "entity_id", "counterparty_key").distinct().withColumns({"outcome": pick, "category_code": F.lit("05"), "decided_on": F.lit("2002-01-01").cast("date")})


def resolved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    txn, said, _ = answered(spark, sf_dir)
    return review.resolve(txn, said, decisions(carrier.transactions(spark, sf_dir)))


@query("review_resolve", f"{WITH}, {DECISION_SQL} SELECT txn_id || '#h' AS classification_id, txn_id, target AS category_code FROM covered WHERE target IS NOT NULL")
def review_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir)[0].select("classification_id", "txn_id", "category_code")


@query("review_vendors", f"{WITH}, {DECISION_SQL} SELECT org_id, counterparty_key, target AS category_code FROM target WHERE outcome = 'categorised'")
def review_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir)[1].select("org_id", "counterparty_key", "category_code")


@query("review_coverage", f"{WITH}, {DECISION_SQL} SELECT d.org_id, d.entity_id, d.counterparty_key, d.outcome, d.target, count(c.txn_id) AS covered_count, coalesce(sum(abs(c.reported_minor)), 0)::BIGINT AS covered_minor FROM target d LEFT JOIN covered c USING (org_id, entity_id, counterparty_key) GROUP BY 1, 2, 3, 4, 5")
def review_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir)[2]


@query("review_undo", f"{WITH}, {DECISION_SQL} SELECT classification_id, l.txn_id FROM live l JOIN txn t ON t.txn_id = l.txn_id JOIN (SELECT DISTINCT org_id, counterparty_key FROM decision WHERE outcome = 'categorised') u ON u.org_id = t.org_id AND u.counterparty_key = t.counterparty_key WHERE engine_layer = 'human'")
def review_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    txn, said, _ = ledger(spark, sf_dir)
    made = decisions(txn)
    vendors = made.select("org_id", "counterparty_key").distinct()
    return review.undo(txn, said, vendors, made.where("outcome = 'categorised'"))[0].select("classification_id", "txn_id")


@query("supersede", f"{WITH}, {DECISION_SQL}, n AS (SELECT txn_id || '#n' AS classification_id, txn_id FROM txn WHERE quantity % 4 = 0) SELECT c.classification_id, CASE WHEN c.superseded_by IS NULL AND c.retracted_on IS NULL AND n.txn_id IS NOT NULL THEN n.classification_id ELSE c.superseded_by END AS superseded_by FROM classification c LEFT JOIN n USING (txn_id) UNION ALL SELECT classification_id, NULL FROM n")
def supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    txn, said, _ = ledger(spark, sf_dir)
    new = txn.where("quantity % 4 = 0").select(F.concat("txn_id", F.lit("#n")).alias("classification_id"), "txn_id", "org_id")
    return review.supersede(said, new).select("classification_id", "superseded_by")


@query("vendor_upsert", f"{WITH}, v AS (SELECT DISTINCT org_id, counterparty_key FROM txn) SELECT org_id, counterparty_key, CASE WHEN length(counterparty_key) % 2 = 0 THEN '05' ELSE '03' END AS category_code FROM v")
def vendor_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = carrier.transactions(spark, sf_dir).select("org_id", "counterparty_key").distinct().withColumns({"category_code": F.lit("03"), "decided_on": F.lit("2001-01-01").cast("date")})
    new = old.where(F.length("counterparty_key") % 2 == 0).withColumns({"category_code": F.lit("05"), "decided_on": F.lit("2001-06-01").cast("date")})
    return review.upsert_vendors(old, new).select("org_id", "counterparty_key", "category_code")


@query("batch_transactions", f"{WITH} SELECT batch_id, line_no, txn.txn_id, booked_on, amount_minor, live.category_code, name AS category_name, engine_layer FROM txn LEFT JOIN live ON live.txn_id = txn.txn_id LEFT JOIN category ON code = live.category_code")
def batch_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.batch_transactions(*answered(spark, sf_dir))


@query(
    "assert_live_once",
    "SELECT l_orderkey AS txn_id, count(*) AS n FROM lineitem WHERE l_partkey % 4 > 0 AND l_suppkey % 5 > 0 GROUP BY 1 HAVING count(*) > 1",
)
def assert_live_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as answers for their order: some superseded, some retracted, and more than one left for many."""
    said = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("txn_id"), F.when(F.col("l_partkey") % 4 == 0, "x").alias("superseded_by"), F.when(F.col("l_suppkey") % 5 == 0, F.col("l_shipdate")).alias("retracted_on"))
    return c.assert_live_once(said)


@query("agg_counts", f"{WITH} SELECT batch_id, count(*) AS row_count, count(DISTINCT account_id) AS accounts FROM txn GROUP BY 1")
def agg_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carrier.transactions(spark, sf_dir).groupBy("batch_id").agg(F.count(F.lit(1)).alias("row_count"), F.countDistinct("account_id").alias("accounts"))


# Validation. Orders stand for rows of statements, spelled as text, with every kind of fault in some of them.
TODAY = "2001-06-30"
RAW_SQL = f"""raw AS (SELECT o_orderkey AS line_no, o_custkey % 20 AS batch_id, o_orderdate::DATE AS d, o_orderkey % 50 AS k,
   replace((round(o_totalprice * 100)::BIGINT // 100) || '.' || lpad((round(o_totalprice * 100)::BIGINT % 100)::VARCHAR, 2, '0'), '.', ',') AS amount FROM orders),
srow AS (SELECT line_no, batch_id, d, k, CASE WHEN k = 1 THEN '31.02.2000' ELSE strftime(d, '%d.%m.%Y') END AS booked_on,
   CASE WHEN k = 2 THEN '12x' WHEN k = 3 OR k % 2 = 0 THEN amount ELSE '0,00' END AS debit, CASE WHEN k = 3 OR k % 2 = 1 THEN amount ELSE '0,00' END AS credit,
   CASE WHEN k = 4 THEN ' ' WHEN k = 5 THEN 'a' || chr(65533) ELSE 'payment' END AS description, CASE WHEN k = 6 THEN 'XYZ' ELSE 'BYN' END AS currency, CASE WHEN k = 7 THEN ' ' ELSE 'BY13X' END AS account FROM raw)"""


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 50
    amount = F.replace(money.format_money(F.lit("BYN"), F.round(F.col("o_totalprice") * 100).cast("bigint")), F.lit("."), F.lit(","))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("line_no"),
        (F.col("o_custkey") % 20).alias("batch_id"),
        F.when(k == 6, "XYZ").otherwise("BYN").alias("currency"),
        F.when(k == 7, " ").otherwise("BY13X").alias("account"),
        F.when(k == 1, "31.02.2000").otherwise(F.date_format("o_orderdate", "dd.MM.yyyy")).alias("booked_on"),
        F.when(k == 2, "12x").when((k == 3) | (k % 2 == 0), amount).otherwise("0,00").alias("debit"),
        F.when((k == 3) | (k % 2 == 1), amount).otherwise("0,00").alias("credit"),
        F.when(k == 4, " ").when(k == 5, "a�").otherwise("payment").alias("description"),
        F.lit("ACME").alias("counterparty"),
        F.col("o_orderkey").cast("string").alias("document_no"),
    )


ERRORS_SQL = f"""{RAW_SQL}, err AS (
 SELECT batch_id, line_no, 'booked_on' AS field, 'date_implausible' AS code, booked_on AS raw FROM srow WHERE k = 1 OR d < DATE '{TODAY}' - 3650 OR d > DATE '{TODAY}' + 1
 UNION ALL SELECT batch_id, line_no, 'debit', 'amount_unparseable', debit FROM srow WHERE k = 2
 UNION ALL SELECT batch_id, line_no, 'debit', 'debit_and_credit_both_set', debit || ' / ' || credit FROM srow WHERE k = 3
 UNION ALL SELECT batch_id, line_no, 'description', 'replacement_character', description FROM srow WHERE k = 5
 UNION ALL SELECT batch_id, line_no, 'description', 'description_missing', description FROM srow WHERE k = 4
 UNION ALL SELECT batch_id, line_no, 'currency', 'currency_unknown', currency FROM srow WHERE k = 6
 UNION ALL SELECT batch_id, line_no, 'account', 'account_unresolved', account FROM srow WHERE k = 7)"""


@query("validate_rows", f"WITH {ERRORS_SQL} SELECT * FROM err")
def validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.row_errors(raw_rows(spark, sf_dir), TODAY)


@query(
    "report_json",
    f"""WITH {ERRORS_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY line_no, field, code) AS rn, count(*) OVER (PARTITION BY batch_id) AS n FROM err)
SELECT batch_id, to_json({{'schema': 1, 'error_count': any_value(n), 'errors': list({{'rn': rn, 'line_no': line_no, 'field': field, 'code': code, 'raw': raw}} ORDER BY rn)}})::VARCHAR AS report FROM ranked WHERE rn <= 100 GROUP BY batch_id""",
)
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.report_json(validate.row_errors(raw_rows(spark, sf_dir), TODAY))


STATEMENTS_SQL = f"""{WITH}, st AS (SELECT org_id * 100000 + entity_id * 10000 + batch_id AS batch_id, booked_on, 'd' || line_no AS document_no, account_id::VARCHAR AS counterparty_account,
  CASE WHEN amount_minor < 0 THEN -amount_minor ELSE 0 END AS debit_minor, CASE WHEN amount_minor > 0 THEN amount_minor ELSE 0 END AS credit_minor, CASE WHEN entity_id = 4 AND account_id % 2 = 0 THEN 'EUR' ELSE 'BYN' END AS currency FROM txn),
f AS (SELECT batch_id, 'BYN' AS currency, 0::BIGINT AS opening_minor, CASE WHEN batch_id % 3 = 0 THEN NULL ELSE (sum(credit_minor - debit_minor) + CASE WHEN batch_id % 3 = 1 THEN 1 ELSE 0 END)::BIGINT END AS closing_minor,
  min(booked_on) AS period_from, CASE WHEN batch_id % 2 = 0 THEN max(booked_on) - 1 ELSE max(booked_on) END AS period_to, CASE WHEN batch_id % 5 = 0 THEN count(*) + 1 END AS declared_rows FROM st GROUP BY batch_id),
warn AS (SELECT batch_id, 'balance_mismatch' AS code FROM f WHERE closing_minor IS NOT NULL AND batch_id % 3 = 1 UNION ALL SELECT batch_id, 'row_count_mismatch' FROM f WHERE declared_rows IS NOT NULL
 UNION ALL SELECT batch_id, 'period_gap' FROM f WHERE batch_id % 2 = 0 UNION ALL SELECT batch_id, 'mixed_currency' FROM st GROUP BY 1 HAVING min(currency) <> max(currency)
 UNION ALL SELECT DISTINCT batch_id, 'duplicate_bank_reference' FROM (SELECT batch_id FROM st GROUP BY batch_id, booked_on, document_no, counterparty_account, debit_minor, credit_minor HAVING count(*) > 1))"""


def batch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = carrier.transactions(spark, sf_dir)
    a = F.col("amount_minor")
    return t.select(
        (F.col("org_id") * 100000 + F.col("entity_id") * 10000 + F.col("batch_id")).alias("batch_id"),
        "booked_on",
        F.concat(F.lit("d"), F.col("line_no").cast("string")).alias("document_no"),
        F.col("account_id").cast("string").alias("counterparty_account"),
        F.when(a < 0, -a).otherwise(0).alias("debit_minor"),
        F.when(a > 0, a).otherwise(0).alias("credit_minor"),
        F.when((F.col("entity_id") == 4) & (F.col("account_id") % 2 == 0), "EUR").otherwise("BYN").alias("currency"),
    )


def statement_files(sums: DataFrame) -> DataFrame:
    """What the files of statements declare, made from their sums: some of it wrong or missing."""
    b = F.col("batch_id")
    return sums.select(
        "batch_id",
        F.lit("BYN").alias("currency"),
        F.lit(0).cast("bigint").alias("opening_minor"),
        F.when(b % 3 != 0, F.col("movement") + F.when(b % 3 == 1, 1).otherwise(0)).alias("closing_minor"),
        F.col("first_on").alias("period_from"),
        F.when(b % 2 == 0, F.date_sub("last_on", 1)).otherwise(F.col("last_on")).alias("period_to"),
        F.when(b % 5 == 0, F.col("n") + 1).alias("declared_rows"),
    )


def statements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, files, warnings). Files and warnings come from the same sums, a row a batch, which are written once: the ledger is joined once for both."""
    rows = batch_rows(spark, sf_dir)
    sums = cut_lineage(validate.statement_sums(rows))
    files = statement_files(sums)
    return rows, files, validate.warnings_of(sums, files)


@query("validate_file", f"{STATEMENTS_SQL} SELECT * FROM warn")
def validate_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements(spark, sf_dir)[2]


@query("agg_balance_check", f"{STATEMENTS_SQL} SELECT f.batch_id, (opening_minor + sum(credit_minor - debit_minor) - closing_minor)::BIGINT AS difference_minor, opening_minor + sum(credit_minor - debit_minor) = closing_minor AS passed FROM f JOIN st USING (batch_id) GROUP BY f.batch_id, opening_minor, closing_minor")
def agg_balance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.sum(F.col("credit_minor") - F.col("debit_minor")).alias("movement")
    sums = cut_lineage(batch_rows(spark, sf_dir).groupBy("batch_id").agg(moved, F.min("booked_on").alias("first_on"), F.max("booked_on").alias("last_on"), F.count(F.lit(1)).alias("n")))
    difference = F.col("opening_minor") + F.col("movement") - F.col("closing_minor")
    return statement_files(sums).join(sums.select("batch_id", "movement"), "batch_id").select("batch_id", difference.alias("difference_minor"), (difference == 0).alias("passed"))


@query("outcome", f"{STATEMENTS_SQL} SELECT f.batch_id, 0::BIGINT AS error_count, coalesce(w.n, 0) AS warning_count, CASE WHEN coalesce(w.n, 0) > 0 THEN 'valid_with_warnings' ELSE 'valid' END AS outcome FROM f LEFT JOIN (SELECT batch_id, count(*) AS n FROM warn GROUP BY 1) w USING (batch_id)")
def outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, files, warnings = statements(spark, sf_dir)
    return validate.outcomes(files, validate.row_errors(raw_rows(spark, sf_dir), TODAY), warnings)


@query("outcome_rejected", f"WITH {ERRORS_SQL} SELECT batch_id, count(*) AS error_count, 0::BIGINT AS warning_count, 'rejected' AS outcome FROM err GROUP BY 1")
def outcome_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = validate.row_errors(raw_rows(spark, sf_dir), TODAY)
    return validate.outcomes(errors.select("batch_id").distinct(), errors, errors.where("false").select("batch_id", "code"))


# Written out beside the library's own table, so that the two are held against each other.
LEGAL_SQL = """(VALUES ('awaiting_upload', 'uploaded'), ('awaiting_upload', 'abandoned'), ('awaiting_upload', 'failed'), ('uploaded', 'parsing'), ('uploaded', 'failed'),
  ('parsing', 'parsed'), ('parsing', 'failed'), ('parsed', 'validating'), ('parsed', 'failed'), ('validating', 'validated'), ('validating', 'rejected'), ('validating', 'failed'),
  ('validated', 'persisting'), ('validated', 'failed'), ('persisting', 'imported'), ('persisting', 'failed')) AS legal(state, next_state)"""
STATES = ["abandoned", "awaiting_upload", "failed", "imported", "parsed", "parsing", "persisting", "rejected", "uploaded", "validated", "validating", "measured"]
_STATE_SQL = "['abandoned', 'awaiting_upload', 'failed', 'imported', 'parsed', 'parsing', 'persisting', 'rejected', 'uploaded', 'validated', 'validating', 'measured']"


def _state(place: str) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in STATES]), F.expr(f"cast({place} as int)"))


@query("batch_state_illegal", f"WITH h AS (SELECT o_orderkey AS batch_id, {_STATE_SQL}[o_orderkey % 12 + 1] AS state, {_STATE_SQL}[o_custkey % 12 + 1] AS next_state FROM orders) SELECT * FROM h WHERE (state, next_state) NOT IN (SELECT (state, next_state) FROM {LEGAL_SQL})")
def batch_state_illegal(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("batch_id"), _state("o_orderkey % 12 + 1").alias("state"), _state("o_custkey % 12 + 1").alias("next_state"))
    return validate.illegal_moves(history).select("batch_id", "state", "next_state")


BATCHES_SQL = f"""batches AS (
  SELECT o_orderkey AS batch_id, 'o' || (o_custkey % 3) AS org_id, {_STATE_SQL}[o_orderkey % 11 + 1] AS status, CASE WHEN o_orderkey % 13 > 0 THEN 'f' || o_custkey END AS file_sha256
  FROM orders),
asked AS (
  SELECT CASE WHEN l_linenumber = 5 THEN -l_orderkey ELSE l_orderkey END AS batch_id, {_STATE_SQL}[l_partkey % 11 + 1] AS status, CASE WHEN l_suppkey % 2 = 0 THEN 'code' || (l_suppkey % 5) END AS failure_code
  FROM lineitem WHERE l_linenumber IN (3, 5) OR l_linenumber = 4 AND l_partkey % 20 = 0),
judged AS (
  SELECT a.batch_id, b.status, a.status AS next_status, a.failure_code,
         CASE WHEN count(*) OVER (PARTITION BY a.batch_id) > 1 THEN 'asked_twice'
              WHEN b.batch_id IS NULL THEN 'not_found'
              WHEN (b.status, a.status) NOT IN (SELECT (state, next_state) FROM {LEGAL_SQL}) THEN 'illegal_transition'
              WHEN b.file_sha256 IS NULL AND a.status NOT IN ('awaiting_upload', 'abandoned', 'failed') THEN 'not_measured'
              WHEN a.status = 'imported' AND b.file_sha256 IS NOT NULL AND ((b.org_id, b.file_sha256) IN (SELECT (org_id, file_sha256) FROM batches WHERE status = 'imported' AND file_sha256 IS NOT NULL)
                   OR row_number() OVER (PARTITION BY a.status, b.org_id, b.file_sha256 ORDER BY a.batch_id) > 1) THEN 'already_imported' END AS refused
  FROM asked a LEFT JOIN batches b ON a.batch_id = b.batch_id)"""


def _moves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sha = F.when(F.expr("o_orderkey % 13 > 0"), F.concat(F.lit("f"), F.expr("cast(o_custkey as string)")))
    batches = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("batch_id"),
        F.concat(F.lit("o"), F.expr("cast(o_custkey % 3 as string)")).alias("org_id"),
        _state("o_orderkey % 11 + 1").alias("status"),
        F.lit(None).cast("string").alias("failure_code"),
        sha.alias("file_sha256"),
        F.when(sha.isNotNull(), 1).cast("bigint").alias("byte_length"),
        F.when(sha.isNotNull(), "text/plain").alias("content_type"),
        F.lit(None).cast("timestamp").alias("updated_at"),
    )
    asked = (
        spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        .where("l_linenumber IN (3, 5) OR l_linenumber = 4 AND l_partkey % 20 = 0")
        .select(F.expr("CASE WHEN l_linenumber = 5 THEN -l_orderkey ELSE l_orderkey END").alias("batch_id"), _state("l_partkey % 11 + 1").alias("status"), F.expr("CASE WHEN l_suppkey % 2 = 0 THEN concat('code', l_suppkey % 5) END").alias("failure_code"))
    )
    return validate.moved(batches, asked, F.current_timestamp())


@query("batch_moves", f"WITH {BATCHES_SQL} SELECT batch_id, next_status AS status, CASE WHEN next_status = 'failed' THEN failure_code END AS failure_code FROM judged WHERE refused IS NULL")
def batch_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that requests bring into a new state."""
    return _moves(spark, sf_dir)[0].select("batch_id", "status", "failure_code")


@query("batch_moves_refused", f"WITH {BATCHES_SQL} SELECT batch_id, status, next_status, refused FROM judged WHERE refused IS NOT NULL")
def batch_moves_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that move nothing, and why."""
    return _moves(spark, sf_dir)[1]


@query("expiry", "SELECT event_id AS batch_id, CASE WHEN event_type = 'view' AND ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 15 MINUTE THEN 'abandoned' WHEN event_type = 'view' THEN 'awaiting_upload' ELSE 'uploaded' END AS state FROM events")
def expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("batch_id"), F.col("ts").alias("created_at"), F.when(F.col("event_type") == "view", "awaiting_upload").otherwise("uploaded").alias("state"))
    return validate.expired(batches, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("batch_id", "state")


@query("overridden_batches", f"{STATEMENTS_SQL} SELECT DISTINCT batch_id FROM warn JOIN st USING (batch_id) WHERE booked_on >= DATE '1996-01-01' AND booked_on < DATE '1998-01-01'")
def overridden_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches with overridden warnings and rows in a half-open period."""
    rows, files, warnings = statements(spark, sf_dir)
    warned = validate.outcomes(files, files.where("false").select("batch_id"), warnings).withColumn("overridden_by", F.lit(None).cast("string"))
    asked = files.select("batch_id", F.lit("approver").alias("role"), F.lit("checked with the bank").alias("reason"), F.lit("u1").alias("user_id"))
    over = validate.override(warned, asked)
    return rows.where("booked_on >= DATE '1996-01-01' AND booked_on < DATE '1998-01-01'").select("batch_id").distinct().join(over.select("batch_id"), "batch_id", "left_semi")


@query(
    "resolve_account",
    f"""{WITH}, r AS (SELECT DISTINCT org_id, entity_id, CASE WHEN account_id % 5 = 0 THEN ' ' ELSE account_id::VARCHAR END AS external_ref, account_id, currency FROM txn)
SELECT DISTINCT org_id, entity_id, external_ref, currency, CASE WHEN external_ref = ' ' THEN NULL WHEN account_id % 3 = 0 THEN 'a' || account_id ELSE sha256(org_id || chr(31) || entity_id || chr(31) || account_id) END AS account_id,
  external_ref <> ' ' AND account_id % 3 = 0 AND currency <> CASE WHEN account_id % 2 = 0 THEN 'PLN' ELSE 'BYN' END AS mixed_currency FROM r""",
)
def resolve_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    txn = carrier.transactions(spark, sf_dir)
    ref = F.col("account_id").cast("string")
    rows = txn.select("org_id", "entity_id", F.when(F.col("account_id") % 5 == 0, " ").otherwise(ref).alias("external_ref"), "currency")
    known = txn.where("account_id % 3 = 0").select("org_id", "entity_id", ref.alias("external_ref"), F.concat(F.lit("a"), ref).alias("account_id"), F.when(F.col("account_id") % 2 == 0, "PLN").otherwise("BYN").alias("currency")).distinct()
    found, _ = validate.resolve_accounts(rows, known)
    return found.select("org_id", "entity_id", "external_ref", "currency", "account_id", "mixed_currency").distinct()


@query("build_transaction", f"WITH {RAW_SQL} SELECT line_no, CASE WHEN debit <> '0,00' THEN -replace(debit, ',', '')::BIGINT ELSE replace(credit, ',', '')::BIGINT END AS amount_minor FROM srow WHERE k NOT IN (2, 6)")
def build_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    debit, credit = (money.try_parse_amount(F.col("currency"), F.col(x)) for x in ("debit", "credit"))
    return raw_rows(spark, sf_dir).where(debit.isNotNull()).select("line_no", F.when(debit != 0, -debit).otherwise(credit).alias("amount_minor"))


@query("raw_rows_payload", f"WITH {RAW_SQL} SELECT batch_id, line_no, booked_on, debit, credit, description FROM srow")
def raw_rows_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows stored as JSON payloads and read back with a declared schema."""
    from quern.sources.sinks import payloads, read_payloads

    return read_payloads(payloads(raw_rows(spark, sf_dir)), "booked_on string, debit string, credit string, description string")


@query("pseudonymise")
def pseudonymise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names, account numbers and what is written about them, all under one salt; a test holds every row against the definition."""
    of = spark.read.parquet(f"{sf_dir}/customer.parquet")
    account = F.concat(F.lit("BY13 PJCB "), F.lpad(F.col("c_custkey").cast("string"), 12, "0"))
    said = F.concat(F.lit("Выплата ПЕТРОВ ИВАНОВИЧ №"), F.col("c_custkey").cast("string"), F.lit(" за 01.02.2024, счёт "), account, F.lit(" Сидорову А. Б."))
    replaced = lambda c, kind: pseudonyms.pseudonymised(c, kind, "salt")
    return of.select("c_custkey", replaced(F.col("c_name"), "company").alias("name"), replaced(account, "digits").alias("account"), replaced(said, "preamble").alias("said"))
