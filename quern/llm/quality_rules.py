"""Quality rules whose thresholds follow each language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import cut_lineage, whole_text, words

#: metric: numerator, what is added to it, denominator, scale, whether low values are fenced as well.
#: One is added to counts that are mostly zero, so that every text has a place on a scale of ratios.
METRICS: dict[str, tuple[str, int, str, int, bool]] = {
    "word_length": ("word_chars", 0, "n_words", 100, True),
    "symbols": ("n_symbols", 1, "n_words", 1_000_000, False),
    "dup_lines": ("n_dup_lines", 1, "n_lines", 1_000_000, False),
    "repeats": ("n_repeat_words", 1, "n_words", 1_000_000, False),
}


def value_sql(metric: str, div: str = "div") -> str:
    """A metric's whole value, at least 1; the integer division's name differs between engines."""
    num, plus, den, scale, _ = METRICS[metric]
    return f"greatest(({scale} * ({num} + {plus})) {div} greatest({den}, 1), 1)"


def _neighbours_equal(sorted_array: Column, key) -> Column:
    """The elements whose key equals that of the element before or after."""
    last = F.size(sorted_array) - 1
    same = lambda a, b: key(a) == key(b)
    return F.filter(
        sorted_array,
        lambda x, i: F.when(i > 0, same(F.get(sorted_array, i - 1), x)).otherwise(F.lit(False)) | F.when(i < last, same(F.get(sorted_array, i + 1), x)).otherwise(F.lit(False)),
    )


def text_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    n_repeat_words counts the words covered by three-word windows found twice
    or more. Windows are sorted by 33 bits of a hash, packed above their place;
    only windows that share these bits with a neighbour are sorted again by
    their words, so the count is exact and takes n log n steps.
    """
    text = whole_text(text_col)
    kept = [c for c in docs.columns if c != text_col]
    step = docs.select(
        *kept,
        words(text).alias("__w"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
    )
    window = lambda i: [F.get(F.col("__w"), i + k) for k in range(3)]
    packed = F.transform(F.sequence(F.lit(0), F.size("__w") - 3), lambda i: F.shiftleft(F.xxhash64(*window(i)), 31).bitwiseOR(i.cast("bigint")))
    step = step.select(
        *kept,
        "n_symbols",
        "__w",
        F.size("__w").cast("bigint").alias("n_words"),
        F.aggregate("__w", F.lit(0).cast("bigint"), lambda n, w: n + F.length(w)).alias("word_chars"),
        F.size("__lines").cast("bigint").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        F.sort_array(F.when(F.size("__w") >= 3, packed).otherwise(F.array().cast("array<bigint>"))).alias("__s"),
    )
    alike = F.transform(_neighbours_equal(F.col("__s"), lambda x: F.shiftright(x, 31)), lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
    step = step.withColumn("__g", F.sort_array(F.transform(alike, lambda p: F.struct(F.concat_ws(" ", *window(p)).alias("gram"), p.alias("at")))))
    step = step.withColumn("__r", _neighbours_equal(F.col("__g"), lambda x: x["gram"]))
    covered = F.size(F.array_distinct(F.flatten(F.transform("__r", lambda r: F.array(r["at"], r["at"] + 1, r["at"] + 2)))))
    return step.withColumn("n_repeat_words", covered.cast("bigint")).drop("__w", "__s", "__g", "__r")


def sketch(counts: DataFrame, by: list[str]) -> DataFrame:
    """Mergeable quantile sketches: rows of (by, metric, bucket, n).

    A value's bucket keeps its six leading bits, so a bucket is off by 1/32 of
    its value at most and a sketch has some 32 buckets for each doubling, at
    any number of rows. Sketches merge by adding n.
    """
    width = lambda v: F.expr(f"shiftleft(1L, greatest(length(bin({v})) - 6, 0))")
    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.expr(value_sql(m)).alias("value")) for m in METRICS])
    long = counts.select(*by, F.explode(values).alias("x")).select(*by, "x.metric", "x.value")
    return long.groupBy(*by, "metric", (F.col("value") - F.pmod(F.col("value"), width("value"))).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def fences(sketches: DataFrame, by: list[str], reach: int = 3) -> DataFrame:
    """One row per group: rows, and lo_<metric>, hi_<metric>: the quartiles and ``reach`` spreads beyond.

    A spread is the ratio of the quartiles, so fences lie a few quartile
    distances out on a scale of logarithms, and no unit of a metric is built in.
    It is never taken for less than a sketch can tell, one part in 32.
    """
    group = Window.partitionBy(*by, "metric")
    ranked = sketches.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("rows", F.sum("n").over(group))
    at = lambda percent: F.min(F.when(F.col("upto") * 100 >= F.col("rows") * percent, F.col("bucket"))).cast("double")
    quartiles = ranked.groupBy(*by, "metric").agg(F.max("rows").alias("rows"), at(25).alias("q1"), at(75).alias("q3"))
    quartiles = quartiles.withColumn("spread", F.greatest(F.col("q3") / F.col("q1"), F.lit(1 + 1 / 32)))
    beyond = F.lit(1.0)
    for _ in range(reach):
        beyond = beyond * F.col("spread")
    out = [F.max("rows").alias("rows")]
    for m, (*_, low) in METRICS.items():
        mine = lambda e: F.max(F.when(F.col("metric") == m, e))  # noqa: B023, E731
        out.append(mine(F.col("q3") * beyond).alias(f"hi_{m}"))
        if low:
            out.append(mine(F.col("q1") / beyond).alias(f"lo_{m}"))
    return quartiles.groupBy(*by).agg(*out)


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_rows: int = 200, reach: int = 3) -> DataFrame:
    """One row per document: doc_id, counts, base_failed, kept, failed (names of the fences crossed).

    A document fails the base with under 50 words or over half of its words in
    repeated windows. Of the others, sketches of each metric are kept for each
    (language, source) and merged upwards to languages and to the whole; a
    document is kept unless a metric lies more than ``reach`` spreads outside the
    quartiles of its group. A text without the fault that a metric counts never
    crosses its fence. A group of fewer than ``least_rows`` rows takes the fences of its
    language, and a small language those of all documents.

    The table of fences has a row per (language, source) and is joined, not
    broadcast by hand; a hot source is split by adaptive execution.

    Null language or source is a group like others; null and empty texts fail
    the base; extra columns are ignored; an empty table gives an empty result.
    """
    used = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    counts = text_counts(used).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    counts = cut_lineage(counts)
    fine = sketch(counts.where(~F.col("base_failed")), ["lang", "source"])
    by_lang = fine.groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("n"))
    overall = by_lang.groupBy(F.lit("all").alias("every"), "metric", "bucket").agg(F.sum("n").alias("n"))
    limits = [c for m, (*_, low) in METRICS.items() for c in [f"hi_{m}"] + [f"lo_{m}"] * low]
    whole = fences(overall, ["every"], reach).first()  # one row: the fences of all documents
    f, g = fences(fine, ["lang", "source"], reach).alias("f"), fences(by_lang, ["lang"], reach).alias("g")
    joined = f.join(g, F.col("f.lang").eqNullSafe(F.col("g.lang")))
    pick = lambda c: F.when(F.col("f.rows") >= least_rows, F.col(f"f.{c}")).when(F.col("g.rows") >= least_rows, F.col(f"g.{c}")).otherwise(F.lit(whole[c] if whole else None).cast("double"))
    limit = joined.select(F.col("f.lang").alias("t_lang"), F.col("f.source").alias("t_source"), *[pick(c).alias(c) for c in limits])
    d = counts.join(limit, counts["lang"].eqNullSafe(limit["t_lang"]) & counts["source"].eqNullSafe(limit["t_source"]), "left")
    crossed = []
    for m, (num, *_, low) in METRICS.items():
        value = F.expr(value_sql(m))
        out = (value > F.col(f"hi_{m}")) & (F.col(num) > 0)
        out = out | (value < F.col(f"lo_{m}")) if low else out
        crossed.append(F.when(out & ~F.col("base_failed"), F.lit(m)))
    d = d.withColumn("failed", F.array_join(F.array_compact(F.array(*crossed)), ","))
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("failed") == "")).alias("kept"), "failed"
    )


def drop_low_quality(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; repeated rows share their fate."""
    kept = judge_quality(docs, id_col, **options).where("kept").select(F.col("doc_id").alias("__kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["__kept_id"]), "left_semi")


def oracle() -> str:
    """DuckDB SQL for the rows of ``judge_quality`` with its default settings."""
    values = ",\n  ".join(f"('{m}', {value_sql(m, '//')}, {num}, {low})" for m, (num, *_, low) in METRICS.items())
    return f"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
grams AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM grams, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1 GROUP BY doc_id),
counts AS (
  SELECT w.doc_id, lang, source, len(w) AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0) AS n_repeat_words
  FROM w LEFT JOIN repeated r ON r.doc_id = w.doc_id),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
values_of AS (
  SELECT doc_id, lang, source, base_failed, v.metric, v.value::BIGINT AS value, v.num, v.low
  FROM judged, LATERAL (VALUES
  {values}) AS v(metric, value, num, low)),
bucketed AS (
  SELECT *, value - value % (1::BIGINT << greatest(length(bin(value)) - 6, 0)) AS bucket FROM values_of WHERE NOT base_failed),
levels AS (
  SELECT lang, source, metric, bucket, count(*) AS n, grouping(lang, source) AS level
  FROM bucketed GROUP BY GROUPING SETS ((lang, source, metric, bucket), (lang, metric, bucket), (metric, bucket))),
upto AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS upto,
         sum(n) OVER (PARTITION BY level, lang, source, metric) AS total FROM levels),
fence AS (
  SELECT level, lang, source, metric, total, q3 * (1.0::DOUBLE * spread * spread * spread) AS hi, q1 / (1.0::DOUBLE * spread * spread * spread) AS lo
  FROM (SELECT *, greatest(q3 / q1, 1.03125::DOUBLE) AS spread
        FROM (SELECT level, lang, source, metric, max(total) AS total,
                     min(bucket) FILTER (WHERE upto * 100 >= total * 25)::DOUBLE AS q1, min(bucket) FILTER (WHERE upto * 100 >= total * 75)::DOUBLE AS q3
              FROM upto GROUP BY ALL))),
crossed AS (
  SELECT v.doc_id, string_agg(v.metric, ',' ORDER BY list_position({list(METRICS)}, v.metric)) AS failed
  FROM values_of v
  JOIN fence f ON f.level = 0 AND f.metric = v.metric AND f.lang IS NOT DISTINCT FROM v.lang AND f.source IS NOT DISTINCT FROM v.source
  JOIN fence g ON g.level = 1 AND g.metric = v.metric AND g.lang IS NOT DISTINCT FROM v.lang
  JOIN fence h ON h.level = 3 AND h.metric = v.metric
  WHERE NOT v.base_failed
    AND (v.num > 0 AND v.value > CASE WHEN f.total >= 200 THEN f.hi WHEN g.total >= 200 THEN g.hi ELSE h.hi END
      OR v.low AND v.value < CASE WHEN f.total >= 200 THEN f.lo WHEN g.total >= 200 THEN g.lo ELSE h.lo END)
  GROUP BY v.doc_id)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND c.failed IS NULL AS kept, coalesce(c.failed, '') AS failed
FROM judged j LEFT JOIN crossed c ON c.doc_id = j.doc_id"""
