"""What five filters remove, alone and in every order of theirs."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import WHITE, cut_lineage, whole_text

#: Filters by letter; a document's failures are the sum of 1 << place.
LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(LETTERS)]
MASKS = range(1 << len(LETTERS))
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def word_totals(docs: DataFrame) -> DataFrame:
    """Words and distinct words of each (doc_id, print), of a table with doc_id, print and content.

    Rows that repeat id and text are folded into one before words are exploded,
    and that places each text in the task that then counts by (document, word)
    and by document, so no word is sent anywhere. Texts without words have no
    row.
    """
    texts = docs.groupBy("doc_id", "print").agg(F.first("content").alias("content"))
    each = texts.select("doc_id", "print", F.explode(F.split("content", WHITE)).alias("word")).where("word <> ''")
    counted = each.groupBy("doc_id", "print", "word").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("doc_id", "print").agg(F.sum("n").alias("n_words"), F.count(F.lit(1)).alias("n_distinct"))


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, part, failed (sum of 1, 2, 4, 8, 16 for A to E), good, toxic.

    A: under 200 words; B: under half of the words distinct; C: over 3 percent
    of the code points are A to Z; D: holds one of ``#$%&*|``; E: the text of
    some smaller id. A null text counts as empty, a null part as the empty
    string. A null id is not compared: it is a copy of nothing and makes no
    copies. Rows that repeat an id are documents of their own; those that
    repeat id and text share all flags, and neither is a copy of the other.
    A document is good or toxic if any row of its id in ``labels`` says so.
    """
    content = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), content.alias("content"), F.xxhash64(content).alias("print"))
    upper = F.length("content") - F.length(F.translate("content", UPPER, ""))
    facts = cut_lineage(
        rows.select(
            "doc_id",
            "part",
            "print",
            F.unhex(F.sha2("content", 256)).alias("digest"),
            (100 * upper > 3 * F.length("content")).alias("c"),
            F.col("content").rlike(r"[#$%&*|]").alias("d"),
        )
    )
    firsts = cut_lineage(facts.groupBy("digest").agg(F.min("doc_id").alias("first")))
    marked = labels.groupBy(F.col("doc_id").alias("__label")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    flagged = facts.join(firsts, "digest").select("doc_id", "part", "print", "c", "d", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("e"))
    totals = cut_lineage(word_totals(rows)).withColumnsRenamed({"doc_id": "__doc_id", "print": "__print"})
    same = flagged["doc_id"].eqNullSafe(totals["__doc_id"]) & (flagged["print"] == totals["__print"])
    flags = flagged.join(totals, same, "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in ("n_words", "n_distinct")})
    flags = flags.join(marked, flags["doc_id"] == marked["__label"], "left")
    bit = lambda holds, k: F.when(holds, F.lit(1 << k)).otherwise(F.lit(0))
    failed = bit(F.col("n_words") < 200, 0) + bit(100 * F.col("n_distinct") < 50 * F.col("n_words"), 1) + bit(F.col("c"), 2) + bit(F.col("d"), 3) + bit(F.col("e"), 4)
    return flags.select("doc_id", "part", failed.alias("failed"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def mask_counts(failed: DataFrame) -> DataFrame:
    """One row per part: documents, good and toxic ones for each of the 32 sets of failures, as arrays ``n``, ``good``, ``toxic``."""
    counts = failed.groupBy("part", "good", "toxic").agg(*[F.count(F.when(F.col("failed") == m, 1)).alias(f"m{m}") for m in MASKS])
    sums = lambda when: F.array(*[F.sum(F.when(when, F.col(f"m{m}")).otherwise(0)).cast("bigint") for m in MASKS])
    return counts.groupBy("part").agg(sums(F.lit(True)).alias("n"), sums(F.col("good")).alias("good"), sums(F.col("toxic")).alias("toxic"))


def _over(counts: str, holds: Callable[[Column], Column], times: Callable[[Column], Column] = lambda m: F.lit(1)) -> Column:
    """The sum of those counts whose set of failures holds."""
    none = F.lit(0).cast("bigint")
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(MASKS) - 1)), none, lambda total, m: total + F.when(holds(m), F.get(F.col(counts), m) * times(m)).otherwise(none))


def audit_orders(counts: DataFrame) -> DataFrame:
    """Each part's counts for all 120 orders and 5 steps; see ``audit_filters``."""
    steps = counts.select("*", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    before = F.aggregate(F.split(F.substring("filter_order", F.lit(1), F.col("step") - 1), ""), F.lit(0), lambda bits, x: bits + F.when(x == "", 0).otherwise(_bit(x)))
    steps = steps.select("*", _bit(letter).alias("bit"), before.alias("before"))
    own, earlier = F.col("bit"), F.col("before")
    here = lambda m: (m.bitwiseAND(earlier) == 0) & (m.bitwiseAND(own) != 0)
    # of the filters that a document fails, each comes first in an equal share of all orders
    firsts = F.array(*[F.lit(len(ORDERS) // max(1, m.bit_count())).cast("bigint") for m in MASKS])
    shapley = _over("n", lambda m: m.bitwiseAND(own) != 0, lambda m: F.get(firsts, m))
    return steps.select(
        "part",
        "filter_order",
        "step",
        _over("n", lambda m: m.bitwiseAND(earlier.bitwiseOR(own)) == 0).alias("kept"),
        _over("n", here).alias("removed"),
        _over("n", lambda m: (m.bitwiseAND(earlier) != 0) & (m.bitwiseAND(own) != 0)).alias("redundant"),
        _over("n", lambda m: m == own).alias("unique_fails"),
        _over("good", here).alias("good_lost"),
        _over("toxic", here).alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def _bit(letter: Column) -> Column:
    """1 << the letter's place among the filters."""
    return F.get(F.array(*[F.lit(1 << k) for k in range(len(LETTERS))]), F.instr(F.lit(LETTERS), letter) - 1)


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """For each part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Documents are judged once (see ``failures``, also for nulls, ties and
    repeated rows); 32 conditional counts a part hold all that the orders need.
    Counts are rows of ``docs``. Further columns are ignored; an empty table
    gives an empty result; a label without a document counts nowhere.
    """
    return audit_orders(mask_counts(failures(docs, labels, id_col, text_col, part_col)))


#: Whole words of whole texts, as the operator takes them, then every order played out.
ORACLE = """
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
marks AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
failing AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         [len(words) < 200,
          100 * len(list_distinct(words)) < 50 * len(words),
          100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
          regexp_matches(t, '[#$%&*|]'),
          coalesce(texts.doc_id > min(texts.doc_id) OVER (PARTITION BY t), false)] AS f
  FROM texts LEFT JOIN marks ON texts.doc_id = marks.doc_id),
sets AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failing GROUP BY part, f),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 3, 4, 5]) AS place),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.place, b.place, c.place, d.place, e.place] AS places
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, places, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
played AS (
  SELECT part, filter_order, step, places[step] AS place, n, good, toxic,
         f[places[step]] AS fails,
         len(list_filter(places[1:step - 1], lambda p: f[p])) > 0 AS gone,
         len(list_filter([1, 2, 3, 4, 5], lambda p: f[p])) = 1 AS once
  FROM sets, steps),
summed AS (
  SELECT part, filter_order, step, place,
         coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (NOT gone AND fails), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (gone AND fails), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (fails AND once), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (NOT gone AND fails), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (NOT gone AND fails), 0)::BIGINT AS toxic_lost
  FROM played GROUP BY part, filter_order, step, place)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, place))::BIGINT AS shapley
FROM summed"""
