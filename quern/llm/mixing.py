"""Mixing to target weights with soft membership.

A classifier learned from a labelled table gives each document a posterior over
domains. Rates x >= 0 for the documents are then fitted by projected gradient so
that the expected tokens of each domain, the sum of x * posterior * tokens, come
to the targets in least squares.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut_lineage, whole_text, words

#: Features a word is hashed to; the classifier's table has this many rows, whatever the corpus.
FEATURES = 32_768
#: Documents whose posteriors round to the same parts share a cell when rates are fitted; a cell keeps their mean.
PARTS = 256
#: Tasks that read the cells in each round.
CELL_TASKS = 16
#: Labelled rows that are learned from, about and at most.
MOST_ROWS = 20_000
#: Texts are dealt to so many folds; a text is scored by weights learned from the labels of the other folds.
FOLDS = 4


def fold_of(text_col: str = "text") -> Column:
    """The fold of a text, by its hash: equal texts share theirs, so a copy does not give a label away."""
    return F.pmod(F.xxhash64(F.lit("fold"), whole_text(text_col)), F.lit(FOLDS)).cast("int")


def word_features(docs: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """A row for each word: the columns to keep, and its hashed feature."""
    lower = F.lower(whole_text(text_col))
    return docs.select(*keep, F.explode(words(lower)).alias("__word")).select(*keep, F.pmod(F.xxhash64("__word"), F.lit(FEATURES)).cast("int").alias("feature"))


def fit_domains(labelled: DataFrame, domains: list[str], text_col: str = "text", domain_col: str = "domain") -> DataFrame:
    """feature, w (an array): log p(feature | domain) for the domains in their order, for each fold in turn.

    The numbers of a fold are learned from the labelled rows of all other folds,
    so no row is scored by what its own label taught.

    A domain's counts are smoothed by ``FEATURES`` words of the background, the
    mixture of all labelled rows. Words that a small domain never saw then speak
    neither for it nor against it.

    All rows given are learned from (``labelled_domains`` bounds them). The
    result has ``FEATURES`` rows and one more, feature -1, with the log priors. A
    domain without labels has the prior zero, so no text is of it; if no domain
    has any, all are alike. Null labels are left out.
    """
    rows = labelled.where(F.col(domain_col).isin(domains)).select(F.col(text_col).alias("text"), F.col(domain_col).alias("domain"))
    k, folds = range(len(domains)), range(FOLDS)
    rows = cut_lineage(rows.withColumn("fold", fold_of()))
    # Of each fold, the rows of the others.
    count_of = [F.sum(((F.col("domain") == domains[i]) & (F.col("fold") != f)).cast("bigint")).alias(f"n{f}_{i}") for f in folds for i in k]
    counted = cut_lineage(word_features(rows, "text", "domain", "fold").groupBy("feature").agg(*count_of))
    every = rows.sparkSession.range(FEATURES).select(F.col("id").cast("int").alias("feature"))
    total = counted.agg(*[F.coalesce(F.sum(f"n{f}_{i}"), F.lit(0)).alias(f"t{f}_{i}") for f in folds for i in k]).first()
    size = rows.agg(*[F.coalesce(c, F.lit(0)).alias(f"n{n}") for n, c in enumerate(count_of)]).first()
    weights, priors = [], []
    for f in folds:
        seen = [F.coalesce(F.col(f"n{f}_{i}"), F.lit(0)) for i in k]
        every_word = sum(total[f"t{f}_{i}"] for i in k)
        background = (sum(seen, F.lit(1)) / float(every_word + FEATURES)).cast("double")
        weights += [F.log((seen[i] + FEATURES * background) / float(total[f"t{f}_{i}"] + FEATURES)) for i in k]
        labels = [size[f"n{f * len(domains) + i}"] for i in k]
        priors += [F.lit(math.log((n + 1.0) / (sum(labels) + len(domains))) if n or not any(labels) else -math.inf) for n in labels]
    table = every.join(counted, "feature", "left").select("feature", F.array(*weights).alias("w"))
    return table.unionByName(rows.sparkSession.range(1).select(F.lit(-1).alias("feature"), F.array(*priors).alias("w")))


def domain_posteriors(docs: DataFrame, weights: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, n_tokens and p0, p1, ...: the posterior, as doubles that sum to one.

    A document's log likelihood is the sum over its words, divided by the fourth
    root of their number: words of one text are not independent, and the plain
    sum would make nearly every posterior 0 or 1. A text without words has the
    priors.
    """
    k = range(len(domains))
    weights = cut_lineage(weights)
    prior = weights.where("feature = -1").first()["w"]
    numbered = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id()).withColumn("fold", fold_of())
    # The table of features has FEATURES rows of a few numbers, whatever the input.
    one = F.when(F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.array(F.lit(None).cast("string"))).otherwise(words(F.lower("text")))
    exploded = numbered.select("row", "doc_id", "fold", F.explode(one).alias("__word"))
    feature = F.when(F.col("__word").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("__word"), F.lit(FEATURES)).cast("int"))
    met = exploded.select("row", "doc_id", "fold", feature.alias("feature")).join(F.broadcast(weights), "feature")
    own = lambda i: F.get("w", F.col("fold") * len(domains) + i)
    summed = met.groupBy("row", "doc_id", "fold").agg(
        F.sum((F.col("feature") >= 0).cast("bigint")).alias("n_tokens"),
        *[F.sum(F.when(F.col("feature") >= 0, own(i)).otherwise(F.lit(0.0))).alias(f"s{i}") for i in k],
    )
    root = F.sqrt(F.sqrt(F.greatest(F.col("n_tokens"), F.lit(1)).cast("double")))
    scored = summed.select("row", "doc_id", "n_tokens", *[(F.get(F.array(*[F.lit(prior[f * len(domains) + i]) for f in range(FOLDS)]), F.col("fold")) + F.col(f"s{i}") / root).alias(f"s{i}") for i in k])
    top = F.greatest(*[F.col(f"s{i}") for i in k]) if len(domains) > 1 else F.col("s0")
    scored = scored.withColumn("top", top).select("row", "doc_id", "n_tokens", *[F.exp(F.col(f"s{i}") - F.col("top")).alias(f"e{i}") for i in k])
    total = sum((F.col(f"e{i}") for i in k), F.lit(0.0))
    return scored.select("row", "doc_id", "n_tokens", *[(F.col(f"e{i}") / total).alias(f"p{i}") for i in k])


def rate_of(steps: list[list[float]], domains: list[str], most: float | None) -> Column:
    """The rate that the recorded gradient steps lead to from 1, projected after each."""
    parts = F.array(*[F.col(f"p{i}") for i in range(len(domains))])
    rate = F.lit(1.0)
    taken = F.array(*[F.array(*[F.lit(float(g)) for g in step]) for step in steps]) if steps else F.array().cast("array<array<double>>")
    moved = lambda x, g: x - F.aggregate(F.zip_with(g, parts, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    kept = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(float(most))) if most is not None else F.greatest(x, F.lit(0.0))
    return F.aggregate(taken, rate, lambda x, g: kept(moved(x, g)))


def domain_mass(rows: DataFrame, domains: list[str], rate: Column | None = None) -> list[float]:
    """Expected tokens of each domain at the given rates (one, if none): K sums to the driver."""
    x = F.lit(1.0) if rate is None else rate
    sums = rows.agg(*[F.coalesce(F.sum(x * F.col("n_tokens") * F.col(f"p{i}")), F.lit(0.0)).alias(f"t{i}") for i in range(len(domains))])
    return list(sums.first())


def fit_rates(posteriors: DataFrame, targets: Mapping[str, float], domains: list[str], rounds: int = 60, most: float | None = None) -> list[list[float]]:
    """Gradient steps, one number for each domain and round, for ``rate_of``.

    ``targets``: tokens wanted of each domain. Documents whose posteriors round
    to the same ``PARTS``-ths are one cell, with their tokens and their mean
    posterior, so a cell's expected tokens are exact whatever its rate; the
    cells are summed once by a shuffle, and each round is an aggregation of them
    whose K sums go to the driver. Distances to the targets are taken relative
    to the domains' tokens at rate one, and a document's step is not scaled by
    its own tokens; in that metric the gradient's largest slope is one, so steps
    of length one converge; rounds end when targets are met or the distances
    stand still. A domain without any posterior is left out.
    """
    k = range(len(domains))
    cell = [F.round(F.col(f"p{i}") * PARTS).cast("int").alias(f"c{i}") for i in k]
    tokens = F.sum("n_tokens").cast("double")
    cells = cut_lineage(posteriors.where("n_tokens > 0").groupBy(*cell).agg(tokens.alias("n_tokens"), *[(F.sum(F.col("n_tokens") * F.col(f"p{i}")) / tokens).alias(f"p{i}") for i in k]).coalesce(CELL_TASKS))
    mass = domain_mass(cells, domains)
    if not sum(mass):
        return []
    wanted = [float(targets[d]) for d in domains]
    steps: list[list[float]] = []
    for _ in range(rounds):
        now = domain_mass(cells, domains, rate_of(steps, domains, most))
        off = [round((now[i] - wanted[i]) / mass[i], 12) if mass[i] else 0.0 for i in k]
        still = bool(steps) and max(abs(a - b) for a, b in zip(off, steps[-1], strict=True)) < 1e-6
        if max(map(abs, off)) < 1e-5 or still:
            break
        steps.append(off)
    return steps


def reachable_targets(posteriors: DataFrame, weights: Mapping[str, float], most: float) -> dict[str, float]:
    """Targets that rates up to ``most`` can reach, domain by domain.

    The domain of the largest weight gets all it has; the others get their share
    beside it, or all they have if that is less. A scarce domain so bounds its
    own target only, not the mixture.
    """
    domains = list(weights)
    mass = dict(zip(domains, domain_mass(posteriors, domains), strict=True))
    main = max(domains, key=lambda d: (weights[d], d))
    total = mass[main] / weights[main]
    return {d: most * min(total * weights[d], mass[d]) for d in domains}


def mix_documents(docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", total_tokens: float | None = None, rounds: int = 60, most_rate: float | None = None, seed: int = 7) -> DataFrame:
    """One row per input row: doc_id, n_tokens, posterior (map), rate, copies, target (map).

    ``weights``: the share of tokens wanted of each domain; they are scaled to
    sum to one and times ``total_tokens``. If that is None, it is the corpus's
    own number of tokens, or, if ``most_rate`` bounds the rates, targets are the
    ``reachable_targets``. ``target`` holds the tokens that were
    aimed at, ``expected_mixture`` what the rates lead to. ``copies`` is the rate
    rounded down or up by a seeded hash of the id, so its mean is the rate.

    No task holds more than its share: features are summed map-side, rows are
    told apart by number, posteriors are folded into cells. A null or empty text
    has no tokens and the posterior of the priors; null labels and labels beyond
    ``weights`` are not learned from; repeated rows get equal rates, and equal
    copies if their ids are equal; further columns are ignored; an empty table
    gives an empty result.
    """
    domains = list(weights)
    posteriors = cut_lineage(domain_posteriors(docs, fit_domains(labelled, domains, text_col, domain_col), domains, id_col, text_col))
    whole = float(sum(weights.values()))
    if total_tokens is None and most_rate is not None:
        targets = reachable_targets(posteriors, weights, most_rate)
    else:
        tokens = total_tokens if total_tokens is not None else float(posteriors.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0])
        targets = {d: tokens * w / whole for d, w in weights.items()}
    steps = fit_rates(posteriors, targets, domains, rounds, most_rate)
    draw = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_003)) + 0.5) / 1_000_003
    named = lambda values: F.map_from_arrays(F.array(*[F.lit(d) for d in domains]), F.array(*values))
    rated = posteriors.withColumn("rate", F.round(rate_of(steps, domains, most_rate), 6))
    return rated.select("doc_id", "n_tokens", named([F.col(f"p{i}") for i in range(len(domains))]).alias("posterior"), "rate", F.floor(F.col("rate") + draw).cast("bigint").alias("copies"), named([F.lit(targets[d]) for d in domains]).alias("target"))


def expected_mixture(mixed: DataFrame) -> DataFrame:
    """domain, target, expected, off: what the rates of ``mix_documents`` lead to, and its distance from the target as a share of all targets."""
    whole = F.aggregate(F.map_values("target"), F.lit(0.0), lambda a, b: a + b).alias("whole")
    pairs = F.map_entries(F.map_zip_with("target", "posterior", lambda _, t, p: F.struct(t.alias("t"), p.alias("p"))))
    each = mixed.select("n_tokens", "rate", whole, F.explode(pairs).alias("e"))
    sums = each.groupBy(F.col("e.key").alias("domain")).agg(F.max("whole").alias("whole"), F.max("e.value.t").alias("target"), F.sum(F.col("rate") * F.col("n_tokens") * F.col("e.value.p")).alias("expected"))
    return sums.select("domain", "target", "expected", F.try_divide(F.col("expected") - F.col("target"), "whole").alias("off"))


def take_mixture(docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float], id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with each row as often as its copies, with all its columns; rows of one id share their copies."""
    mixed = mix_documents(docs, labelled, weights, id_col, **options).where("copies > 0")
    mixed = mixed.groupBy(F.col("doc_id").alias("__mixed_id")).agg(F.max("copies").alias("__copies"))
    out = docs.join(mixed, docs[id_col].eqNullSafe(mixed["__mixed_id"]))
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "__copies"))).select(*[docs[c] for c in docs.columns])


def labelled_domains(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """text and domain of the documents in the table of labels: ``toxic``, ``low`` or ``clean``.

    Of the labels about ``most_rows`` at most are taken, chosen by a hash of the
    id, before they meet the documents; so they are sent to the documents, and no
    text is shuffled. A document labelled more than once is toxic if any label
    says so, then low; rows without id, or with neither label, are left out. Ids
    that documents repeat give a row for each.
    """
    domain = F.when(F.max("toxic") == 1, "toxic").when(F.min("quality") == 0, "low").when(F.min("quality") == 1, "clean")
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(domain.alias("domain")).where("domain is not null")
    said = cut_lineage(said.withColumn("__draw", F.pmod(F.xxhash64(F.lit("mixing"), "doc_id"), F.lit(1_000_003))))
    n = said.count()
    if n > most_rows:
        said = said.where(F.col("__draw") < int(1_000_003 * most_rows / n))
    return docs.select("doc_id", "text").join(F.broadcast(said.select("doc_id", "domain")), "doc_id").select("text", "domain")
