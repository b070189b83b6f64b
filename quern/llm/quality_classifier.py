"""A quality classifier by co-training: text and metadata teach each other.

Two views of a document, the words of its text and its metadata (source,
language, length), each have a naive Bayes classifier on hashed features. Both
start from labelled rows. In each round, a view's classifier labels the rows
without a label that it is sure of, and these train the other view. Scores are
calibrated on labelled rows kept aside, so "sure" is a probability; the final
score adds the two views' calibrated log odds.

Every pass reads the whole documents where they lie and shuffles only counts of
features, of which there is a fixed number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import remainder
from quern.llm.textkit import U64, blocks, text_bytes, word_hashes

WORDS = 32_768
META = 512
BINS, REACH = 400, 20.0
VIEWS = ("text", "meta")


@dataclass
class Views:
    """Weights of each view's features (log odds), and slope and offset of its calibration."""

    weight: dict[str, np.ndarray] = field(default_factory=lambda: {"text": np.zeros(WORDS), "meta": np.zeros(META)})
    line: dict[str, tuple[float, float]] = field(default_factory=lambda: dict.fromkeys(VIEWS, (1.0, 0.0)))
    prior: float = 0.0

    def log_odds(self, view: str, raw: np.ndarray) -> np.ndarray:
        a, b = self.line[view]
        return np.clip(a * raw + b, -30, 30)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _meta_features(frame: pa.RecordBatch) -> np.ndarray:
    """Three features of each row: source, language, doublings of the length."""
    named = lambda name, size: np.array([zlib.crc32(str(x).encode()) % size if x is not None else size for x in frame.column(name).to_pylist()])
    length = np.log2(np.maximum(np.array(frame.column("n_chars").fill_null(0), float), 1)).astype(int)
    return np.stack([named("source", 300), 310 + named("lang", 100), 420 + np.minimum(2 * length, 60)], 1)


def _word_features(frame: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """first, last, then owner and feature of each different word feature of the texts between."""
    data, offsets = text_bytes(frame.column("text"))
    for first, last in blocks(offsets, 4 << 20):
        word, at = word_hashes(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        owner = np.repeat(np.arange(last - first), np.diff(at))
        both = np.unique(owner * WORDS + (word % U64(WORDS)).astype(np.int64))
        yield first, last, both // WORDS, both % WORDS


def _raw_scores(views: Views, m: int, owner: np.ndarray, feature: np.ndarray, meta: np.ndarray) -> dict[str, np.ndarray]:
    text = np.bincount(owner, views.weight["text"][feature], m) / np.sqrt(np.maximum(np.bincount(owner, minlength=m), 1))
    return {"text": np.clip(text, -REACH, REACH), "meta": np.clip(views.weight["meta"][meta].sum(1), -REACH, REACH)}


def _labels(frame: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The label to train with, -1 for none, and whether the row is kept aside for calibration."""
    return np.array(frame.column("label").fill_null(-1)), np.array(frame.column("aside").fill_null(False), bool)


def _count_features(rows: DataFrame, views: Views | None, sure: float) -> dict[str, np.ndarray]:
    """Of each view, how many rows of each label have each feature: an array of 2 x features.

    With ``views``, a row without a label counts for a view if the other view is sure of it.
    """
    shipped = rows.sparkSession.sparkContext.broadcast(views)

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        total = {"text": np.zeros((2, WORDS), np.int64), "meta": np.zeros((2, META), np.int64)}
        for frame in frames:
            label, aside = _labels(frame)
            meta = _meta_features(frame)
            for first, last, owner, feature in _word_features(frame):
                m, own = last - first, meta[first:last]
                use = dict.fromkeys(VIEWS, np.where(aside[first:last], -1, label[first:last]))
                if known is not None:
                    raw = _raw_scores(known, m, owner, feature, own)
                    for view, other in (("text", "meta"), ("meta", "text")):
                        p = _sigmoid(known.log_odds(other, raw[other]))
                        guess = np.where(p >= sure, 1, np.where(p <= 1 - sure, 0, -1))
                        use[view] = np.where((use[view] < 0) & ~aside[first:last], guess, use[view])
                for y in (0, 1):
                    total["text"][y] += np.bincount(feature[use["text"][owner] == y], minlength=WORDS)
                    total["meta"][y] += np.bincount(own[use["meta"] == y].ravel(), minlength=META)
        for view, n in total.items():
            y, f = np.nonzero(n)
            yield pa.RecordBatch.from_pydict({"view": pa.array([view] * len(y), pa.string()), "label": pa.array(y, pa.int64()), "feature": pa.array(f, pa.int64()), "n": pa.array(n[y, f], pa.int64())})

    counted = rows.mapInArrow(batches, "view string, label bigint, feature bigint, n bigint").groupBy("view", "label", "feature").agg(F.sum("n").alias("n")).toPandas()
    out = {"text": np.zeros((2, WORDS)), "meta": np.zeros((2, META))}
    for view, part in counted.groupby("view"):
        out[view][part["label"].to_numpy(), part["feature"].to_numpy()] = part["n"].to_numpy()
    return out


def _bayes(n: np.ndarray) -> np.ndarray:
    if not n.sum(1).all():
        return np.zeros(n.shape[1])
    p = np.log((n + 1) / (n.sum(1, keepdims=True) + n.shape[1]))
    return p[1] - p[0]


def _histograms(labelled: DataFrame, views: Views) -> dict[str, np.ndarray]:
    """Of each view, the raw scores of the rows kept aside: an array of 2 x BINS."""
    shipped = labelled.sparkSession.sparkContext.broadcast(views)

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        for frame in frames:
            label, _ = _labels(frame)
            meta = _meta_features(frame)
            for first, last, owner, feature in _word_features(frame):
                raw = _raw_scores(known, last - first, owner, feature, meta[first:last])
                for view in VIEWS:
                    cell = np.minimum(((raw[view] + REACH) * BINS / (2 * REACH)).astype(int), BINS - 1)
                    both, n = np.unique(label[first:last] * BINS + cell, return_counts=True)
                    yield pa.RecordBatch.from_pydict({"view": pa.array([view] * len(n), pa.string()), "cell": pa.array(both, pa.int64()), "n": pa.array(n, pa.int64())})

    counted = labelled.mapInArrow(batches, "view string, cell bigint, n bigint").groupBy("view", "cell").agg(F.sum("n").alias("n")).toPandas()
    out = {view: np.zeros(2 * BINS) for view in VIEWS}
    for view, part in counted.groupby("view"):
        out[view][part["cell"].to_numpy()] = part["n"].to_numpy()
    return {view: n.reshape(2, BINS) for view, n in out.items()}


def platt_line(histogram: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve through scores of two labels, with Platt's softened targets."""
    n0, n1 = histogram.sum(1)
    if not n0 or not n1:
        return 0.0, float(np.log((n1 + 1) / (n0 + 1)))
    x = (np.arange(BINS) + 0.5) * 2 * REACH / BINS - REACH
    t = np.array([1 / (n0 + 2), (n1 + 1) / (n1 + 2)])
    a, b = 0.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(steps):
        p = _sigmoid(a * x + b)
        g = (histogram * (p - t[:, None])).sum(0)
        h = histogram.sum(0) * p * (1 - p)
        ga, gb = (g * x).sum() + 1e-3 * a, g.sum()
        haa, hab, hbb = (h * x * x).sum() + 1e-3, (h * x).sum(), h.sum() + 1e-9
        det = haa * hbb - hab * hab
        if det <= 0:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
        if abs(da) + abs(db) < 1e-9:
            break
    return float(max(a, 0.0)), float(b)


def _labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, most_labelled: int) -> DataFrame:
    """doc_id, label, aside: at most about ``most_labelled`` rows, chosen by a hash; every fifth is kept aside."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg((F.min(label_col) > 0).cast("bigint").alias("label"))
    n = known.count()
    if n > most_labelled:
        known = known.where(F.pmod(F.xxhash64(F.lit("quality"), "__id"), F.lit(1_000_003)) < int(1_000_003 * most_labelled / n))
    return known.withColumn("aside", remainder("__id", 5) == 0)


def co_train(rows: DataFrame, rounds: int, sure: float) -> Views:
    """The views after ``rounds`` exchanges; rows: text, source, lang, n_chars, label, aside."""
    held = rows.where("aside")
    views = None
    for _ in range(rounds + 1):
        counts = _count_features(rows if views is not None else rows.where("label is not null"), views, sure)
        views = Views({view: _bayes(n) for view, n in counts.items()})
        seen = _histograms(held, views)
        views.line = {view: platt_line(n) for view, n in seen.items()}
        n0, n1 = seen["text"].sum(1)
        views.prior = float(np.log((n1 + 1) / (n0 + 1)))
    return views


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rounds: int = 2, sure: float = 0.97, most_labelled: int = 20_000) -> DataFrame:
    """One row per input row: doc_id, text_score, meta_score, score, good.

    Scores are calibrated probabilities that the quality label is 1; score adds
    the views' log odds, less the prior's; good is score >= 1/2. Learns from at
    most about ``most_labelled`` rows of ``labels`` (a bounded sample, so it is
    broadcast to the documents), and from all documents without a label there.

    A null text has no words and a null source, language or length is a value of
    its own; both then speak by the prior. Labels of unknown ids, null labels
    and repeated labels (the lowest counts) do no harm; with labels of one kind
    only, all scores are the prior's. Repeated rows get equal scores. Further
    columns are ignored; an empty table gives an empty result.
    """
    known = _labelled_rows(docs, labels, id_col, label_col, most_labelled)
    n_chars = F.col("n_chars").cast("bigint") if "n_chars" in docs.columns else F.length(F.col(text_col)).cast("bigint")
    named = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), named("source").alias("source"), named("lang").alias("lang"), n_chars.alias("n_chars"))
    rows = rows.join(F.broadcast(known), rows["doc_id"] == known["__id"], "left").drop("__id")
    views = co_train(rows, rounds, sure)
    shipped = docs.sparkSession.sparkContext.broadcast(views)

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        for frame in frames:
            meta = _meta_features(frame)
            for first, last, owner, feature in _word_features(frame):
                raw = _raw_scores(known, last - first, owner, feature, meta[first:last])
                text, other = (known.log_odds(view, raw[view]) for view in VIEWS)
                score = _sigmoid(text + other - known.prior)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": frame.column("doc_id").slice(first, last - first), "text_score": pa.array(_sigmoid(text)), "meta_score": pa.array(_sigmoid(other)), "score": pa.array(score), "good": pa.array(score >= 0.5)}
                )

    return rows.mapInArrow(batches, f"doc_id {docs.schema[id_col].dataType.simpleString()}, text_score double, meta_score double, score double, good boolean")
