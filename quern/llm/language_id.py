"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts of up to three bytes, learned once
and frozen. The probability of a byte comes from the longest context known to
the language: n / (total + kinds) for a byte seen there, otherwise the escape
kinds / (total + kinds) times the probability in the context without its
oldest byte; below the empty context every byte has 1/256. A text's code length
under a language is exact: the sum over all its bytes. The shortest code wins.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import remainder
from quern.llm.textkit import blocks, text_bytes

ORDER = 3


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, each text after ORDER zero bytes, and where each text's own bytes begin."""
    n = len(offsets) - 1
    out = np.zeros(len(data) + ORDER * n, np.uint8)
    begin = offsets[:-1] + ORDER * np.arange(1, n + 1)
    own = np.arange(len(data)) + np.repeat(ORDER * np.arange(1, n + 1), np.diff(offsets))
    out[own] = data
    return out, begin


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each byte, its three bytes of context and itself, as one 32-bit number."""
    text, begin = padded(data, offsets)
    wide = text.astype(np.uint32)
    code = wide.copy()
    for k in range(1, ORDER + 1):
        code[k:] |= wide[:-k] << np.uint32(8 * k)
    own = np.arange(len(data)) + np.repeat(ORDER * np.arange(1, len(offsets)), np.diff(offsets))
    return code[own]


def count_grams(labelled: DataFrame) -> DataFrame:
    """lang, gram, n over rows of (lang, text); counts are folded in each batch before they are shuffled."""

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            data, offsets = text_bytes(frame.column("text"))
            langs = np.array(frame.column("lang").to_pylist(), object)
            for first, last in blocks(offsets):
                for lang in set(langs[first:last]):
                    rows = np.flatnonzero(langs[first:last] == lang) + first
                    codes = [grams(data[offsets[r] : offsets[r + 1]], np.array([0, offsets[r + 1] - offsets[r]])) for r in rows]
                    gram, n = np.unique(np.concatenate(codes), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(gram), pa.string()), "gram": pa.array(gram.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    return labelled.mapInArrow(batches, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Frozen code lengths in bits: cost[state, symbol, language], and the state of each context.

    Symbols are the bytes seen in training, and one for all others. A state is a
    context of three, two or one symbols: the longest that any language knows.
    """

    def __init__(self, langs: list[str], gram: np.ndarray, n: np.ndarray):
        """gram: the 32-bit numbers; n: counts, a row per gram and a column per language."""
        self.langs = langs
        seen = np.unique(gram & 0xFF)
        self.symbol = np.full(256, len(seen), np.int64)
        self.symbol[seen] = np.arange(len(seen))
        # The zero byte that stands before a text is a symbol of contexts only.
        size = self.size = len(seen) + 2
        context = self.symbol.copy()
        context[0] = self.symbol[0] if 0 in seen else len(seen) + 1
        self.context = context
        parts = [context[(gram >> (8 * k)) & 0xFF] for k in (3, 2, 1)]
        sym = self.symbol[gram & 0xFF]
        width = len(seen) + 1

        def table(ids: np.ndarray, rows: int, lang: int) -> tuple[np.ndarray, np.ndarray]:
            """Probability of a symbol seen in a context (0 if not), and the context's escape (1 if unknown)."""
            c = np.zeros((rows, width))
            np.add.at(c, (ids, sym), n[:, lang])
            total, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
            whole = np.maximum(total + kinds, 1)
            return c / whole, np.where(total > 0, kinds / whole, 1.0)

        three = (parts[0] * size + parts[1]) * size + parts[2]
        two = parts[1] * size + parts[2]
        known3, at3 = np.unique(three, return_inverse=True)
        known2, at2 = np.unique(two, return_inverse=True)
        n3, n2 = len(known3), len(known2)
        # States in this order: size single contexts, the known twos, the known threes.
        state2 = np.arange(size * size) % size
        state2[known2] = size + np.arange(n2)
        self.state = np.tile(state2, size).astype(np.int32)
        self.state[known3] = size + n2 + np.arange(n3)
        self.cost = np.empty((size + n2 + n3, width, len(langs)), np.float32)
        for k in range(len(langs)):
            p0, e0 = table(np.zeros(len(gram), np.int64), 1, k)
            base = np.full((1, width), 1 / 256)
            p0 = np.where(p0 > 0, p0, e0 * base)
            p1, e1 = table(parts[2], size, k)
            p1 = np.where(p1 > 0, p1, e1 * p0)
            p2, e2 = table(at2, n2, k)
            p2 = np.where(p2 > 0, p2, e2 * p1[known2 % size])
            p3, e3 = table(at3, n3, k)
            p3 = np.where(p3 > 0, p3, e3 * p2[np.searchsorted(known2, known3 % (size * size))])
            self.cost[:, :, k] = -np.log2(np.concatenate([p1, p2, p3]))

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        flat = self.cost.reshape(-1, len(self.langs))
        for first, last in blocks(offsets, 1 << 20):
            at = offsets[first : last + 1] - offsets[first]
            own = data[offsets[first] : offsets[last]]
            # A text longer than a block is summed in runs that share their contexts.
            text, begin = padded(own, at)
            ctx = self.context[text]
            place = np.arange(len(own)) + np.repeat(ORDER * np.arange(1, last - first + 1), np.diff(at))
            for lo in range(0, len(own), 1 << 20):
                p = place[lo : lo + (1 << 20)]
                state = self.state[(ctx[p - 3] * self.size + ctx[p - 2]) * self.size + ctx[p - 1]]
                bits = flat[state.astype(np.int64) * self.cost.shape[1] + self.symbol[text[p]]]
                owner = np.searchsorted(at, np.arange(lo, lo + len(p)), "right") - 1
                cut = np.flatnonzero(np.diff(owner, prepend=-1))
                out[first + owner[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.float64)
        return out


def training_rows(docs: DataFrame, most_rows: int, lang_col: str, text_col: str, id_col: str) -> DataFrame:
    """(lang, text) of the rows that may be learned from, about ``most_rows`` a language at most.

    A language's share is chosen by a hash of the id against most_rows / rows of
    the language, so no language's rows meet in one task.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (remainder(id_col, 4) != 2))
    rows = rows.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    size = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    if not size:
        return rows.select("lang", "text")
    share = F.create_map(*[F.lit(x) for lang, n in sorted(size.items()) for x in (lang, min(1.0, most_rows / n))])
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1_000_003)) / 1_000_003
    return rows.where(draw < F.element_at(share, F.col("lang"))).select("lang", "text")


def fit(docs: DataFrame, most_rows: int = 3000, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> Model | None:
    """The model of all languages found among the rows to learn from; None if there are none.

    The driver gets one number for each (language, gram): bounded by
    ``most_rows`` texts a language, whatever the size of the corpus.
    """
    learned = count_grams(training_rows(docs, most_rows, lang_col, text_col, id_col)).toPandas()
    if learned.empty:
        return None
    langs = sorted(learned["lang"].unique())
    gram, row = np.unique(learned["gram"].to_numpy(np.int64), return_inverse=True)
    n = np.zeros((len(gram), len(langs)))
    n[row, learned["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy()] = learned["n"].to_numpy()
    return Model(langs, gram, n)


_ready: dict[str, Model] = {}


def identify_languages(docs: DataFrame, most_rows: int = 3000, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, bits_per_byte.

    Learns from rows whose language is not null and whose crc32(id) mod 4 is not
    2, from about ``most_rows`` whole texts of each language at most. The
    language, source and id of a row are not used to predict it. score is the
    winner's posterior under equal priors. A text that is null or has no letter
    is ``und`` with score 0, and so is every text if there was nothing to learn
    from. Equal code lengths go to the first language by name. Repeated rows get
    equal results; further columns are ignored; an empty table gives an empty
    result.
    """
    model = fit(docs, most_rows, lang_col, text_col, id_col)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), (remainder(id_col, 4) == 2).alias("held_out"), F.when(text.rlike(r"\p{L}"), text).alias("text"))
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, lang_pred string, score double, bits_per_byte double"
    if model is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    name = uuid.uuid4().hex  # tells this model from those that a worker has kept
    shipped = docs.sparkSession.sparkContext.broadcast((model.langs, model.symbol, model.context, model.size, model.state, model.cost))

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _ready:
            _ready.clear()
            m = Model.__new__(Model)
            m.langs, m.symbol, m.context, m.size, m.state, m.cost = shipped.value
            _ready[name] = m
        m = _ready[name]
        names = np.array(m.langs, object)
        for frame in frames:
            data, offsets = text_bytes(frame.column("text"))
            bits, size = m.code_lengths(data, offsets), np.diff(offsets)
            best = bits.argmin(1)
            least = bits[np.arange(len(best)), best]
            some = size > 0
            score = np.where(some, 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1), 0.0)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": frame.column("doc_id"),
                    "held_out": frame.column("held_out"),
                    "lang_pred": pa.array(np.where(some, names[best], "und"), pa.string()),
                    "score": pa.array(score),
                    "bits_per_byte": pa.array(np.where(some, least / np.maximum(size, 1), 0.0), mask=~some),
                }
            )

    return rows.mapInArrow(batches, schema)
