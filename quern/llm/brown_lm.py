"""Scores of texts under a Brown class-based bigram model.

p(word | word before) = p(class | class before) * p(word | class). Classes are
learned by exchange over all texts that may be learned from:

1. The ``exchanged_words`` most frequent words, a stated number, are placed in
   tiers of falling frequency and then moved in rounds, each to the class that
   raises the likelihood of the corpus's class bigrams most. Their bigrams are
   counted once by a shuffle; a round reads that table without another, and what
   words move together is taken back if the likelihood falls.
2. Every other word found twice or more takes one such step: it goes to the class
   that its neighbours are likeliest around, by a shuffle on words.
3. Words found once have nothing to be told apart by. They are a class of their
   own, which stands for unseen words as well.

A vocabulary grows with the corpus, so it is never broadcast whole: tasks get the
``hot_words`` most frequent words with their classes and counts, and each other
word of a text meets its class and count in a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut_lineage, remainder
from quern.llm.textkit import U64, blocks, mix, text_bytes, word_hashes

#: The end of a text, as a word that no text can hold.
END = U64(0x5EED_0F_E2D)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and its end, and the n+1 offsets."""
    word, at = word_hashes(data, offsets)
    n = len(offsets) - 1
    out = np.empty(len(word) + n, U64)
    ends = at[1:] + np.arange(n)
    is_end = np.zeros(len(out), bool)
    is_end[ends] = True
    out[is_end] = END
    out[~is_end] = word
    return out, at + np.arange(n + 1)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def token_runs(frames: Iterator[pa.RecordBatch], most: int = 1 << 22) -> Iterator[np.ndarray]:
    """The tokens of a task's texts, one text after another, in runs of about ``most``; a text is never cut."""
    held, n = [], 0
    for frame in frames:
        data, offsets = text_bytes(frame.column("text"))
        for first, last in blocks(offsets):
            token, _ = tokens(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            held.append(token)
            n += len(token)
            if n >= most:
                yield np.concatenate(held)
                held, n = [], 0
    if held:
        yield np.concatenate(held)


def count_words(texts: DataFrame) -> DataFrame:
    """word (a 64-bit hash, signed), n over rows of (text); folded in each task before the shuffle."""

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token in token_runs(frames):
            word, n = np.unique(token, return_counts=True)
            yield pa.RecordBatch.from_pydict({"word": _signed(word), "n": pa.array(n.astype(np.int64))})

    return texts.mapInArrow(batches, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def least_counts(vocabulary: DataFrame, *most: int) -> list[int]:
    """For each number, the count from which upwards at most so many words are found.

    It is found on a histogram with 32 steps for each doubling, so no task ever
    sorts the vocabulary; words of one step are taken together or not at all.
    """
    step = F.expr("n - pmod(n, shiftleft(1L, greatest(length(bin(n)) - 6, 0)))")
    sizes = sorted(((r["least"], r["words"]) for r in vocabulary.where(F.col("word") != int(END)).groupBy(step.alias("least")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    out = []
    for limit in most:
        least, so_far = 1 << 62, 0
        for bucket, words in sizes:
            so_far += words
            if so_far > limit:
                break
            least = bucket
        out.append(least)
    return out


class Lexicon:
    """The exchanged words by number; then the end, and all other words together."""

    def __init__(self, word: np.ndarray, n: np.ndarray):
        order = np.argsort(word)
        self.word, self.n = word[order], n[order]
        # Ties in frequency go by the word's hash.
        self.rank = np.empty(len(word), np.int64)
        self.rank[np.lexsort((self.word, -self.n))] = np.arange(len(word))
        self.end, self.other, self.size = len(word), len(word) + 1, len(word) + 2

    def ids(self, token: np.ndarray) -> np.ndarray:
        if not self.end:
            return np.where(token == END, self.end, self.other)
        at = np.minimum(np.searchsorted(self.word, token), self.end - 1)
        return np.where(token == END, self.end, np.where(self.word[at] == token, at, self.other))


#: Pairs in a row of a table of lists at most, so that a batch of rows stays small.
PIECE = 1024
_LISTS = "key bigint, other array<int>, n array<int>"


def _listed(key: np.ndarray, other: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Rows of (key, others, counts) from pairs sorted by key."""
    start = np.flatnonzero(np.diff(key, prepend=key[:1] - 1)) if len(key) else np.zeros(0, np.int64)
    within = np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key))))
    cut = np.flatnonzero(within % PIECE == 0)
    ends = pa.array(np.append(cut, len(key)).astype(np.int32))
    return pa.RecordBatch.from_pydict({"key": pa.array(key[cut].astype(np.int64)), "other": pa.ListArray.from_arrays(ends, pa.array(other.astype(np.int32))), "n": pa.ListArray.from_arrays(ends, pa.array(np.minimum(n, 2**31 - 1).astype(np.int32)))})


def _pairs_of(frame: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of rows of lists: key, other, n."""
    key, other, n = frame.column("key").to_numpy(), frame.column("other"), frame.column("n")
    return np.repeat(key, np.diff(other.offsets.to_numpy())), other.flatten().to_numpy(), n.flatten().to_numpy().astype(np.int64)


def neighbours(texts: DataFrame, lexicon: Lexicon, salts: int = 16) -> DataFrame:
    """key (a word's number), other, n: how often words come after it, and, from ``lexicon.size`` upwards, before it.

    What comes before is kept for the exchanged words alone. Pairs are folded in
    each task, then by word and salt, then by word; the table has the square of
    the lexicon's size as its bound.
    """
    shipped, wide = texts.sparkSession.sparkContext.broadcast(lexicon), 2 * lexicon.size

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for token in token_runs(frames):
            word = own.ids(token)
            before = np.concatenate([[own.end], word[:-1]])  # a text begins after an end
            pair, n = np.unique(before * own.size + word, return_counts=True)
            first, second = pair // own.size, pair % own.size
            yield _listed(first, second, n)
            back = np.flatnonzero(second < own.end)
            back = back[np.argsort(second[back], kind="stable")]
            yield _listed(second[back], first[back] + own.size, n[back])

    def merge(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by key; the pairs of the last key wait for the next batch."""
        rest = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for frame in frames:
            key, other, n = _pairs_of(frame)
            pair, at = np.unique(np.concatenate([rest[0], key * wide + other]), return_inverse=True)
            n = np.bincount(at, np.concatenate([rest[1], n]), len(pair)).astype(np.int64)
            done = np.searchsorted(pair, pair[-1] // wide * wide) if len(pair) else 0
            rest = pair[done:], n[done:]
            yield _listed(pair[:done] // wide, pair[:done] % wide, n[:done])
        yield _listed(rest[0] // wide, rest[0] % wide, rest[1])

    rows = texts.mapInArrow(batches, _LISTS).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    salted = rows.repartition("key", "salt").sortWithinPartitions("key").select("key", "other", "n").mapInArrow(merge, _LISTS)
    return salted.repartition("key").sortWithinPartitions("key").mapInArrow(merge, _LISTS)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def best_class(table: np.ndarray, exchanged: int, old: int, right: np.ndarray, left: np.ndarray, self_n: float) -> int:
    """The best of the exchanged classes for a word of class ``old``, which is taken out of ``table``.

    right, left: how often each class comes after and before the word, itself
    left out. A word without an exchanged class always gets one.
    """
    free = np.arange(exchanged)
    table[old] -= right
    table[:, old] -= left
    table[old, old] -= self_n
    # What each class's row, column and own cell gain if the word joins it.
    rows, cols = table[free], table[:, free].T
    grown_r, grown_c = rows + right, cols + left
    gain = (_xlogx(grown_r) - _xlogx(rows)).sum(1) + (_xlogx(grown_c) - _xlogx(cols)).sum(1)
    own = table[free, free]
    gain += _xlogx(own + right[free] + left[free] + self_n) - _xlogx(own + right[free]) - _xlogx(own + left[free]) + _xlogx(own)
    # Wherever the word goes, its neighbours' classes get their totals back.
    tr, tc = (table.sum(1) + left)[free], (table.sum(0) + right)[free]
    gain -= _xlogx(tr + right.sum() + self_n) - _xlogx(tr) + _xlogx(tc + left.sum() + self_n) - _xlogx(tc)
    new = int(gain.argmax())
    return int(old) if old < exchanged and gain[new] <= gain[old] + 1e-9 else new


def _contexts(frames: Iterator[pa.RecordBatch], slot_of, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, how often each meets each of ``width`` slots, and its count, from rows sorted by key; slots below zero are left out."""
    rest = None
    for frame in frames:
        if not frame.num_rows:
            continue
        pairs, other, n = _pairs_of(frame)
        own, count = frame.column("key").to_numpy(), np.zeros(frame.num_rows)
        if "count" in frame.schema.names:
            count = frame.column("count").fill_null(0).to_numpy(zero_copy_only=False)
        key, at = np.unique(own, return_inverse=True)
        at_pair = np.repeat(at, np.diff(frame.column("other").offsets.to_numpy()))
        slot = slot_of(pairs, other)
        used = slot >= 0
        # Sums of nothing come as whole numbers, to which a key's earlier sums could not be added.
        met = np.bincount(at_pair[used] * width + slot[used], n[used], len(key) * width).astype(np.float64).reshape(len(key), width)
        total = np.bincount(at, count, len(key))
        if rest is not None and rest[0][0] == key[0]:
            met[0] += rest[1][0]
            total[0] += rest[2][0]
        elif rest is not None:
            yield rest
        rest = key[-1:], met[-1:].copy(), total[-1:].copy()
        yield key[:-1], met[:-1], total[:-1]
    if rest is not None:
        yield rest


class Exchange:
    """Classes of the exchanged words: 0 to ``classes`` - 1; then the class of words found once, and the end's."""

    def __init__(self, near: DataFrame, lexicon: Lexicon, classes: int):
        self.near, self.lexicon, self.classes, self.size = near, lexicon, classes, classes + 2
        self.of = np.full(lexicon.end, classes)

    def all_classes(self) -> np.ndarray:
        """The class of each number of the lexicon; all other words count as words found once."""
        return np.concatenate([self.of, [self.classes + 1, self.classes]])

    def _rows(self, emit, schema: str) -> DataFrame:
        """``emit`` of a task's (numbers, contexts): the classes after and before each, and how often it follows itself."""
        of, k, size = self.all_classes(), self.lexicon.size, self.size
        shipped = self.near.sparkSession.sparkContext.broadcast(np.concatenate([of, size + of]).astype(np.int32))

        def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of = shipped.value
            slot_of = lambda key, other: np.where(other == key, 2 * size, np.where(other == key + k, -1, of[other]))
            yield from emit(((key, met) for key, met, _ in _contexts(frames, slot_of, 2 * size + 1)), of)

        return self.near.mapInArrow(batches, schema)

    def table(self) -> np.ndarray:
        """The class bigrams of the corpus; at most size squared sums go to the driver."""
        size = self.size

        def emit(contexts, of: np.ndarray) -> Iterator[pa.RecordBatch]:
            table = np.zeros((size, size))
            for key, met in contexts:
                np.add.at(table, of[key], met[:, :size])
                np.add.at(table, (of[key], of[key]), met[:, -1])
            cell = np.flatnonzero(table)
            yield pa.RecordBatch.from_pydict({"cell": pa.array(cell.astype(np.int32)), "n": pa.array(table.ravel()[cell].astype(np.int64))})

        table = np.zeros(size * size)
        for r in self._rows(emit, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            table[r["cell"]] = r["n"]
        return table.reshape(size, size)

    def move(self, moves: np.ndarray, table: np.ndarray) -> None:
        """Each word that ``moves`` names goes to its best class, as if it moved alone."""
        shipped, end, size, classes = self.near.sparkSession.sparkContext.broadcast((moves, table)), self.lexicon.end, self.size, self.classes

        def emit(contexts, of: np.ndarray) -> Iterator[pa.RecordBatch]:
            moves, table = shipped.value
            for key, met in contexts:
                used = np.flatnonzero(key < end)
                used = used[moves[key[used]]]
                best = [best_class(table.copy(), classes, of[key[i]], met[i, :size], met[i, size:-1], met[i, -1]) for i in used]
                yield pa.RecordBatch.from_pydict({"key": pa.array(key[used]), "class": pa.array(np.array(best, np.int32))})

        chosen = self._rows(emit, "key bigint, class int").toPandas()
        self.of[chosen["key"].to_numpy()] = chosen["class"].to_numpy()

    def run(self, least_gain: float = 1e-4, most_rounds: int = 24) -> np.ndarray:
        """Places and moves all words; returns the table of class bigrams.

        The most frequent words begin with a class each; the others are placed in
        tiers of eightfold size. Then halves of the words move in turn. A half
        that lowers the likelihood is taken back, and two halves in a row that
        raise it by less than ``least_gain`` of itself end the run.
        """
        rank, upto = self.lexicon.rank, self.classes
        self.of[rank < upto] = rank[rank < upto]
        table = self.table()
        while upto < self.lexicon.end:
            self.move((rank >= upto) & (rank < 8 * upto), table)
            upto, table = 8 * upto, self.table()
        likelihood = lambda t: _xlogx(t).sum() - _xlogx(t.sum(1)).sum() - _xlogx(t.sum(0)).sum()
        reached, small = likelihood(table), 0
        for k in range(most_rounds):
            kept = self.of.copy()
            self.move(rank % 2 == k % 2, table)
            if (self.of == kept).all():
                small += 1
            else:
                moved = self.table()
                now = likelihood(moved)
                small = 0 if now - reached > least_gain * abs(reached) else small + 1
                if now > reached:
                    table, reached = moved, now
                else:
                    self.of = kept
            if small == 2:
                break
        return table


def place_others(texts: DataFrame, vocabulary: DataFrame, found: Exchange, table: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """(word, n, class) of the words of ``vocabulary``, none of them exchanged; and what their classes meet.

    A word's contexts are the classes of the words next to it, other words among
    them as one class. It goes to the class around which they are likeliest; of
    classes alike, to the first. The second result has a row for each class and
    a column for each class after it, then before it.
    """
    lexicon, size, classes = found.lexicon, found.size, found.classes
    after = np.log((table + 1) / (table.sum(1, keepdims=True) + size))
    before = np.log((table + 1) / (table.sum(0, keepdims=True) + size))
    shipped = texts.sparkSession.sparkContext.broadcast((lexicon, found.all_classes(), np.concatenate([after.T, before])[:, :classes]))

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, of, _ = shipped.value
        for token in token_runs(frames):
            word = own.ids(token)
            cls = of[word]
            at = np.flatnonzero(word == own.other)  # a word is never the last token, which is an end
            key, place = np.unique(token[at].view(np.int64), return_inverse=True)
            ahead = np.where(at > 0, cls[at - 1], classes + 1)
            pair, n = np.unique(np.concatenate([place * (2 * size) + cls[at + 1], place * (2 * size) + size + ahead]), return_counts=True)
            yield _listed_as_counts(key[pair // (2 * size)], pair % (2 * size), n)

    def reduce(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, weight = shipped.value
        met_by = np.zeros((size, 2 * size))
        for word, met, count in _contexts(frames, lambda _, other: other, 2 * size):
            cls = np.where(count > 1, (met @ weight).argmax(1), classes)
            np.add.at(met_by, cls, met)
            yield pa.RecordBatch.from_pydict({"word": pa.array(word), "n": pa.array(count.astype(np.int64)), "class": pa.array(cls.astype(np.int32)), "slot": pa.nulls(len(word), pa.int32())})
        cell = np.flatnonzero(met_by)
        yield pa.RecordBatch.from_pydict({"word": pa.nulls(len(cell), pa.int64()), "n": pa.array(met_by.ravel()[cell].astype(np.int64)), "class": pa.array((cell // (2 * size)).astype(np.int32)), "slot": pa.array((cell % (2 * size)).astype(np.int32))})

    none = F.array().cast("array<int>")
    counted = vocabulary.select(F.col("word").alias("key"), none.alias("other"), none.alias("n"), F.col("n").alias("count"))
    rows = texts.mapInArrow(batches, f"{_LISTS}, count bigint").unionByName(counted)
    out = cut_lineage(rows.repartition("key").sortWithinPartitions("key").mapInArrow(reduce, "word bigint, n bigint, class int, slot int"))
    met_by = np.zeros((size, 2 * size))
    for r in out.where("word is null").groupBy("class", "slot").agg(F.sum("n").alias("n")).collect():
        met_by[r["class"], r["slot"]] = r["n"]
    return out.where("word is not null").select("word", "n", "class"), met_by


def _listed_as_counts(key: np.ndarray, other: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    rows = _listed(key, other, n)
    return rows.append_column("count", pa.nulls(rows.num_rows, pa.int64()))


class Model(NamedTuple):
    """What scores a text: hot words (sorted) with class and count, logs of class bigrams and of class sizes."""

    word: np.ndarray
    cls: np.ndarray
    n: np.ndarray
    ends: int
    step: np.ndarray
    class_log: np.ndarray
    total: int
    different: int

    def of(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and count of each token; class -1 of words that are not hot."""
        if not len(self.word):
            return np.where(token == END, len(self.step) - 1, -1), np.where(token == END, self.ends, 0)
        at = np.minimum(np.searchsorted(self.word, token), len(self.word) - 1)
        hot = self.word[at] == token
        return np.where(token == END, len(self.step) - 1, np.where(hot, self.cls[at], -1)), np.where(token == END, self.ends, np.where(hot, self.n[at], 0))


def fit(train: DataFrame, classes: int = 48, exchanged_words: int = 16_384, hot_words: int = 131_072) -> tuple[Model, DataFrame]:
    """The model of rows of (text), and (word, n, class) of the words that are not exchanged.

    Class bigrams are counts of the corpus. Of two words side by side that are
    both not exchanged, the second's class is taken as those words' classes are
    spread overall.
    """
    vocabulary = cut_lineage(count_words(train))
    least, least_hot = least_counts(vocabulary, exchanged_words, max(exchanged_words, hot_words))
    few = vocabulary.where((F.col("n") >= least) | (F.col("word") == int(END))).toPandas()
    word, n = few["word"].to_numpy(np.int64).view(U64), few["n"].to_numpy(np.int64)
    ends = int(n[word == END].sum())
    lexicon = Lexicon(word[word != END], n[word != END])
    found = Exchange(cut_lineage(neighbours(train, lexicon)), lexicon, classes)
    table = found.run()
    others, met = place_others(train, vocabulary.where((F.col("n") < least) & (F.col("word") != int(END))), found, table)

    size, once = found.size, classes
    v_class, n_class = np.zeros(size), np.zeros(size)
    for r in others.groupBy("class").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).collect():
        v_class[r["class"]], n_class[r["class"]] = r["v"], r["n"]
    share = n_class / max(n_class.sum(), 1)
    after, before = met[:, :size].copy(), met[:, size:].copy()
    spread = after[:, once].copy()
    after[:, once] = before[:, once] = 0
    table[once], table[:, once] = 0, 0
    table = table + after + before.T + spread[:, None] * share[None, :]
    np.add.at(v_class, found.of, 1)
    np.add.at(n_class, found.of, lexicon.n)
    v_class[-1], n_class[-1] = 1, ends

    hot = others.where(F.col("n") >= least_hot).toPandas()
    hot_word = np.concatenate([lexicon.word, hot["word"].to_numpy(np.int64).view(U64)])
    hot_cls, hot_n = np.concatenate([found.of, hot["class"].to_numpy(np.int64)]), np.concatenate([lexicon.n, hot["n"].to_numpy(np.int64)])
    order = np.argsort(hot_word)
    half = np.zeros(size)
    half[once] = 0.5  # for all unseen words
    class_log = np.log10(np.maximum(n_class + v_class / 2 + half, 0.5))
    step = np.log10((table + 1) / (table.sum(1, keepdims=True) + size))
    different = int(v_class.sum()) if ends else 0
    return Model(hot_word[order], hot_cls[order], hot_n[order], ends, step, class_log, int(n_class.sum()), different), others


def score_texts(docs: DataFrame, classes: int = 48, exchanged_words: int = 16_384, hot_words: int = 131_072, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Learns from the texts whose crc32(id) mod 7 is not 2. Tokens are the words,
    A-Z lower-cased, then one end. base_score is the add-one unigram score.
    score is the class model's log10 probability: class bigrams with add-one
    smoothing over the classes, words within a class by (c + 1/2) / (N(class) +
    V(class) / 2); the class of words found once has another half for all unseen
    words. ``classes`` is at most 252.

    The driver holds classes and counts of ``hot_words`` words and totals per
    class; words of one count are taken among these together or not at all. Ties
    between classes go to the first, in ranks to the smaller hash. Counts in the
    tables of neighbours stop at 2**31 - 1. A null text counts as empty: it is an
    end alone. A text's own tokens are held by a task at once, however long it
    is. Ids may repeat or be null; rows are told apart by their own number.
    Further columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), (remainder(id_col, 7) == 2).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    model, others = fit(rows.where(~F.col("held_out")).select("text"), classes, exchanged_words, hot_words)
    shipped = spark.sparkContext.broadcast(model)
    text_type = f"struct<doc_id:{docs.schema[id_col].dataType.simpleString()},held_out:boolean,n_tokens:bigint,known:bigint,base:double,model:double>"

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each text a row of what its hot words say, at -1 and under a word of its own, then a row for each other word.

        ``at`` packs a word's place with the classes before and after it, each
        plus one; 0 is that of a word that is not hot either.
        """
        own = shipped.value
        for frame in frames:
            data, offsets = text_bytes(frame.column("text"))
            row_id = frame.column("row").to_numpy()
            for first, last in blocks(offsets, 4 << 20):
                token, at = tokens(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                m = last - first
                owner = np.repeat(np.arange(m), np.diff(at))
                cls, n = own.of(token)
                hot = cls >= 0
                before = np.concatenate([[len(own.step) - 1], cls[:-1]])
                said = np.where(hot, np.log10(n + 0.5) - own.class_log[cls], 0.0) + np.where(hot & (before >= 0), own.step[before, cls], 0.0)
                cold = np.flatnonzero(~hot)
                packed = (cold - at[owner[cold]]) << 16 | (before[cold] + 1) << 8 | (cls[cold + 1] + 1)
                mine = row_id[first:last]
                about = pa.StructArray.from_arrays(
                    [
                        frame.column("doc_id").slice(first, m),
                        frame.column("held_out").slice(first, m),
                        pa.array(np.diff(at).astype(np.int64)),
                        pa.array(np.bincount(owner[n > 0], minlength=m).astype(np.int64)),
                        pa.array(np.bincount(owner, np.where(hot, np.log10(n + 1), 0.0), m)),
                        pa.array(np.bincount(owner, said, m)),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "known", "base", "model"],
                )
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": pa.array(np.concatenate([mine, mine[owner[cold]]])),
                        "at": pa.array(np.concatenate([np.full(m, -1), packed])),
                        "word": _signed(np.concatenate([mix(mine.view(U64) + U64(1)), token[cold]])),
                        "about": pa.concat_arrays([about, pa.nulls(len(cold), about.type)]),
                    }
                )

    def finish(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (row, at); the last text of a batch waits for the next."""
        own, rest = shipped.value, None
        once = len(own.step) - 2

        def scored(t: pa.Table) -> pa.RecordBatch:
            at, n = t.column("at").to_numpy(), t.column("n").fill_null(0).to_numpy()
            cls = t.column("class").fill_null(once).to_numpy()
            is_text = at < 0
            text = np.cumsum(is_text) - 1
            before, after = (at >> 8 & 255) - 1, (at & 255) - 1
            before = np.where(is_text, once, np.where(before >= 0, before, np.concatenate([[once], cls[:-1]])))
            after = np.where(is_text, -1, after)
            said = own.step[before, cls] + np.log10(n + 0.5) - own.class_log[cls] + np.where(after >= 0, own.step[cls, after], 0.0)
            m = int(is_text.sum())
            add = lambda x: np.bincount(text[~is_text], x[~is_text], m)
            about = t.column("about").combine_chunks().filter(pa.array(is_text))
            tokens_, known, base, model = (about.field(c).to_numpy() for c in ("n_tokens", "known", "base", "model"))
            score = model + add(said)
            return pa.RecordBatch.from_pydict(
                {
                    "doc_id": about.field("doc_id"),
                    "held_out": about.field("held_out"),
                    "n_tokens": about.field("n_tokens"),
                    "n_known": pa.array((known + add(n > 0)).astype(np.int64)),
                    "train_tokens": pa.array(np.full(m, own.total, np.int64)),
                    "base_score": pa.array(base + add(np.log10(n + 1)) - tokens_ * np.log10(own.total + own.different + 1.0)),
                    "score": pa.array(score),
                    "perplexity": pa.array(10.0 ** (-score / tokens_)),
                }
            )

        for frame in frames:
            if not frame.num_rows:
                continue
            t = pa.Table.from_batches([frame])
            t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
            done = int(np.searchsorted(t.column("row").to_numpy(), t.column("row")[-1].as_py()))
            if done:
                yield scored(t.slice(0, done))
            rest = t.slice(done)
        if rest is not None:
            yield scored(rest)

    parts = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(batches, f"row bigint, at bigint, word bigint, about {text_type}")
    met = parts.join(others, "word", "left").select("row", "at", "about", "n", "class").repartition("row").sortWithinPartitions("row", "at")
    id_type = docs.schema[id_col].dataType.simpleString()
    return met.mapInArrow(finish, f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double")
