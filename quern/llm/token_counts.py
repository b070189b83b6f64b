"""Exact token counts of every prefix of a text, so that cuts and budgets need no second encoding.

The last token of a byte string's encoding is the only one that ends there and
whose border with the encoding before it holds. Going through a piece once,
that gives the count of each of its prefixes; a text's counts are sums over its
pieces. A text that is cut is cut into other pieces at its end alone: white
space before the end stays together, and a contraction that is not complete is
a sign and a letter.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.bpe import Encoder

#: The pieces that a byte-level pre-tokenizer cuts, white space before a word taken along with it.
UNIT = regex.compile(r"(?:\s*+(?<=[^\S ]))?'(?:[stmd]|ll|ve|re)|\s*+(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)|\s+")
RUN = regex.compile(r"\s*")
LONG_CONTRACTIONS = frozenset({"'ll", "'ve", "'re"})


@dataclass(frozen=True)
class Vocabulary:
    """Tokens with the order of their merges, and special strings that are one token each."""

    ranks: dict[bytes, int]
    specials: tuple[str, ...]
    name: str


def read_vocabulary(spark: SparkSession, path: str) -> Vocabulary:
    """The vocabulary of a tokenizer file with byte-level BPE.

    Such a file has a fixed size (here 50,000 merges), so the driver reads it
    and ships it with the tasks. Files that ask for something else than plain
    byte-level BPE are refused.
    """
    if "://" in path:
        text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    else:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    file = json.loads(text)
    model, before = file["model"], file["pre_tokenizer"]
    plain = not any([file.get("normalizer"), file.get("truncation"), file.get("padding"), model.get("dropout"), model.get("ignore_merges"), before.get("add_prefix_space"), model.get("continuing_subword_prefix"), model.get("end_of_word_suffix")])
    if not plain or model["type"] != "BPE" or before["type"] != "ByteLevel" or not before.get("use_regex", True):
        raise ValueError(f"{path}: not plain byte-level BPE")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in file["added_tokens"]):
        raise ValueError(f"{path}: special tokens that look at what is around them")
    as_byte = byte_letters()
    spelled = lambda token: bytes(as_byte[c] for c in token)
    ranks = {bytes([b]): b for b in range(256)}
    for pair in model["merges"]:
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        ranks.setdefault(spelled(a) + spelled(b), len(ranks))
    return Vocabulary(ranks, tuple(t["content"] for t in file["added_tokens"]), hashlib.sha256(text.encode()).hexdigest())


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in tokenizer files: itself where it can be seen, else the next from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(hidden)}


class PrefixCounter(Encoder):
    """Token counts of all prefixes."""

    def __init__(self, vocabulary: Vocabulary, most_kept: int = 300_000):
        super().__init__(vocabulary.ranks, r"\A.*\Z", most_kept)
        self._special = regex.compile("|".join(map(regex.escape, sorted(vocabulary.specials, key=len, reverse=True))) or r"(?!)")
        self._size = [0] * (max(vocabulary.ranks.values()) + 1)
        for token, rank in vocabulary.ranks.items():
            self._size[rank] = len(token)
        self._units: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def piece_counts(self, piece: bytes) -> list[int]:
        """Tokens of piece[:0], piece[:1], ..., piece."""
        size, known, last, count = self._size, self._holds, [-1] * (len(piece) + 1), [0] * (len(piece) + 1)
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] < 0:
                start = end - size[token]
                if start:
                    holds = known.get((last[start], token))
                    if not (self._border(last[start], token) if holds is None else holds):
                        continue
                last[end], count[end] = token, count[start] + 1
        return count

    def _by_letter(self, piece: str) -> list[int]:
        """``piece_counts`` at the ends of code points."""
        raw = piece.encode()
        counts = self.piece_counts(raw)
        if len(raw) == len(piece):
            return counts
        return [counts[k] for k in range(len(raw) + 1) if k == len(raw) or raw[k] & 0xC0 != 0x80]

    def _unit(self, unit: str) -> bytes:
        """What each code point of white space and the piece after it adds to the count."""
        white = RUN.match(unit).end()
        run, body = unit[:white], unit[white:]
        if body and run in ("", " "):  # one piece, whose first space alone is a token too
            counts = self._by_letter(unit)
        else:
            counts = self._by_letter(run)
            if body and run[-1] == " ":  # the last space belongs to the piece
                before, own = counts[-2], self._by_letter(" " + body)[2:]
                counts += [before + c for c in own]
            elif body:
                before, own = counts[-2] + self._by_letter(run[-1])[-1], self._by_letter(body)[1:]
                counts += [before + c for c in own]
        if body in LONG_CONTRACTIONS:
            counts[-2] = counts[-3] + self._by_letter(body[1])[-1]
        return array("i", [y - x for x, y in pairwise(counts)]).tobytes()

    def _plain(self, text: str) -> np.ndarray:
        """Counts of all prefixes of a text without special strings."""
        kept, steps = self._units, []
        for unit in UNIT.findall(text):
            own = kept.get(unit)
            if own is None:
                own = self._older.get(unit) or self._unit(unit)
                if len(unit) <= 64:
                    if len(kept) >= self.most_kept:  # what was not asked for since the last time goes
                        self._older, self._units = kept, {}
                        kept = self._units
                    kept[unit] = own
            steps.append(own)
        counts = np.zeros(len(text) + 1, np.int64)
        np.cumsum(np.frombuffer(b"".join(steps), "i"), out=counts[1:])
        return counts

    def counts(self, text: str) -> np.ndarray:
        """Tokens of text[:0], text[:1], ..., text."""
        special = self._special.search(text)
        if special is None:
            return self._plain(text)
        out, at, before = [], 0, 0
        while special is not None:
            own = self._plain(text[at : special.end() - 1]) + before  # a special string that is cut is ordinary text
            before = own[special.start() - at] + 1
            at = special.end()
            out.append(own)
            special = self._special.search(text, at)
        out.append(self._plain(text[at:]) + before)
        return np.concatenate(out)


_ready: dict[str, PrefixCounter] = {}


def _counter(vocabulary: Vocabulary) -> PrefixCounter:
    """One counter a worker process for each vocabulary."""
    if vocabulary.name not in _ready:
        _ready.clear()
        _ready[vocabulary.name] = PrefixCounter(vocabulary)
    return _ready[vocabulary.name]


def longest_within(counts: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens; a longer prefix can have fewer tokens than a shorter one."""
    return len(counts) - 1 - int(np.argmax(counts[::-1] <= budget)) if budget >= 0 else 0


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, limit: int = 512, text_col: str = "text", keep_prefixes: bool = False) -> DataFrame:
    """``docs`` with n_bytes, n_tokens, over_limit and within_limit; with ``keep_prefixes``, prefix_tokens too.

    within_limit is the number of code points of the longest prefix that has at
    most ``limit`` tokens. prefix_tokens holds the count of every prefix, from
    the empty one to the whole text, as little-endian 32-bit integers, one for
    each code point and one more; ``tokens_of_prefix`` and ``cut_to_budget``
    answer from it. Special strings within a text are one token each.

    No shuffle: every row is worked on where it is read, and a task holds one
    text's counts at a time unless they are kept. A null text counts as empty:
    no tokens, and prefix_tokens has one zero. The new columns replace columns
    of their names, others stay; repeated rows each have their counts; an empty
    table gives an empty result.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of the vocabulary's fixed size

    @F.pandas_udf("struct<n_bytes:bigint,n_tokens:bigint,within:bigint,prefixes:binary>")
    def counted(texts: pd.Series) -> pd.DataFrame:
        counter, rows = _counter(shipped.value), []
        for text in texts:
            text = text or ""
            counts = counter.counts(text)
            rows.append((len(text.encode()), int(counts[-1]), longest_within(counts, limit), counts.astype("<i4").tobytes() if keep_prefixes else None))
        return pd.DataFrame(rows, columns=["n_bytes", "n_tokens", "within", "prefixes"])

    new = {"n_bytes", "n_tokens", "over_limit", "within_limit", "prefix_tokens"}
    keep = [c for c in docs.columns if c not in new]
    out = docs.select(*keep, counted(F.col(text_col).cast("string")).alias("__c"))
    stored = [F.col("__c.prefixes").alias("prefix_tokens")] if keep_prefixes else []
    return out.select(*keep, "__c.n_bytes", "__c.n_tokens", (F.col("__c.n_tokens") > limit).alias("over_limit"), F.col("__c.within").alias("within_limit"), *stored)


def tokens_of_prefix(chars: Column, prefixes: str = "prefix_tokens") -> Column:
    """Tokens of the first ``chars`` code points, from the stored counts; beyond the text, those of all of it."""

    @F.pandas_udf("bigint")
    def answer(stored: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or pd.isna(k) else int((c := np.frombuffer(s, "<i4"))[min(max(int(k), 0), len(c) - 1)]) for s, k in zip(stored, at, strict=True)], dtype="Int64")

    return answer(F.col(prefixes), chars)


def cut_to_budget(budget: Column, prefixes: str = "prefix_tokens") -> Column:
    """Code points of the longest prefix within ``budget`` tokens, from the stored counts."""

    @F.pandas_udf("bigint")
    def answer(stored: pd.Series, most: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or pd.isna(k) else longest_within(np.frombuffer(s, "<i4"), int(k)) for s, k in zip(stored, most, strict=True)], dtype="Int64")

    return answer(F.col(prefixes), budget)


def count_columns(counted: DataFrame) -> DataFrame:
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit", "within_limit")
