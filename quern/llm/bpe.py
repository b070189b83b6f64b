"""Byte-level BPE by backtracking: exact merges in linear time, and back to bytes.

A sequence of tokens is what the merges give exactly if each two neighbours
are: if no merge crosses the border between them before both are complete.
Encoding therefore takes the longest token that fits and whose border with the
token before holds, shortens it otherwise, and steps back when nothing is left.
A place that once led nowhere is marked, so each place is entered once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The tokens of a rank file with their ranks: lines of base64 and a number.

    A vocabulary has a fixed size (here 50,256 lines), so the driver reads it and ships it with the tasks.
    """
    if "://" in path:
        lines = [x.value for x in spark.read.text(path).collect()]
    else:
        with open(path, encoding="ascii") as f:
            lines = f.read().splitlines()
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}


class Encoder:
    """Ids of the pieces that ``pattern`` cuts from a text, as the vocabulary's merges give them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most_kept: int = 300_000, most_pairs: int = 2_000_000):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.most_kept, self.most_pairs = most_kept, most_pairs
        self._pieces: dict[str, bytes] = {}
        self._holds: dict[tuple[int, int], bool] = {}
        self._halves: dict[int, tuple[int, int]] = {}
        self._merged: dict[tuple[int, int], int] = {}
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            self._split(token, i)
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            if i in self._halves:
                self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self._shorter = {i: self._next_prefix(t) for t, i in ranks.items() if i in self._halves}

    def _split(self, token: bytes, i: int) -> None:
        """The two tokens whose merge makes this one; a token that no merge reaches is left out."""
        if len(token) == 1:
            self._halves[i] = (i, i)
            return
        parts = merge_plainly(token, self.ranks, i)
        if len(parts) == 2 and parts[0] in self._halves and parts[1] in self._halves:
            self._halves[i] = parts
            self._merged[parts] = i

    def _next_prefix(self, token: bytes) -> int | None:
        for n in range(len(token) - 1, 0, -1):
            if (i := self.ranks.get(token[:n])) is not None and i in self._halves:
                return i
        return None

    def _border(self, left: int, right: int) -> bool:
        """Whether the merges leave ``left`` and ``right`` beside each other; looked up once for each pair."""
        if (known := self._holds.get((left, right))) is not None:
            return known
        a, b, bound, holds = left, right, 1 << 62, None
        while holds is None:
            merged = self._merged.get((a, b))
            if merged is not None and merged < bound:
                holds = False
            elif a > b:  # the younger of the two tokens is undone first
                bound = a
                a = self._halves[a][1]
                if a == bound:
                    bound = b + 1
                    b = self._halves[b][0]
                    if b + 1 == bound:
                        holds = True
            else:
                bound = b + 1
                b = self._halves[b][0]
                if b + 1 == bound:
                    bound = a
                    a = self._halves[a][1]
                    if a == bound:
                        holds = True
        if len(self._holds) >= self.most_pairs:
            self._holds.clear()
        self._holds[left, right] = holds
        return holds

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, longest = len(piece), [None] * len(piece)
        for end, i in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - len(self.bytes_of[i])] = i  # ends grow, so the last is the longest
        out: list[int] = []
        open_ = bytearray(b"\x01") * (n + 1)
        at, token = 0, longest[0]
        while at < n:
            if token is None:  # nothing fits here: give up the token before
                open_[at] = 0
                token = out.pop()
                at -= len(self.bytes_of[token])
                token = self._shorter[token]
                continue
            end = at + len(self.bytes_of[token])
            if open_[end] and (not out or self._border(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else None
            else:
                token = self._shorter[token]
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        kept, out = self._pieces, []
        for piece in self.pattern.findall(text):
            ids = kept.get(piece)
            if ids is None:
                ids = np.array(self.encode_piece(piece.encode()), "<u4").tobytes()
                if len(piece) <= 64:
                    if len(kept) >= self.most_kept:
                        kept.clear()
                    kept[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def merge_plainly(piece: bytes, ranks: dict[bytes, int], below: int | None = None) -> tuple[int, ...]:
    """The ids of a piece by repeated merging of the pair of lowest rank, with ranks under ``below`` only."""
    parts = [piece[k : k + 1] for k in range(len(piece))]
    while len(parts) > 1:
        rank, k = min((ranks.get(parts[k] + parts[k + 1], 1 << 62), k) for k in range(len(parts) - 1))
        if rank == 1 << 62 or below is not None and rank >= below:
            break
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return tuple(ranks[p] for p in parts)


_ready: dict[tuple[int, str], Encoder] = {}


def _encoder(ranks: dict[bytes, int], pattern: str) -> Encoder:
    """One encoder a worker process for each vocabulary."""
    key = (hash(frozenset(ranks.items())), pattern)
    if key not in _ready:
        _ready.clear()
        _ready[key] = Encoder(ranks, pattern)
    return _ready[key]


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", ids_col: str = "token_ids", decoded_col: str = "decoded") -> DataFrame:
    """``docs`` without its text, with the ids (binary, little-endian unsigned 32-bit) and the bytes decoded from them.

    ``ranks`` must hold all 256 single bytes. Each piece of the text that
    ``pattern`` cuts is encoded by itself, without special tokens. No shuffle:
    every row is worked on where it is read. A null text counts as empty and
    has no ids; ``ids_col`` and ``decoded_col`` replace columns of that name; an
    empty table gives an empty result.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(ranks)  # of the vocabulary's fixed size

    @F.pandas_udf("struct<ids:binary,decoded:binary>")
    def encoded(texts: pd.Series) -> pd.DataFrame:
        encoder = _encoder(shipped.value, pattern)
        ids = [encoder.encode(t or "") for t in texts]
        return pd.DataFrame({"ids": ids, "decoded": [encoder.decode(x) for x in ids]})

    keep = [c for c in docs.columns if c not in (text_col, ids_col, decoded_col)]
    return docs.select(*keep, encoded(F.col(text_col).cast("string")).alias("__e")).select(*keep, F.col("__e.ids").alias(ids_col), F.col("__e.decoded").alias(decoded_col))


def digest_columns(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.expr("length(token_ids) div 4").cast("bigint").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
