import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import token_counts
from quern.llm.token_counts import PrefixCounter, count_tokens, cut_to_budget, read_vocabulary, tokens_of_prefix

PATH = public_tokenizers.path("byte_bpe_50k.json")
LETTERS = ["a", "b", "e", "s", "t", "r", "v", "l", "'", "'", " ", " ", "\n", "\t", ".", "!", "12", "é", " ", " ", "\x85", "漢", "😀", "́", "½", "<|endoftext|>", "<|endo", "'ll", "'re", "\r\n", " the", "ſ", "\x00"]


@pytest.fixture(scope="module")
def vocabulary(spark):
    return read_vocabulary(spark, PATH)


@pytest.fixture(scope="module")
def counter(vocabulary):
    return PrefixCounter(vocabulary)


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(LETTERS), max_size=16).map("".join))
def test_every_prefix_as_the_library(counter, library, text):
    assert counter.counts(text).tolist() == [library(text[:k]) for k in range(len(text) + 1)]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_any_text_as_the_library(counter, library, text):
    text = text.encode("utf-8", "ignore").decode()
    assert counter.counts(text)[-1] == library(text)


def test_whole_documents(spark, docs_of, vocabulary, library, sample):
    rows = [(i, t) for i, t, *_ in sample] + [(i, t) for i, t, *_ in sample[:3]]
    got = count_tokens(docs_of(rows), vocabulary).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    want = sorted((i, len((t or "").encode()), n := library(t or ""), n > 512) for i, t in rows)
    assert sorted(tuple(r) for r in got) == want


def test_cuts_need_no_second_encoding(docs_of, vocabulary, library, sample):
    """Random prefixes and budgets, each held against the library on the text that is cut."""
    rows = [(i, t[:3000]) for i, t, *_ in sample[:40]] + [(-1, None), (-2, ""), (-3, " \n " * 50), (-4, "x<|endoftext|> y")]
    rng = random.Random(3)
    stored = count_tokens(docs_of(rows), vocabulary, keep_prefixes=True).withColumn("at", F.lit(rng.randint(1, 900))).withColumn("budget", F.lit(rng.randint(1, 300)))
    for r in stored.select("text", "prefix_tokens", "at", "budget", tokens_of_prefix(F.col("at")).alias("tokens"), cut_to_budget(F.col("budget")).alias("cut")).collect():
        text = r.text or ""
        assert len(r.prefix_tokens) == 4 * (len(text) + 1)
        assert r.tokens == library(text[: r.at])
        each = [library(text[:k]) for k in range(len(text) + 1)] if len(text) < 200 else np.frombuffer(r.prefix_tokens, "<i4").tolist()
        assert r.cut == max(k for k, n in enumerate(each) if n <= r.budget) and library(text[: r.cut]) <= r.budget


def test_cut_takes_the_longest_prefix(counter):
    """A prefix with more characters can have fewer tokens."""
    counts = counter.counts("unbelievably")
    assert token_counts.longest_within(counts, 1) == max(k for k in range(len(counts)) if counts[k] <= 1)
    assert token_counts.longest_within(counts, 0) == 0 and token_counts.longest_within(np.array([0]), 5) == 0


def test_nulls_repeats_names_and_long_texts(docs_of, vocabulary, library):
    long = "ab" * 60_000 + " " * 20_000 + "é漢" * 20_000
    rows = [(1, None), (1, None), (None, "a b"), (2, long), (3, " ".join(map(str, range(60_000)))), (4, "a" * 100_000)]
    out = count_tokens(docs_of(rows).withColumn("n_tokens", F.lit("own")).withColumn("within_limit", F.lit(1)), vocabulary, limit=7)
    assert out.columns.count("n_tokens") == 1 and "digest" in out.columns
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect()))
    assert got == sorted((i is None, i or 0, len((t or "").encode()), n := library(t or ""), n > 7) for i, t in rows)


def test_empty_table(docs_of, vocabulary):
    assert count_tokens(docs_of([]), vocabulary, keep_prefixes=True).count() == 0


def test_other_tokenizers_are_refused(spark):
    with pytest.raises(ValueError):
        read_vocabulary(spark, public_tokenizers.path("word_bpe_49k.json"))
