import re
from collections import Counter

import duckdb

from quern.llm import quality_rules as q


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(map((text or "").count, "#*$%&|<>")), len(lines), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \t\n", "a", "a b", "a a a a", "a b c a b c", "x\n x\nx\n\n\nx\r\nx\r", "ä b c #*$%&|<>", "one two three four " * 4000, "\v\f a\x1fb  c", "a b c d a b c e a b", "📚 x y 📚 x y"]


def test_counts_match_brute_force(docs_of):
    out = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) for r in q.text_counts(docs_of(TEXTS)).collect()}
    assert out == {k: counts(t) for k, t in enumerate(TEXTS)}


def test_verdicts(docs_of):
    fine = [(k, " ".join(f"w{k:02d}x{j}" for j in range(80)), "en", "a" if k % 2 else None) for k in range(60)]
    bad = [(100, " ".join(f"w{j}###" for j in range(80)), "en", "a"), (101, "a b c " * 40, "en", "a"), (102, "short", None, None), (103, None, "en", "new")]
    out = {r.doc_id: (r.base_failed, r.kept, r.failed) for r in q.judge_quality(docs_of(fine + bad), least_rows=10).collect()}
    assert all(out[k] == (False, True, "") for k in range(60))
    assert out[100][:2] == (False, False) and "symbols" in out[100][2]
    assert out[101][:2] == out[102][:2] == out[103][:2] == (True, False)


def test_fences_follow_their_source(docs_of):
    """What is usual in one source is cut in another; texts without a fault stay, however tight the group is."""
    plain = [(k, " ".join(f"w{j:03d}" for j in range(60 + k % 40)) + " #" * (k % 2), "en", "plain") for k in range(60)]
    marked = [(100 + k, " ".join(f"w{j:03d}" for j in range(60 + k % 40)) + " #" * (20 + k % 9), "en", "marked") for k in range(60)]
    odd = [(300, " ".join(f"w{j:03d}" for j in range(70)) + " #" * 24, "en", "plain"), (301, " ".join(f"w{j:03d}" for j in range(70)) + " #" * 24, "en", "marked"), (302, " ".join(f"w{j:03d}" for j in range(50)), "en", "marked")]
    out = {r.doc_id: r.failed for r in q.judge_quality(docs_of(plain + marked + odd), least_rows=10).collect()}
    assert "symbols" in out[300] and out[301] == "" and "symbols" not in out[302]
    c = q.text_counts(docs_of(plain + marked))
    hi = {r.source: r.hi_symbols for r in q.fences(q.sketch(c, ["source"]), ["source"]).collect()}
    assert hi["marked"] > 3 * hi["plain"] / 2 or hi["plain"] > 3 * hi["marked"] / 2


def test_sketches_merge(docs_of):
    """Sketches of two halves, added, are the sketch of the whole."""
    rows = [(k, "word " * (k % 50 + 1), "en", f"s{k % 2}") for k in range(100)]
    c = q.text_counts(docs_of(rows))
    add = lambda df: Counter({(r.metric, r.bucket): r["sum(n)"] for r in df.groupBy("metric", "bucket").sum("n").collect()})
    assert add(q.sketch(c.where("source = 's0'"), ["source"]).unionByName(q.sketch(c.where("source = 's1'"), ["source"]))) == add(q.sketch(c, ["lang"]))


def test_empty(docs_of):
    assert q.judge_quality(docs_of([])).count() == 0 and q.drop_low_quality(docs_of([])).count() == 0


def test_repeated_rows_and_columns_stay(docs_of):
    row = (1, " ".join(f"w{j}" for j in range(80)), "en", "a")
    out = q.drop_low_quality(docs_of([row, row, (2, "x", "en", "a")]))
    assert [r.doc_id for r in out.collect()] == [1, 1] and "word" in out.columns


def test_oracle_on_edge_texts(spark, docs_of):
    docs = docs_of(TEXTS)
    con = duckdb.connect()
    con.register("d", docs.toPandas())
    con.sql("create table documents as select doc_id::bigint as doc_id, text::varchar as text, lang, source from d")
    want = {r[0]: r[1:] for r in con.sql(f"select doc_id, n_words, n_repeat_words, kept from ({q.oracle()})").fetchall()}
    assert {r.doc_id: (r.n_words, r.n_repeat_words, r.kept) for r in q.judge_quality(docs).collect()} == want


def test_labelled_clean_documents_stay():
    """Of the labelled documents that pass the base, the fences take the low ones and leave the clean ones."""
    import os

    import pytest
    from pyspark.sql import SparkSession

    sf = "/root/testdata/sf0.01"
    if not os.path.exists(sf):
        pytest.skip("no test tables here")
    spark = SparkSession.builder.getOrCreate()
    out = q.judge_quality(spark.read.parquet(f"{sf}/documents.parquet")).where("not base_failed").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("quality", "kept").collect()
    clean, low = ([r.kept for r in out if r.quality == v] for v in (1, 0))
    assert sum(clean) >= 0.98 * len(clean) and sum(low) <= 0.2 * len(low)
