import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from quern.llm import bpe, mixing
from quern.llm import quality_classifier as qc

DOMAINS = {"clean": 0.7, "low": 0.2, "toxic": 0.1}


def corpus(n=300):
    rng = random.Random(4)
    words = {"clean": "alpha beta gamma delta", "low": "spam buy click now", "toxic": "vile scum trash foul"}
    rows, labels = [], []
    for k in range(n):
        d = ("clean", "low", "toxic")[k % 3]
        mix = words[d].split() * 3 + words["clean"].split() * (k % 2)
        rows.append((k, " ".join(rng.choice(mix) for _ in range(20 + k % 40)), "en", f"s{k % 4}"))
        if k % 2:
            labels.append((k, 0 if d == "low" else 1, 1 if d == "toxic" else 0))
    return rows, labels


def test_mixture_meets_its_targets(spark, docs_of):
    rows, labels = corpus()
    docs, table = docs_of(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    out = mixing.mix_documents(docs, mixing.labelled_domains(docs, table), DOMAINS).collect()
    total = sum(r.n_tokens for r in out)
    assert total == sum(len(t.split()) for _, t, _, _ in rows)
    for d, share in DOMAINS.items():
        assert sum(r.rate * r.posterior[d] * r.n_tokens for r in out) == pytest.approx(share * total, rel=2e-3)
    assert all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in out)
    assert sum(max(r.posterior, key=r.posterior.get) == ("clean", "low", "toxic")[r.doc_id % 3] for r in out) > 0.9 * len(out)


def test_labels_do_not_score_their_own_rows(spark, docs_of):
    """With labels at random and words of no meaning, labelled rows' posteriors know nothing of their labels."""
    rng = random.Random(9)
    rows = [(k, " ".join(f"w{rng.randrange(3000)}" for _ in range(60)), "en", "s") for k in range(300)]
    labels = [(k, 1, rng.randrange(2)) for k in range(300)]
    docs, table = docs_of(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    out = mixing.mix_documents(docs, mixing.labelled_domains(docs, table), DOMAINS).collect()
    mean = lambda y: np.mean([r.posterior["toxic"] for r in out if labels[r.doc_id][2] == y])
    assert abs(mean(1) - mean(0)) < 0.15


def test_domain_without_labels_is_left_out(spark, docs_of):
    rows, labels = corpus()
    docs, table = docs_of(rows), spark.createDataFrame([r for r in labels if r[1]], "doc_id bigint, quality int, toxic int")
    out = mixing.mix_documents(docs, mixing.labelled_domains(docs, table), DOMAINS).collect()
    assert len(out) == len(rows) and all(r.posterior["low"] == 0 for r in out)


def test_rates_match_a_direct_projected_gradient(spark):
    """The rates of cells are those of the same descent over single documents."""
    rng = np.random.default_rng(3)
    parts = rng.multinomial(mixing.PARTS, [0.6, 0.3, 0.1], 50) / mixing.PARTS
    tokens = rng.integers(1, 500, 50)
    rows = spark.createDataFrame([(int(t), *map(float, p)) for t, p in zip(tokens, parts, strict=True)], "n_tokens bigint, p0 double, p1 double, p2 double")
    targets = dict(zip(DOMAINS, (0.2 * tokens.sum(), 0.5 * tokens.sum(), 0.0), strict=True))
    steps = mixing.fit_rates(rows, targets, list(DOMAINS), rounds=25)
    x, p = np.ones(50), parts
    mass, want = (p * tokens[:, None]).sum(0), np.array(list(targets.values()))
    for _ in range(25):
        off = ((x * tokens) @ p - want) / mass
        x = np.maximum(0, x - p @ off)
    got = [r.x for r in rows.select(mixing.rate_of(steps, list(DOMAINS), None).alias("x")).collect()]
    assert got == pytest.approx(x.tolist(), abs=1e-6)


def test_targets_are_met_on_the_test_tables(spark):
    """Expected tokens of each domain come within a ten-thousandth of all tokens of their targets."""
    import os

    sf = "/root/testdata/sf0.01"
    if not os.path.exists(sf):
        pytest.skip("no test tables here")
    from quern.llm.queries import MIXTURE

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mixed = mixing.mix_documents(docs, mixing.labelled_domains(docs, spark.read.parquet(f"{sf}/labels.parquet")), MIXTURE)
    out = {r.domain: r for r in mixing.expected_mixture(mixed).collect()}
    assert set(out) == set(MIXTURE) and all(abs(r.off) < 1e-4 for r in out.values())


def test_scarce_domain_does_not_bound_the_mixture(spark):
    """With rates of one at most, clean text stays whole however little of another domain there is."""
    schema = "n_tokens bigint, p0 double, p1 double, p2 double"
    rows = spark.createDataFrame([(100, 1.0, 0.0, 0.0)] * 90 + [(100, 0.0, 0.0, 1.0)] * 10 + [(1, 0.0, 1.0, 0.0)], schema)
    weights = {"clean": 0.9, "low": 0.05, "toxic": 0.05}
    targets = mixing.reachable_targets(rows, weights, 1.0)
    assert targets == pytest.approx({"clean": 9000, "low": 1, "toxic": 500})
    steps = mixing.fit_rates(rows, targets, list(weights), most=1.0)
    got = {tuple(r[:3]): r[3] for r in rows.select("p0", "p1", "p2", mixing.rate_of(steps, list(weights), 1.0)).distinct().collect()}
    assert got[1, 0, 0] == pytest.approx(1, abs=1e-4) and got[0, 1, 0] == pytest.approx(1, abs=1e-4) and got[0, 0, 1] == pytest.approx(0.5, abs=1e-3)
    none = spark.createDataFrame([], schema)
    assert mixing.reachable_targets(none, weights, 1.0) == {"clean": 0, "low": 0, "toxic": 0}


def test_labels_are_bounded_and_count_once(spark, docs_of):
    docs = docs_of([(k, f"t{k}") for k in range(400)])
    labels = spark.createDataFrame([(k, 1, 0) for k in range(400)] + [(0, 0, 1), (1, 0, 0), (1, 0, 0), (2, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    out = dict(map(tuple, mixing.labelled_domains(docs, labels).collect()))
    assert len(out) == 400 and out["t0"] == "toxic" and out["t1"] == "low" and out["t2"] == "clean"
    assert 20 < mixing.labelled_domains(docs, labels, most_rows=100).count() < 200


def test_posteriors_match_brute_force(spark, docs_of):
    """Naive Bayes with folds, in plain Python over the same hashed features."""
    import math
    from collections import Counter

    rows, table = corpus(40)
    docs = docs_of(rows)
    labelled = mixing.labelled_domains(docs, spark.createDataFrame(table, "doc_id bigint, quality int, toxic int"))
    domains = list(DOMAINS)
    got = {r.doc_id: [r.posterior[d] for d in domains] for r in mixing.mix_documents(docs, labelled, DOMAINS).collect()}
    feature = {r.w: r.f for r in spark.createDataFrame(sorted({w for _, t, *_ in rows for w in t.lower().split()}), "string").selectExpr("value AS w", f"pmod(xxhash64(value), {mixing.FEATURES}) AS f").collect()}
    fold = {r.doc_id: r.f for r in docs.select("doc_id", mixing.fold_of().alias("f")).collect()}
    texts = {r[0]: r[1] for r in rows}
    of_text = {t: fold[i] for i, t in texts.items()}
    known = [(r.text, domains.index(r.domain)) for r in labelled.collect()]
    for i, t in texts.items():
        own = [(x, d) for x, d in known if of_text[x] != fold[i]]
        n = [Counter(feature[w] for x, d in own if d == k for w in x.lower().split()) for k in range(len(domains))]
        total = [sum(c.values()) for c in n]
        words = [feature[w] for w in t.lower().split()]
        score = []
        for k in range(len(domains)):
            labels = [sum(d == j for _, d in own) for j in range(len(domains))]
            prior = math.log((labels[k] + 1) / (sum(labels) + len(domains))) if labels[k] else -math.inf
            weight = lambda f: math.log((n[k][f] + mixing.FEATURES * (sum(c[f] for c in n) + 1) / (sum(total) + mixing.FEATURES)) / (total[k] + mixing.FEATURES))  # noqa: B023, E731
            score.append(prior + sum(map(weight, words)) / max(1, len(words)) ** 0.25)
        e = [math.exp(s - max(score)) for s in score]
        assert got[i] == pytest.approx([x / sum(e) for x in e], abs=1e-9)


def test_mixture_edges(spark, docs_of):
    rows, labels = corpus(30)
    rows += [(100, None), (101, ""), (102, " \n"), (5, "alpha"), (None, "spam")]
    docs, table = docs_of(rows), spark.createDataFrame([*labels, (None, 1, 0), (3, None, None)], "doc_id bigint, quality int, toxic int")
    labelled = mixing.labelled_domains(docs, table)
    out = mixing.mix_documents(docs, labelled, DOMAINS).collect()
    assert len(out) == len(rows) and all(r.n_tokens == 0 for r in out if r.doc_id in (100, 101, 102))
    kept = mixing.take_mixture(docs, labelled, DOMAINS, most_rate=1.0)
    assert kept.columns == docs.columns and kept.count() <= len(rows)
    assert mixing.mix_documents(docs_of([]), labelled, DOMAINS).count() == 0
    assert mixing.mix_documents(docs, labelled.where("false"), DOMAINS).count() == len(rows)


def test_classifier_learns_from_both_views(spark, docs_of):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(600):
        good = k % 2
        words = "alpha beta gamma delta" if good else "junk### spam*** buy$$$ now&&&"
        rows.append((k, " ".join(rng.choice(words.split()) for _ in range(30)), "en", "good" if good else "bad"))
        if k % 5 == 0:
            labels.append((k, good))
    out = qc.score_quality(docs_of(rows), spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()
    assert sum(r.good == bool(r.doc_id % 2) for r in out) >= 0.99 * len(out)
    assert all(0 <= r.score <= 1 for r in out)


def test_classifier_edges(spark, docs_of):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (77, 1)], "doc_id bigint, quality int")
    rows = [(1, "a"), (1, "a"), (2, None), (None, ""), (3, "b c", None, None)]
    out = qc.score_quality(docs_of(rows), labels).collect()
    assert len(out) == len(rows) and all(r.score == r.score for r in out)
    assert qc.score_quality(docs_of([]), labels).count() == 0
    assert qc.score_quality(docs_of(rows), labels.where("false")).count() == len(rows)


def test_co_training_matches_brute_force(spark, docs_of):
    """Two rounds over single rows in plain Python: counts, calibration, pseudo-labels of the other view, scores."""
    import math
    import zlib

    from quern.llm.textkit import text_bytes, word_hashes

    rng = random.Random(8)
    rows, given = [], {}
    for k in range(260):
        good = rng.random() < 0.5
        words = ("alpha beta gamma delta common" if good else "junk spam buy now common").split()
        rows.append((k, " ".join(rng.choice(words) for _ in range(4 + k % 9)) if k % 50 else None, "en" if k % 3 else None, rng.choice("ab" if good else "bc")))
        if k % 3 == 0:
            given[k] = int(good if rng.random() < 0.95 else not good)
    out = {r.doc_id: r for r in qc.score_quality(docs_of(rows), spark.createDataFrame(list(given.items()), "doc_id bigint, quality int"), sure=0.8).collect()}

    import pyarrow as pa

    def features(text):
        word, _ = word_hashes(*text_bytes(pa.array([text], pa.string())))
        return {int(w) % qc.WORDS for w in word}

    crc = lambda x: zlib.crc32(x.encode())
    view_of = {}
    for k, text, lang, source in rows:
        size = int(math.log2(max(len(text or ""), 1)))
        meta = [crc(source) % 300, 310 + (crc(lang) % 100 if lang else 100), 420 + min(2 * size, 60)]
        view_of[k] = {"text": features(text), "meta": meta}
    aside = {k for k in given if crc(str(k)) % 5 == 0}
    size_of = {"text": qc.WORDS, "meta": qc.META}
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    weight = line = None
    for _ in range(3):
        sets = {}
        for view, other in (("text", "meta"), ("meta", "text")):
            sets[view] = {0: [], 1: []}
            for k in view_of:
                if k in aside:
                    continue
                if k in given:
                    sets[view][given[k]].append(k)
                elif weight is not None:
                    p = sigmoid(min(30, max(-30, line[other][0] * raw(other, k) + line[other][1])))  # noqa: F821
                    if p >= 0.8 or p <= 1 - 0.8:
                        sets[view][int(p >= 0.8)].append(k)
        learned = {}
        for view in qc.VIEWS:
            n = [Counter(f for k in sets[view][y] for f in view_of[k][view]) for y in (0, 1)]
            total = [sum(c.values()) for c in n]
            learned[view] = lambda f, n=n, total=total, size=size_of[view]: math.log((n[1][f] + 1) / (total[1] + size)) - math.log((n[0][f] + 1) / (total[0] + size))
        weight = learned

        def raw(view, k, weight=weight):
            each = [weight[view](f) for f in view_of[k][view]]
            value = sum(each) / math.sqrt(max(len(each), 1)) if view == "text" else sum(each)
            return min(qc.REACH, max(-qc.REACH, value))

        line = {}
        for view in qc.VIEWS:
            cells = np.zeros((2, qc.BINS))
            for k in aside:
                cells[given[k], min(int((raw(view, k) + qc.REACH) * qc.BINS / (2 * qc.REACH)), qc.BINS - 1)] += 1
            line[view] = qc.platt_line(cells)
        n1 = sum(given[k] for k in aside)
        prior = math.log((n1 + 1) / (len(aside) - n1 + 1))
    for k in view_of:
        text, meta = (min(30, max(-30, line[v][0] * raw(v, k) + line[v][1])) for v in qc.VIEWS)
        assert (out[k].text_score, out[k].meta_score, out[k].score) == pytest.approx((sigmoid(text), sigmoid(meta), sigmoid(text + meta - prior)), abs=1e-9)


def test_platt_line_fits_a_logistic_curve():
    x = (np.arange(qc.BINS) + 0.5) * 2 * qc.REACH / qc.BINS - qc.REACH
    p = 1 / (1 + np.exp(-(0.7 * x - 1)))
    a, b = qc.platt_line(np.stack([(1 - p) * 1000, p * 1000]))
    assert (a, b) == (pytest.approx(0.7, abs=0.02), pytest.approx(-1, abs=0.05))
    assert qc.platt_line(np.zeros((2, qc.BINS)))[0] == 0.0


def test_pipeline_against_its_parts(spark, tmp_path, docs_of):
    """Each stage's rows follow from what its operator says about its own input; the ids are the library's."""
    import duckdb

    from quern.llm import quality_rules

    rng = random.Random(7)
    text = lambda k: " ".join(f"w{rng.randrange(3000)}" for _ in range(90))
    rows = [(k, text(k), "en", f"s{k % 3}") for k in range(60)]
    rows += [(100 + k, rows[k][1], "en", "s0") for k in range(10)]
    rows += [(200 + k, rows[k][1] + " more words here", "en", "s1") for k in range(10)]
    rows += [(300, "too short", "en", "s1"), (301, None, None, None), (302, "a b c " * 60, "en", "s2"), (303, " ".join(f"w{k}***" for k in range(90)), "en", "s2")]
    vile = ("vile", "scum", "trash", "foul")
    rows += [(400 + k, " ".join(rng.choice(vile) + str(rng.randrange(9)) if j % 3 else f"w{rng.randrange(3000)}" for j in range(90)), "en", "s0") for k in range(20)]
    docs_of(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, 1, 0) for k in range(60)] + [(300, 0, 0)] + [(400 + k, 1, 1) for k in range(10)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(out := f"{tmp_path}/{len(seen)}")
        docs = spark.read.parquet(out)
        seen[name] = docs
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    by_rules = {r[0] for r in con.sql(f"select doc_id from ({quality_rules.oracle()}) where kept").fetchall()}
    ids = {name: {r.doc_id for r in df.collect()} for name, df in seen.items()}
    assert ids["quality rules"] == by_rules
    last = {}
    for i, t, *_ in rows:
        if i in by_rules:
            last[t] = max(i, last.get(t, -1))
    assert ids["exact dedup"] == set(last.values())
    assert ids["near dedup"] == {i for i in ids["exact dedup"] if not (200 <= i < 210 and 100 + i - 200 in ids["exact dedup"])}
    assert ids["mixing"] <= ids["near dedup"] and {i for i in ids["near dedup"] if i < 60} <= ids["mixing"]
    assert len({i for i in ids["mixing"] if i >= 400}) < 10 < len({i for i in ids["near dedup"] if i >= 400})
    assert ids["byte-level BPE"] == ids["mixing"]
    assert all(df.columns == ["doc_id", "text", "lang", "source", "n_chars"] for df in list(seen.values())[:-1])
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    texts = {r[0]: r[1] for r in rows}
    for r in docs.collect():
        assert np.frombuffer(r.token_ids, "<u4").tolist() == library.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.token_ids) // 4
    whole = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "ids_sha256").collect()
    assert Counter(map(tuple, whole)) == Counter(map(tuple, docs.select("doc_id", "ids_sha256").collect()))


def test_pipeline_on_an_empty_table(spark, tmp_path, docs_of):
    docs_of([]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_one_query():
    from quern.llm.queries import queries

    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))
    assert len(corpus_pipeline.STAGES) == 5


