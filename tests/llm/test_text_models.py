import base64
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import bpe, brown_lm, language_id, pii
from quern.llm.textkit import text_bytes

# Language identification.


def texts_of(lang, n, start):
    words = {"en": "the of and to in is that with", "fr": "le la de et les des être où"}[lang].split()
    return [(start + k, " ".join(words[(k * 7 + j * j) % len(words)] for j in range(40)), lang, "s") for k in range(n)]


def brute_codes(train, text):
    trees = defaultdict(lambda: defaultdict(Counter))
    for lang, t in train:
        b = bytes(3) + t.encode()
        for i in range(3, len(b)):
            for k in range(4):
                trees[lang][b[i - k : i]][b[i]] += 1
    out = {}
    for lang, tree in trees.items():
        b, bits = bytes(3) + text.encode(), 0.0
        for i in range(3, len(b)):
            p = 1.0
            for k in (3, 2, 1, 0):
                c = tree.get(b[i - k : i])
                if c:
                    total = sum(c.values()) + len(c)
                    if b[i] in c:
                        p *= c[b[i]] / total
                        break
                    p *= len(c) / total
            else:
                p /= 256
            bits -= math.log2(p)
        out[lang] = bits
    return out


def test_language_codes_are_exact(docs_of):
    rows = texts_of("en", 40, 0) + texts_of("fr", 40, 100) + [(300, "der und 漢字 \x00 the", None, "s"), (301, None, "fr", "s"), (302, "12 !", "en", "s"), (303, "", None, None)]
    train = [(r[2], r[1]) for r in rows if r[2] and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    for r in language_id.identify_languages(docs_of(rows)).collect():
        text = next(x[1] for x in rows if x[0] == r.doc_id)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if not re.search(r"[^\W\d_]", text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        codes = brute_codes(train, text)
        best = min(sorted(codes), key=codes.get)
        assert r.lang_pred == best and r.bits_per_byte == pytest.approx(codes[best] / len(text.encode()), rel=1e-4) and 0 <= r.score <= 1


def test_language_without_training_rows(docs_of):
    out = language_id.identify_languages(docs_of([(1, "abc", None, "s")])).collect()
    assert [(r.lang_pred, r.score) for r in out] == [("und", 0.0)]
    assert language_id.identify_languages(docs_of([])).count() == 0


def test_language_held_out_accuracy(docs_of, sample):
    out = language_id.identify_languages(docs_of(sample)).join(docs_of(sample).select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out)


# Scores under the class model.


def brute_base(rows):
    split = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in split(t))
    n, v = sum(c.values()), len(c)
    return n, {i: (len(split(t)), sum(c[w] > 0 for w in split(t)), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in split(t))) for i, t in rows}


@pytest.mark.parametrize("hot", [0, 3, 1000])
def test_base_scores(docs_of, hot):
    """With no hot word, a few, or all: what is broadcast doesn't change the scores."""
    rows = [(k, " ".join(f"w{(k * j) % 23}" for j in range(k % 30))) for k in range(60)] + [(100, None), (101, ""), (102, "W1 unseen unseen É É"), (103, "W1 w1\x0bw1")]
    n, want = brute_base(rows)
    for r in brown_lm.score_texts(docs_of(rows), classes=3, exchanged_words=hot, hot_words=hot).collect():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (*want[r.doc_id][:2], n)
        assert r.base_score == pytest.approx(want[r.doc_id][2], abs=1e-9)


def test_scores_do_not_depend_on_what_is_broadcast(docs_of):
    rows = [(k, " ".join(f"w{(k * j) % 23}" for j in range(k % 30))) for k in range(60)]
    few, many = ({r.doc_id: r.score for r in brown_lm.score_texts(docs_of(rows), classes=3, exchanged_words=5, hot_words=h).collect()} for h in (5, 1000))
    assert few == pytest.approx(many)


def hashed(word):
    return int(brown_lm.tokens(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word.encode())]))[0][0])


@pytest.mark.parametrize(("exchanged", "hot"), [(0, 0), (6, 10), (1000, 1000)])
def test_scores_match_brute_force(docs_of, exchanged, hot):
    """Given the learned classes, counts, transitions and scores follow in plain Python; each seen word has a class."""
    rows = [(k, " ".join(f"w{(k * j * j) % 29}" for j in range(k % 40)) + f" once{k}") for k in range(70)] + [(200, None), (201, "new words w1 new"), (202, "w1 " * 500 + "w2")]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    split = lambda t: (t or "").split()
    train = [split(t) for i, t in rows if not held(i)]
    model, others = brown_lm.fit(docs_of([(i, t) for i, t in rows if not held(i)]).select("text"), 3, exchanged, hot)
    found = {r.word % 2**64: (r.n, r["class"]) for r in others.collect()}
    moved = {int(w): (int(n), int(c)) for w, n, c in zip(model.word, model.n, model.cls, strict=True) if int(w) not in found}
    count = Counter(w for t in train for w in t)
    cls = {}
    for w, n in count.items():
        known, cls[w] = (moved | found)[hashed(w)]
        assert known == n and (cls[w] == 3) == (n == 1 and hashed(w) in found)
    assert len(moved) + len(found) == len(count) and (len(moved) > 0) == (exchanged > 0)
    is_moved = lambda w: w is None or hashed(w) in moved
    cls[None] = 4
    rest = Counter(cls[w] for t in train for w in t if not is_moved(w))
    total = sum(rest.values())
    table = np.zeros((5, 5))
    for t in train:
        for x, y in zip([None, *t], [*t, None], strict=True):
            if is_moved(x) or is_moved(y):
                table[cls[x], cls[y]] += 1
            else:
                table[cls[x]] += [rest[c] / total for c in range(5)]
    step = np.log10((table + 1) / (table.sum(1, keepdims=True) + 5))
    n_class, v_class = np.zeros(5), np.zeros(5)
    for w, n in (count | {None: len(train)}).items():
        n_class[cls[w]] += n
        v_class[cls[w]] += 1
    n_class[3] += 0.5
    emit = lambda w: math.log10(((len(train) if w is None else count[w]) + 0.5) / (n_class + v_class / 2)[cls.get(w, 3)])
    for r in brown_lm.score_texts(docs_of(rows), 3, exchanged, hot).collect():
        t = split(dict(rows)[r.doc_id])
        want = sum(step[cls.get(x, 3), cls.get(y, 3)] + emit(y) for x, y in zip([None, *t], [*t, None], strict=True))
        assert r.score == pytest.approx(want, abs=1e-8)
    # After each class, all words, one unseen word and the end sum to one.
    filled = v_class > 0
    share = [sum(10 ** emit(w) for w in cls if cls[w] == c) + (c == 3) * 0.5 / (n_class + v_class / 2)[3] for c in range(5)]
    assert np.array(share)[filled] == pytest.approx(1)


@pytest.mark.parametrize("exchanged", [4, 1000])
def test_words_of_one_context_come_to_one_class(docs_of, exchanged):
    """Words after "a" and words after "b" are told apart, by exchange or by the one step of the other words."""
    number = lambda k, j: 0 if j % 2 else 1 + (k + j) % 8
    rows = [(k, " ".join(f"a x{number(k, j)} b y{number(3 * k, j)}" for j in range(20))) for k in range(60)]
    model, others = brown_lm.fit(docs_of(rows).select("text"), 4, exchanged, 1000)
    of = {int(w): int(c) for w, c in zip(model.word, model.cls, strict=True)}
    x, y = ({of[hashed(f"{c}{j}")] for j in range(9)} for c in "xy")
    assert max(x | y) < 4 and not x & y and model.total == sum(len(t.split()) + 1 for _, t in rows)


def test_contexts_of_a_key_in_two_batches_of_which_one_counts_nothing():
    def batch(key, others):
        return pa.RecordBatch.from_pydict({"key": pa.array([key], pa.int64()), "other": pa.array([others], pa.list_(pa.int32())), "n": pa.array([[2] * len(others)], pa.list_(pa.int32()))})

    frames = [batch(7, [1, 3]), batch(7, [5]), batch(7, []), batch(8, [1])]
    got = {}
    for key, met, _ in brown_lm._contexts(iter(frames), lambda pairs, other: np.where(other < 4, other, -1), 4):
        got |= {int(k): m.tolist() for k, m in zip(key, met, strict=True)}
    assert got == {7: [0.0, 2.0, 0.0, 2.0], 8: [0.0, 2.0, 0.0, 0.0]}


def test_exchange_never_lowers_the_likelihood(docs_of):
    rng = np.random.default_rng(1)
    rows = [(k, " ".join(f"w{min(rng.geometric(0.08), 40)}" if j % 2 else f"v{min(rng.geometric(0.2), 12)}" for j in range(60))) for k in range(80)]
    texts = docs_of(rows).select("text")
    n = brown_lm.count_words(texts).where(f"word != {int(brown_lm.END)}").toPandas()
    lexicon = brown_lm.Lexicon(n["word"].to_numpy(np.int64).view(np.uint64), n["n"].to_numpy())
    near = brown_lm.neighbours(texts, lexicon, salts=3)
    x = lambda a: (a * np.log(np.maximum(a, 1))).sum()
    seen = []
    for rounds in (0, 1, 6):
        table = brown_lm.Exchange(near, lexicon, 5).run(most_rounds=rounds)
        assert table.sum() == sum(len(t.split()) + 1 for _, t in rows)
        seen.append(x(table) - x(table.sum(1)) - x(table.sum(0)))
    assert seen == sorted(seen) and seen[-1] > seen[0]


def test_class_model_beats_unigrams_on_held_out_text(docs_of, sample):
    out = [r for r in brown_lm.score_texts(docs_of(sample)).collect() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_lm_empty_and_long(docs_of):
    assert brown_lm.score_texts(docs_of([])).count() == 0
    rows = [(None, "a b"), (1, "a b"), (1, "a b"), (2, "a " * 300_000)]
    out = brown_lm.score_texts(docs_of(rows), exchanged_words=0, hot_words=0).collect()
    assert sorted(r.n_tokens for r in out) == [3, 3, 3, 300_001] and all(r.score < 0 for r in out)


# Personal data.

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_spans(text):
    out = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            fits = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if fits:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["1", "9", ".", "@", "a.b", "+", "-", " ", "(", "4111 1111 1111 1111", "12", "x@y.z", "%", "255", "é", "0", "@a-b.c."]), max_size=40).map("".join))
def test_base_spans(text):
    assert [s[:3] for s in pii.find_spans(text) if s.base] == base_spans(text)


def test_added_kinds_need_a_checksum_or_context():
    iban, ssn = "GB82 WEST 1234 5698 7654 32", "123-45-6789"
    kinds = lambda t: [s.kind for s in pii.find_spans(t) if not s.base]
    assert kinds(f"pay to {iban} now") == ["iban"] and kinds(f"pay to {iban[:-1]}3 now") == []
    assert kinds(f"code {ssn}") == [] and kinds(f"my SSN is {ssn}") == ["ssn"]
    assert kinds("call (212) 555-0199") == ["local_phone"] and kinds("item 212-555-0199") == []
    spans = pii.find_spans("mail a@b.co or +1 212 555 0199")
    assert pii.redact("mail a@b.co or +1 212 555 0199", spans) == "mail [EMAIL] or [PHONE]"


def test_long_runs_are_read_once():
    for run in ("9" * 300_000, "a" * 300_000, "1." * 150_000, "+1" + "(" * 300_000, "9 " * 150_000):
        pii.find_spans(run)


def test_context_words_are_whole_words():
    kinds = lambda t: [s.kind for s in pii.find_spans(t) if not s.base]
    assert kinds("hotel 555-123-4567") == [] and kinds("tel 555-123-4567") == ["local_phone"]
    plain, described, hosted = (pii.find_spans(f"{w} 10.0.0.1")[0].score for w in ("x", "the recipient's description", "host"))
    assert plain == described < hosted


def test_iban_ends_with_its_country_s_length():
    found = lambda t: [(s.start, s.end) for s in pii.find_spans(t) if s.kind == "iban"]
    assert found("BE68 5390 0754 7034 PAID") == [(0, 19)] and found("iban BE68539007547034, and") == [(5, 21)]
    assert found("BE68 5390 0754 7035") == [] and found("ZZ68 5390 0754 7034") == [] and found("BE685390075470341") == []


def test_secrets_need_a_context_and_many_characters():
    run = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    kinds = lambda t: [s.kind for s in pii.find_spans(t) if not s.base]
    assert kinds(f'token = "{run}"') == ["secret"] and kinds(f"api_key: {run}") == ["secret"]
    assert kinds(run) == [] and kinds("token " + "a1" * 20) == [] and kinds("token " + "abcdefghij" * 4) == []


def test_added_spans_keep_clear_of_every_base_span():
    """More than four base spans of other kinds lie over the added one."""
    text = "call " + "+1 (212) 555-0199 " * 6 + "ssn 219-09-9999 mail " + "a.219-09-9999@b.co"
    spans = pii.find_spans(text)
    base = [(s.start, s.end) for s in spans if s.base]
    added = [(s.start, s.end) for s in spans if not s.base]
    assert added and all(e <= a or s >= b for a, b in base for s, e in added)


def test_personal_data_rows(docs_of):
    rows = [(1, None), (2, ""), (3, "x@y.zz +1234567890"), (3, "x@y.zz +1234567890")]
    out = sorted(tuple(r) for r in pii.digest_columns(pii.find_personal_data(docs_of(rows))).collect())
    assert [(r[0], *r[1:5], r[6]) for r in out] == [(1, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, "")] + [(3, 1, 0, 0, 1, "email:0:6,phone:7:18")] * 2
    assert pii.find_personal_data(docs_of([])).count() == 0


# Byte-level BPE.


@pytest.fixture(scope="module")
def coders():
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") if x.strip())}
    return bpe.Encoder(ranks, public_tokenizers.PATTERN, most_kept=50, most_pairs=50), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="abcehinorst ", max_size=200), st.text(alphabet="aéß漢 \n'0", max_size=80)))
def test_ids_are_those_of_the_library(coders, text):
    ours, library = coders
    ids = ours.encode(text)
    assert ids == np.array(library.encode_ordinary(text), "<u4").tobytes() and ours.decode(ids) == text.encode()


def test_long_pieces_take_linear_time(coders):
    ours, library = coders
    for text in ("a" * 3000, "ab" * 1500, "th" * 900 + "zq" * 100):
        assert ours.encode(text) == np.array(library.encode_ordinary(text), "<u4").tobytes()
    assert ours.decode(ours.encode("ab" * 100_000)) == b"ab" * 100_000


def test_a_small_vocabulary_against_plain_merging():
    ranks = {bytes([k]): k for k in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cab": 259, b"aa": 260, b"aaa": 261, b"bcab": 262}
    coder = bpe.Encoder(ranks, r"[a-c]+")
    for n in range(3**7):
        text = "".join("abc"[n // 3**k % 3] for k in range(7))
        assert tuple(coder.encode_piece(text.encode())) == bpe.merge_plainly(text.encode(), ranks)


def test_bpe_rows(spark, docs_of, coders):
    ranks = bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    assert ranks == bpe.read_ranks(spark, "file://" + public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    rows = [(1, None), (2, ""), (3, "héllo  world"), (3, "héllo  world")]
    out = {r.doc_id: (r.token_ids, r.decoded) for r in bpe.encode_documents(docs_of(rows), ranks, public_tokenizers.PATTERN).collect()}
    assert out[1] == out[2] == (b"", b"") and out[3] == (coders[0].encode("héllo  world"), "héllo  world".encode())
    assert bpe.encode_documents(docs_of([]), ranks, public_tokenizers.PATTERN).count() == 0


def test_offsets_of_sliced_columns():
    import pyarrow as pa

    data, offsets = text_bytes(pa.array(["xx", "é", None, "b"]).slice(1))
    assert data.tobytes() == "éb".encode() and offsets.tolist() == [0, 2, 2, 3]
