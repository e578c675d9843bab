import math
from collections import Counter

import numpy as np
import pytest

from quillstone.llm import ngram_lm as N, registry


def brute(texts):
    """Scores from exact counts of exact n-grams less one, quantised alike."""
    c, total = Counter(), 0
    for t in texts:
        for w in N.tokens(t or ""):
            p = "\2" + w + "\3"
            total += len(w) + 1
            for i in range(len(p)):
                for k in range(1, N.ORDER + 1):
                    if i - k + 1 >= 0:
                        c[p[i - k + 1 : i + 1]] += 1
    val = {g: float(N.value(N.level(np.array(n - 1)))) for g, n in c.items()}

    def score(text):
        s = 0.0
        for w in N.tokens(text or ""):
            p = "\2" + w + "\3"
            for i in range(1, len(p)):
                prob = (val.get(p[i], 0.0) + 0.5) / (total + 1)
                for k in range(2, min(N.ORDER, i + 1) + 1):
                    ctx = val.get(p[i - k + 1 : i], 0.0)
                    if ctx > 0:
                        prob = N.LAMBDA * min(val.get(p[i - k + 1 : i + 1], 0.0) / ctx, 1.0) + (1 - N.LAMBDA) * prob
                s += math.log2(min(prob, 1.0))
        return s

    return score, c, total


def test_against_brute_force(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: r.text for r in d.collect()}
    score, _, _ = brute(rows.values())
    many = N.train(d, bits=60)  # next to no false positives
    got = {r.doc_id: r.log2_prob for r in N.score(d, model=many).collect()}
    assert got == pytest.approx({i: score(t) for i, t in rows.items()}, rel=1e-6)
    usual = {r.doc_id: r.log2_prob for r in registry.QUERIES["op2_lm_scoring"](spark, small).collect()}
    assert len(usual) == len(rows) and usual == pytest.approx(got, rel=0.03)


def test_levels_are_never_understated(spark, docs):
    texts = ["the cat and the dog", "the the the", "ça été"]
    _, c, total = brute(texts)
    m = N.train(docs(*enumerate(texts))).filter()
    assert m.total == total
    for gram, n in c.items():
        h, _ = N.grams(np.array([ord(x) for x in gram], np.uint32), np.arange(len(gram)), len(gram))
        assert m.levels(h)[-1] >= N.level(np.array(n - 1))


def test_false_positives_are_rare():
    rng = np.random.default_rng(0)
    h = np.unique(rng.integers(0, 1 << 63, 200_000).astype(np.uint64) * np.uint64(2))
    key = N.keys(h, 3)
    parts = {b: N.enter(key[lo:hi], np.full(hi - lo, 1)) for b, lo, hi in N.by_bucket(key, 3)}
    f = N.Filter(parts, 3, 1.5)
    assert len(parts) == 8 and (f.levels(h) >= 1).all()
    assert (f.levels(rng.integers(0, 1 << 63, 100_000).astype(np.uint64)) > 0).mean() < 0.01


def test_packing_of_counts_is_exact():
    key = np.array([3, 7, 9], np.uint64)
    x = N.unplanes(N.planes(N.packed(key, np.array([1, (1 << 24) + 5, 1 << 26]))))
    assert (np.diff(x >> np.uint64(24)).astype(np.int64) >= 0).all()
    assert [int((x[x >> np.uint64(24) == k] & N._MOST).sum()) for k in key] == [1, (1 << 24) + 5, 1 << 26]


def test_junk_is_less_likely_than_text(spark, docs, small):
    d = spark.read.parquet(f"{small}/documents.parquet")
    m = N.train(d)
    r = {x.doc_id: x.bits_per_char for x in N.score(docs((1, "the and of that with"), (2, "xq zzkj wvvq qqx")), model=m).collect()}
    assert r[1] < r[2]


def test_a_filter_too_large_to_broadcast_gives_the_same_scores(spark, small, clashing):
    d = spark.read.parquet(f"{small}/documents.parquet")
    d = d.unionByName(d.where("doc_id < 9")).unionByName(spark.createDataFrame([(None, "", "en", "s", 0), (None, None, "en", "s", 0)], d.schema))
    m = N.train(d, bucket_chars=20_000)
    assert m.depth > 3 and m.size > 1000
    one, two = (sorted(N.score(clashing(d), model=m, **kw).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.n_symbols)) for kw in ({}, {"max_bytes": 1000, "chunk_chars": 50_000}))
    assert one == two and len(one) == d.count()


def test_bits_for_an_entry_do_not_depend_on_size(docs):
    def entries(n):  # of the words and of their characters
        text = [f"word{i}" for i in range(n)] * 2
        return sum(int(N.level(np.array(c - 1))) for c in [*brute(text)[1].values(), *Counter(text).values()])

    few, many = (N.train(docs(*[(i, f"word{i} word{i}") for i in range(n)])) for n in (50, 500))
    assert many.size > 5 * few.size and abs(many.size * 8 / entries(500) - few.size * 8 / entries(50)) < N.BITS / 2


def test_documents_that_occur_twice_stand_apart(spark, docs):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 80) % 5000) for _ in range(300)]
    r = {x.doc_id: x.bits_per_word for x in N.score(docs(*enumerate(texts), *((1000 + i, texts[i]) for i in range(20)))).collect()}
    assert max(r[i] for i in range(20)) < min(r[i] for i in range(20, 300))


def test_nulls_empty_repeats_long_and_other_columns(docs, clashing):
    d = clashing(docs((None, "ab cd"), (1, None), (2, ""), (3, " \n\t "), (4, "ab cd"), (4, "ab cd"), (5, "x" * 300000 + " ab"), (6, " ab  cd ")))
    got = N.score(d).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_symbols, round(r.log2_prob, 6), r.bits_per_char))
    assert by[1] == by[2] == by[3] == [(0, 0.0, None)]
    assert by[4][0] == by[4][1] == by[None][0] == by[6][0] and by[4][0][0] == 6 and by[5][0][0] == 300004
    assert N.score(docs()).count() == 0


def test_words_are_scored_in_their_order(spark, docs, small):
    """The model of words, from exact counts; shuffled words are less likely than the text."""
    import random

    d = spark.read.parquet(f"{small}/documents.parquet")
    m = N.train(d, bits=60)  # next to no false positives
    f = m.filter()
    texts = [N.tokens(r.text or "") for r in d.collect()]
    c, total = Counter(), 0
    for w in filter(None, texts):
        w = ["<", *w, ">"]
        total += len(w) - 1
        c.update(tuple(w[i - k + 1 : i + 1]) for k in (1, 2, 3) for i in range(k - 1, len(w)))
    assert m.n_words == total
    val = {g: float(N.value(N.level(np.array(n - 1)))) for g, n in c.items()}

    def score(w):
        bits, out, w = dict(zip(w, N.word_bits(w, f.levels, f.total))), 0.0, ["<", *w, ">"]
        for i in range(1, len(w)):
            p = 0.5 / (total + 1) if w[i] == ">" else 2.0 ** bits[w[i]]
            for k in range(1, min(3, i + 1) + 1):
                ctx = val.get(tuple(w[i - k + 1 : i]), 0.0) if k > 1 else total
                if ctx > 0:
                    p = N.LAMBDA * min(val.get(tuple(w[i - k + 1 : i + 1]), 0.0) / ctx, 1.0) + (1 - N.LAMBDA) * p
            out += math.log2(p)
        return out

    some = [w for w in texts if 20 <= len(w) <= 300][:20]
    mixed = [random.Random(1).sample(w, len(w)) for w in some]
    r = {x.doc_id: x for x in N.score(docs(*enumerate(" ".join(w) for w in some + mixed)), model=m).collect()}
    for i, w in enumerate(some + mixed):
        assert r[i].n_words == len(w) and r[i].word_log2_prob == pytest.approx(score(w), rel=1e-6)
    assert all(r[i].log2_prob == pytest.approx(r[i + len(some)].log2_prob) and r[i].bits_per_word < r[i + len(some)].bits_per_word for i in range(len(some)))


def test_the_corpus_by_itself_is_scored_as_by_its_broadcast_filter(spark, small, clashing, monkeypatch):
    """Rows repeated often, null ids, no text; many buckets and chunks; nothing is broadcast, whatever the size."""
    d = spark.read.parquet(f"{small}/documents.parquet")
    none = spark.createDataFrame([(None, "", "en", "s", 0), (None, None, "en", "s", 0), (None, "ab ab", "en", "s", 5), (3, " \n", "en", "s", 2)], d.schema)
    d = d.unionByName(d.where("doc_id < 9")).unionByName(none).unionByName(spark.range(50).selectExpr("7L doc_id", "'twice said is said twice' text", "'en' lang", "'s' source", "24L n_chars"))
    monkeypatch.setattr(N, "BUCKET_CHARS", 20_000)
    m = N.train(d, bucket_chars=20_000)
    assert m.depth > 3
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_symbols, r.n_words)
    want = sorted(N.score(d, model=m).collect(), key=key)

    def broadcast(*_):
        raise AssertionError("a filter was broadcast")

    monkeypatch.setattr(N.Model, "filter", broadcast)
    got = sorted(N.score(clashing(d), chunk_chars=50_000).collect(), key=key)
    assert got == want and len(got) == d.count()


def test_what_is_sent_is_small():
    """4 bytes for an n-gram at 30,000 to a bucket and chunk, near the 3.5 that random keys need."""
    rng = np.random.default_rng(8)
    key = np.unique(rng.integers(0, 1 << 40, 30_000).astype(np.uint64))
    x = N.packed(key, np.where(rng.random(len(key)) < 0.1, 2, 1))
    assert (N.unplanes(N.planes(x)) == x).all() and len(N.planes(x)) < 4 * len(x)
    assert len(N.unplanes(N.planes(x[:0]))) == 0
