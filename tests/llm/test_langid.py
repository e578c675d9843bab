import random

import numpy as np
import pytest

from quillstone.llm import langid as L, registry


@pytest.fixture(scope="module")
def rows(spark, small):
    return [(r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def model(rows):
    return L.train(rows[:700])


def test_held_out_accuracy_and_calibration(rows, model):
    lang, conf, known, ok = L.predict(model, [t for t, _ in rows[700:]])
    right = np.array([a == b for a, (_, b) in zip(lang, rows[700:])])
    assert right.mean() > 0.97 and (~ok).mean() < 0.02
    assert abs(conf.mean() - right.mean()) < 0.05
    assert 1 / len(model.langs) <= model.confidence <= L.MAX_CONFIDENCE


@pytest.mark.parametrize("text", ["", "  ", "12345 678 !!!", "### %%%", "Съешь ещё этих мягких французских булок, да выпей чаю. " * 5, "你好世界这是一个测试文本" * 5])
def test_rejects_what_is_no_known_language(model, text):
    lang, conf, _, ok = L.predict(model, [text])
    assert not ok[0] and (lang[0] == "und") == (not any(c.isalpha() for c in text))


def test_sums_against_plain_hashing(model):
    """Every n-gram of every word, looked up one at a time."""
    text = "Ab cde, ÉTé x9y"
    words = ["ab", "cde", "été", "x", "y"]
    mask, want, n = 0xFFFFFFFF, np.zeros(model.table.shape[1]), 0
    for w in words:
        p = [32, *map(ord, w), 32]
        for order in L.ORDERS:
            for i in range(len(p) - order + 1):
                mixed = [(c * 0x9E3779B1 & mask) for c in p[i : i + order]]
                mixed = [m ^ (m >> 15) for m in mixed]
                h = mixed[0]
                for m in mixed[1:]:
                    h = (h * 0x85EBCA77 + m) & mask
                b = h ^ (h >> 13)
                b = (b * 0xC2B2AE3D & mask) >> (32 - L.BUCKETS.bit_length() + 1)
                want += model.table[b]
                n += 1
    s, k = L.totals(["zz top", text], model.table)
    assert k[1] == n and np.allclose(s[1], want)


def test_batches_and_long_texts_do_not_matter(rows, model, monkeypatch):
    texts = [t for t, _ in rows[:40]]
    s, n = L.totals(texts, model.table)
    one = [L.totals([t], model.table) for t in texts]
    assert np.allclose(s, [x[0][0] for x in one]) and np.allclose(n, [x[1][0] for x in one])
    long = " ".join(texts) + "xyz" * 9000  # and a word longer than a piece
    want = L.totals([long], model.table)
    monkeypatch.setattr(L, "CHUNK", 3000)
    monkeypatch.setattr(L, "LONG", 12000)
    for size in (2999, 3000, 3001, 3002, 3003):
        monkeypatch.setattr(L, "CHUNK", size)
        got = L.totals([long], model.table)
        assert np.array_equal(got[1], want[1]) and np.allclose(got[0], want[0], rtol=1e-9)
    alone, after = L.totals([long, "a"], model.table), L.totals(["a", long], model.table)
    assert np.array_equal(alone[0][0], after[0][1]) and np.array_equal(alone[1][0], after[1][1])


def plain(model, text):
    """Softmax of the mean of the rows of every n-gram of every word, looked up one at a time."""
    mask, total, n = 0xFFFFFFFF, np.zeros(model.table.shape[1]), 0
    word: list[int] = [32]
    for c in [*L._table()[[ord(c) for c in text]].tolist(), 32] if text else [32]:
        word.append(c)
        if c != 32:
            continue
        if len(word) > 2:
            for order in L.ORDERS:
                for i in range(len(word) - order + 1):
                    mixed = [(x * 0x9E3779B1 & mask) for x in word[i : i + order]]
                    mixed = [m ^ (m >> 15) for m in mixed]
                    h = mixed[0]
                    for m in mixed[1:]:
                        h = (h * 0x85EBCA77 + m) & mask
                    total += model.table[((h ^ (h >> 13)) * 0xC2B2AE3D & mask) >> (32 - L.BUCKETS.bit_length() + 1)]
                    n += 1
        word = [32]
    if not n:
        return "und", 0.0, False
    z = np.exp((total[:-1] / n + model.bias) / model.temperature)
    best = int(z.argmax())
    return model.langs[best], z[best] / z.sum(), z[best] / z.sum() >= model.confidence and total[-1] / n >= model.known


def test_query_against_plain_loops(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet")
    model = L.fit(d)
    got = {r.doc_id: r for r in registry.QUERIES["op1_language_id"](spark, small).collect()}
    rows = [r for r in d.collect() if len(r.text) < 4000]
    assert len(got) == d.count() and len(rows) > 150
    for r in rows:
        lang, conf, ok = plain(model, r.text)
        assert (got[r.doc_id].predicted_lang, got[r.doc_id].accepted) == (lang, ok) and got[r.doc_id].confidence == pytest.approx(conf, abs=1e-5)


def test_whole_table(spark, small):
    got = registry.QUERIES["op1_language_id"](spark, small)
    assert got.columns == ["doc_id", "predicted_lang", "confidence", "known_share", "accepted"]
    assert got.count() == spark.read.parquet(f"{small}/documents.parquet").count()


def test_same_sample_for_any_partitions(spark, docs):
    rng = random.Random(1)
    d = docs(*[(i, " ".join(rng.choices(["uno dos", "one two", "tres", "three"], k=9)), "en" if i % 2 else "es") for i in range(300)])
    a, b = L.fit(d, rows=100), L.fit(d.repartition(7, "text"), rows=100)
    assert a.confidence == b.confidence and np.array_equal(a.table, b.table)


def test_nulls_empty_repeats_and_other_columns(docs, clashing, model):
    d = clashing(docs((None, "the of and that"), (1, None), (2, ""), (3, "the of and that"), (3, "the of and that"), (4, "the and " * 300000), (5, "le la de une", None)))
    got = {}
    for r in L.classify(d, model=model).collect():
        got.setdefault(r.doc_id, []).append((r.predicted_lang, r.accepted))
    assert got[1] == got[2] == [("und", False)] and len(set(got[3])) == 1 and len(got[3]) == 2 and got[None] == got[3][:1]
    kept = L.accepted_rows(d, model=model)
    assert kept.columns == d.columns and kept.schema.fieldNames() == d.schema.fieldNames()
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(k or 0 for k, v in got.items() for _, ok in v if ok)
    assert L.classify(docs(), model=model).count() == 0 and L.classify(docs()).count() == 0


def test_without_labels_everything_is_rejected(docs):
    got = L.classify(docs((1, "some text", None))).collect()
    assert [(r.predicted_lang, r.accepted) for r in got] == [("und", False)]
