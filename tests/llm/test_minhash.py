import random
from collections import defaultdict

import numpy as np
import pytest

from quillstone.llm import common, minhash as M, registry
from quillstone.plans.components import connected


def sets_of(rows):
    out = {}
    for k in range(0, len(rows), 50):
        part = rows[k : k + 50]
        for first, per, s, _ in M.shingle_chunks([t for _, t in part]):
            for j, p in enumerate(np.split(s, np.cumsum(per)[:-1])):
                out[part[first + j][0]] = set(p.tolist())
    return out


def plain_shingles(text):
    import re

    w = [x.group() for x in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", text.casefold().encode())]
    return {tuple(w[i : i + M.SHINGLE]) for i in range(max(len(w) - M.SHINGLE + 1, 1))} if w else set()


def components_of(pairs):
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for p in pairs for x in p}


def brute(rows, threshold=M.THRESHOLD):
    s = {i: plain_shingles(t) for i, t in rows}
    return [(a, b) for a in s for b in s if a < b and s[a] and s[b] and len(s[a] & s[b]) / len(s[a] | s[b]) >= threshold]


def test_shingle_hashes_stand_for_word_grams():
    texts = ["a b c d a b c", "", "one", "Two WORDS", "?!", "x " * 5000, "é ß ü"]
    got = sets_of(list(enumerate(texts)))
    assert [len(got[i]) for i in range(len(texts))] == [len(plain_shingles(t)) for t in texts]
    assert sets_of([(0, "The cat, SAT down")])[0] == sets_of([(0, "the cat sat -- down")])[0]


def test_pieces_of_long_texts_hash_as_one(monkeypatch):
    text = " ".join(f"w{i % 700}" for i in range(20000))
    want = [h for _, _, h in common.word_hashes([text, "a b"])]
    monkeypatch.setattr(common.chunks, "__defaults__", (1000,))
    got = [h for _, _, h in common.word_hashes([text, "a b"])]
    assert np.array_equal(np.concatenate(want), np.concatenate(got))


def test_signature_agreement_estimates_jaccard():
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    for keep in (0.95, 0.8, 0.5):
        other = [w if rng.random() < keep else f"z{rng.randrange(10**6)}" for w in base]
        found = list(M.shingle_chunks([" ".join(base), " ".join(other)]))
        per, s = np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])
        sig = M.signatures(per, s)
        a, b = (set(x.tolist()) for x in np.split(s, [per[0]]))
        true = len(a & b) / len(a | b)
        assert (sig[0] == sig[1]).mean() == pytest.approx(true, abs=0.15)
        sk = M.sketch(sig).view(np.uint64)
        assert M.similar(sk[:1], sk[1:])[0] == pytest.approx(true, abs=0.2)


def test_sigma_and_pi_are_permutations():
    x = np.arange(1 << 16, dtype=np.uint32) * np.uint32(65537)
    assert len(np.unique(M._sigma(x))) == len(x) and len(np.unique(M._pi(x.copy(), np.empty_like(x)))) == len(x)


def test_against_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = components_of(brute(rows))
    got = {r.doc_id: r.cluster_id for r in registry.QUERIES["op7_minhash_near_dedup"](spark, small).collect()}
    assert got == want and want


def test_planted_groups_and_shared_passages(spark, docs):
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(10**5)}"
    passage = [word() for _ in range(60)]
    rows, clean = [], []
    for i in range(120):  # a passage that many share makes no group
        rows.append((i, " ".join([word() for _ in range(70)] + passage + [word() for _ in range(70)])))
        clean.append(i)
    for g in range(6):
        base = [word() for _ in range(200)]
        for k in range(2 + 8 * g):
            rows.append((1000 * (g + 1) + k, " ".join(w if rng.random() > 0.05 or k == 0 else word() for w in base)))
    rows += [(9000 + k, "  Exactly the, SAME text\nhere." if k % 2 else "exactly the same text here") for k in range(30)]
    rng.shuffle(rows)
    d = docs(*rows)
    got = {r.doc_id: r.cluster_id for r in M.groups(d.repartition(5)).collect()}
    assert not set(clean) & set(got)
    true = brute(rows)
    assert sum(got.get(a) == got.get(b, -1) for a, b in true) >= 0.99 * len(true)
    by = defaultdict(set)
    for i, c in got.items():
        by[c].add(i)
    assert all(c == min(m) for c, m in by.items()) and by[9000] == {9000 + k for k in range(30)}
    kept = {r.doc_id for r in M.dedup(d).collect()}
    assert kept == {i for i, _ in rows} - {i for i, c in got.items() if i != c}


def test_bucket_compares_what_is_unsure_with_all():
    rng = np.random.default_rng(0)
    ids = np.arange(40)
    sk = rng.integers(0, 1 << 62, (40, 4)).astype(np.uint64)
    sk[21] = sk[20]
    sk[5] = sk[0]
    pairs = {(int(a), int(b)) for x, y in M._bucket(ids, sk, 0.5, 0.7) for a, b in zip(x, y)}
    assert pairs == {(0, 5), (20, 21)}


def test_nulls_empty_ties_repeats_and_other_columns(docs, clashing):
    t = "one two three four five"
    d = clashing(docs((None, t), (1, None), (2, ""), (3, "?!"), (4, ""), (9, t), (5, t), (7, "x y"), (7, "x y"), (8, "X, y"), (10, "lone words stand here")))
    got = {r.doc_id: (r.cluster_id, r.kept) for r in M.groups(d).collect()}
    assert got == {5: (5, True), 9: (5, False), 7: (7, True), 8: (7, False)}
    kept = M.dedup(d)
    assert kept.columns == d.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 10]
    assert M.groups(docs()).count() == 0 and M.dedup(docs()).count() == 0


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(20)] + [(50, 52, 1.0)], "a long, b long, jaccard double")
    assert {r.id: r.label for r in connected(e).collect()} == {i: 0 for i in range(21)} | {50: 50, 52: 50}


def test_leads_dealt_out_and_small_batches_give_the_same(spark, docs, monkeypatch):
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**5)}" for _ in range(120)]
    rows = [(i, " ".join(w if rng.random() > 0.03 else f"z{rng.randrange(10**6)}" for w in base)) for i in range(150)] + [(500 + i, f"lone {i} words {i * i} of no {i + 7} group") for i in range(20)]
    d = docs(*rows)
    want = components_of(brute(rows))
    monkeypatch.setattr(M, "SHARE", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r.doc_id: r.cluster_id for r in M.groups(d).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and len(got) == 150


def test_ids_of_other_types(docs):
    d = docs((1, "one two three"), (2, "one two three"), (3, "four")).selectExpr("concat('d', doc_id) AS doc_id", "text")
    assert sorted((r.doc_id, r.cluster_id, r.kept) for r in M.groups(d).collect()) == [("d1", "d1", True), ("d2", "d1", False)]
    assert sorted(r.doc_id for r in M.dedup(d).collect()) == ["d1", "d3"]
