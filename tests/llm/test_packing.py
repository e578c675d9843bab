import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from quillstone.llm import packing as P, registry


def check(rows, lengths, window):
    """Every token is packed once, no window is overfull, no slots overlap. Returns the share of the windows that is used."""
    per, wins = defaultdict(list), defaultdict(list)
    for r in rows:
        if r.window_id is None:
            assert r.n_tokens == 0
            continue
        per[r.doc_id].append((r.first_token, r.n_tokens))
        wins[r.window_id].append((r.window_offset, r.n_tokens))
    for d, n in lengths.items():
        at = 0
        for s, k in sorted(per[d]):
            assert s == at and 0 < k <= window
            at += k
        assert at == n
    for w in wins.values():
        end = 0
        for o, k in sorted(w):
            assert o >= end
            end = o + k
        assert end <= window
    assert sorted(wins) == list(range(len(wins)))
    return sum(lengths.values()) / max(1, len(wins) * window)


def first_fit(lengths, window):
    left = []
    for n in sorted((p for x in lengths for p in [window] * (x // window) + [x % window] if p), reverse=True):
        for i, free in enumerate(left):
            if free >= n:
                left[i] -= n
                break
        else:
            left.append(window - n)
    return len(left)


def test_whole_table(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet")
    lengths = {r.doc_id: len(r.text.split()) for r in d.collect()}
    rows = registry.QUERIES["op6_packing"](spark, small).collect()
    used = check(rows, lengths, P.WINDOW)
    n = max(r.window_id for r in rows) + 1
    assert used > 0.9 and n <= 1.06 * first_fit(lengths.values(), P.WINDOW) + 1


def test_full_use_where_lengths_are_many():
    rng = np.random.default_rng(1)
    h = Counter((np.clip(rng.gamma(1.2, 25, 100_000).astype(int), 0, 127) + 1).tolist())
    p = P.plan(h)
    assert sum(b * n for b, n in h.items()) / 128 / sum(n for _, n in p) > 0.999


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 16), st.integers(1, 10**9), max_size=16))
def test_plan_uses_the_histogram_exactly(h):
    got = Counter()
    for pattern, n in P.plan(h, bins=16):
        assert n > 0 and sum(pattern) <= 16
        for b in pattern:
            got[b] += n
    assert got == Counter(h)


def test_combinations_against_enumeration():
    want = {(a,) for a in [12]} | {(a, 12 - a) for a in range(6, 12)} | {(a, b, 12 - a - b) for a in range(1, 12) for b in range(1, a + 1) if 1 <= 12 - a - b <= b}
    assert set(P.combinations(12)) == want and len(P.combinations(12)) == len(want)


def test_nnls_against_its_conditions():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, y = rng.random((12, 30)), rng.random(12)
        x = P.nnls(a, y)
        g = a.T @ (a @ x - y)
        assert (x >= 0).all() and (g > -1e-6).all() and abs(g @ x) < 1e-6


def test_partitions_do_not_matter(docs):
    rng = random.Random(3)
    d = docs(*[(i, "w " * rng.randint(0, 300)) for i in range(150)])
    a, b = (sorted(map(str, P.pack(x, window=256, bins=32).collect())) for x in (d, d.repartition(9, "text")))
    assert a == b


def test_nulls_empty_repeats_long_and_other_columns(docs, clashing):
    d = clashing(docs((None, "a b"), (1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "w " * 100001)))
    rows = P.pack(d).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows if r.doc_id != 4) == [(0, 2), (1, 0), (2, 0), (3, 2), (3, 2)]
    assert sum(r.n_tokens for r in rows) == 100001 + 6 and len({(r.window_id, r.slot) for r in rows if r.window_id is not None}) == len(rows) - 2
    assert P.pack(docs()).count() == 0
    with pytest.raises(ValueError):
        P.pack(d, window=100, bins=128)
