import difflib
import random

import pytest
from pyspark.sql import functions as F

from quillstone.functions.text import normal_form
from quillstone.operators import resolve
from quillstone.sources.world import WorldBuilder
from tests.test_world import ent


def mentions(spark, names):
    return spark.createDataFrame(list(enumerate(names)), "mention_ord int, surface string")


def ask(spark, w, names, **kw):
    got, missed = resolve.resolve_mentions(mentions(spark, names), w, resolve.Settings(**kw))
    return [(r.mention_ord, r.canonical_id, r.confidence, r.tier) for r in got.collect()], [r.surface for r in missed.collect()]


@pytest.fixture(scope="module")
def w(spark):
    return WorldBuilder(spark).add([ent("auth::user", "user"), ent("payment::user", "User", aliases=["user"]), ent("p::retry", "payment retry policy"), ent("x::c", "aaaa bbbb cccc"), ent("x::d", "aaaa bbbb dddd")]).freeze()


def test_tiers(spark, w):
    got, missed = ask(spark, w, ["user", "USER!", "policy payment retry", "payment retry polcy", "aa", "nothing like it", "nothing like it"])
    assert [g[:2] + g[3:] for g in got] == [(0, "auth::user", "exact"), (0, "payment::user", "exact"), (1, "auth::user", "normalized"), (1, "payment::user", "normalized"), (2, "p::retry", "fuzzy"), (3, "p::retry", "fuzzy")]
    assert got[4][2] == 1.0 and 0.85 <= got[5][2] < 1
    assert missed == ["aa", "nothing like it", "nothing like it"]


def test_exact_shadows_normal_form(spark, w):
    assert ask(spark, w, ["User"])[0] == [(0, "payment::user", 1.0, "exact")]


def test_arbiter_picks_only_candidates(spark, w):
    name = ["aaaa bbbb czzz"]
    assert ask(spark, w, name)[1] == name
    assert [g[1] for g in ask(spark, w, name, arbiter=lambda s, c: "x::d", band=(0.6, 0.85))[0]] == ["x::d"]
    assert ask(spark, w, name, arbiter=lambda s, c: "made::up", band=(0.6, 0.85))[1] == name
    assert ask(spark, w, name, arbiter=lambda s, c: None, band=(0.6, 0.85))[1] == name
    assert ask(spark, w, name, arbiter=lambda s, c: c[0][0], band=(0.75, 0.85))[1] == name  # one candidate is no choice


def test_vectors(spark, w):
    av = spark.createDataFrame([("a", ["e1"], [1.0, 0.0]), ("b", ["e2", "e3"], [0.0, 1.0])], "norm string, ids array<string>, vector array<double>")
    mv = spark.createDataFrame([("q", [0.28, 0.96]), ("r", [0.6, 0.8]), ("s", [-1.0, 0.0])], "surface string, vector array<double>")
    got, missed = ask(spark, w, ["q", "r", "s"], fuzzy=False, alias_vectors=av, mention_vectors=mv)
    assert [(g[0], g[1], g[3]) for g in got] == [(0, "e2", "embedding"), (0, "e3", "embedding")] and got[0][2] == pytest.approx(0.96) and missed == ["r", "s"]


def test_no_mentions(spark, w):
    assert ask(spark, w, []) == ([], [])


def scanned(spark, aliases, text):
    g = spark.createDataFrame([(a, [i]) for a, i in aliases.items()], "norm string, ids array<string>")
    q = spark.createDataFrame([(0, text)], "query_id int, text string")
    return [r.canonical_id for r in resolve.scan(q, g).orderBy("start").collect()]


def test_scan(spark):
    assert scanned(spark, {"payment": "p", "payment retry policy": "r", "user": "u"}, "The user's Payment-Retry policy, user") == ["u", "r"]
    assert scanned(spark, {"alpha beta": "ab", "beta gamma": "bg"}, "alpha beta gamma") == ["ab"]
    assert scanned(spark, {"alpha": "a"}, "") == [] and scanned(spark, {}, "alpha") == []


def test_scan_against_a_greedy_loop(spark):
    rng = random.Random(3)
    words = "a b c d".split()
    aliases = {" ".join(rng.choices(words, k=rng.randint(1, 3))): f"e{i}" for i in range(12)}
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(40)]
    g = spark.createDataFrame([(a, [i]) for a, i in aliases.items()], "norm string, ids array<string>")
    got = resolve.scan(spark.createDataFrame(list(enumerate(texts)), "query_id int, text string"), g).collect()
    for q, t in enumerate(texts):
        tok, used, want = t.split(), set(), {}
        for size in (3, 2, 1):
            for s in range(len(tok) - size + 1):
                gram = " ".join(tok[s : s + size])
                if gram in aliases and not used & set(range(s, s + size)):
                    used |= set(range(s, s + size))
                    want[gram] = min(s, want.get(gram, s))
        assert {r.surface: r.start for r in got if r.query_id == q} == want


def test_fuzzy_against_brute_force(spark, small):
    names = sorted({r.p_name for r in spark.read.parquet(f"{small}/part.parquet").select("p_name").collect()})
    w = WorldBuilder(spark).add([ent(f"p::{i}", n) for i, n in enumerate(names)]).freeze()
    asked = [n[1:] + "s" for n in names[:20]]
    got, _ = ask(spark, w, asked)
    for k, a in enumerate(asked):
        score = {f"p::{i}": difflib.SequenceMatcher(None, " ".join(sorted(normal_form(a).split())), " ".join(sorted(n.split()))).ratio() for i, n in enumerate(names)}
        best = max(score.values())
        assert sorted(g[1] for g in got if g[0] == k) == sorted(i for i, s in score.items() if s == best >= 0.85)


def test_scan_is_spread_and_splits_texts_once(spark):
    """Texts of one partition are dealt out before their runs of words are made, and no run splits its text again."""
    q = spark.range(50).coalesce(1).select(F.col("id").alias("query_id"), F.concat(F.lit("we met open ai and ai no "), "id").alias("text"))
    g = spark.createDataFrame([("open ai", ["a"]), ("ai", ["b"])], "norm string, ids array<string>")
    out = resolve.scan(q, g)
    assert {(r.query_id, r.start, r.canonical_id) for r in out.collect()} == {x for i in range(50) for x in ((i, 2, "a"), (i, 5, "b"))}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "RepartitionByExpression [query_id" in plan
