import math

import pytest
from pyspark.sql import functions as F

from quillstone.operators import assemble, authoring, dense, evals, fusion, gate, lexical, links, retrieve
from quillstone.plans import catalog
from quillstone.sources.world import WorldBuilder
from quillstone.streaming import history
from tests.test_world import ent


def docs(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "doc_id string, text string")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")


def test_bm25(spark, tmp_path):
    d = docs(spark, d1="cat cat cat", d2="cat dog", d3="dog dog dog dog")
    i = lexical.build(d)
    got = [(r.doc_id, r.score) for r in lexical.search(asked(spark, "Cat cat"), i).orderBy("rank0").collect()]
    assert [g[0] for g in got] == ["d1", "d2"] and got[0][1] == pytest.approx(math.log(1.6) * 6.6 / 4.2, abs=1e-9)
    assert [(r.doc_id, round(r.score, 9)) for r in lexical.bm25_once(d, "cat", 5).collect()] == [(a, round(b, 9)) for a, b in got]
    again = lexical.write(i, str(tmp_path / "i"))
    assert [r.doc_id for r in lexical.search(asked(spark, "cat"), again).orderBy("rank0").collect()] == ["d1", "d2"]
    assert lexical.search(asked(spark, "nothing"), i).count() == 0
    with pytest.raises(ValueError):
        lexical.build(d.union(d))
    assert len({r.score for r in lexical.search(asked(spark, "x"), lexical.build(docs(spark, a="x", b="x y y y")), b=0.0).collect()}) == 1


def test_scan_lines(spark):
    d = docs(spark, f1="dog\nCat\n", f2="x\ncat one\na cat")
    assert sorted(f"{r.doc_id}:{r.line_no}" for r in lexical.scan(d, "cat").collect()) == ["f2:2", "f2:3"]
    assert sorted(f"{r.doc_id}:{r.line_no}" for r in lexical.scan(d, "(?i)cat", regex=True).collect()) == ["f1:2", "f2:2", "f2:3"]


def test_dense(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.8, 0.6]), ("c", [-1.0, 0.0])], "doc_id string, vector array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, vector array<double>")
    assert [r.doc_id for r in dense.search(q, v).orderBy("rank0").collect()] == ["a", "b"]  # negatives are dropped
    assert [r.doc_id for r in dense.search(q, v, floor=0.9).collect()] == ["a"]
    with pytest.raises(ValueError):
        dense.search(spark.createDataFrame([(0, [1.0])], "query_id int, vector array<double>"), v)
    assert dense.document_index(docs(spark, a="xx"), lambda ts: [[len(t)] for t in ts]).first().vector == [2.0]
    with pytest.raises(Exception, match="vectors for"):
        dense.document_index(docs(spark, a="xx"), lambda ts: []).collect()


def test_rrf(spark):
    s = spark.createDataFrame([(0, g, r, d) for g, ds in {"lex": "abc", "sem": "bad"}.items() for r, d in enumerate(ds)], "query_id int, signal string, rank0 int, doc_id string")
    got = [(r.doc_id, r.score) for r in fusion.fuse(s).orderBy("rank0").collect()]
    assert got == [("a", 1.5), ("b", 1.5), ("c", pytest.approx(1 / 3)), ("d", pytest.approx(1 / 3))]
    w = spark.createDataFrame([("sem", 0.0)], "signal string, w double")
    assert [r.score for r in fusion.fuse(s, weights=w, top_k=1).collect()] == [1.0]
    assert [c.signal for c in fusion.fuse(s).where("doc_id = 'a'").first().contributions] == ["lex", "sem"]


def decided(spark, text, ents=(), private=(), tail=()):
    df = spark.createDataFrame([(text, list(ents), list(private), list(tail))], "text string, entities array<string>, private_ids array<string>, tail_ids array<string>")
    return gate.decide(df).first()


def test_gate(spark):
    assert decided(spark, "capital of France").complexity == pytest.approx(0.09)
    assert decided(spark, "compare why these connect").complexity == pytest.approx(0.52)
    assert decided(spark, " ".join(["why"] * 40)).complexity == 1.0
    r = decided(spark, "capital of France")
    assert (r.strategy, r.stage) == ("none", 2) and {x.tier: round(x.utility, 4) for x in r.scores}["grep"] == 0.3067
    assert decided(spark, "capital of France", ["e"], tail=["e"]).strategy == "grep"
    for text, ents, private, want in (("the latest", [], [], "semantic"), ("current plan", ["e"], [], "graph"), ("x", ["a", "b"], [], "composite"), ("why x", ["a"], [], "composite"), ("x", ["a"], ["a"], "graph"), ("it costs 19.99", [], [], "semantic"), ("he knows", [], [], "semantic")):
        got = decided(spark, text, ents, private)
        assert (got.strategy, got.stage, len(got.scores)) == (want, 1, 0), text


RARE = math.log(1.5)
CAND = "query_id int, doc_id string, content string, tokens int, rel double, embedding array<double>, budget int"


def test_assembly(spark):
    c = spark.createDataFrame([(0, "a", "A", 40, 0.9, [1.0, 0.0], 100), (0, "b", "B", 40, 0.8, [1.0, 0.0], 100), (0, "c", "C", 40, 0.7, [0.0, 1.0], 100)], CAND)
    r = assemble.assemble(c).first()
    assert {m.doc_id for m in r.manifest} == {"a", "c"} and r.total_tokens == 80 and r.text == "[[a]]\nA\n\n[[c]]\nC"
    five = spark.createDataFrame([(0, d, x) for d, x in zip("abcde", (0.9, 0.8, 0.7, 0.6, 0.5))], "query_id int, doc_id string, rel double")
    assert "".join(x.doc_id for x in assemble.fold_order(five).orderBy("position").collect()) == "acedb"


def test_ties_go_to_the_longer_of_ids_that_begin_alike():
    assert [i for i, _ in assemble.choose([1, 1, 1], [0.5] * 3, ["d1", "d10", "d2"], [None] * 3, 3, 0.5, 0.95)] == [1, 0, 2]


def test_choice_against_the_plain_loop():
    import random

    rng = random.Random(2)
    n = 25
    vec = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(n)]
    tok, rel, ids = [rng.randint(1, 9) for _ in range(n)], [rng.random() for _ in range(n)], [f"d{i}" for i in range(n)]

    def cos(p, q):
        return math.sumprod(p, q) / math.sqrt(math.sumprod(p, p) * math.sumprod(q, q))

    got, want, left = [i for i, _ in assemble.choose(tok, rel, ids, vec, 60, 0.5, 0.6)], [], 60
    while True:
        ok = [(0.5 * rel[i] - 0.5 * (s := max((cos(vec[i], vec[j]) for j in want), default=0.0)), rel[i], i) for i in range(n) if i not in want and tok[i] <= left and not (want and max(cos(vec[i], vec[j]) for j in want) >= 0.6)]
        if not ok:
            break
        want.append(max(ok)[2])
        left -= tok[want[-1]]
    assert got == want


def link_world(spark):
    e = [("A", "rare", 1.0), ("A", "niche", 1.0), ("B", "common", 1.0), ("C", "rare", 1.0), ("C", "common", 1.0), ("A", "common", 1.0)]
    return spark.createDataFrame(e, "src_id string, target_id string, weight double"), spark.createDataFrame([(x, "document") for x in "ABC"] + [(x, "concept") for x in ("rare", "niche", "common")], "canonical_id string, entity_type string")


def test_links(spark):
    edges, ents = link_world(spark)
    tf = links.mentions(edges, ents)
    idf = links.concept_idf(tf, spark.createDataFrame([(3,)], "n long"))
    assert {r.concept: round(r.idf, 6) for r in idf.collect()} == {"common": 0.0, "rare": round(math.log(1.5), 6), "niche": round(math.log(3), 6)}
    got = {(r.source_id, r.target_id): (r.score, r.shared) for r in links.rank_links(links.tfidf(tf, idf)).collect()}
    c = round(RARE / math.hypot(RARE, math.log(3)), 6)
    assert got == {("A", "C"): (c, ["rare"]), ("C", "A"): (c, ["rare"])}


def test_suggestions(spark):
    edges, ents = link_world(spark)
    cand = spark.createDataFrame([("rare", 1.0), ("niche", 1.0), ("unheard", 1.0)], "target_id string, weight double")
    got = [(r.target_id, r.score) for r in links.suggest(cand, edges, ents).collect()]
    assert got == [("A", 1.0), ("C", round(RARE / math.hypot(RARE, math.log(3)), 6))]
    star = spark.createDataFrame([("a", "b", 1.0), ("c", "a", 1.0)], "src_id string, target_id string, weight double")
    who = spark.createDataFrame([(x, "document") for x in "abc"], "canonical_id string, entity_type string")
    seeds = spark.createDataFrame([("a",), ("ghost",)], "seed string")
    got = [(r.target_id, r.score, r.structural_score, r.via) for r in links.suggest(cand, star, who, seeds).collect()]
    assert got == [("b", 0.125, 0.5, ["a"]), ("c", 0.125, 0.5, ["a"])]


def test_extraction():
    assert authoring.extract('The Decision Layer uses World Models and "entity resolution".') == "Decision Layer|World Models|entity resolution".split("|")
    assert authoring.extract("We use Cloud, API and ROI daily.") == ["Cloud", "API", "ROI"]
    assert authoring.extract("Aa Bb Cc Dd Ee Ff Gg") == ["Aa Bb Cc Dd Ee", "Ff Gg"]
    assert authoring.extract("I've seen It's fine. The Of") == []


def candidates(spark, names):
    return spark.createDataFrame([(i, n, "concept", "s", "h", "pending_review") for i, n in enumerate(names)], "ord int, surface string, entity_type string, source string, extractor string, status string")


def test_dedup(spark):
    u, d, _ = authoring.dedup(candidates(spark, ["Payment retry policy", "payment-retry policy", "Payment retry policyy", "aa", "aaa", "Known"]), spark.createDataFrame([("known",)], "norm string"))
    assert sorted(r.ord for r in u.collect()) == [0, 3, 4]
    assert sorted((r.ord, r.kept_ord, r.reason) for r in d.collect()) == [(1, 0, "same_form"), (2, 0, "fuzzy"), (5, None, "existing")]


def test_authoring(spark):
    t = spark.createDataFrame([("s", "Open Data and Open Data"), ("t", None)], "source string, text string")
    assert [(r.ord, r.surface, r.status) for r in authoring.author(t).collect()] == [(0, "Open Data", "pending_review")]
    with pytest.raises(ValueError):
        authoring.author(t, "llm")
    assert authoring.author(t, lambda x: x.split()[:1]).first().surface == "Open"
    ok = spark.createDataFrame([("Open Data", "c::open_data")], "surface string, canonical_id string")
    assert authoring.approve(authoring.author(t), ok).first().canonical_id == "c::open_data"


def test_retrieve(spark):
    w = WorldBuilder(spark).add([ent("c::acme", "Acme", relations=[("with", "c::beta")], refs=["d1"]), ent("c::beta", "Beta", refs=["d2"])]).freeze()
    corpus = spark.createDataFrame([("d1", "acme makes things", 30, [1.0, 0.0]), ("d2", "beta sells things", 30, [0.0, 1.0]), ("d3", "other", 30, [0.6, 0.8])], "doc_id string, content string, tokens int, embedding array<double>")
    e = retrieve.Engine(w, corpus, lexical.build(corpus.select("doc_id", F.col("content").alias("text"))), corpus.select("doc_id", F.col("embedding").alias("vector")), lambda ts: [[1.0, 0.0] for _ in ts], tail_ids=("c::beta",))
    q = spark.createDataFrame([(0, "acme", 60), (1, "beta", 60), (2, "acme and beta", 60), (3, "zzz", 60)], "query_id int, text string, budget int")
    out, fused = e.retrieve(q)
    got = {r.query_id: r for r in out.collect()}
    assert [got[i].strategy for i in range(4)] == ["none", "grep", "composite", "none"]
    assert got[0].manifest is None
    assert [m.doc_id for m in got[1].manifest] == ["d2"] and got[2].total_tokens <= 60
    assert {c.signal for r in fused.where("query_id = 2").collect() for c in r.contributions} == set("graph lexical semantic".split())
    assert [(r.doc_id, r.score) for r in retrieve.ground(e, q).where("query_id = 0").collect()] == [("d1", 1.0), ("d2", 0.5)]


def test_scores(spark):
    t = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "task string, ok boolean")
    assert {r.task: r.passed for r in evals.pass_at_k(t, ["task"]).collect()} == {"a": False, "b": True}
    assert [(r.n, r.n_ok, r.percent) for r in evals.accuracy(t, "task").orderBy("task").collect()] == [(2, 1, 50.0), (1, 1, 100.0)]
    one = evals.corpus_hash(t.select("task", "ok"), "task", ["task"]).first()
    assert one.sha == evals.corpus_hash(t.orderBy(F.desc("task")), "task", ["task"]).first().sha and one.n == 3
    art = spark.sql("SELECT named_struct('total_prompts', 4, 'passed', 3, 'detection_rate_blocked_categories', 90D, 'false_positive_rate_safe_harbor', 10D, 'pass_at_k_rate', CAST(NULL AS DOUBLE), 'api_latency_ms', named_struct('p99', 12D)) AS aggregate, array(named_struct('engine_path', 'rules', 'passed', true), named_struct('engine_path', 'error', 'passed', false)) AS results")
    r = evals.score_row(art).first()
    assert (r.n_tasks, r.correctness, r.pass_at_k, r.policy_pass, r.path_safety, r.latency_ms_p99) == (4, 75.0, 75.0, 90.0, 50.0, 12.0)
    assert evals.leaderboard(evals.accuracy(t, "task")).count("\n") == 4
    ranked = spark.createDataFrame([(0, "a", 0), (0, "b", 1)], "query_id int, doc_id string, rank0 int")
    rel = spark.createDataFrame([(0, "b", 1.0), (0, "c", 1.0)], "query_id int, doc_id string, gain double")
    m = evals.ndcg(ranked, rel).first()
    assert m.recall == 0.5 and m.ndcg == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))


def test_streamed_history_equals_the_batch(spark, tmp_path):
    rows = spark.createDataFrame([("f", 1, "2026-01"), ("f", 2, "2026-03"), ("g", 3, "2026-02")], "fact_id string, ord int, known_from string")
    rows.where("ord < 3").write.parquet(str(tmp_path / "in"))
    for more in (None, rows.where("ord = 3")):
        if more is not None:
            more.write.mode("append").parquet(str(tmp_path / "in"))
        s = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        history.append_versions(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = history.read_history(spark, str(tmp_path / "out"), ["fact_id"], ["ord"])
    assert sorted((r.ord, r.known_until) for r in got.collect()) == [(1, "2026-03"), (2, None), (3, None)]


@pytest.mark.parametrize("parts", [1, 7])
def test_results_do_not_depend_on_partitions(spark, small, parts):
    d = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    q = asked(spark, "the of en", "and la de")
    want = [(r.query_id, r.rank0, r.doc_id, r.score) for r in lexical.search(q, lexical.build(d)).orderBy("query_id", "rank0").collect()]
    got = [(r.query_id, r.rank0, r.doc_id, r.score) for r in lexical.search(q, lexical.build(d.repartition(parts, "text"))).orderBy("query_id", "rank0").collect()]
    assert got == want


def test_whole_documents_are_assembled(spark, small, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.read.parquet(f"{small}/embeddings.parquet").where("vec_id < 20").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = {str(r.doc_id): r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = catalog.QUERIES["mmr_assemble"](spark, str(tmp_path)).collect()
    for r in got:
        assert r.text == "\n\n".join(f"[[{i}]]\n{rows[i].text}" for i in r.doc_ids) and r.total_tokens == sum(rows[i].n_chars // 4 for i in r.doc_ids) <= catalog.BUDGET
    assert any(int(i) >= 20 for r in got for i in r.doc_ids)  # documents without a vector take part


def test_phrases_are_counted_on_words_split_once(spark):
    d = spark.createDataFrame([("d", "of the end of the of")], "doc_id string, n string").select("doc_id", F.split("n", " ").alias("tokens"))
    g = spark.createDataFrame([("of the", ["x"]), ("of", ["y"])], "norm string, ids array<string>")
    out = links.phrase_counts(d, g, 2)
    assert {(r.canonical_id, r.tf) for r in out.collect()} == {("x", 2), ("y", 3)} and out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_search_scores_few_documents_and_loses_none(spark, monkeypatch):
    """A term that all documents have is not spread over all of them for each query, and what is returned is what scoring all returns."""
    import random

    rng = random.Random(3)
    words = ["w%d" % i for i in range(40)]
    d = spark.createDataFrame([("d%03d" % i, " ".join(["all"] * rng.randint(1, 2) + ["most"] * (i % 5 > 0) + rng.choices(words, k=rng.randint(0, 6)))) for i in range(300)], "doc_id string, text string")
    q = spark.createDataFrame([(i, " ".join(["all"] * (i % 7 > 0) + ["most"] * (i % 3) + rng.sample(words, i % 4))) for i in range(60)], "query_id int, text string")
    held = {}
    monkeypatch.setattr(lexical, "materialize", lambda df, tag: held.setdefault(tag, df.localCheckpoint()))
    i = lexical.build(d)
    got = {(r.query_id, r.doc_id, r.rank0, r.score) for r in lexical.search(q, i, 5).collect()}
    assert got == {(r.query_id, r.doc_id, r.rank0, r.score) for r in lexical.top(lexical.scores(q, i), 5).collect()} and len(got) > 250
    assert held["sums"].count() < lexical.scores(q, i).count() / 2


def test_choice_takes_many_queries_from_a_batch(spark):
    """Queries share batches; without vectors the choice is that of the general way."""
    rows = [(q, "d%d" % (j % 7), j, 3 + (q * j) % 5, ((q * 7 + j * 5) % 11) / 10, None, 12) for q in range(40) for j in range(9)]
    kind = "query_id long, doc_id string, print long, tokens int, rel double, embedding array<double>, budget int"
    got = {(r.query_id, r.doc_id, r.print, r.pick, r.mmr_score) for r in assemble.choice(spark.createDataFrame(rows, kind)).collect()}
    want = set()
    for q in range(40):
        g = sorted((r for r in rows if r[0] == q), key=lambda r: (r[1], r[2]))
        far = [[1.0 if a == b else 0.0 for a in range(len(g))] for b in range(len(g))]  # vectors at right angles: the general way
        picks = assemble.choose([r[3] for r in g], [r[4] for r in g], [r[1] for r in g], far, 12, 0.5, 0.95)
        want |= {(q, g[i][1], g[i][2], n, v) for n, (i, v) in enumerate(picks)}
    assert got == want


def test_vectors_of_a_column_are_scored_a_few_queries_at_a_time():
    import numpy as np
    import pyarrow as pa

    given = [[3.0, 4.0], None, [], [0.0, 0.0], [1.0, 2.0, 2.0], [0.0, 2.0]]
    want, got = dense._unit(given), dense._unit_column(pa.array(given, pa.list_(pa.float64())))
    assert want.keys() == got.keys() and all(np.array_equal(want[n][i], got[n][i]) for n in want for i in (0, 1))
    b = dense._best(["a", "b"], np.array([0, 1]), [7, 8, 9], np.array([0, 1, 2]), np.array([[0.5, 0.9, 0.5], [0.1, 0.0, 0.2]]), 0.1, 2, [pa.string(), pa.int64(), pa.float64()])
    assert b.to_pylist() == [{"query_id": q, "doc_id": d, "score": s} for q, d, s in (("a", 8, 0.9), ("a", 7, 0.5), ("b", 9, 0.2), ("b", 7, 0.1))] and dense.ROWS <= 64


def test_candidates_are_held_for_a_few_texts_at_a_time():
    import pandas as pd

    n = 2 * authoring.SLICE + 1
    texts = pd.DataFrame({"source": list(map(str, range(n))), "text": ["we met Ada Lovelace. Then Alan Turing"] * n})
    frames = list(authoring._found(texts, authoring.extract, "person", "heuristic"))
    assert [len(f) for f in frames] == [2 * authoring.SLICE, 2 * authoring.SLICE, 2] and list(frames[2].surface) == ["Ada Lovelace", "Alan Turing"]
