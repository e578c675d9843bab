import random

import pytest

from quillstone.operators import graph
from quillstone.plans.components import connected

EDGE = "src_id string, target_id string, valid_from string, valid_until string, known_from string, known_until string"


def setup(spark, edges, nodes):
    e = spark.createDataFrame([(*x, *[None] * (6 - len(x))) for x in edges], EDGE)
    n = spark.createDataFrame([(x,) for x in nodes], "id string")
    r = spark.createDataFrame([(x, f"doc-{x}", None) for x in nodes], "entity_id string, doc_id string, locator string")
    return n, e, r


def walk(spark, edges, nodes, seed="a", depth=2, **at):
    n, e, r = setup(spark, edges, nodes)
    return [(x.entity_id, x.hop, x.score, x.mode) for x in graph.ordered(graph.traverse(spark.createDataFrame([(seed,)], "seed string"), n, e, r, depth, **at)).collect()]


def test_chain(spark):
    assert walk(spark, [("a", "b"), ("b", "c"), ("c", "d")], "abcd") == [("a", 0, 1.0, "graph"), ("b", 1, 0.5, "graph"), ("c", 2, 1 / 3, "graph")]


def test_diamond_cycle_and_dangling(spark):
    got = walk(spark, [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("c", "nowhere")], "abc", depth=3)
    assert [x[:2] for x in got] == [("a", 0), ("b", 1), ("c", 1)]


def test_validity(spark):
    e = [("a", "b", *("2026-01-01 2026-06-01".split()))]
    for at, n in (("2026-03-01", 2), ("2026-06-01", 1), ("2025-12-31", 1), (None, 2)):
        assert len(walk(spark, e, "ab", as_of=at)) == n
    assert walk(spark, e, "ab", as_of="2027")[0][3] == "graph"  # expired edges are edges


def test_flat_unknown_and_depth(spark):
    assert walk(spark, [], "ab") == [("a", 0, 1.0, "flat")]
    assert walk(spark, [("a", "b")], "ab", seed="z") == []
    for bad in (-1, 4):
        with pytest.raises(ValueError):
            walk(spark, [], "a", depth=bad)
        with pytest.raises(ValueError):
            graph.traversal_sql(bad)


def test_joins_and_recursive_sql_agree(spark):
    rng = random.Random(1)
    nodes = [f"n{i}" for i in range(12)]
    edges = [(rng.choice(nodes), rng.choice(nodes), rng.choice([None, "2", "4"]), rng.choice([None, "5", "7"]), rng.choice([None, "1", "6"]), None) for _ in range(30)]
    n, e, r = setup(spark, edges, nodes)
    for name, df in (("nodes", n), ("edges", e), ("refs", r)):
        df.createOrReplaceTempView(name)
    for at in ({}, {"as_of": "4"}, {"as_of": "6", "known_as_of": "3"}):
        one = graph.ordered(graph.traverse(spark.createDataFrame([("n0",)], "seed string"), n, e, r, 3, **at))
        two = graph.traverse_with("n0", lambda q, a: spark.sql(q, a), 3, **at)
        assert [(x.entity_id, x.hop, x.score) for x in one.collect()] == [(x.entity_id, x.hop, x.score) for x in two.collect()]


def test_compiled_query_names_only_the_axes_given():
    q, a = graph.traversal_sql(2)
    assert "valid_from" not in q and a == {}
    q, a = graph.traversal_sql(1, as_of="it's")
    assert "it's" not in q and a == {"as_of": "it's"} and "known" not in q


def test_best_hit_of_each_document(spark):
    h = spark.createDataFrame([(1, "d", 2, 0.3), (1, "d", 1, 0.5), (2, "d", 0, 1.0)], "query_id int, doc_id string, hop int, score double")
    assert sorted((r.query_id, r.hop, r.score) for r in graph.graph_documents(h).collect()) == [(1, 1, 0.5), (2, 0, 1.0)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 105), (105, 103)]
    got = {r.id: r.label for r in connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 103: 100, 105: 100}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
