import json

import pytest
from pyspark.sql import functions as F

from quillstone.functions import temporal
from quillstone.sources import cross_system, posts, world


def ent(cid, label=None, kind="concept", aliases=(), relations=(), refs=(), **kw):
    return {"canonical_id": cid, "label": label or cid, "entity_type": kind, "aliases": list(aliases), "relations": [dict(zip(("predicate", "target_id"), r[:2])) | (r[2] if len(r) > 2 else {}) for r in relations], "refs": [{"doc_id": r} for r in refs]} | kw


def ids(df, c="canonical_id"):
    return sorted(r[c] for r in df.collect())


def test_merge_chain_resolves_to_the_last(spark):
    names = ["c::llms", "c::llm"]
    b = world.WorldBuilder(spark).add([ent("c::language_models", "Language models"), ent("c::llms", "LLMs"), ent("c::llm", "LLM", aliases=["large language model"])])
    w = b.merge("c::language_models", names[0]).merge(*names).freeze()
    e = w.entities.collect()
    assert [x.canonical_id for x in e] == ["c::llm"]
    assert e[0].aliases == ["large language model", "Language models", "LLMs"] and e[0].merged_from == ["c::language_models", "c::llms"]
    have = spark.createDataFrame([("c::llm",), ("c::llms",), ("c::other",)], "id string")
    assert ids(w.has_id(have), "id") == ["c::llm"] and ids(w.has_record(have), "id") == ["c::llm", "c::llms"]


def test_order_of_merges_decides_the_representative():
    assert world.union_find([("a", "b"), ("b", "c")]) == {"a": "c", "b": "c"}
    assert world.union_find([("a", "b"), ("c", "a"), ("a", "c")]) == {"a": "b", "c": "b"}


def test_fold_takes_refs_and_rewrites_relations(spark):
    w = world.WorldBuilder(spark).add([ent("x", refs=["d2"], relations=[("rel", "y"), ("to", "z")]), ent("y", refs=["d1", "d2"], relations=[("rel", "x")]), ent("z", relations=[("in", "y")])]).merge("y", "x").freeze()
    e = {r.canonical_id: r for r in w.entities.collect()}
    assert [r.doc_id for r in e["x"].refs] == ["d1", "d2"]
    assert [(r.predicate, r.target_id) for r in e["x"].relations] == [("to", "z")] and [r.target_id for r in e["z"].relations] == ["x"]


def test_builder_guards(spark):
    with pytest.raises(ValueError, match="duplicate"):
        world.WorldBuilder(spark).add([ent("a"), ent("a")]).freeze()
    with pytest.raises(ValueError, match="unknown"):
        world.WorldBuilder(spark).add([ent("a")]).merge("a", "b").freeze()
    with pytest.raises(ValueError, match="JSON"):
        world.WorldBuilder(spark).add([ent("a", metadata="[1]")]).freeze()
    b = world.WorldBuilder(spark).add([ent("a")])
    b.freeze()
    with pytest.raises(RuntimeError):
        b.add([ent("b")])
    assert world.WorldBuilder(spark).freeze().entities.count() == 0


def test_conflicts_and_gazetteer(spark):
    w = world.WorldBuilder(spark).add([ent("auth::user", "User"), ent("payment::user", "user!"), ent("x", "--")]).freeze()
    assert [(r.norm, r.ids) for r in w.gazetteer.collect()] == [("user", ["auth::user", "payment::user"])]
    assert [(r.norm, r.ids) for r in world.alias_conflicts(w.normalized).collect()] == [("user", ["auth::user", "payment::user"])]


def test_parquet_and_json_round_trips(spark, tmp_path):
    rows = [ent("b", "Bé", aliases=["β"], relations=[("in", "a", {"weight": 2.5, "valid_from": "2026-01-01"})], refs=["d"], metadata={"k": [1, {"x": None}]}), ent("a")]
    w = world.WorldBuilder(spark).add(rows).freeze()
    again = w.write(str(tmp_path / "w"))
    assert sorted(map(str, again.entities.collect())) == sorted(map(str, w.entities.collect()))
    assert again.normalized.count() == w.normalized.count()
    with pytest.raises(ValueError, match="no world"):
        world.World.read(spark, str(tmp_path / "none"))
    text = world.dump_document(w.entities)
    assert text.endswith("\n") and [e["canonical_id"] for e in json.loads(text)["entities"]] == ["a", "b"]
    assert world.dump_document(world.load_document(spark, text)) == text
    with pytest.raises(ValueError, match="version"):
        world.load_document(spark, '{"version": 99, "entities": []}')
    world.to_json_lines(w.entities).write.text(str(tmp_path / "j"))
    assert world.dump_document(world.read_json_lines(spark, str(tmp_path / "j"))) == text


def test_mirrors(spark):
    e = world.entities_frame(spark, [ent("d", relations=[("mentions", "c", {"valid_from": "2026", "known_from": "2027", "weight": 3.0}), ("mentions", "nobody"), ("other", "c")]), ent("c")])
    once = world.with_mirrors(e)
    made = [r for r in once.where("canonical_id = 'c'").first().relations]
    assert [(r.predicate, r.target_id, r.valid_from, r.known_from, r.weight) for r in made] == [("mentioned_in", "d", "2026", None, 3.0)]
    assert sorted(map(str, world.with_mirrors(once).collect())) == sorted(map(str, once.collect()))


def test_edges_and_refs_of(spark):
    w = world.WorldBuilder(spark).add([ent("a", relations=[("z", "b"), ("m", "c")], refs=["2", "1"]), ent("b"), ent("c")]).freeze()
    who = spark.createDataFrame([("a",)], "id string")
    assert [r.predicate for r in w.edges_of(who).collect()] == ["m", "z"] and [r.doc_id for r in w.refs_of(who).collect()] == ["1", "2"]
    assert w.edge_capable


def test_cross_system(spark):
    e = world.entities_frame(spark, [ent("a", metadata={"system_ids": {"crm": "1", "erp": ["x", "y"]}}), ent("b", metadata={"system_ids": {"crm": 2}}), ent("c")])
    x = cross_system.from_entities(e)
    asked = spark.createDataFrame([("a", "crm"), ("a", "erp"), ("a", "none"), ("z", "crm")], "canonical_id string, system string")
    got = {(r.canonical_id, r.system): (r.external_id, r.status) for r in cross_system.bind(x, asked).collect()}
    assert got == {("a", "crm"): ("1", "bound"), ("a", "erp"): (None, "ambiguous"), ("a", "none"): (None, "missing"), ("z", "crm"): (None, "missing")}
    with pytest.raises(Exception, match="ambiguous"):
        cross_system.bind(x, asked, strict=True).collect()
    back = cross_system.owners(x, spark.createDataFrame([("crm", "2"), ("crm", "9")], "system string, external_id string"))
    assert {r.external_id: r.canonical_id for r in back.collect()} == {"2": "b", "9": None}
    assert {r.canonical_id: r.systems for r in cross_system.systems(x).collect()} == {"a": ["crm", "erp"], "b": ["crm"]}
    with pytest.raises(ValueError, match="two"):
        cross_system.build(spark.createDataFrame([("a", "s", "1"), ("b", "s", "1")], "canonical_id string, system string, external_id string"))
    with pytest.raises(ValueError, match="map"):
        cross_system.from_entities(world.entities_frame(spark, [ent("a", metadata={"system_ids": [1]})]))


def facts(spark, rows):
    return spark.createDataFrame(rows, "v string, valid_from string, valid_until string, known_from string, known_until string")


def test_half_open_intervals(spark):
    f = facts(spark, [("in", "2026-01-01", "2026-06-01", None, None), ("open", None, None, None, None)])
    for at, want in (("2026-01-01", ["in", "open"]), ("2026-06-01", ["open"]), ("2025-12-31", ["open"]), (None, ["in", "open"])):
        assert ids(temporal.as_at(f, at), "v") == want


def test_supersede(spark):
    first = facts(spark, [("v1", None, None, "2026-02-01", None)])
    h = temporal.supersede(first, facts(spark, [("v2", None, None, None, None)]), "2026-04-02")
    for at, want in (("2026-01-01", []), ("2026-02-01", ["v1"]), ("2026-04-02", ["v2"]), ("2026-05-01", ["v2"])):
        assert ids(temporal.as_at(h, known_as_of=at), "v") == want


def test_instants_in_a_table(spark):
    f = facts(spark, [("a", "1", "3", None, None), ("b", "3", None, None, None)]).withColumn("k", F.lit(1))
    i = spark.createDataFrame([(1, "2", None), (1, "3", None)], "k int, valid_as_of string, known_as_of string")
    assert sorted((r.valid_as_of, r.v) for r in temporal.as_at_each(f, i, "k").collect()) == [("2", "a"), ("3", "b")]


def test_posts(spark, tmp_path):
    (tmp_path / "posts_p1.json").write_text(json.dumps([{"id": 2, "slug": "b", "title": {"rendered": "B &amp; b"}, "link": "l", "date": "d", "content": {"rendered": "<p>x</p><p>y"}}, {"id": 1, "slug": "a", "title": {"rendered": "A"}, "link": "l", "date": "d", "content": {"rendered": ""}}]))
    df = posts.read_posts(spark, str(tmp_path / "posts_p*.json"))
    assert [(r.slug, r.title, r.text) for r in df.collect()] == [("a", "A", ""), ("b", "B & b", "x\ny")]
    posts.write_posts(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_projection_equals_the_general_fold(spark):
    rows = [ent("a", aliases=["z", "y", "z"], relations=[("p", "b"), ("p", "a"), ("o", "b"), ("p", "b")], refs=["2", "1", "2"]), ent("b"), ent("m1"), ent("m2")]
    e = world.entities_frame(spark, rows)
    none, some = (spark.createDataFrame(x, "child_id string, root_id string") for x in ([], [("m1", "m2")]))
    plain = {r.canonical_id: r for r in world.fold(e, none).collect()}
    folded = {r.canonical_id: r for r in world.fold(e, some).collect()}
    assert plain["a"] == folded["a"] and plain["b"] == folded["b"] and set(folded) == {"a", "b", "m2"}
    assert plain["a"].aliases == ["z", "y"] and [(r.predicate, r.target_id) for r in plain["a"].relations] == [("o", "b"), ("p", "b")]


def test_sqlite_round_trip(spark, tmp_path):
    from quillstone.operators import resolve
    from quillstone.sources import sqlite

    w = world.WorldBuilder(spark).add([ent("a", "Alpha Beta", aliases=["ab"], refs=["d"], relations=[("r", "b", {"weight": 2.0})], metadata={"k": 1}), ent("b"), ent("c", "Gamma")]).merge("c", "a").freeze()
    path = str(tmp_path / "w.db")
    sqlite.write(w, path)
    again = sqlite.read(spark, path)
    assert world.dump_document(again.entities) == world.dump_document(w.entities)
    asked = spark.createDataFrame([(0, "ab"), (1, "alpha-beta"), (2, "gamma!"), (3, "none")], "mention_ord int, surface string")
    one, two = (sorted(map(str, resolve.lookup(asked, x).collect())) for x in (w, again))
    assert one == two and len(one) == 3
    assert ids(again.has_record(spark.createDataFrame([("c",)], "id string")), "id") == ["c"]
    with pytest.raises(ValueError, match="exists"):
        sqlite.write(w, path)
    (tmp_path / "junk.db").write_bytes(b"not a database at all" * 10)
    for bad in ("junk.db", "missing.db"):
        with pytest.raises(ValueError):
            sqlite.read(spark, str(tmp_path / bad))
    import sqlite3

    with sqlite3.connect(path) as db:
        db.execute("UPDATE meta SET schema_version = 99")
    with pytest.raises(ValueError, match="version"):
        sqlite.read(spark, path)
