import math
from collections import Counter

import pytest

from quillstone.llm import registry, sharding as S
from tests.oracle import compare


def test_equals_sql(spark, small):
    compare(spark, small, registry.QUERIES["op4_sharding"], registry.ORACLES["op4_sharding"])


def test_against_a_plain_loop(docs):
    import hashlib

    def best(key, shards):
        def score(n):
            u = (int(hashlib.md5(f"{key}|{n}".encode()).hexdigest()[: S.DIGITS], 16) + 0.5) / 16**S.DIGITS
            return -shards[n] / math.log(u)

        return max(sorted(shards), key=score)

    got = S.shard(docs(*[(i, "x") for i in range(200)])).collect()
    assert all(r.shard == best(r.doc_id, S.SHARDS) for r in got)


def test_few_move_and_only_to_the_new_shard(spark):
    got = S.shard(spark.range(6000).withColumnRenamed("id", "doc_id")).collect()
    moved = [r for r in got if r.moved]
    assert {r.shard_after for r in moved} == {"shard-048"}
    assert len(moved) / 6000 == pytest.approx(1 / (sum(S.SHARDS.values()) + 1), rel=0.35)
    n = Counter(r.shard for r in got)
    heavy = sum(n[s] for s, w in S.SHARDS.items() if w == 2)
    assert heavy / 6000 == pytest.approx(12 / 54, rel=0.15)


def test_removing_a_shard_moves_its_records_only(spark):
    less = {k: v for k, v in S.SHARDS.items() if k != "shard-003"}
    for r in S.shard(spark.range(2000).withColumnRenamed("id", "doc_id"), after=less).collect():
        assert r.moved == (r.shard == "shard-003")


def test_nulls_repeats_empty_and_other_columns(docs, clashing):
    d = clashing(docs((None, "a"), (None, "b"), (7, "a"), (7, None)))
    got = S.shard(d).collect()
    assert len(got) == 4 and len({r.shard for r in got if r.doc_id is None}) == 1 and len({r.shard for r in got if r.doc_id == 7}) == 1
    assert S.shard(docs()).count() == 0


def test_bad_weights():
    for bad in ({}, {"a": 0.0}, {"a": -1.0}, {"a": math.inf}):
        with pytest.raises(ValueError):
            S._checked(bad)


def test_written_by_shard(spark, docs, tmp_path):
    S.write_shards(docs(*[(i, "x") for i in range(50)]), str(tmp_path / "o"), files_per_shard=2)
    back = spark.read.parquet(str(tmp_path / "o"))
    assert back.count() == 50 and {(r.doc_id, r.shard) for r in back.collect()} == {(r.doc_id, r.shard) for r in S.shard(back.select("doc_id")).collect()}
