import corpus_pipeline as C
from quillstone.llm import decontamination, langid, minhash, pii, registry


def test_stages():
    assert [n for n, _ in C.STAGES] == ["language_id", "minhash_near_dedup", "benchmark_decontamination", "pii", "packing"]
    assert C.ORACLE_SQL is None and len([q for q in registry.QUERIES if q.startswith("op")]) == 10


def test_stages_against_the_operators(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    cols, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    ok = {r.doc_id for r in langid.classify(docs).collect() if r.accepted}
    one = C.language(spark, docs, small)
    assert one.columns == cols and {r.doc_id for r in one.collect()} == ok
    two = C.near_duplicates(spark, one, small)
    gone = {r.doc_id for r in minhash.groups(one).collect() if not r.kept}
    assert two.columns == cols and {r.doc_id for r in two.collect()} == ok - gone and gone
    three = C.decontaminate(spark, two, small)
    bad = {r.doc_id for r in decontamination.contaminated(two, spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    assert three.columns == cols and {r.doc_id for r in three.collect()} == ok - gone - bad and bad
    four = C.sanitise(spark, three, small)
    assert four.columns == cols and four.schema == docs.schema.fromJson(four.schema.jsonValue()) and four.dtypes == docs.dtypes
    clean = {r.doc_id: r for r in four.collect()}
    want = {r.doc_id: r.text for r in pii.sanitize(three).collect()}
    assert {i: r.text for i, r in clean.items()} == want and all(r.n_chars == len(r.text) for r in clean.values())
    assert sum(rows[i].text != t for i, t in want.items()) > 0
    packed = C.pack(spark, four, small).collect()
    assert sum(r.n_tokens for r in packed) == sum(len(t.split()) for t in want.values())
    run = C.run(spark, small).collect()
    assert sorted(map(str, run)) == sorted(map(str, packed))


def test_odd_rows_through_all_stages(spark, clashing, small):
    """Nulls, empty and very long texts, repeated rows and ties, among the small table's documents and more columns."""
    base = spark.read.parquet(f"{small}/documents.parquet")
    clean = [r for r in base.orderBy("doc_id").collect() if r.lang == "en" and 1000 < len(r.text) < 8000]
    bad = {r.doc_id for r in decontamination.contaminated(base, spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    clean = [r for r in clean if r.doc_id not in bad]
    text, long = clean[0].text, "\n".join(r.text for r in clean) * 30
    odd = [(None, text), (90001, None), (90002, ""), (90003, text), (90003, text), (90004, long), (90005, text.upper())]
    docs = clashing(base.unionByName(spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t)) for i, t in odd], base.schema)))

    def texts(df):
        assert df.columns == docs.columns
        return sorted(((-1 if r.doc_id is None else r.doc_id), r.text) for r in df.collect() if r.doc_id is None or r.doc_id > 90000)

    one = C.language(spark, docs, small)
    assert texts(one) == sorted([(-1, text), (90003, text), (90003, text), (90004, long), (90005, text.upper())])
    two = C.near_duplicates(spark, one, small)
    assert texts(two) == sorted([(-1, text), (90004, long)])  # copies go, whatever their case; a row without an id is nobody's copy
    three = C.decontaminate(spark, two, small)
    assert texts(three) == sorted([(-1, text), (90004, long)])
    four = C.sanitise(spark, three, small)
    got = dict(texts(four))
    assert got[90004] == {r.doc_id: r.text for r in pii.sanitize(three).collect()}[90004] and got[-1] == pii.rewrite(text)[0]
    packed = [r for r in C.pack(spark, four, small).collect() if r.doc_id == 90004]
    assert len(packed) > 1 and sum(r.n_tokens for r in packed) == len(got[90004].split())


def test_empty_tables(spark, docs, clashing, small):
    for name, stage in C.STAGES:
        out = stage(spark, clashing(docs()), small)
        assert out.count() == 0 and (name == "packing" or out.columns == clashing(docs()).columns), name
