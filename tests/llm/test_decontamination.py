import re

from quillstone.llm import decontamination as D, registry


def brute(text, items, gram=D.GRAM, min_run=D.MIN_RUN, min_words=D.MIN_WORDS):
    """All maximal runs of words that text and item share, in one alignment, that hold a pattern and are long enough."""
    w, out = D.words(text), set()
    for item, t in items:
        v = D.words(t or "")
        if len(v) < min_words:
            continue
        for shift in range(-len(v) + 1, len(w)):
            run = []
            for i in range(len(v) + 1):
                if i < len(v) and 0 <= shift + i < len(w) and w[shift + i] == v[i]:
                    run.append(shift + i)
                    continue
                if len(run) >= min(gram, len(v)) and len(run) >= min(min_run, len(v)):
                    out.add((item, run[0], len(run)))
                run = []
    return out


def found(docs_df, bench):
    return {(r.doc_id, r.item_id, r.n_words): (r.start, r.end, r.passage) for r in D.contaminated(docs_df, bench).collect()}


def test_against_brute_force(spark, small):
    docs, bench = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    want = {(r.doc_id, i, n) for r in docs.collect() for i, _, n in brute(r.text, items)}
    got = registry.QUERIES["op9_benchmark_decontamination"](spark, small).collect()
    assert {(r.doc_id, r.item_id, r.n_words) for r in got} == want and want
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(texts[r.doc_id][r.start : r.end] == r.passage for r in got)


ITEM = "What is the Boiling point of water, at sea level in degrees? One hundred degrees Celsius exactly."


def bench(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


def test_case_punctuation_and_offsets(spark, docs):
    text = "İßtanbul ﬁrst — " + ITEM.upper().replace(" ", "  \n") + " the end"
    got = found(docs((1, text)), bench(spark, ITEM))
    assert list(got) == [(1, 0, 17)]
    s, e, p = got[1, 0, 17]
    assert text[s:e] == p and p.startswith("WHAT") and p.endswith("EXACTLY")


def test_parts(spark, docs):
    w = ITEM.split()
    b = bench(spark, ITEM, "five words make one item", "too short")
    got = found(docs((1, " ".join(w[2:15])), (2, " ".join(w[:12])), (3, "x five words make one item x"), (4, "five words make one itemx"), (5, "too short")), b)
    assert set(got) == {(1, 0, 13), (3, 1, 5)}


def test_nulls_empty_repeats_long_and_other_columns(spark, docs, clashing):
    long = "filler words here " * 60000 + ITEM + " more" * 1000
    d = clashing(docs((None, ITEM), (2, None), (3, ""), (4, ITEM), (4, ITEM), (5, long)))
    got = D.contaminated(d, bench(spark, ITEM, ITEM, None)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.item_id) for r in got) == [(-1, 0), (-1, 1), (4, 0), (4, 0), (4, 1), (4, 1), (5, 0), (5, 1)]
    clean = D.clean_rows(d, bench(spark, ITEM))
    assert clean.columns == d.columns and sorted(r.doc_id for r in clean.collect()) == [2, 3]
    assert D.contaminated(docs(), bench(spark, ITEM)).count() == 0 and D.contaminated(d, bench(spark)).count() == 0
    assert D.clean_rows(d, bench(spark)).count() == 6


def test_items_in_parts_give_the_same(spark, docs):
    items = [ITEM, re.sub("water", "iron", ITEM), "five words make one item"]
    d = docs(*[(i, f"so {t} and on") for i, t in enumerate(items)])
    one = D.contaminated(d, bench(spark, *items))
    two = D.contaminated(d, bench(spark, *items), most_chars=10)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_ids_of_other_types(spark, docs):
    words = " ".join(f"w{i}" for i in range(20))
    d = docs((1, "a " + words), (2, "b")).selectExpr("concat('d', doc_id) AS doc_id", "text")
    bench = spark.createDataFrame([("q1", words)], "item_id string, text string")
    assert [(r.doc_id, r.item_id, r.start) for r in D.contaminated(d, bench).collect()] == [("d1", "q1", 2)]
    assert [r.doc_id for r in D.clean_rows(d, bench).collect()] == ["d2"]
