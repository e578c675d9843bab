import random
from collections import defaultdict

import numpy as np
import pytest

from quillstone.llm import html_text as H, registry


def brute(streams, pages, size, least=2):
    """Cover every window of ``size`` tokens that occurs on ``least`` pages."""
    return [[x >= 0 and any(n[i] >= least for i in range(max(0, x - size + 1), min(x + 1, len(n)))) for x in range(len(s))] for s, n in zip(streams, window_pages(streams, pages, size))]


def window_pages(streams, pages, size):
    """The number of pages that hold each window of each stream."""
    seen = defaultdict(set)
    for s, p in zip(streams, pages):
        for i in range(len(s) - size + 1):
            seen[tuple(s[i : i + size])].add(p)
    return [[len(seen[tuple(s[i : i + size])]) for i in range(len(s) - size + 1)] for s in streams]


def brute_rule(streams, pages, size, least=2):
    """``brute``, but of a page that would be left empty only what stands on more pages than its rarest windows do, where those are few."""
    out = []
    for s, gone, n in zip(streams, brute(streams, pages, size, least), window_pages(streams, pages, size)):
        if any(w != "\n" for w in s) and all(g for g, w in zip(gone, s) if w != "\n"):
            m = min(x for x in n if x >= least)
            if m <= max(2, len(set(pages)) // 10):
                gone = [any(n[i] > m for i in range(max(0, x - size + 1), min(x + 1, len(n)))) for x in range(len(s))]
        out.append(gone)
    return out


@pytest.mark.parametrize("size, least", [(1, 2), (2, 2), (3, 2), (5, 2), (8, 2), (3, 3)])
def test_suffix_array_against_brute_force(size, least):
    rng = random.Random(size)
    for _ in range(25):
        pages = [rng.randrange(5) for _ in range(rng.randint(1, 7))]
        streams = [[rng.randrange(3) for _ in range(rng.randint(0, 25))] for _ in pages]
        ids = np.array([x for k, s in enumerate(streams) for x in [*s, 100 + k]], np.int64)
        page = np.array([p for s, p in zip(streams, pages) for _ in range(len(s) + 1)])
        got = H.repeated(ids, page, size, least)
        want = [x for c in brute(streams, pages, size, least) for x in [*c, False]]
        assert got.tolist() == want


def test_page_text():
    assert H.page_text("<html><head><title>t</title></head><body><!-- no --><p>A <b>b</b>old&amp;x<br>two</p><script>var t='</p>'</script><div>c") == "A bold&x\ntwo\nc"
    assert H.page_text("<style>x") == "" and H.page_text("1 < 2 and 3 > 2") == "1 < 2 and 3 > 2"


def page(spark, *rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


NAV = "<nav><ul>" + "".join(f"<li><a>item{i}</a></li>" for i in range(6)) + "</ul></nav>"


def words(tag, n):
    return " ".join(f"{tag}{i}" for i in range(n))


def test_boilerplate_goes_and_content_stays(spark):
    rows = [(i, f"http://a.example/{i}", f"{NAV}<p>{words(f'u{i}x', 30)}</p><footer>{words('foot', 9)}</footer>") for i in range(4)] + [(9, "http://b.example/", f"{NAV}<p>other</p>")]
    got = {r.page_id: r for r in H.extract(page(spark, *rows)).collect()}
    for i in range(4):
        assert got[i].text == words(f"u{i}x", 30) and got[i].n_dropped == 15
    assert got[9].text.startswith("item0\nitem1") and got[9].n_dropped == 0  # another host


def test_against_brute_force(spark, small):
    p = spark.read.parquet(f"{small}/pages.parquet")
    got = {r.page_id: r for r in registry.QUERIES["op8_html_extraction"](spark, small).collect()}
    assert len(got) == p.count()
    by = defaultdict(list)
    for r in p.withColumn("host", H.host(p.url)).collect():
        by[r.host].append((r.page_id, H.page_text(r.html)))
    for h, rows in by.items():
        streams = [[x for line in t.split("\n") for x in ["\n", *line.split(" ")]] + ["\n"] if t else ["\n"] for _, t in rows]
        for (i, t), s, c in zip(rows, streams, brute_rule(streams, [i for i, _ in rows], H.MIN_TOKENS)):
            left = [w for w, gone in zip(s, c) if not gone and w != "\n"]
            assert got[i].text.split() == left and got[i].n_tokens == sum(w != "\n" for w in s) and got[i].host == h


@pytest.mark.parametrize("min_pages", [2, 3])
def test_blocks_give_the_same(spark, small, min_pages):
    p = spark.read.parquet(f"{small}/pages.parquet")
    one = sorted(map(str, H.extract(p, min_pages=min_pages).collect()))
    assert sorted(map(str, H.extract(p, min_pages=min_pages, block=15000).collect())) == one
    rows = [(i, "http://a.example", f"<p>{words('same', 12)}</p><p>{words(f'x{i}y', 12)}</p>") for i in range(3)]
    got = H.extract(page(spark, *rows), block=60).collect()
    assert sorted(r.text for r in got) == [words(f"x{i}y", 12) for i in range(3)]


@pytest.mark.parametrize("block", [H.BLOCK, 900])
def test_an_article_under_two_addresses_stays(spark, block):
    article = f"<p>{words('art', 60)}</p>"
    rows = [(i, f"http://a.example/{i}", f"{NAV}<p>{words(f'u{i}x', 30)}</p>") for i in range(4)] + [(i, f"http://a.example/{i}", NAV + article) for i in (8, 9)]
    got = {r.page_id: r for r in H.extract(page(spark, *rows), block=block).collect()}
    assert got[8].text == got[9].text == words("art", 60) and got[8].n_dropped == 6
    nav_only = [(i, f"http://n.example/{i}", NAV) for i in range(5)]
    assert {r.text for r in H.extract(page(spark, *nav_only), block=block).collect()} == {""}


def test_hosts(spark):
    urls = {"http://A.Example:80/x": "a.example", "https://u:p@b.example?q=1": "b.example", "nonsense": "", None: "", "ftp://c.example#f": "c.example"}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.h for r in df.select("u", H.host(df.u).alias("h")).collect()} == urls


def test_nulls_empty_repeats_long_and_other_columns(spark, clashing):
    t = f"<p>{words('w', 40)}</p>"
    rows = [(1, "http://a.example", None), (2, "http://a.example", ""), (3, "http://r.example", t), (3, "http://r.example", t), (4, None, t), (None, "http://n.example", t), (5, "http://l.example", "<p>" + words("x", 200000)), (6, "http://c.example/1", t), (7, "http://c.example/2", t)]
    d = clashing(page(spark, *rows))
    got = sorted((r.page_id or 0, len(r.text), r.n_tokens, r.n_dropped) for r in H.extract(d).collect())
    n = len(words("w", 40))
    assert got == [(0, n, 40, 0), (1, 0, 0, 0), (2, 0, 0, 0), (3, n, 40, 0), (3, n, 40, 0), (4, n, 40, 0), (5, len(words("x", 200000)), 200000, 0), (6, n, 40, 0), (7, n, 40, 0)]
    assert H.extract(page(spark)).count() == 0
