import math
import unicodedata

import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from quillstone.functions import text as t


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(col.alias("x")).first().x


@pytest.mark.parametrize("raw, want", [("Payment-Retry  POLICY!", "payment retry policy"), ("Ｓｃｈｗａｂ", "schwab"), ("  --  ", ""), ("AI-OS", "ai os"), ("Straße", "strasse"), ("ﬁn", "fin")])
def test_normal_form(spark, raw, want):
    assert t.normal_form(raw) == want
    assert one(spark, t.norm(F.col("s")), s=raw) == want


@given(st.text(max_size=40))
def test_normal_form_letter_by_letter(s):
    folded = unicodedata.normalize("NFKC", s).casefold()
    out, gap = "", True
    for c in folded:
        if c.isalnum():
            out, gap = out + c, False
        elif not gap:
            out, gap = out + " ", True
    assert t.normal_form(s) == out.strip(" ")


def test_latin_and_ascii_forms_agree_with_the_general_one(spark):
    rows = ["Große Straße, 12!", "Éaux ai-je", "plain words", "", "a_b"]
    df = spark.createDataFrame([(r,) for r in rows], "s string").select(t.norm("s").alias("a"), t.norm_latin(F.col("s")).alias("b"))
    assert all(r.a == r.b for r in df.collect())
    assert one(spark, t.norm_ascii(F.col("s")), s=" A-b  C ") == "a b c"


def test_null_stays_null(spark):
    df = spark.createDataFrame([(None,)], "s string")
    assert df.select(t.norm("s").alias("x")).first().x is None


def test_entropy(spark):
    assert one(spark, t.entropy(F.col("s")), s="aa") == 0
    assert one(spark, t.entropy(F.col("s")), s="") == 0
    assert one(spark, t.entropy(F.col("s")), s="aab") == pytest.approx(-(2 / 3) * math.log2(2 / 3) - (1 / 3) * math.log2(1 / 3))


def test_token_sort_ratio(spark):
    def r(a, b):
        return one(spark, t.token_sort_ratio("a", "b"), a=a, b=b)

    full = "payment retry policy"
    assert r("retry policy payment", full) == 1
    assert 0.85 <= r("payment retry polcy", "payment retry policy") < 1
    assert r("payment retry polcy", "payment") < 0.85
    assert r("aaaa bbbb czzz", "aaaa bbbb cccc") == pytest.approx(22 / 28)


def test_bound_is_an_upper_bound(spark):
    pairs = [("abc def", "abd"), ("x", "xxxxxxxx"), ("aa bb cc", "cc bb aa"), ("", "a")]
    for r in spark.createDataFrame(pairs, "a string, b string").select(t.ratio_bound(F.col("a"), F.col("b")).alias("up"), t.token_sort_ratio("a", "b").alias("r")).collect():
        assert r.r <= r.up + 1e-12


def test_lines(spark):
    df = spark.createDataFrame([("a\r\nb\x0bc d\n",), ("",), ("x",)], "s string").select("s", t.lines(F.col("s")).alias("l"))
    for r in df.collect():
        assert r.l == r.s.splitlines()


def test_lexical_tokens_are_ascii(spark):
    assert one(spark, t.lexical_tokens(F.col("s")), s="Grün-Kohl 12x") == ["gr", "n", "kohl", "12x"]


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 1.0], math.sqrt(0.5)), ([], [], 0.0), ([1.0], [1.0, 2.0], 0.0), ([0.0, 0.0], [1.0, 2.0], 0.0)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, w double")
    for r in df.select(t.cosine(F.col("a"), F.col("b")).alias("c"), "w").collect():
        assert r.c == pytest.approx(r.w)


def test_ids_and_slugs(spark):
    assert one(spark, t.suggest_id(t.norm("s"), F.lit("concept")), s="Decision Layer") == "concept::decision_layer"
    with pytest.raises(Exception, match="nothing"):
        one(spark, t.suggest_id(t.norm("s"), F.lit("c")), s="--")
    assert one(spark, t.slug(F.col("s")), s="  AI & OS! ") == "ai-os"


def test_signature_and_bands(spark):
    sig = t.signature("alpha beta")
    assert len(sig) == t.PERMUTATIONS and sig == t.signature("alpha beta")
    got = spark.createDataFrame([(sig,)], "s array<long>").select(t.bands(F.col("s")).alias("b")).first().b
    assert [list(b.rows) for b in got] == [sig[i : i + 4] for i in range(0, 32, 4)]
    assert t.trigrams("") == {b"   "}


def test_plain_text():
    page = "<p>Hello <b>big</b>  world<br>next&amp;last</p><script>var a='<p>no</p>';</script><ul><li>one<li>two</ul><style>x</style>"
    assert t.plain_text(page) == "Hello big world\nnext&last\none\ntwo"


def test_report_helpers(spark):
    df = spark.createDataFrame([(1, 3, "error_x"), (0, 0, None), (2, 2, "rules")], "n int, d int, p string")
    rows = df.select(t.percent(F.col("n"), F.col("d")).alias("x"), t.is_error_path(F.col("p")).alias("e")).collect()
    assert [(r.x, r.e) for r in rows] == [(33.3, True), (0.0, True), (100.0, False)]
    assert one(spark, t.redact_paths(F.col("s")), s="see /home/me/work/a.txt") == "see <workspace>/work/a.txt"
