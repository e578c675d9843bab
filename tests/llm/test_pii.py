import math
import re

import pytest

from quillstone.llm import pii as P, registry

CASES = [
    ("write to Jane.Doe+x@mail5.example.com now", "write to [EMAIL] now"), ("call +1 (017) 555-7713 or (030) 555-1234", "call [PHONE] or [PHONE]"), ("card 4736962573099581, 4111 1111 1111 1111", "card [CARD], [CARD]"),
    ("from 97.51.17.173 and 10.0.0.1.", "from [IP] and [IP]."), ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x', "[SECRET] x"), ("DE89 3704 0044 0532 0130 00 ok", "[IBAN] ok"), ("ssn 123-45-6789", "ssn [SSN]"),
    ('key "x" secret: "' + "ab c" * 80 + '" end', 'key "x" [SECRET] end'), ("token=" + "A1b2" * 100 + " end", "[SECRET] end"), ("apikey: abcdefghijklmnop end", "[SECRET] end"),
    ("a -----BEGIN RSA PRIVATE KEY-----\nMIIEow+/=\nabc\n-----END RSA PRIVATE KEY----- b", "a [PEM] b"), ("a -----BEGIN PRIVATE KEY-----\nMIIEow+/=\n\n... b", "a [PEM]... b"),
    ("version 3, 1234 items at 12:30, CC BY-NC 4.0.", None), ("in 2024 the 1.2.3 release", None), ("the token ring", None), ("", None), ("números 12 y 34", None),
]


@pytest.mark.parametrize("text, want", CASES)
def test_shapes(text, want):
    assert P.rewrite(text)[0] == (text if want is None else want)


def brute(rows):
    """Counts over the documents themselves; words are found one by one in the whole of each text."""
    n, ent, term, both, ctx = len({d for d, t in rows if t is not None}), {}, {}, {}, {}
    for d, t in rows:
        for w in set(re.findall(r"[^\W_]+", (t or "").casefold())):
            term.setdefault(w, set()).add(d)
        found = P.mentions(t or "")
        for i, (s, e, _, value) in enumerate(found):
            left = t[found[i - 1][1] if i else 0 : s].casefold()
            right = t[e : found[i + 1][0] if i + 1 < len(found) else len(t)].casefold()
            near = re.findall(r"[^\W_]+", left)[-5:] + re.findall(r"[^\W_]+", right)[:5]
            ent.setdefault(value, set()).add(d)
            for w in near:
                if len(w) >= 4 and not re.search(r"[\d_]", w):
                    both.setdefault((value, w), set()).add(d)
                    ctx.setdefault((value, w), set()).add(tuple(near))
    out = {}
    for (e, w), c in ctx.items():
        p_e, k = len(ent[e]) / n, len(c)
        p = (k * len(both[e, w]) / len(term[w]) + p_e) / (k + 1)
        if p_e < 1 and math.log2(p / p_e) / -math.log2(p_e) >= 0.8:
            out[P.digest(e), w] = math.log2(p / p_e)
    return out


def test_disclosures_against_brute_force(spark, docs):
    filler = [(100 + i, f"plain words about nothing number {'abcdefghij'[i % 10] * 5}") for i in range(60)]
    rows = filler + [
        (1, "yesterday Zebediah wrote from zeb@mail.example.com about plain"), (2, "ask Zebediah, zeb@mail.example.com, about words"), (3, "about plain zeb@mail.example.com words"), (4, "nothing"), (5, "Jonathan near plain ann@mail.example.com words"), (6, "Jonathan near plain ann@mail.example.com words"),
    ] + [(200 + i, "yesterday near wrote") for i in range(9)]
    d = docs(*rows)
    want = brute(rows)
    flagged, _ = P.disclosures(d)
    got = {(r.entity, r.term): r.pmi for r in flagged.collect()}
    assert got == pytest.approx(want) and {w for _, w in got} == {"zebediah", "jonathan"}
    out = {r.doc_id: r.text for r in P.sanitize(d).collect()}
    assert out[1] == "yesterday [TERM] wrote from [EMAIL] about plain" and out[5] == "[TERM] near plain [EMAIL] words"
    assert all(out[i] == t for i, t in filler)


def test_disclosures_of_the_whole_table(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in d.collect()]
    want = brute(rows)
    assert {(r.entity, r.term): r.pmi for r in P.disclosures(d)[0].collect()} == pytest.approx(want)
    out = {r.doc_id: r for r in P.sanitize(d).collect()}
    held = {i for i, t in rows if P.mentions(t or "")}
    assert want and sum(out[i].n_terms > 0 for i in held) > len(held) / 10 and all(out[i].text == t for i, t in rows if i not in held)


def test_neighbours_of_any_length_are_read_whole():
    long = "x" * 900
    (_, near, _), = P.contexts(f"first {long} second y@mail.example.com third {long}y fourth", P.mentions(f"first {long} second y@mail.example.com third {long}y fourth"))
    assert near == sorted(["first", long, "second", "third", long + "y", "fourth"])
    assert P.rewrite("İstanbul x@mail.example.com", frozenset(["stanbul"]))[0] == "[TERM] [EMAIL]"


def test_counting_by_join_agrees(spark, docs, monkeypatch):
    rows = [(i, f"person{'x' * (i % 3)} Großmann{'ß' * (i % 4)} İstanbul zzname{'ab'[i % 2]} a{i % 2}@mail.example.com other{'y' * i}") for i in range(12)] + [(50 + i, "nothing to see") for i in range(20)]
    d = docs(*rows)
    one = {(r.entity, r.term): round(r.pmi, 9) for r in P.disclosures(d)[0].collect()}
    monkeypatch.setattr(P, "MOST_TERMS", 0)
    assert {(r.entity, r.term): round(r.pmi, 9) for r in P.disclosures(d)[0].collect()} == one and any("grossmann" in w for _, w in one)


def test_ids_of_other_types(docs):
    d = docs(*[(i, "Zebediah zeb@mail.example.com" if i < 2 else "plain words") for i in range(80)]).selectExpr("concat('d', doc_id) AS doc_id", "text")
    out = {r.doc_id: (r.text, r.n_terms) for r in P.sanitize(d).collect()}
    assert out["d0"] == ("[TERM] [EMAIL]", 1) and out["d79"] == ("plain words", 0)


def test_whole_table(spark, small):
    got = registry.QUERIES["op3_pii_sanitisation"](spark, small).collect()
    old = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert len(got) == len(old)
    for r in got:
        assert not re.search(r"@\w+\.|\b\d{16}\b|\+1 \(\d|\b[0-9a-f]{40}\b|\b\d+\.\d+\.\d+\.\d+\b", r.text)
        assert (r.text == old[r.doc_id]) == (r.n_entities == 0)


def test_nulls_empty_repeats_long_and_other_columns(docs, clashing):
    d = clashing(docs((None, "x@mail.example.com"), (1, None), (2, ""), (3, "a@mail.example.com"), (3, "a@mail.example.com"), (4, "word " * 200000 + "10.1.2.3")))
    out, e, t = P.sanitize_rows(d)
    assert out.columns == [*d.columns, e, t] and e not in d.columns
    got = sorted(((r.doc_id or 0), None if r.text is None else r.text[-7:]) for r in out.collect())
    assert got == [(0, "[EMAIL]"), (1, None), (2, ""), (3, "[EMAIL]"), (3, "[EMAIL]"), (4, "rd [IP]")]
    assert P.sanitize(docs()).count() == 0
