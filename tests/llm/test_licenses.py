import random
import re

from quillstone.llm import licenses as L, registry
from quillstone.llm.license_rules import rules


def brute(text):
    """Every rule on the text, without the keyword gate; suppression by comparing with all that stands."""
    found = []
    for n, (_, p, _, _, e) in enumerate(rules()):
        found += [(-p, m.start() - m.end(), m.start(), n, m.end()) for m in re.finditer(e, text, re.I | re.S) if m.end() > m.start()]
    out = []
    for _, _, s, n, e in sorted(found):
        if not any((a <= s and e <= b) or (s <= a and b <= e) for a, b, _ in out):
            out.append((s, e, n))
    return sorted(out)


def test_hundreds_of_rules_whose_keywords_are_in_their_texts():
    all_ = rules()
    assert len(all_) > 300 and len({r[0] for r in all_}) == len(all_) and all(k == k.lower() for _, _, _, k, _ in all_)


def test_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    want = sorted((d.doc_id, s, e, rules()[n][0]) for d in docs for s, e, n in brute(d.text))
    got = registry.QUERIES["op10_license_scan"](spark, small).collect()
    assert sorted((r.doc_id, r.start, r.end, r.rule) for r in got) == want and want


TEXTS = [
    ("SPDX-License-Identifier: Apache-2.0", ["Apache-2.0"]), ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]), ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
    ("Released under the MIT License.\nAll rights reserved.", ["MIT", "All-rights-reserved"]), ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]), ("er kommt mit der Lizenz", []), ("mit freundlichen", []),
    ("Permission is hereby granted,\n free of charge, to any person obtaining a copy of this software and associated documentation files", ["MIT"]), ("see https://www.apache.org/licenses/LICENSE-2.0", ["Apache-2.0"]),
    ("GNU Lesser General Public License", ["LGPL"]), ("Copyright (c) 2020-2024 me", ["Copyright"]), ("under the Creative Commons Attribution-ShareAlike 4.0 International", ["CC-BY-SA-4.0"]),
]


def test_texts(docs):
    got = L.detect(docs(*[(i, t) for i, (t, _) in enumerate(TEXTS)])).orderBy("doc_id", "start").collect()
    for i, (t, want) in enumerate(TEXTS):
        assert [r.license for r in got if r.doc_id == i] == want, t
        assert all(t[r.start : r.end] == r.matched for r in got if r.doc_id == i)


def test_suppression_against_brute_force():
    rng, sc = random.Random(4), L.Scanner()
    for _ in range(150):
        t = " ".join(rng.choice(TEXTS)[0] for _ in range(rng.randint(1, 6)))
        assert sc.scan(t) == brute(t)


def test_nulls_empty_repeats_long_and_other_columns(docs, clashing):
    d = clashing(docs((None, "MIT License"), (1, None), (2, ""), (3, "MIT License"), (3, "MIT License"), (4, "word " * 200000 + "MIT License")))
    got = L.detect(d).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.start) for r in got) == [(-1, 0), (3, 0), (3, 0), (4, 1000000)]
    assert L.detect(docs()).count() == 0


def written(items, most=2000):
    """Texts that match a parsed expression: every branch, and optional parts both with and without."""
    outs = [""]
    for op, a in items:
        op = str(op)
        if op == "LITERAL":
            new = [chr(a)]
        elif op == "IN":
            new = [c for c in " 1azx.-,/\"'\u2013:;()" if re.fullmatch(parsed_class(a), c)][:2] + [chr(v) for k, v in a if str(k) == "LITERAL" and str(a[0][0]) != "NEGATE"]
        elif op == "BRANCH":
            new = [t for b in a[1] for t in written(b, most)]
        elif op == "SUBPATTERN":
            new = written(a[3], most)
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            new = ([""] if a[0] == 0 else []) + [t * max(a[0], 1) for t in written(a[2], most)]
        else:
            new = ["z"] if op in ("ANY", "NOT_LITERAL") else [""]
        outs = [x + y for x in outs for y in dict.fromkeys(new)]
        if len(outs) > most:
            outs = random.Random(1).sample(outs, most)
    return outs


def parsed_class(a):
    kinds = {"CATEGORY_SPACE": r"\s", "CATEGORY_DIGIT": r"\d", "CATEGORY_WORD": r"\w", "CATEGORY_NOT_SPACE": r"\S", "CATEGORY_NOT_DIGIT": r"\D", "CATEGORY_NOT_WORD": r"\W"}
    out = ""
    for k, v in a:
        k = str(k)
        out += "^" if k == "NEGATE" else re.escape(chr(v)) if k == "LITERAL" else f"{re.escape(chr(v[0]))}-{re.escape(chr(v[1]))}" if k == "RANGE" else kinds[str(v)]
    return f"[{out}]"


def test_every_match_holds_its_keyword():
    wrong, tried = {}, set()
    for r, _, _, k, e in rules():
        for t in written(re._parser.parse(e, re.I | re.S)):
            if re.search(e, t, re.I | re.S):
                tried.add(r)
                if L.gated(k) not in L.gated(t):
                    wrong.setdefault(r, (k, t))
    assert not wrong and len(tried) > 0.95 * len(rules())


def test_optional_parts_of_apache_rules():
    sc, header = L.Scanner(), "you may not use this file except in compliance with the License. You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"
    for t in ("Licensed under the Apache Software License, Version 2.0", "the Apache Public License", header):
        assert sc.scan(t) == brute(t) != []
    assert [sc.rules[n][1] for _, _, n in sc.scan(header)] == [4]


def test_ids_of_other_types(docs):
    d = docs((1, "Licensed under the Apache License, Version 2.0")).selectExpr("concat('d', doc_id) AS doc_id", "text")
    assert {r.doc_id for r in L.detect(d).collect()} == {"d1"}
