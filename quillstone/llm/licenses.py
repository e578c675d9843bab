"""Operator 10: licence scan by ordered signature rules.

Hundreds of hand-written expressions (``license_rules``) are gated by keywords: one Aho-Corasick pass over the text (lower case, hyphens and white space alike) tells
which keywords occur, and only their rules are tried, on the whole text. Detections are taken by priority, then length, then place, then order of
the rules; one whose interval lies within that of one already taken, or holds it, is suppressed. Those which merely overlap both stand.
The operator is one pass without a shuffle.

Defined cases: a very long text is scanned whole; ids may be of any type; null or empty texts have no detections; equal intervals go to the higher priority, then the earlier rule; repeated rows each report theirs;
rows with a null id report that null; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillstone.llm.common import frugal
from quillstone.llm.license_rules import rules

SCHEMA = "license string, rule string, priority int, start long, end long, matched string"


def gated(text: str) -> str:
    """A text as the keywords see it: what the expressions take for a hyphen or white space (a plus too) is one space."""
    return " ".join(text.lower().replace("-", " ").replace("+", " ").split())


class Scanner:
    def __init__(self) -> None:
        self.rules = [(r, p, lic, re.compile(e, re.IGNORECASE | re.DOTALL)) for r, p, lic, _, e in rules()]
        by: dict[str, list[int]] = {}
        for n, (_, _, _, keyword, _) in enumerate(rules()):
            by.setdefault(gated(keyword), []).append(n)
        self.auto = ahocorasick.Automaton()
        for keyword, own in by.items():
            self.auto.add_word(keyword, own)
        self.auto.make_automaton()

    def detections(self, text: str) -> list[tuple[int, int, int]]:
        """All (start, end, index of rule), before suppression."""
        live = {n for _, own in self.auto.iter(gated(text)) for n in own}
        return [(m.start(), m.end(), n) for n in live for m in self.rules[n][3].finditer(text) if m.end() > m.start()]

    def scan(self, text: str) -> list[tuple[int, int, int]]:
        """What stands, by place. Intervals that stand never hold each other, so in order of start they are in order of end too."""
        taken: list[tuple[int, int, int]] = []
        for s, e, n in sorted(self.detections(text), key=lambda d: (-self.rules[d[2]][1], d[0] - d[1], d[0], d[2])):
            at = bisect_left(taken, (s, 0, 0))
            after = at < len(taken) and (taken[at][1] <= e or taken[at][0] == s)
            if not after and not (at and e <= taken[at - 1][1]):
                taken.insert(at, (s, e, n))
        return taken


_scanner: list[Scanner] = []


@frugal
def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not _scanner:
        _scanner.append(Scanner())
    sc = _scanner[0]
    for b in batches:
        kinds = (b.column(0).type, pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        cols: list[list] = [[] for _ in kinds]
        for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for s, e, n in sc.scan(t):
                rule, p, lic, _ = sc.rules[n]
                for c, v in zip(cols, (d, lic, rule, p, s, e, t[s:e])):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "license", "rule", "priority", "start", "end", "matched"])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, license, rule, priority, start, end, matched)`` of each detection; ``matched`` is ``text[start:end]``."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    return source.mapInArrow(_scan, f"doc_id {docs.schema[id_col].dataType.simpleString()}, {SCHEMA}")
