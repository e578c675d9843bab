"""Operator 9: benchmark decontamination with one Aho-Corasick automaton.

Texts and benchmark items are case-folded and reduced to their words. Every window of ``gram`` words of an item (the whole
item, if shorter) is a pattern of one automaton, which scans a text once; overlapping windows of an item join into runs. A run counts
if it spans ``min_run`` words, or all the words of an item with ``min_words`` at least. Its offsets are mapped back to the text as given.

The automaton is built on each worker from the broadcast items. Items of more than ``most_chars`` characters in all are split over
several scans of the same kind, so that what is broadcast at once is bounded.

Defined cases: a very long text is scanned whole; matches that tie or overlap are all reported, by place and then in the order of the items; ids may be of any type; null or empty texts, and items of fewer than ``min_words`` words, match nothing; repeated items report
each item_id; repeated rows each report their matches; rows with a null id are scanned and reported with that null;
empty tables give no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillstone.llm.common import frugal

GRAM, MIN_RUN, MIN_WORDS, MOST_CHARS = 8, 13, 5, 20_000_000
_GAP = re.compile(r"[\W_]+")
_TOKEN = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _TOKEN.findall(text.casefold())


def automaton(items: list[tuple[int, str]], gram: int = GRAM, min_words: int = MIN_WORDS):
    """The automaton, whose values are lists of (index of item, first word, words), and the items' lengths in words."""
    auto, values, lens = ahocorasick.Automaton(), {}, []
    for k, (_, text) in enumerate(items):
        w = words(text or "")
        lens.append(len(w))
        if len(w) < min_words:
            continue
        n = min(gram, len(w))
        for i in range(len(w) - n + 1):
            values.setdefault(" " + " ".join(w[i : i + n]) + " ", []).append((k, i, n))
    for p, v in values.items():
        auto.add_word(p, (len(p), v))
    if values:
        auto.make_automaton()
    return (auto if values else None), lens


def _back(text: str, folded: str) -> np.ndarray | None:
    """Offset in ``text`` for each offset in ``folded``; None if they agree."""
    if len(text) == len(folded):
        return None
    return np.append(np.repeat(np.arange(len(text)), [len(c.casefold()) for c in text]), len(text))


def find(text: str, auto, lens: list[int], min_run: int = MIN_RUN) -> list[tuple[int, int, int, int]]:
    """(index of item, start, end, words) of each run that counts, in order."""
    folded = text.casefold()
    norm = " " + _GAP.sub(" ", folded).strip() + " "
    hits: dict[tuple[int, int], list[tuple[int, int]]] = {}
    starts = None
    for end, (size, values) in auto.iter(norm):
        if starts is None:
            starts = np.flatnonzero(np.frombuffer(norm.encode("utf-32-le"), np.uint32) == 32)
        at = int(np.searchsorted(starts, end - size + 1))
        for k, i, n in values:
            hits.setdefault((k, at - i), []).append((at, n))  # one alignment of item and text
    if not hits:
        return []
    runs = []
    for (k, _), found in hits.items():
        found.sort()
        lo, hi = found[0][0], found[0][0] + found[0][1]
        for at, n in [*found[1:], (1 << 60, 0)]:
            if at > hi:
                if hi - lo >= min(min_run, lens[k]):
                    runs.append((k, lo, hi))
                lo = at
            hi = at + n if at > hi else max(hi, at + n)
    if not runs:
        return []
    spans = [m.span() for m in _TOKEN.finditer(folded)]
    back = _back(text, folded)
    out = set()
    for k, lo, hi in runs:
        s, e = spans[lo][0], spans[hi - 1][1]
        if back is not None:
            s, e = int(back[s]), int(back[e - 1]) + 1
        out.add((k, s, e, hi - lo))
    return sorted(out, key=lambda r: (r[1], r[2], r[0]))


_built: dict = {}


def _held(held, gram: int, min_words: int) -> tuple:
    items = held.value
    key = (id(items), gram, min_words)
    if key not in _built:
        _built.clear()
        _built[key] = (items, *automaton(items, gram, min_words))
    return _built[key]


@frugal
def _scan(batches: Iterator[pa.RecordBatch], held, item_kind: pa.DataType, gram: int, min_run: int, min_words: int) -> Iterator[pa.RecordBatch]:
    items, auto, lens = _held(held, gram, min_words)
    for b in batches:
        rows: list[list] = [[], [], [], [], [], []]
        if auto is not None:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for k, s, e, n in find(t, auto, lens, min_run) if t else ():
                    for col, v in zip(rows, (d, items[k][0], s, e, n, t[s:e])):
                        col.append(v)
        kinds = (b.column(0).type, item_kind, pa.int64(), pa.int64(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], ["doc_id", "item_id", "start", "end", "n_words", "passage"])


@frugal
def _filter(batches: Iterator[pa.RecordBatch], held, at: int, gram: int, min_run: int, min_words: int) -> Iterator[pa.RecordBatch]:
    """The rows without a run that counts; the text is column ``at``."""
    _, auto, lens = _held(held, gram, min_words)
    for b in batches:
        yield b if auto is None else b.filter(pa.array([not (t and find(t, auto, lens, min_run)) for t in b.column(at).to_pylist()], pa.bool_()))


def _parts(benchmark: DataFrame, item_col: str, item_text_col: str, most_chars: int) -> Iterator[list[tuple]]:
    """The items in parts of up to ``most_chars`` characters (a longer item is one), one part at a time; an empty one if there are none."""
    part: list[tuple] = []
    size = 0
    for r in benchmark.select(F.col(item_col).alias("i"), F.col(item_text_col).alias("t")).where(F.col("t").isNotNull()).orderBy("i", "t").toLocalIterator():
        if part and size + len(r.t) > most_chars:
            yield part
            part, size = [], 0
        part.append((r.i, r.t))
        size += len(r.t)
    yield part


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", gram: int = GRAM, min_run: int = MIN_RUN, min_words: int = MIN_WORDS, most_chars: int = MOST_CHARS) -> DataFrame:
    """``(doc_id, item_id, start, end, n_words, passage)`` of each benchmark run found in ``docs``; ``passage`` is ``text[start:end]``."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    item = benchmark.schema[item_col].dataType
    schema, item_kind = f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {item.simpleString()}, start long, end long, n_words int, passage string", to_arrow_type(item)
    found = None
    for part in _parts(benchmark, item_col, item_text_col, most_chars):
        held = spark.sparkContext.broadcast(part)
        one = source.mapInArrow(lambda it, held=held: _scan(it, held, item_kind, gram, min_run, min_words), schema)
        found = one if found is None else found.unionByName(one)
    return found


def clean_rows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", gram: int = GRAM, min_run: int = MIN_RUN, min_words: int = MIN_WORDS, most_chars: int = MOST_CHARS) -> DataFrame:
    """``docs`` without the rows that hold a benchmark run; one pass over the rows, no join."""
    names, at = docs.columns, docs.columns.index(text_col)
    out = docs.toDF(*[f"c{i}" for i in range(len(names))])
    for part in _parts(benchmark, item_col, item_text_col, most_chars):
        held = docs.sparkSession.sparkContext.broadcast(part)
        out = out.mapInArrow(lambda it, held=held: _filter(it, held, at, gram, min_run, min_words), out.schema)
    return out.toDF(*names)
