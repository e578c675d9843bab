"""Operator 3: information-theoretic sanitisation of personal data.

Protected entities are found by shape: e-mail addresses, telephone numbers, IP addresses, payment card and account numbers, secrets
assigned to a name, keys. An entity reveals itself entirely, so it is always generalised to its kind (``[EMAIL]``). A term near an entity may reveal
it too. With n(.) the number of documents of the corpus, p(e) = n(e) / N and IC(e) = -log2 p(e), what there is to know of e. Of the documents that hold the term t, a share n(e, t) / n(t) mention e near it; as the
evidence may be thin, the share is shrunk to what is known without it: p(e | t) = (k n(e, t) / n(t) + ``PRIOR`` p(e)) / (k + ``PRIOR``), with k the number of different contexts in which the two stand together (contexts that repeat word for
word count once, so copies are no evidence). PMI(e; t) = log2 p(e | t) / p(e) is what t tells of e. In documents that mention e, a term with PMI / IC of at least ``threshold`` is generalised to ``[TERM]``, and from ``remove`` on removed. Every pair is
scored, those met once as well; all counts are over the whole corpus. Terms are words of four letters or more, without digits, within ``window`` words of a mention.

One light pass finds mentions, one counts the terms near them, one rewrites. Only (entity, term, context) hashes are shuffled, never texts, unless the flagged
documents are too many to broadcast (``SMALL``). Up to ``MOST_TERMS`` terms are broadcast to be counted; of more, the counts of all words are joined with them. Both count the same words.

Defined cases: null texts stay null, empty ones empty; texts without an entity come back unchanged, however long; a very long text is one document, and its entities have no greatest length; rows with a null id are sanitised by shape
alone, as no terms can be tied to them; repeated rows are each rewritten; rows of one doc_id count as one document; ids may be of any type; of terms that tie all are replaced; an empty table gives an empty table;
columns of other names are kept by ``sanitize_rows`` and not read by ``sanitize``.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillstone.llm.common import fresh, frugal, joined, materialize

WINDOW, PRIOR, THRESHOLD, REMOVE = 5, 1.0, 0.8, 0.97
SMALL, MOST_TERMS = 100_000, 500_000

SHAPES = [
    ("PEM", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*-----END [A-Z ]*PRIVATE KEY-----|[A-Za-z0-9+/=\s]*)"),
    ("EMAIL", r"[A-Za-z0-9._%+\-\u00C0-\u024F]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+"),
    ("SECRET", r"""(?i:\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key)\b\s*[:=]\s*)(?:"[^"\n]{6,}"|'[^'\n]{6,}'|[A-Za-z0-9+/_\-]{12,}={0,2})"""),
    ("KEY", r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abpr]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{20,}|[0-9a-f]{40}|[0-9a-f]{64})\b"),
    ("IBAN", r"\b[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?\b"),
    ("CARD", r"(?<![\d.])\d{4}([ \-]?)\d{4}\1\d{4}\1\d{1,7}(?![\d])"),
    ("IP", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)|\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b"),
    ("SSN", r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"),
    ("PHONE", r"(?<![\w.])(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\d)|(?<![\w.])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}(?!\d)|(?<![\w.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\w\-])"),
]
_ENTITY = re.compile("|".join(f"(?P<{k}>{e})".replace(r"\1", r"(?P=sep)").replace(r"([ \-]?)", r"(?P<sep>[ \-]?)") for k, e in SHAPES))
_MAY = re.compile(r"[@0-9]|(?i:token|secret|passw|pwd|(?:api|access|private)[ _-]?key)")
MAY = r"[@0-9]|(?i)(token|secret|passw|pwd|(api|access|private)[ _-]?key)"
_TERM = re.compile(r"[^\W\d_]{4,}")
_WORD = re.compile(r"[^\W_]+")


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value in one case) of the protected entities, by place."""
    return [(m.start(), m.end(), m.lastgroup if m.lastgroup != "sep" else "CARD", m.group().lower()) for m in _ENTITY.finditer(text)] if _MAY.search(text) else []


def digest(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _before(text: str, start: int, end: int, window: int) -> list[str]:
    """The last ``window`` words, folded, of ``text[start:end]``; no more of it is read than they need."""
    size = 16 * window
    while True:
        size *= 4
        words = _WORD.findall(text[max(start, end - size) : end].casefold())
        if end - size <= start or len(words) > window:  # one more than needed, as the first may be cut
            return words[-window:]


def _after(text: str, start: int, end: int, window: int) -> list[str]:
    size = 16 * window
    while True:
        size *= 4
        words = _WORD.findall(text[start : min(end, start + size)].casefold())
        if start + size >= end or len(words) > window:
            return words[:window]


def contexts(text: str, found: list[tuple[int, int, str, str]], window: int = WINDOW) -> list[tuple[int, list[str], int]]:
    """For each mention: hash of the entity, the terms near it (folded, distinct), hash of the context word for word."""
    out = []
    for n, (s, e, _, value) in enumerate(found):
        left_end, right_start = (found[n - 1][1] if n else 0), (found[n + 1][0] if n + 1 < len(found) else len(text))
        near = _before(text, left_end, s, window) + _after(text, e, right_start, window)
        out.append((digest(value), sorted({w for w in near if _TERM.fullmatch(w)}), digest(" ".join(near))))
    return out


@frugal
def _mentions(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ent, doc, ctx, terms = [], [], [], []
        for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for e, near, c in contexts(t, mentions(t), window):
                ent.append(e)
                doc.append(d)
                ctx.append(c)
                terms.append(near)
        yield pa.RecordBatch.from_arrays([pa.array(ent, pa.int64()), pa.array(doc, b.column(0).type), pa.array(ctx, pa.int64()), pa.array(terms, pa.list_(pa.string()))], names=["entity", "doc", "ctx", "terms"])


@frugal
def _count(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    wanted, n = held.value, dict.fromkeys(held.value, 0)
    for b in batches:
        for t in b.column(0).to_pylist():
            for w in wanted.intersection(_WORD.findall(t.casefold())):
                n[w] += 1
    yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["term", "n"])


@frugal
def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of a batch's texts that hold each word that could be a term."""
    for b in batches:
        n = Counter(w for t in b.column(0).to_pylist() for w in set(_WORD.findall(t.casefold())) if _TERM.fullmatch(w))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["term", "n"])


def disclosures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, prior: float = PRIOR, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """``(entity, term, pmi, ic, disclosure)`` that reach ``threshold``, and the mentions ``(entity, doc, ctx, terms)``."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    seen = materialize(source.where(F.col("text").rlike(MAY)).mapInArrow(lambda it: _mentions(it, window), f"entity long, doc {kind}, ctx long, terms array<string>"), "mentions")
    near = seen.select("entity", "doc", "ctx", F.explode("terms").alias("term"))
    both = materialize(near.groupBy("entity", "term").agg(F.count_distinct("ctx").alias("contexts"), F.count_distinct("doc").alias("n_both")), "pairs")
    terms = materialize(both.select("term").distinct(), "terms")
    total = source.select(F.count("*")).first()[0]
    if (n_terms := terms.count()) <= MOST_TERMS:
        held = spark.sparkContext.broadcast(frozenset(r.term for r in terms.toLocalIterator()))
        df = source.select("text").mapInArrow(lambda it: _count(it, held), "term string, n long") if n_terms else terms.select("term", F.lit(0).cast("long").alias("n"))
    else:
        df = source.select("text").mapInArrow(_words, "term string, n long").join(terms, "term", "left_semi")
    n_term = df.groupBy("term").agg(F.sum("n").alias("n_term"))
    n_ent = seen.groupBy("entity").agg(F.count_distinct("doc").alias("n_entity"))
    p_e, k = F.col("n_entity") / F.lit(float(max(total, 1))), F.col("contexts")
    p = (k * F.col("n_both") / F.greatest("n_term", "n_both") + F.lit(prior) * p_e) / (k + F.lit(prior))
    scored = both.join(n_ent, "entity").join(n_term, "term").select("entity", "term", F.log2(p / p_e).alias("pmi"), (-F.log2(p_e)).alias("ic"))
    scored = scored.where("ic > 0").withColumn("disclosure", F.col("pmi") / F.col("ic"))
    return scored.where(F.col("disclosure") >= threshold), seen


def rewrite(text: str, general: frozenset[str] = frozenset(), removed: frozenset[str] = frozenset()) -> tuple[str, int, int]:
    """The text without its entities and the given terms, and how many of either were replaced."""
    found = mentions(text)
    if not found:
        return text, 0, 0
    out, at, n_terms = [], 0, 0

    def plain(part: str) -> str:
        nonlocal n_terms
        if not general and not removed:
            return part

        def one(m: re.Match) -> str:
            nonlocal n_terms
            w = m.group().casefold()
            w = {w} if w.isalnum() else set(_WORD.findall(w))  # folding can part a word
            if gone := w & removed or w & general:
                n_terms += 1
                return "" if gone & removed else "[TERM]"
            return m.group()

        return _WORD.sub(one, part)

    for s, e, kind, _ in found:
        out += [plain(text[at:s]), f"[{kind}]"]
        at = e
    return "".join([*out, plain(text[at:])]), len(found), n_terms


@frugal
def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns (text, general, removed, others...) to (text, others..., n_entities, n_terms)."""
    for b in batches:
        texts, ents, terms = [], [], []
        general, removed = b.column(1), b.column(2)
        g_null, r_null = general.null_count == len(general), removed.null_count == len(removed)
        for n, t in enumerate(b.column(0).to_pylist()):
            if t is None:
                x = (None, 0, 0)
            else:
                g = frozenset() if g_null else frozenset(general[n].as_py() or ())
                r = frozenset() if r_null else frozenset(removed[n].as_py() or ())
                x = rewrite(t, g, r)
            texts.append(x[0])
            ents.append(x[1])
            terms.append(x[2])
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *b.columns[3:], pa.array(ents, pa.int32()), pa.array(terms, pa.int32())], names=["c0", *(f"c{i}" for i in range(3, b.num_columns)), "e", "t"])


def sanitize_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove: float = REMOVE, **kw) -> tuple[DataFrame, str, str]:
    """``docs``, its text sanitised, and two more columns, whose names are returned: numbers of entities and of terms replaced."""
    flagged, seen = disclosures(docs, id_col, text_col, **kw)
    rows = seen.select("entity", "doc").distinct().join(flagged.select("entity", "term", "disclosure"), "entity")
    rows = rows.groupBy("doc", "term").agg(F.max("disclosure").alias("d"))
    g, r, n_e, n_t, key = fresh(docs, "general"), fresh(docs, "removed"), fresh(docs, "n_entities"), fresh(docs, "n_terms"), fresh(docs, "doc_key")
    per = rows.groupBy(F.col("doc").alias(key)).agg(F.collect_set(F.when(F.col("d") < remove, F.col("term"))).alias(g), F.collect_set(F.when(F.col("d") >= remove, F.col("term"))).alias(r))
    per = materialize(per, "flagged")
    out = joined(docs.withColumn(key, F.col(id_col)), per, key, "left", SMALL)
    rest = [c for c in docs.columns if c != text_col]
    schema = ", ".join(["c0 string", *(f"c{i + 3} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(rest)), "e int", "t int"])
    new = out.select(text_col, g, r, *rest).mapInArrow(_rewrite, schema)
    place = {c: f"c{i + 3}" for i, c in enumerate(rest)} | {text_col: "c0"}
    return new.select(*[F.col(place[c]).alias(c) for c in docs.columns], F.col("e").alias(n_e), F.col("t").alias(n_t)), n_e, n_t


def sanitize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``(doc_id, text, n_entities, n_terms)`` for every document."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return sanitize_rows(own, **kw)[0]
