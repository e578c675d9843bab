"""Operator 1: language identification by averaged hashed subword embeddings.

A text is the mean of the embeddings of its subwords: character n-grams (2 to 4) of its words with their boundaries, hashed into ``BUCKETS`` rows. A
linear softmax on top gives the languages. Embeddings and softmax are trained together by stochastic gradient descent in numpy, on the driver, on a
bounded sample of labelled rows (``FIT_ROWS``, whole texts). Both layers being linear, a worker needs only their product: a table of
BUCKETS x languages floats, broadcast, whose size does not depend on the data.

Rejection is calibrated on rows held out of the sample: a temperature is fitted to the softmax; a text is rejected if its confidence
is below the ``REJECT`` quantile of the held-out rows' (at most ``MAX_CONFIDENCE``), or if the share of its subwords whose buckets training met is below
half their least share. Prediction hashes every character of every text; texts of more than ``LONG`` characters in overlapping pieces, whose sums are those of the whole.

Defined cases: texts without letters (null and empty ones too) are rejected with language ``und`` and confidence 0; a tie goes to the first
language by name; rows with a null id are classified as any other; repeated rows each get the same answer; without labelled rows everything is
``und``; an empty table gives an empty table; ``classify`` returns its own columns only, ``accepted_rows`` keeps all columns of the input.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillstone.llm.common import frugal

FIT_ROWS, BUCKETS, DIM, EPOCHS, RATE = 6000, 1 << 18, 16, 4, 1.5
ORDERS = (2, 3, 4)
REJECT, MAX_CONFIDENCE = 0.001, 0.5
CHUNK = 1 << 18
LONG = 4 * CHUNK

_fold: list[np.ndarray] = []


def _table() -> np.ndarray:
    """Code point to folded code point; what is no letter, to a space."""
    if not _fold:
        t = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha() or unicodedata.combining(s):
                low = s.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _fold.append(t)
    return _fold[0]


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of the texts, each between spaces, and the offsets where they end."""
    raw = [t.encode("utf-32-le", "replace") for t in texts]
    sep = (32).to_bytes(4, "little")
    data = np.frombuffer(sep + sep.join(raw) + sep, np.uint32)
    return _table()[data], np.cumsum([len(r) // 4 + 1 for r in raw]) + 1


def subwords(points: np.ndarray, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: bucket of the n-gram at each offset, and whether it lies within one word and its boundaries."""
    space = points == 32
    mixed = points * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    h = mixed.copy()
    inner = np.ones(len(points), bool)
    for n in range(2, max(ORDERS) + 1):
        h = h[:-1] * np.uint32(0x85EBCA77) + mixed[n - 1 :]
        inner = inner[: len(h)] if n == 2 else inner[: len(h)] & ~space[n - 2 : n - 2 + len(h)]
        if n in ORDERS:
            b = h ^ (h >> np.uint32(13))
            b = (b * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - buckets.bit_length() + 1)
            ends = space[: len(h)] & space[n - 1 : n - 1 + len(h)] if n == 2 else False
            yield b, inner & ~ends if n == 2 else inner


def groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about CHUNK characters; one of more than LONG stands alone, wherever it comes."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        if held and len(t) > LONG:
            yield first, held
            first, held, size = i, [], 0
        held.append(t)
        size += len(t)
        if size >= CHUNK:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def pieces(text: str) -> Iterator[np.ndarray]:
    """Folded code points of a text between spaces, in pieces that overlap by the longest n-gram less one, so that each n-gram starts in one piece only."""
    for lo in range(0, len(text) + 2, CHUNK):
        hi = lo + CHUNK + max(ORDERS) - 1
        part = " " * (lo == 0) + text[max(lo - 1, 0) : hi - 1] + " " * (hi >= len(text) + 2)
        yield _table()[np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32)]


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # buckets x (languages + 1): logits, and 1 if training met the bucket
    bias: np.ndarray
    temperature: float
    confidence: float
    known: float


def totals(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the table's rows over each text's subwords, and their number. A long text is taken alone, in pieces, so what it gives doesn't depend on its neighbours."""
    out, n = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts))
    for first, held in groups(texts):
        if len(held[0]) > LONG:
            for points in pieces(held[0]):
                for b, ok in subwords(points):
                    at = b[:CHUNK][ok[:CHUNK]]
                    out[first] += table[at].sum(axis=0, dtype=np.float64)
                    n[first] += len(at)
            continue
        points, ends = _points(held)
        for b, ok in subwords(points):
            at = np.flatnonzero(ok)
            own = np.searchsorted(ends - 1, at, side="right")
            cut = np.flatnonzero(np.diff(own, prepend=-1))
            if len(at):
                out[first + own[cut]] += np.add.reduceat(table[b[at]], cut, axis=0, dtype=np.float64)
                n += np.bincount(own + first, minlength=len(texts))
    return out, n


def _features(text: str) -> tuple[np.ndarray, np.ndarray]:
    points, _ = _points([text])
    ids, counts = np.unique(np.concatenate([b[ok] for b, ok in subwords(points)]), return_counts=True)
    return ids, (counts / max(counts.sum(), 1)).astype(np.float32)


def train(rows: list[tuple[str, str]], seed: int = 7, epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """Fit to (text, language); every fifth row is held out for calibration."""
    rows = [(t, lang) for t, lang in rows if t and lang]
    langs = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(seed)
    data = [(*_features(t), langs.index(lang), t) for t, lang in rows]
    data = [d for d in data if len(d[0])]
    if len(langs) < 2 or len(data) < 10:
        return Model([], np.zeros((BUCKETS, 1), np.float32), np.zeros(0), 1.0, 1.0, 1.0)
    held, fit = data[::5], [d for i, d in enumerate(data) if i % 5]
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    met, steps = np.zeros(BUCKETS, np.float32), epochs * len(fit)
    for step in range(steps):
        if step % len(fit) == 0:
            order = rng.permutation(len(fit))
        ids, x, y, _ = fit[order[step % len(fit)]]
        lr = rate * (1 - step / steps)
        own = emb[ids]
        z = x @ own
        p = np.exp((s := z @ w + bias) - s.max())
        p /= p.sum()
        p[y] -= 1
        dz = w @ p
        w -= lr * np.outer(z, p)
        bias -= lr * 0.1 * p
        emb[ids] = own - (lr * 20) * np.outer(x, dz)
        met[ids] = 1
    table = np.concatenate([np.where(met[:, None] > 0, emb @ w, 0), met[:, None]], 1).astype(np.float32)
    s, n = totals([d[3] for d in held], table)
    logits, known, truth = s[:, :-1] / n[:, None] + bias, s[:, -1] / n, np.array([d[2] for d in held])

    def loss(t: float) -> float:
        return float((np.logaddexp.reduce(logits / t, axis=1) - logits[np.arange(len(truth)), truth] / t).mean())

    temperature = min(np.geomspace(0.05, 5, 60), key=loss)
    q = np.exp(logits / temperature - np.logaddexp.reduce(logits / temperature, axis=1)[:, None]).max(1)
    confidence = float(np.clip(np.quantile(q, REJECT), 1 / len(langs), MAX_CONFIDENCE))
    return Model(langs, table, bias, float(temperature), confidence, float(known.min() / 2))


def predict(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(language, confidence, share of known subwords, accepted) for each text."""
    if not model.langs:
        z = np.zeros(len(texts))
        return ["und"] * len(texts), z, z, z > 0
    s, n = totals(texts, model.table)
    some = n > 0
    logits = (s[:, :-1] / np.maximum(n, 1)[:, None] + model.bias) / model.temperature
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best, known = p.argmax(1), s[:, -1] / np.maximum(n, 1)
    conf = np.where(some, p.max(1), 0.0)
    ok = some & (conf >= model.confidence) & (known >= model.known)
    return [model.langs[b] if k else "und" for b, k in zip(best, some)], conf, known, ok


def fit(docs: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", rows: int = FIT_ROWS) -> Model:
    """Train on about ``rows`` labelled rows, those of least hash of the id: the same rows however the table is partitioned.

    The rows' number decides how small the hash must be, so tasks return the sample's rows only.
    """
    labelled = docs.where(F.col(label_col).isNotNull())
    share = min(1.0, 1.25 * rows / max(labelled.count(), 1))
    h = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.substring(text_col, 1, 100)))
    some = labelled.select(F.col(text_col).alias("t"), F.col(label_col).alias("l"), h.alias("h")).where(F.col("h") <= -(2**63) + int(share * 2**53) * 2**11 - 1)
    found = sorted(some.where(F.length("t") > 0).collect(), key=lambda r: (r.h, r.t, r.l))
    return train([(r.t, r.l) for r in found[:rows]])


@frugal
def _scan(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    """Columns (text, others...) to (others..., language, confidence, known, accepted)."""
    for b in batches:
        lang, conf, known, ok = predict(held.value, [t or "" for t in b.column(0).to_pylist()])
        cols = [*b.columns[1:], pa.array(lang, pa.string()), pa.array(conf), pa.array(known), pa.array(ok)]
        yield pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(cols))])


def _apply(docs: DataFrame, text_col: str, keep: list[str], model: Model) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)
    kinds = [docs.schema[c].dataType.simpleString() for c in keep] + ["string", "double", "double", "boolean"]
    return docs.select(text_col, *keep).mapInArrow(lambda it: _scan(it, held), ", ".join(f"c{i} {k}" for i, k in enumerate(kinds)))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", model: Model | None = None) -> DataFrame:
    """``(doc_id, predicted_lang, confidence, known_share, accepted)`` for every document."""
    return _apply(docs, text_col, [id_col], model or fit(docs, text_col, label_col, id_col)).toDF("doc_id", "predicted_lang", "confidence", "known_share", "accepted")


def accepted_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", model: Model | None = None) -> DataFrame:
    """``docs`` without the rejected rows."""
    out = _apply(docs, text_col, docs.columns, model or fit(docs, text_col, label_col, id_col))
    n, ok = len(docs.columns), f"c{len(docs.columns) + 3}"
    return out.where(ok).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns[:n])])
