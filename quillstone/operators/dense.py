"""Exact search over dense vectors, and the indexes that embedders fill."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillstone.operators.lexical import top

BLOCK = 1024  # queries that are broadcast at once
ROWS = 32  # and multiplied at once
Embedder = Callable[[list[str]], list[list[float]]]


def embed(df: DataFrame, text_col: str, embedder: Embedder, out: str = "vector") -> DataFrame:
    """``df`` with a vector for each text: one call of the embedder for each Arrow batch, whose answers are counted."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        vectors = embedder(texts.tolist())
        if len(vectors) != len(texts):
            raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
        return pd.Series([list(map(float, v)) for v in vectors])

    return df.withColumn(out, run(text_col))


def document_index(docs: DataFrame, embedder: Embedder) -> DataFrame:
    """``(doc_id, vector)``."""
    return embed(docs, "text", embedder).select("doc_id", "vector")


def alias_index(gazetteer: DataFrame, embedder: Embedder) -> DataFrame:
    """``(norm, ids, vector)`` of a gazetteer."""
    return embed(gazetteer, "norm", embedder)


def check_dimension(queries: DataFrame, vectors: DataFrame) -> None:
    """An error if queries and documents differ in length (the first of each decides)."""
    q, d = (x.select(F.size("vector").alias("n")).first() for x in (queries, vectors))
    if q and d and q.n != d.n:
        raise ValueError(f"query vectors have {q.n} dimensions, documents {d.n}")


def _unit(vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length, the places of the vectors that have a direction and their unit rows in double precision."""
    out: dict[int, list] = {}
    for i, v in enumerate(vectors):
        x = np.array(v if v is not None else [], float)
        norm = float(np.sqrt((x * x).sum())) if len(x) else 0.0
        if norm > 0:
            out.setdefault(len(x), []).append((i, x / norm))
    return {n: (np.array([i for i, _ in rows]), np.array([x for _, x in rows])) for n, rows in out.items()}


def _unit_column(vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """``_unit`` of an Arrow column, without a Python object for each number."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0))
    out = {}
    for n in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == n)
        x = np.asarray(vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, n)
        norm = np.sqrt((x * x).sum(axis=1))
        if (norm > 0).any():
            out[n] = at[norm > 0], x[norm > 0] / norm[norm > 0, None]
    return out


def scored(queries: DataFrame, vectors: DataFrame, floor: float = 0.0, k: int | None = None) -> DataFrame:
    """``(query_id, doc_id, score)`` of cosine ``floor`` or more, to ten decimals (so that equal vectors tie); of each batch of vectors the ``k`` best of a query, ties to the smaller id.

    Queries are broadcast in blocks of ``BLOCK``; each block is a matrix product with the vectors where they lie, so no pair below the floor, or beyond the k-th of its batch, leaves a task. Vectors without a direction, or of
    another length than the query, have a cosine of 0.
    """
    spark = queries.sparkSession
    q_kind, d_kind = queries.schema["query_id"].dataType, vectors.schema["doc_id"].dataType
    kinds = [to_arrow_type(q_kind), to_arrow_type(d_kind), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
        names, asked = held.value
        for b in batches:
            ids = b.column(0).to_pylist()
            rank = np.argsort(np.argsort(np.array([str(i) for i in ids]) if ids and not isinstance(ids[0], (int, float)) else np.array(ids), kind="stable"), kind="stable")
            own = _unit_column(b.column(1))
            for n, (q_at, q_rows) in asked.items():
                for lo in range(0, len(q_at), ROWS):  # a few queries at a time: what a task holds doesn't grow with their number
                    s = np.zeros((len(q_at[lo : lo + ROWS]), len(ids)))
                    if n in own:
                        s[:, own[n][0]] = q_rows[lo : lo + ROWS] @ own[n][1].T
                    np.round(s, 10, out=s)
                    s += 0.0
                    yield _best(names, q_at[lo : lo + ROWS], ids, rank, s, floor, k, kinds)
            if floor <= 0 and (blank := sorted(set(range(len(names))) - {i for at, _ in asked.values() for i in at.tolist()})):
                for lo in range(0, len(blank), ROWS):
                    some = np.array(blank[lo : lo + ROWS])
                    yield _best(names, some, ids, rank, np.zeros((len(some), len(ids))), floor, k, kinds)

    out, block = None, []

    def ask() -> None:
        nonlocal out
        held = spark.sparkContext.broadcast(([r[0] for r in block], _unit([r[1] for r in block])))
        one = vectors.select("doc_id", "vector").mapInArrow(lambda it: run(it, held), f"query_id {q_kind.simpleString()}, doc_id {d_kind.simpleString()}, score double")
        out = one if out is None else out.unionByName(one)
        block.clear()

    for r in queries.select("query_id", "vector").toLocalIterator():
        block.append((r.query_id, r.vector))
        if len(block) == BLOCK:
            ask()
    if block or out is None:
        ask()
    return out


def _best(names: list, q_at: np.ndarray, ids: list, rank: np.ndarray, s: np.ndarray, floor: float, k: int | None, kinds: list[pa.DataType]) -> pa.RecordBatch:
    if k is not None and k < s.shape[1]:
        order = np.lexsort((np.broadcast_to(rank, s.shape), -s), axis=1)[:, :k]
        row, col = np.repeat(np.arange(len(s)), k), order.ravel()
        ok = s[row, col] >= floor
        row, col = row[ok], col[ok]
    else:
        row, col = np.nonzero(s >= floor)
    return pa.RecordBatch.from_arrays([pa.array([names[q_at[i]] for i in row.tolist()], kinds[0]), pa.array([ids[j] for j in col.tolist()], kinds[1]), pa.array(s[row, col])], names=["query_id", "doc_id", "score"])


def search(queries: DataFrame, vectors: DataFrame, k: int = 10, floor: float = 0.0) -> DataFrame:
    """``(query_id, doc_id, score, rank0)``: the best ``k`` of cosine ``floor`` or more for ``queries (query_id, vector)``. The default drops negatives."""
    check_dimension(queries, vectors)
    return top(scored(queries, vectors, floor, k), k)
