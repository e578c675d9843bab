"""The smallest sufficient context: diverse choice within a budget, strongest at the edges, with a manifest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

CHOSEN = "query_id {key}, doc_id string, print long, tokens int, rel double, mmr_score double, pick int"


def _id_key(name: str) -> list[int]:
    """A sort key. Smaller ids are greater; of two that begin alike, the longer is."""
    return [-ord(c) for c in name]


def choose(tokens: list[int], rel: list[float], ids: list[str], vectors: list[list[float] | None], budget: int, lam: float, duplicate: float) -> list[tuple[int, float]]:
    """(index, value) in order of choice by maximal marginal relevance. The greatest similarity to what is chosen is kept up as it grows; what no longer fits or is too similar
    can't come back, so it is dropped for good."""
    order = sorted(range(len(ids)), key=lambda i: (rel[i], _id_key(ids[i])), reverse=True)  # of equal values the first is best
    if duplicate > 0 and not any(v is not None and len(v) for v in vectors):  # nothing is like anything, so the order is the choice
        picks, named, left = [], set(), budget
        for i in order:
            if tokens[i] <= left and ids[i] not in named:
                picks.append((i, float(lam * rel[i])))
                named.add(ids[i])
                left -= tokens[i]
        return picks
    at = np.array(order, int)
    size, worth, name = np.asarray(tokens)[at], np.asarray(rel, float)[at], pd.factorize(np.asarray(ids, object)[at])[0]
    dims, units = np.zeros(len(at), int), {}
    row = np.zeros(len(at), int)
    for i, k in enumerate(at):
        x = np.array([] if vectors[k] is None else vectors[k], dtype=float)
        norm = float(np.sqrt((x * x).sum())) if len(x) else 0.0
        if norm > 0:
            dims[i], row[i] = len(x), len(units.setdefault(len(x), []))
            units[len(x)].append(x / norm)
    units = {n: np.array(u) for n, u in units.items()}
    most, out, left, free = np.zeros(len(at)), [], budget, np.arange(len(at))
    while True:
        free = free[size[free] <= left]
        if not len(free):
            return out
        values = lam * worth[free] - (1 - lam) * most[free]
        best = int(np.argmax(values))
        pick = free[best]
        out.append((int(at[pick]), float(values[best])))
        left -= int(size[pick])
        free = free[name[free] != name[pick]]
        sim, alike = np.zeros(len(free)), np.flatnonzero((dims[free] == dims[pick]) & (dims[free] > 0))
        if len(alike):
            u = units[dims[pick]]
            sim[alike] = np.einsum("ij,j->i", u[row[free[alike]]], u[row[pick]])
        most[free] = sim if len(out) == 1 else np.maximum(most[free], sim)
        free = free[most[free] < duplicate]


def choice(candidates: DataFrame, lam: float = 0.5, duplicate: float = 0.95) -> DataFrame:
    """Chosen rows of ``candidates (query_id, doc_id, print, tokens, rel, embedding, budget)``, which hold no contents; each query is a group of its own, many of which share a batch. ``print`` tells rows of one doc_id apart."""

    key = candidates.schema["query_id"].dataType
    kinds = [to_arrow_type(key), pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32()]

    def picked(g: list[tuple]) -> list[tuple]:
        q, ids, prints, tokens, rel, vectors, budget = zip(*g)
        return [(q[i], ids[i], prints[i], tokens[i], rel[i], v, n) for n, (i, v) in enumerate(choose(tokens, rel, ids, vectors, int(budget[0]), lam, duplicate))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows of a query that may go on in the next batch

        def chosen(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names=["query_id", "doc_id", "print", "tokens", "rel", "mmr_score", "pick"])

        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and row[0] != held[0][0]:
                    out += picked(held)
                    held = []
                held.append(row)
            yield chosen(out)
        if held:
            yield chosen(picked(held))

    c = candidates.select("query_id", "doc_id", "print", F.col("tokens").cast("int").alias("tokens"), F.col("rel").cast("double").alias("rel"), "embedding", "budget")
    return c.repartition("query_id").sortWithinPartitions("query_id", "doc_id", "print").mapInArrow(run, CHOSEN.format(key=key.simpleString()))


def select(candidates: DataFrame, lam: float = 0.5, duplicate: float = 0.95) -> DataFrame:
    """Chosen rows of ``candidates (query_id, doc_id, content, tokens, rel, embedding, budget)``. Contents are not grouped, only joined to what is chosen."""
    c = candidates.withColumn("print", F.xxhash64("content"))
    texts = c.select(F.col("query_id").alias("q"), F.col("doc_id").alias("d"), F.col("print").alias("p"), "content")
    found = choice(c, lam, duplicate).join(texts, F.col("query_id").eqNullSafe(F.col("q")) & (F.col("doc_id") == F.col("d")) & (F.col("print") == F.col("p")))
    return found.dropDuplicates(["query_id", "doc_id", "print"]).select("query_id", "doc_id", "content", "tokens", "rel", "mmr_score", "pick")


def fold_order(chosen: DataFrame) -> DataFrame:
    """``position``: by relevance, alternately from the front and from the back."""
    w = Window.partitionBy("query_id")
    i = F.row_number().over(w.orderBy(F.desc("rel"), "doc_id")) - 1
    n = F.count("*").over(w)
    return chosen.withColumn("position", F.when(i % 2 == 0, i / 2).otherwise(n - 1 - (i - 1) / 2).cast("int"))


def emit(placed: DataFrame) -> DataFrame:
    """``(query_id, text, manifest, total_tokens)``."""
    rows = F.array_sort(F.collect_list(F.struct("position", "doc_id", "tokens", "rel", "mmr_score", "content")))
    packed = placed.groupBy("query_id").agg(rows.alias("r"), F.sum("tokens").alias("total_tokens"))
    text = F.array_join(F.transform("r", lambda x: F.concat(F.lit("[["), x["doc_id"], F.lit("]]\n"), x["content"])), "\n\n")
    manifest = F.transform("r", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["tokens"].alias("tokens"), x["rel"].alias("rel"), x["mmr_score"].alias("mmr_score"), x["position"].alias("position")))
    return packed.select("query_id", text.alias("text"), manifest.alias("manifest"), "total_tokens")


def assemble(candidates: DataFrame, lam: float = 0.5, duplicate: float = 0.95) -> DataFrame:
    return emit(fold_order(select(candidates, lam, duplicate)))
