"""Operator 6: packing sequences into windows by non-negative least squares.

Lengths (tokens) are put into ``BINS`` bins of equal width up to the window, each bin standing for its greatest length. All combinations of up to ``DEPTH``
bins that fill the window exactly are enumerated; non-negative least squares finds how often each should be used so that together they use up the histogram, a shortfall
weighing little and an excess much. Counts are rounded down and fitted to what is there; the residue is packed greedily, longest first, a pattern at a time,
so the driver's work depends on the number of bins and not on the data. Then every record is ranked within its bin (bins of more than ``SHARE`` rows are dealt out) and finds its
window by its rank: the plan shuffles only (id, piece, length), never texts.

Records longer than the window are cut into full windows and a rest, so every token is packed exactly once, and no window is overfull.

Defined cases: very long texts are cut as any other; null and empty texts have length 0 and window null; repeated rows and rows with a null id are packed each on their own (ties in rank go by id, then text hash);
an empty table gives an empty table; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillstone.llm.common import materialize

WINDOW, BINS, DEPTH = 2048, 128, 3
SHARE = 250_000  # rows of a bin that are ranked in one task


def combinations(bins: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Descending tuples of up to ``depth`` of 1..bins that add up to ``bins``."""
    out: list[tuple[int, ...]] = []

    def grow(left: int, most: int, held: tuple[int, ...]) -> None:
        if not left:
            out.append(held)
        elif len(held) < depth:
            for b in range(min(left, most), 0, -1):
                if b * (depth - len(held)) < left:
                    break
                grow(left - b, b, (*held, b))

    grow(bins, bins, ())
    return out


def nnls(a: np.ndarray, y: np.ndarray, most: int = 2000) -> np.ndarray:
    """Minimise |a x - y| over x >= 0 by the active-set method of Lawson and Hanson."""
    m, n = a.shape
    x, passive = np.zeros(n), np.zeros(n, bool)
    gram, ay = a.T @ a, a.T @ y  # normal equations: small solves, where a decomposition of ``a`` in each step would start threads
    tol = 1e-9 * max(1.0, float(np.abs(a.T @ y).max(initial=0)))
    for _ in range(most):
        w = np.where(passive, -np.inf, a.T @ (y - a @ x))
        j = int(w.argmax())
        if w[j] <= tol:
            break
        passive[j] = True
        while True:
            z = np.zeros(n)
            k = np.flatnonzero(passive)
            z[k] = np.linalg.solve(gram[np.ix_(k, k)] + 1e-10 * np.eye(len(k)), ay[k])
            if (z[passive] > 0).all():
                break
            low = passive & (z <= 0)
            step = (x[low] / np.maximum(x[low] - z[low], 1e-300)).min()
            x = x + step * (z - x)
            passive &= x > 1e-12
            x[~passive] = 0
        x = z
    return x


def plan(histogram: dict[int, int], bins: int = BINS, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use every bin of ``histogram`` exactly; each pattern's bins add up to ``bins`` at most."""
    left = np.zeros(bins + 1, np.int64)
    for b, n in histogram.items():
        left[b] = n
    combos = combinations(bins, depth)
    a = np.zeros((bins, len(combos)))
    for k, c in enumerate(combos):
        for b in c:
            a[b - 1, k] += 1
    y = left[1:].astype(float)
    out: list[tuple[tuple[int, ...], int]] = []
    if y.sum():
        scale = y.sum()
        weight = np.where(y > 0, 1.0, 10.0)  # a pattern can't be used that needs lengths that are not there
        x = nnls(a * weight[:, None], y / scale * weight) * scale
        for k in np.argsort(-x, kind="stable"):
            need = Counter(combos[k])
            n = min([int(x[k] + 1e-6), *(int(left[b]) // m for b, m in need.items())])
            if n > 0:
                out.append((combos[k], n))
                for b, m in need.items():
                    left[b] -= n * m
    while left.any():  # longest first; as often as what is left of its bins allows
        room, pattern = bins, []
        have = left.copy()
        for b in range(bins, 0, -1):
            m = int(min(room // b, have[b]))
            pattern += [b] * m
            room -= m * b
        need = Counter(pattern)
        n = min(int(left[b]) // m for b, m in need.items())
        out.append((tuple(pattern), n))
        for b, m in need.items():
            left[b] -= n * m
    return out


def intervals(patterns: list[tuple[tuple[int, ...], int]], width: int) -> list[tuple[int, int, int, int, int, int]]:
    """(bin, first rank, end, first window, slot, offset): ranks of a bin that take one slot of successive windows."""
    at: Counter[int] = Counter()
    out, window = [], 0
    for pattern, n in patterns:
        offset = 0
        for slot, b in enumerate(pattern):
            out.append((b, at[b], at[b] + n, window, slot, offset))
            at[b] += n
            offset += b * width
        window += n
    return out


def length(text: Column) -> Column:
    """Tokens of a text: runs of what is not white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, bins: int = BINS, depth: int = DEPTH, share: int = SHARE) -> DataFrame:
    """``(doc_id, piece, n_tokens, first_token, window_id, slot, window_offset)`` for each piece of each document."""
    if window % bins:
        raise ValueError("the window must be a multiple of the number of bins")
    width, spark = window // bins, docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), length(F.col(text_col)).alias("len"), F.xxhash64(text_col).alias("x"))
    base = materialize(base, "lengths")
    pieces = F.when(F.col("len") > 0, F.sequence(F.lit(0).cast("long"), F.floor((F.col("len") - 1) / window))).otherwise(F.array(F.lit(0).cast("long")))
    rows = base.select("doc_id", "x", "len", F.explode(pieces).alias("piece"))
    rows = rows.withColumn("n_tokens", F.least(F.lit(window), F.col("len") - F.col("piece") * window))
    rows = rows.withColumn("bin", F.ceil(F.col("n_tokens") / width).cast("int"))
    counts = {r.bin: r.n for r in rows.where("bin > 0").groupBy("bin").agg(F.count("*").alias("n")).collect()}  # a row for each bin
    shares = F.array(*[F.lit(-(-counts.get(b, 0) // share) or 1) for b in range(bins + 1)])[F.col("bin")]
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "x", "piece"), shares).cast("int"))
    sizes = [(r.bin, r.salt, r.n) for r in rows.where("bin > 0").groupBy("bin", "salt").agg(F.count("*").alias("n")).orderBy("bin", "salt").toLocalIterator()]  # a row for each bin, and one more for ``share`` rows
    histogram: Counter[int] = Counter()
    starts = []
    for b, s, n in sizes:
        starts.append((b, s, histogram[b]))
        histogram[b] += n
    placed = intervals(plan(dict(histogram), bins, depth), width)
    start = F.broadcast(spark.createDataFrame(starts, "bin int, salt int, start long"))
    table = F.broadcast(spark.createDataFrame(placed, "bin int, lo long, hi long, window long, slot int, window_offset int"))
    order = Window.partitionBy("bin", "salt").orderBy("doc_id", "x", "piece")
    ranked = rows.where("bin > 0").withColumn("rn", F.row_number().over(order)).join(start, ["bin", "salt"]).withColumn("rank", F.col("start") + F.col("rn") - 1)
    hit = ranked.join(table, (ranked["bin"] == table["bin"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    out = hit.select("doc_id", "piece", "n_tokens", (F.col("piece") * window).alias("first_token"), (F.col("window") + F.col("rank") - F.col("lo")).alias("window_id"), "slot", "window_offset")
    none = rows.where("bin = 0").select("doc_id", "piece", "n_tokens", F.lit(0).cast("long").alias("first_token"), F.lit(None).cast("long").alias("window_id"), F.lit(None).cast("int").alias("slot"), F.lit(None).cast("int").alias("window_offset"))
    return out.unionByName(none)
