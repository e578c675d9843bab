"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from quillstone.plans.tables import materialize, shared_dir  # noqa: F401

CHUNK_BYTES = 1 << 18
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def joined(left: DataFrame, right: DataFrame, on, how: str, most_rows: int) -> DataFrame:
    """Join with ``right`` (already materialised) broadcast if it has at most ``most_rows`` rows, else by shuffle."""
    return left.join(F.broadcast(right) if right.count() <= most_rows else right, on, how)


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], count_col: str, spread_by: str, most: int = 100_000) -> DataFrame:
    """Inner join with ``right``, a row for each key, whose ``count_col`` says how many rows ``left`` has of it. Keys of more than ``most`` rows are dealt out by a hash of ``spread_by``, and ``right``'s
    row is repeated for each share; such keys, at most one for ``most`` rows, are broadcast."""
    shares, salt = fresh(left, "shares"), fresh(left, "salt")
    n = F.ceil(F.col(count_col) / most).cast("int")
    hot = F.broadcast(right.where(F.col(count_col) > most).select(*keys, n.alias(shares)))
    dealt = left.join(hot, keys, "left").withColumn(salt, F.pmod(F.xxhash64(spread_by), F.coalesce(shares, F.lit(1))).cast("int")).drop(shares)
    return dealt.join(right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1))), [*keys, salt]).drop(salt)


def numbered(df: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """``df`` with ids of type long, in the order of the ids, and ``(name, number)`` to turn them back, or None for ids that are whole numbers already."""
    if isinstance(df.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return df.withColumn(id_col, F.col(id_col).cast("long")), None
    name, number = fresh(df, "name"), fresh(df, "number")
    ids = df.select(F.col(id_col).alias(name)).where(F.col(name).isNotNull()).distinct().orderBy(name).withColumn(number, F.monotonically_increasing_id())
    names = materialize(ids, "ids")
    own = df.join(names, F.col(id_col) == F.col(name), "left").select(*[F.col(number).alias(c) if c == id_col else c for c in df.columns])
    return own, names.select(F.col(name).alias("name"), F.col(number).alias("number"))


def named(df: DataFrame, cols: list[str], names: DataFrame | None) -> DataFrame:
    """``df`` with the numbers in ``cols`` turned back into ids."""
    if names is None:
        return df
    order = df.columns
    for c in cols:
        n = fresh(df, "name_of")
        df = df.join(names.select(F.col("number").alias(c), F.col("name").alias(n)), c, "left").drop(c).withColumnRenamed(n, c)
    return df.select(*order)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def chunks(texts: list[str], most: int = CHUNK_BYTES):
    """Yield ``(indices, encoded pieces)`` of about ``most`` bytes; a longer text is split at a space over several chunks."""
    idx: list[int] = []
    held: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "replace")
        while b or t == "":
            if len(b) > most:
                cut = b.rfind(b" ", 0, most) + 1 or b.find(b" ", most) + 1 or len(b)
            else:
                cut = len(b)
            piece, b = b[:cut], b[cut:]
            idx.append(i)
            held.append(piece)
            size += cut
            if size >= most:
                yield np.array(idx), held
                idx, held, size = [], [], 0
            if not b:
                break
    if idx:
        yield np.array(idx), held


_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_pw = np.ones(1, dtype=np.uint64)
_ipw = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pw, _ipw
    if len(_pw) < n:
        m = max(n, 2 * len(_pw))
        _pw = np.cumprod(np.concatenate([[np.uint64(1)], np.full(m - 1, _P)]), dtype=np.uint64)
        _ipw = np.cumprod(np.concatenate([[np.uint64(1)], np.full(m - 1, _PINV)]), dtype=np.uint64)
    return _pw[:n], _ipw[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _hash_pieces(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of ASCII letters, digits and other characters beyond ASCII) and the piece of each."""
    data = np.frombuffer(b"\n".join(pieces) + b"\n", dtype=np.uint8)
    mask = _WORD[data]
    edge = np.diff(np.concatenate([[False], mask]).view(np.int8))
    start = np.flatnonzero(edge == 1)
    end = np.flatnonzero(edge == -1)
    pw, ipw = _powers(len(data))
    cs = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * pw, dtype=np.uint64)])
    h = mix64((cs[end] - cs[start]) * ipw[start])
    ends = np.cumsum([len(p) + 1 for p in pieces])
    return h, np.searchsorted(ends, start, side="right")


def word_hashes(texts: list[str]):
    """Yield, chunk by chunk, ``(first, counts, hashes)``: word hashes of case-folded texts for the texts from ``first`` on.

    A chunk holds whole texts. Words are hashed piece by piece, so memory follows the number of words of the longest text.
    """
    texts = [t.casefold() for t in texts]
    at, acc_h, acc_i = 0, [], []
    for idx, pieces in chunks(texts):
        h, p = _hash_pieces(pieces)
        acc_h.append(h)
        acc_i.append(idx[p] if len(p) else np.empty(0, np.int64))
        last = int(idx[-1])
        h_all, i_all = np.concatenate(acc_h), np.concatenate(acc_i)
        done = i_all < last
        if last > at:
            yield at, np.bincount(i_all[done] - at, minlength=last - at), h_all[done]
        acc_h, acc_i, at = [h_all[~done]], [i_all[~done]], last
    if at < len(texts):
        h_all = np.concatenate(acc_h) if acc_h else np.empty(0, np.uint64)
        i_all = np.concatenate(acc_i) if acc_i else np.empty(0, np.int64)
        yield at, np.bincount(i_all - at, minlength=len(texts) - at), h_all


def give_back() -> None:
    """Return memory that is free to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def frugal(f):
    """Let a function over Arrow batches give its memory back when a partition ends: workers are reused, and what they keep adds up over stages."""

    @functools.wraps(f)
    def run(batches, *args, **kw):
        try:
            yield from f(batches, *args, **kw)
        finally:
            give_back()

    return run
