"""Operator 7: near-duplicates by circulant MinHash.

A document is the set of its word ``SHINGLE``-grams, hashed. One permutation of 32-bit integers (sigma) scatters the set; a second (pi),
circularly shifted by 1, 2, ... K, gives all K coordinates of the signature (C-MinHash). The signature is cut into bands;
documents that share a band are candidates, and exact Jaccard similarity of the shingle sets decides. Components of
the accepted pairs are the groups; the least doc_id of a group stays.

How it stays linear in practice: equal word sequences collapse first; within a band's bucket every document is compared, by a sketch of
two bits for each coordinate (32 bytes), with the bucket's first, and only those which are not clearly its copies are compared with all
others of the bucket. No bucket is cut. The sketch only spares exact checks: its estimate strays from the true similarity by 0.056 (one standard deviation, at the threshold), and what it rules out, or takes for a copy
of the bucket's first, is 0.2 below or 0.1 above the threshold, in each of the bands that two documents share. Exact verification streams the shingle sets of a leader's partners past the leader's; a leader of more than ``SHARE`` partners is
dealt out over several tasks, its own set to each.

Defined cases: documents without a word (null, empty, only punctuation) and rows with a null id are in no group; a very long text is hashed whole; fewer words than a
shingle make one shingle of them all; rows that repeat a doc_id are one document, the union of their shared pairs; ties go to the least
doc_id; ids may be of any type that can be ordered; an empty table gives an empty table; only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quillstone.llm.common import fresh, frugal, join_hot, joined, materialize, mix64, named, numbered, word_hashes
from quillstone.plans.components import connected

SHINGLE, K, ROWS, THRESHOLD = 3, 128, 4, 0.55
SMALL, SHARE = 2_000_000, 5_000
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _sigma(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit integers."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x7FEB352D)
    x = x ^ (x >> np.uint32(15))
    x = x * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def _pi(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Another, in place; ``t`` is room for what it computes."""
    np.right_shift(x, 16, out=t)
    np.bitwise_xor(x, t, out=x)
    np.multiply(x, np.uint32(0x85EBCA6B), out=x)
    np.right_shift(x, 13, out=t)
    np.bitwise_xor(x, t, out=x)
    np.multiply(x, np.uint32(0xC2B2AE35), out=x)
    np.right_shift(x, 16, out=t)
    return np.bitwise_xor(x, t, out=x)


def shingle_chunks(texts: list[str], shingle: int = SHINGLE):
    """Yield ``(first, counts, shingle hashes, exact)`` for runs of whole texts; ``exact`` identifies the word sequence (two hashes)."""
    for first, counts, h in word_hashes(texts):
        ends = np.cumsum(counts)
        starts = ends - counts
        place = np.arange(len(h)) - np.repeat(starts, counts)
        per = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
        at = np.repeat(starts, per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        s = np.zeros(len(at), np.uint64)
        limit = np.repeat(ends, per)
        for j in range(shingle):
            ok = at + j < limit
            s = mix64(s * _A + np.where(ok, h[np.minimum(at + j, max(len(h) - 1, 0))], np.uint64(0)) + np.uint64(j)) if len(at) else s
        exact = np.zeros((len(counts), 2), np.uint64)
        some = np.flatnonzero(counts)
        if len(some):
            for c, m in enumerate((_A, _B)):
                exact[some, c] = np.add.reduceat(mix64(h + (place.astype(np.uint64) + np.uint64(1)) * m), starts[some])
        yield first, per, s, exact


def signatures(per: np.ndarray, s: np.ndarray, k: int = K) -> np.ndarray:
    """Signatures (texts x k, uint32) of the shingle hashes ``s``, of which ``per`` belong to each text; of texts without any, undefined."""
    out = np.full((len(per), k), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(per)
    if not len(some):
        return out
    base = _sigma((s >> np.uint64(32)).astype(np.uint32))
    ends = np.cumsum(per[some])
    block = 1 << 15
    bounds = [0]
    while bounds[-1] < len(some):  # whole texts of about one block, which stays in the cache
        done = ends[bounds[-1] - 1] if bounds[-1] else 0
        bounds.append(max(bounds[-1] + 1, int(np.searchsorted(ends, done + block, side="right"))))
    for lo, hi in zip(bounds, bounds[1:]):
        b0 = int(ends[lo - 1]) if lo else 0
        x = base[b0 : int(ends[hi - 1])]
        at = np.concatenate([[0], ends[lo : hi - 1] - b0]).astype(np.int64)
        y, t = np.empty_like(x), np.empty_like(x)
        for i in range(k):
            np.add(x, np.uint32(i + 1), out=y)  # the circular shift of pi by i + 1
            out[some[lo:hi], i] = np.minimum.reduceat(_pi(y, t), at)
    return out


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band."""
    n = sig.shape[1] // rows
    key = np.tile(np.arange(1, n + 1, dtype=np.uint64) * _B, (len(sig), 1))
    for r in range(rows):
        key = mix64(key * _A + sig[:, r::rows][:, :n].astype(np.uint64))
    return key.view(np.int64)


def sketch(sig: np.ndarray) -> np.ndarray:
    """Two bits of each coordinate, packed (texts x k / 4 bytes)."""
    s = (sig & np.uint32(3)).astype(np.uint8)
    return s[:, 0::4] | (s[:, 1::4] << 2) | (s[:, 2::4] << 4) | (s[:, 3::4] << 6)


def similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity estimated from sketches (uint64 words along the last axis)."""
    x = a ^ b
    off = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(-1, dtype=np.int64)
    n = a.shape[-1] * 32
    return ((n - off) / n - 0.25) / 0.75


_FEATURES = "id long, x1 long, x2 long, sketch binary, bands array<long>"


@frugal
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "x1", "x2", "sketch", "bands"]
    for b in batches:
        ids, texts = b.column(0), b.column(1).to_pylist()
        for first, per, s, exact in shingle_chunks(texts):
            keep = np.flatnonzero(per)
            sig = signatures(per, s)[keep]
            key, sk = bands(sig), sketch(sig)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(keep + first)), pa.array(exact[keep, 0].view(np.int64)), pa.array(exact[keep, 1].view(np.int64)), pa.array([r.tobytes() for r in sk], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * key.shape[1]), pa.array(key.ravel())),
                ], names=names,
            )


def _bucket(ids: np.ndarray, sk: np.ndarray, low: float, sure: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of one bucket, whose ids ascend: its first with all that look like it, those not surely its copies with all."""
    est = similar(sk[1:], sk[:1])
    near = est >= low
    yield np.full(near.sum(), ids[0]), ids[1:][near]
    rest = np.flatnonzero(est < sure) + 1
    for i in range(0, len(rest), 64):
        part = rest[i : i + 64]
        for lo in range(1, len(ids), 1 << 14):
            e = similar(sk[part][:, None], sk[None, lo : lo + (1 << 14)]) >= low
            x, y = np.nonzero(e)
            x, y = part[x], y + lo
            ok = x != y
            a, c = ids[x[ok]], ids[y[ok]]
            yield np.minimum(a, c), np.maximum(a, c)


@frugal
def _candidates(batches: Iterator[pa.RecordBatch], low: float, sure: float) -> Iterator[pa.RecordBatch]:
    """Rows (band key, id, sketch) sorted by both, to pairs (a, b) with a < b."""
    held: list[tuple] = []  # rows of the last key so far

    def out(key: np.ndarray, ids: np.ndarray, sk: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.diff(key)) + 1
        lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
        two = lo[hi - lo == 2]
        ok = similar(sk[two], sk[two + 1]) >= low if len(two) else np.empty(0, bool)
        a, b = [ids[two][ok]], [ids[two + 1][ok]]
        for s, e in zip(lo[hi - lo > 2], hi[hi - lo > 2]):
            for x, y in _bucket(ids[s:e], sk[s:e], low, sure):
                a.append(x)
                b.append(y)
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
        pairs = pairs[pairs[:, 0] < pairs[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    def together() -> tuple:
        return tuple(np.concatenate(x) for x in zip(*held))

    for b in batches:
        if not b.num_rows:
            continue
        key, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
        sk = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint64).reshape(len(key), -1)
        last = int(np.searchsorted(key, key[-1]))
        if held and (last or held[-1][0][-1] != key[-1]):  # what is held ends in this batch
            held.append((key[:last], ids[:last], sk[:last]))
            yield out(*together())
            held = [(key[last:], ids[last:], sk[last:])]
        else:
            if last:
                yield out(key[:last], ids[:last], sk[:last])
            held.append((key[last:], ids[last:], sk[last:]))
    if held:
        yield out(*together())


@frugal
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts = b.column(0), b.column(1).to_pylist()
        for first, per, s, _ in shingle_chunks(texts):
            parts = np.split(s, np.cumsum(per)[:-1])
            yield pa.RecordBatch.from_arrays([ids.slice(first, len(per)), pa.array([np.unique(p).tobytes() for p in parts], pa.binary())], names=["id", "grams"])


@frugal
def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (lead, id, grams) sorted by both, in one share of a lead or several: the lead itself first, then its partners."""
    lead, own = None, np.empty(0, np.uint64)
    for b in batches:
        out_a, out_b, out_j = [], [], []
        for a, i, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            x = np.frombuffer(g, np.uint64)
            if i == a:
                lead, own = a, x
                continue
            if lead != a:
                raise RuntimeError("a partner came before its lead")
            both = len(np.intersect1d(own, x, assume_unique=True))
            if (j := both / (len(own) + len(x) - both)) >= threshold:
                out_a.append(a)
                out_b.append(i)
                out_j.append(j)
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64()), pa.array(out_j, pa.float64())], names=["a", "b", "jaccard"])


def verified(cand: DataFrame, source: DataFrame, threshold: float, tag: str) -> DataFrame:
    """The pairs ``(a, b, jaccard)`` of ``cand`` whose shingle sets reach ``threshold``; the sets are made anew for the documents that take part."""
    n = int(cand.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = cand.groupBy(F.col("a").alias("lead")).agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    hot = joined(cand.withColumnRenamed("a", "lead"), materialize(sizes.where("shares > 1"), f"{tag}-hot"), "lead", "left", SMALL)  # at most a row for SHARE pairs
    own = hot.select("lead", F.col("b").alias("id"), F.pmod(F.xxhash64("b"), F.coalesce("shares", F.lit(1))).cast("int").alias("share"))
    member = own.union(sizes.select("lead", F.col("lead").alias("id"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")))
    need = materialize(member.select("id").distinct(), f"{tag}-members")
    grams = joined(source, need, "id", "left_semi", SMALL).mapInArrow(_sets, "id long, grams binary")
    sets = member.join(grams, "id").select("lead", "share", "id", "grams")
    near = sets.repartition(n, "lead", "share").sortWithinPartitions("lead", "share", "id").select("lead", "id", "grams").mapInArrow(lambda it: _verify(it, threshold), "a long, b long, jaccard double")
    return materialize(near, tag)


def _pairs(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``(same, near)``, for ids of type long: ids ``(a, b)`` of equal word sequences (a the least), and verified pairs ``(a, b, jaccard)`` between the least ids.

    Verified are each document's pair with its least partner, then all pairs which that leaves in different components. The
    others could join nothing.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & (F.length("text") > 0))
    feats = materialize(source.mapInArrow(_features, _FEATURES), "signatures")
    keys = feats.select("x1", "x2", "id")
    first = keys.groupBy("x1", "x2").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.count("*").alias("n")).where("a < z").drop("z")
    same = materialize(join_hot(keys, materialize(first, "copied"), ["x1", "x2"], "n", "id").where("a < id").select("a", F.col("id").alias("b")).distinct(), "same")
    one = joined(feats.drop("x1", "x2"), same.select(F.col("b").alias("id")).distinct(), "id", "left_anti", SMALL)
    rows = one.select(F.explode("bands").alias("key"), "id", "sketch")
    n = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    found = rows.repartition(int(n), "key").sortWithinPartitions("key", "id").mapInArrow(lambda it: _candidates(it, threshold - 0.2, threshold + 0.1), "a long, b long")
    cand = materialize(found.distinct(), "candidates")
    stars = verified(materialize(cand.groupBy("b").agg(F.min("a").alias("a")), "stars"), source, threshold, "near-stars")
    lab = connected(stars)
    side = [lab.select(F.col("id").alias(c), F.col("label").alias(f"label_{c}")) for c in "ab"]
    open_ = cand.join(side[0], "a", "left").join(side[1], "b", "left").where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")
    rest = verified(materialize(open_, "open"), source, threshold, "near-rest")
    return same, stars.unionByName(rest)


def pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """``(same, near)``: ids ``(a, b)`` of equal word sequences, a the least, and verified pairs ``(a, b, jaccard)`` between the least ids, enough of them to join all that belong together."""
    own, names = numbered(docs, id_col)
    same, near = _pairs(own, id_col, text_col, threshold)
    return named(same, ["a", "b"], names), named(near, ["a", "b"], names)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, cluster_id, kept)`` for the documents of groups of two or more; cluster_id is the group's least doc_id, which is kept."""
    own, names = numbered(docs, id_col)
    same, near = _pairs(own, id_col, text_col, threshold)
    lab = connected(near)
    out = same.join(lab.select(F.col("id").alias("a"), "label"), "a", "left").select(F.col("b").alias("doc_id"), F.coalesce("label", "a").alias("cluster_id"))
    heads = same.select("a").distinct().join(lab.select(F.col("id").alias("a"), "label"), "a", "left_anti").select(F.col("a").alias("doc_id"), F.col("a").alias("cluster_id"))
    out = out.unionByName(heads).unionByName(lab.select(F.col("id").alias("doc_id"), F.col("label").alias("cluster_id")))
    out = out.groupBy("doc_id").agg(F.min("cluster_id").alias("cluster_id"))
    return named(out, ["doc_id", "cluster_id"], names).withColumn("kept", F.col("doc_id") == F.col("cluster_id"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without all but one document of each group, columns as they were; of rows that repeat a doc_id, that of the least text stays."""
    n, rank = fresh(docs, "n_rows"), fresh(docs, "rank")
    gone = groups(docs, id_col, text_col, threshold).where(~F.col("kept")).select(F.col("doc_id").alias(id_col), F.lit(False).alias(n))
    again = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias(n)).where(F.col(n) > 1).select(id_col, F.lit(True).alias(n))
    marked = materialize(gone.unionByName(again).groupBy(id_col).agg(F.min(n).alias(n)), "gone")
    kept = joined(docs, marked, id_col, "left_anti", SMALL)
    first = Window.partitionBy(id_col).orderBy(F.col(text_col).asc_nulls_last())
    some = joined(docs, marked.where(F.col(n)).select(id_col), id_col, "left_semi", SMALL).withColumn(rank, F.row_number().over(first))
    return kept.unionByName(some.where(F.col(rank) == 1).drop(rank))
