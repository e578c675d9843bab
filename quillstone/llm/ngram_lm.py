"""Operator 2: scores of a language model held in a log-frequency Bloom filter.

Two models share the filter. That of characters has n-grams of 1 to ``ORDER`` characters within a word and its boundaries, that of words n-grams of 1 to ``WORDS`` words within
a document, with a mark at either end; both are counted over all words of all documents. The corpus is scored by itself, so every count is less one, the occurrence at hand: an n-gram that occurs
once tells nothing but its own place. What is left of a count, c, is quantised to ``1 + floor(log_b c)`` levels; an n-gram of level q is entered q times, as (n-gram, 1) ... (n-gram, q). A lookup probes
levels from 1 until one is missing: a level can be overstated (by a false positive, less than once in a hundred steps), never understated. An entry sets eight bits of one block of 256 (two in each word of 64), and the filter has ``BITS`` bits for each entry. Probabilities interpolate the orders
(Jelinek-Mercer), every count coming from such probes; word unigrams are backed off to the model of characters.

N-grams are known by 40 bits of their hash and the number of their bucket, the hash's first bits; buckets grow in number with the corpus, so that n-grams of a bucket stay few beside 2^40. Tasks sort and sum
what they count before it is shuffled by bucket, and each bucket becomes a segment of the filter, as large as its entries need.

A corpus scored by itself is dealt out over chunks. What a chunk counts is at once what it asks: the task that has a bucket builds its segment from it, probes it, and sends levels back in the order asked, without their
n-grams. So n-grams are shuffled once, nothing is broadcast, and time and memory of a task don't depend on the size. A model trained before is broadcast up to ``MAX_BYTES``; larger ones stay in the shared folder and are
asked by chunks in the same way. All give the same scores. Nothing is pruned, and the bits for an entry don't depend on the size.

Defined cases: null and empty texts, or blank ones, have 0 characters, log-probabilities 0 and null bits_per_char and bits_per_word; very long texts are scored whole, within the memory of one task; rows that repeat id and text are scored once and given back as often; rows with a null id are
counted and scored; repeated rows count each time, and so do ties; an empty table gives an empty table; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quillstone.llm.common import frugal, give_back, materialize, mix64

WORDS = 3
ORDER, BASE, BITS, LAMBDA = 5, 1.5, 14, 0.75
MAX_BYTES, BUCKET_CHARS, CHUNK_CHARS, SLICE = 128 << 20, 8 << 20, 6 << 20, 6 << 20
_FLUSH = 3_000_000  # hashes that a task holds before it sorts and sends them
_SPELT = 400_000  # words whose bits a task keeps at most
_START, _END, TOTALS = 2, 3, -1  # TOTALS: the bucket that holds the numbers of symbols, and of words and ends of documents
_M, _L = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_KEY, _COUNT = np.uint64(40), np.uint64(24)  # bits of a key within its bucket, and of a count packed with it
_MOST = np.uint64((1 << 24) - 1)
_LOW = np.uint64(0xFFFFFFFF)
_ZSTD = pa.Codec("zstd", 1)


def _salt(j: int) -> np.uint64:
    return np.uint64(j * int(_L) & 0xFFFFFFFFFFFFFFFF)


def vocabulary(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct lower-cased words of the texts, the number of each word in turn, and how many words each text has."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    flat = lists.flatten().dictionary_encode()
    words, codes, counts = flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    blank = np.array([not w or w.isspace() for w in words], bool)
    if blank.any():  # white space at either end of a text
        empty = blank[codes]
        counts = counts - np.bincount(np.repeat(np.arange(len(counts)), counts)[empty], minlength=len(counts))
        codes = codes[~empty]
    return words, codes, counts


def slices(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts, in column ``at``, have about ``SLICE`` bytes; a longer text stands alone."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + SLICE, side="right")))
            yield b.slice(lo, hi - lo)
            give_back()
            lo = hi


def tokens(text: str) -> list[str]:
    words, codes, _ = vocabulary(pa.array([text]))
    return [words[c] for c in codes]


def positions(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words, each between a start and an end mark; for each, its distance from the start mark and its word."""
    sep = chr(_END) + chr(_START)
    data = np.frombuffer((chr(_START) + sep.join(words) + chr(_END)).encode("utf-32-le", "replace"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), sizes)
    return data, np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes), word


def grams(data: np.ndarray, depth: np.ndarray, order: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of ``order`` characters, and the offsets where they end (within one word), of all or of those ``at`` some offsets."""
    at = np.flatnonzero(depth >= order - 1) if at is None else at
    h = np.full(len(at), _salt(order), np.uint64)
    for j in range(order - 1, -1, -1):
        h = (h ^ data[at - j]) * _M
        h ^= h >> np.uint64(29)
    return mix64(h), at


def word_keys(words: list[str]) -> np.ndarray:
    """Hashes of words, and at the end those of the marks before and after a document."""
    return np.concatenate([pd.util.hash_array(np.array(words, object), categorize=False) if words else np.empty(0, np.uint64), np.array([_START, _END], np.uint64)])


def sequence(codes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of the documents that have words, each between its marks ``n`` and ``n + 1``; for each, its distance from the start mark and its document."""
    doc = np.flatnonzero(counts)
    sizes = counts[doc] + 2
    first = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.int32)
    own = np.ones(len(out), bool)
    own[first] = own[first + sizes - 1] = False
    out[first], out[first + sizes - 1], out[own] = n, n + 1, codes
    return out, (np.arange(len(out)) - np.repeat(first, sizes)).astype(np.int32), np.repeat(doc.astype(np.int32), sizes)


def word_grams(keys: np.ndarray, depth: np.ndarray, order: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of ``order`` words, and the offsets where they end (within one document), of all or of those ``at`` some offsets."""
    at = np.flatnonzero(depth >= order - 1) if at is None else at
    h = np.full(len(at), _salt(1000 + order), np.uint64)
    for j in range(order - 1, -1, -1):
        h = (h ^ keys[at - j]) * _M
        h ^= h >> np.uint64(29)
    return mix64(h), at


def level(count, base: float = BASE):
    """Quantised level of a count, 0 of a count below 1."""
    return np.where(count < 1, 0, 1 + np.floor(np.log(np.maximum(count, 1)) / math.log(base) + 1e-9)).astype(np.int64)


def value(q, base: float = BASE):
    """The count that a level stands for: the middle of its range."""
    return np.where(q > 0, np.power(base, np.maximum(q, 1) - 1.0) * (1 + base) / 2, 0.0)


def keys(h: np.ndarray, depth: int) -> np.ndarray:
    """Bucket (the first ``depth`` bits) and key of hashed n-grams, as one number."""
    return h >> (np.uint64(64 - depth) - _KEY)


def packed(key: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sorted numbers that hold key (without its bucket) and count; counts too large for one go into several. ``key`` is sorted."""
    n = (count + int(_MOST) - 1) // int(_MOST)
    if (n > 1).any():
        last = np.cumsum(n) - 1
        key, full = np.repeat(key, n), np.full(int(n.sum()), int(_MOST), np.int64)
        full[last] = count - (n - 1) * int(_MOST)
        count = full
    return ((key & ((np.uint64(1) << _KEY) - np.uint64(1))) << _COUNT) | count.astype(np.uint64)


def squeezed(b: bytes) -> bytes:
    return len(b).to_bytes(8, "little") + _ZSTD.compress(b, asbytes=True)


def unsqueezed(b: bytes) -> bytes:
    n = int.from_bytes(b[:8], "little")
    return _ZSTD.decompress(b[8:], n, asbytes=True) if n else b""


def planes(x: np.ndarray) -> bytes:
    """Packed numbers with their keys as steps from one to the next: first bytes of all, then second bytes, and so on, compressed."""
    x = (np.diff(x >> _COUNT, prepend=np.uint64(0)) << _COUNT) | (x & _MOST)
    return squeezed(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes())


def unplanes(b: bytes) -> np.ndarray:
    x = np.ascontiguousarray(np.frombuffer(unsqueezed(b), np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return (np.cumsum(x >> _COUNT, dtype=np.uint64) << _COUNT) | (x & _MOST)


def by_bucket(key: np.ndarray, depth: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, end) of the buckets that sorted keys fall into."""
    bucket = (key >> _KEY).astype(np.int64)
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(key)]):
        yield int(bucket[lo]), lo, hi


def _sent(key: np.ndarray, count: np.ndarray, depth: int) -> pa.RecordBatch:
    found = [(b, planes(packed(key[lo:hi], count[lo:hi]))) for b, lo, hi in by_bucket(key, depth)]
    return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.binary())], names=["bucket", "grams"])


@frugal
def _count(batches: Iterator[pa.RecordBatch], order: int, depth: int) -> Iterator[pa.RecordBatch]:
    plain: list[np.ndarray] = []  # hashes that count one each
    heavy: list[tuple[np.ndarray, np.ndarray]] = []  # hashes with their counts
    totals, held = np.zeros(2, np.int64), 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held
        if plain:
            h = np.concatenate(plain)
            plain.clear()
            h.sort()
            k = keys(h, depth)
            cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            yield _sent(k[cut], np.diff(cut, append=len(k)), depth)
        if heavy:
            h, c = (np.concatenate(x) for x in zip(*heavy))
            heavy.clear()
            at = np.argsort(h)
            k = keys(h[at], depth)
            cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            yield _sent(k[cut], np.add.reduceat(c[at], cut), depth)
        held = 0

    for b in slices(batches, 0):
        words, codes, n_words = vocabulary(b.column(0))
        if not len(codes):
            continue
        n = np.bincount(codes, minlength=len(words))
        row, place, _ = sequence(codes, n_words, len(words))
        totals += [sum((len(w) + 1) * int(c) for w, c in zip(words, n)), int((place > 0).sum())]
        own = word_keys(words)
        docs = int((n_words > 0).sum())
        heavy.append((word_grams(own, np.zeros(len(own), np.int64), 1)[0], np.concatenate([n, [docs, docs]])))
        for lo in range(0, len(words), 50_000):
            data, depths, word = positions(words[lo : lo + 50_000])
            for k in range(1, order + 1):
                h, at = grams(data, depths, k)
                inverse, distinct = pd.factorize(h)  # by hashing: cheaper than sorting
                heavy.append((distinct, np.bincount(inverse, weights=n[lo + word[at]], minlength=len(distinct)).astype(np.int64)))
                held += len(distinct)
        own = own[row]
        for k in range(2, WORDS + 1):
            h = word_grams(own, place, k)[0]
            for lo in range(0, len(h), _FLUSH):
                plain.append(h[lo : lo + _FLUSH])
                held += len(plain[-1])
                if held >= _FLUSH:
                    yield from flush()
    yield from flush()
    yield pa.RecordBatch.from_arrays([pa.array([TOTALS], pa.int32()), pa.array([totals.tobytes()], pa.binary())], names=["bucket", "grams"])


def _places(key: np.ndarray, j: int, size) -> tuple[np.ndarray, np.ndarray]:
    """Block of level ``j`` of each key in a segment of ``size`` blocks, and a hash that tells the bits in it."""
    x = mix64(key + _salt(j))
    return ((x & _LOW) * size) >> np.uint64(32), x * _M


def _bits(y: np.ndarray, word: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits in a word of the block."""
    return (y >> np.uint64(16 + 12 * word)) & np.uint64(63), (y >> np.uint64(22 + 12 * word)) & np.uint64(63)


def enter(key: np.ndarray, q: np.ndarray, bits: int = BITS) -> bytes:
    """A segment of the filter that holds the keys at their levels."""
    size = max(1, math.ceil(int(q.sum()) * bits / 256))
    held = np.zeros(size * 256, np.uint8)
    for j in range(1, int(q.max(initial=0)) + 1):
        block, y = _places(key[q >= j], j, np.uint64(size))
        for word in range(4):
            for bit in _bits(y, word):
                held[((block * np.uint64(4) + np.uint64(word)) * np.uint64(64) + bit).astype(np.int64)] = 1
    return np.packbits(held, bitorder="little").tobytes()


def probe(words: np.ndarray, key: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Level of each key in its segment, which starts at block ``first`` and has ``size`` blocks (of four of the ``words``)."""
    out, one = np.zeros(len(key), np.uint8), np.uint64(1)
    for lo in range(0, len(key), 1 << 14):  # what is computed at once stays in the cache
        live, j = np.arange(lo, min(lo + (1 << 14), len(key))), 1
        k, f, n = key[live], first[live], size[live]
        while len(live):
            block, y = _places(k, j, n)
            at, lacks = ((f + block) << np.uint64(2)).view(np.int64), np.uint64(0)
            for word in range(4):
                a, b = _bits(y, word)
                mask = (one << a) | (one << b)
                lacks = lacks | ((words.take(at + word) & mask) ^ mask)
            ok = np.flatnonzero(lacks == 0)
            live, k, f, n = live[ok], k[ok], f[ok], n[ok]
            out[live] = j
            j += 1
    return out


def _segment(t: pa.Table, bits: int, base: float) -> pa.Table:
    """What all tasks counted in a bucket, to its segment; of the bucket TOTALS, to the totals."""
    bucket, grams_ = t.column("bucket")[0].as_py(), t.column("grams")
    if bucket == TOTALS:
        blob = sum(np.frombuffer(x.as_py(), np.int64) for x in grams_).tobytes()
    else:
        x = np.concatenate([unplanes(g.as_py()) for g in grams_])
        x.sort()
        key = x >> _COUNT
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        q = level(np.add.reduceat((x & _MOST).astype(np.int64), cut) - 1, base)
        some = q > 0
        blob = enter(key[cut][some] | (np.uint64(bucket) << _KEY), q[some], bits)
    give_back()
    return pa.table({"bucket": pa.array([bucket], pa.int32()), "bits": pa.array([blob], pa.binary())})


@dataclass
class Model:
    """A trained filter, its segments in a table."""

    table: DataFrame
    depth: int
    base: float
    total: int
    n_words: int
    size: int  # bytes

    def filter(self) -> Filter:
        return Filter({r.bucket: bytes(r.bits) for r in self.table.toLocalIterator()}, self.depth, self.base, self.total, self.n_words)


class Filter:
    """The filter as workers hold it."""

    def __init__(self, parts: dict[int, bytes], depth: int, base: float, total: int = 0, n_words: int = 0) -> None:
        self.depth, self.base, self.total, self.n_words = depth, base, total, n_words
        each = [parts.get(b, bytes(32)) for b in range(1 << depth)]
        self.bits, self.size = b"".join(each), np.array([len(e) // 32 for e in each], np.uint64)
        self.first = np.cumsum(self.size, dtype=np.uint64) - self.size

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Level of each hashed n-gram; 0 if the filter lacks it."""
        key = keys(h, self.depth)
        bucket = (key >> _KEY).astype(np.int64)
        return probe(np.frombuffer(self.bits, np.uint64), key, self.first[bucket], self.size[bucket])


Lookup = Callable[[np.ndarray], np.ndarray] | np.ndarray  # levels of hashes; or those of an order, by the offset where its n-grams end


def _longer(at: np.ndarray, before: np.ndarray, levels: Lookup, table: np.ndarray, hashes: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Counts of the n-grams that end ``at`` some offsets; ``before``: those of one part less. An n-gram has no count if what it ends with has none, so that is not looked up."""
    out = np.zeros(len(before))
    some = at[before[at] > 0]
    if isinstance(levels, np.ndarray):
        out[some] = table[levels[some]]
        return out
    inverse, distinct = pd.factorize(hashes(some))
    out[some] = table[levels(distinct)][inverse]
    return out


def _of(levels: Lookup | list[np.ndarray], k: int) -> Lookup:
    """The levels of an order, of given ones the ``k``-th."""
    return levels[k] if isinstance(levels, list) else levels


def word_bits(words: list[str], levels: Lookup | list[np.ndarray], total: int, order: int = ORDER, lam: float = LAMBDA, base: float = BASE) -> np.ndarray:
    """log2 of the probability of each word by its characters, its end mark included."""
    if not words:
        return np.zeros(0)
    data, depth, word = positions(words)
    table = value(np.arange(256), base)
    before = _longer(np.arange(len(data)), np.ones(len(data)), _of(levels, 0), table, lambda some: grams(data, depth, 1, some)[0])
    p = (before + 0.5) / (total + 1)
    for k in range(2, order + 1):
        at = np.flatnonzero(depth >= k - 1)
        at = at[before[at - 1] > 0]
        own = _longer(at, before, _of(levels, k - 1), table, lambda some, k=k: grams(data, depth, k, some)[0])
        p[at] = lam * np.minimum(own[at] / before[at - 1], 1.0) + (1 - lam) * p[at]
        before = own
    live = depth >= 1
    return np.bincount(word[live], weights=np.log2(np.minimum(p[live], 1.0)), minlength=len(words))


def document_bits(words: list[str], codes: np.ndarray, counts: np.ndarray, spelt: np.ndarray, levels: Lookup | list[np.ndarray], n_words: int, lam: float = LAMBDA, base: float = BASE) -> np.ndarray:
    """log2 of the probability of each document's words, the end mark included; ``spelt``: log2 of the probability of each word by its characters."""
    row, depth, doc = sequence(codes, counts, len(words))
    own = word_keys(words)
    table = value(np.arange(256), base)
    once = _longer(np.arange(len(own)), np.ones(len(own)), _of(levels, 0), table, lambda some: word_grams(own, np.zeros(len(own), np.int64), 1, some)[0])
    p = np.exp2(np.concatenate([spelt, [0.0, math.log2(0.5 / (n_words + 1))]]))
    p = (lam * np.minimum(once / max(n_words, 1), 1.0) + (1 - lam) * p)[row] if n_words else p[row]
    own, before = own[row], once[row]  # ``before``: counts of the contexts
    for k in range(2, WORDS + 1):
        at = np.flatnonzero(depth >= k - 1)
        at = at[before[at - 1] > 0]
        now = _longer(at, before, _of(levels, k - 1), table, lambda some, k=k: word_grams(own, depth, k, some)[0])
        p[at] = lam * np.minimum(now[at] / before[at - 1], 1.0) + (1 - lam) * p[at]
        before = now
    live = depth >= 1
    return np.bincount(doc[live], weights=np.log2(p[live]), minlength=len(counts))


def scores(texts: pa.Array | None, levels: Lookup | list[np.ndarray], total: int, all_words: int, order: int, lam: float, base: float, spelt: dict[str, float] | None = None, known: tuple[list[str], np.ndarray, np.ndarray] | None = None) -> list[pa.Array]:
    """Columns (n_symbols, log2_prob, bits_per_char, n_words, word_log2_prob, bits_per_word) of the texts. ``spelt`` keeps what words have by their characters, for texts to come.
    ``levels`` may be a list, of all n-grams of these texts as `_all_grams` has them. ``known``: the texts' `vocabulary`."""
    words, codes, n_words = known or vocabulary(texts)
    spelt = {} if spelt is None else spelt
    if len(spelt) > _SPELT:
        spelt.clear()
    new = [w for w in words if w not in spelt]
    given = isinstance(levels, list)
    for i, lo in enumerate(range(0, len(new), 50_000)):
        own = levels[1 + i * order : 1 + (i + 1) * order] if given else levels
        spelt.update(zip(new[lo : lo + 50_000], word_bits(new[lo : lo + 50_000], own, total, order, lam, base).tolist()))
    bits = np.fromiter(map(spelt.__getitem__, words), float, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    some = np.flatnonzero(n_words)
    first = (np.cumsum(n_words) - n_words)[some]
    lp, n = np.zeros(len(n_words)), np.zeros(len(n_words), np.int64)
    if len(some):
        lp[some], n[some] = np.add.reduceat(bits[codes], first), np.add.reduceat(size[codes], first)
    own = [levels[0], *levels[1 - WORDS :]] if given else levels
    by_words = document_bits(words, codes, n_words, bits, own, all_words, lam, base) if len(some) else lp
    return [pa.array(n, pa.int64()), pa.array(lp, pa.float64()), pa.array(-lp / np.maximum(n, 1), mask=n == 0), pa.array(n_words, pa.int64()), pa.array(by_words, pa.float64()), pa.array(-by_words / (n_words + 1), mask=n_words == 0)]


_OUT = ["doc_id", "n_symbols", "log2_prob", "bits_per_char", "n_words", "word_log2_prob", "bits_per_word"]


@frugal
def _score(batches: Iterator[pa.RecordBatch], held, order: int, lam: float) -> Iterator[pa.RecordBatch]:
    f: Filter = held.value
    spelt: dict[str, float] = {}
    for b in slices(batches, 1):
        yield pa.RecordBatch.from_arrays([b.column(0), *scores(b.column(1), f.levels, f.total, f.n_words, order, lam, f.base, spelt)], names=_OUT)


def _depth(chars: int, bucket_chars: int) -> int:
    """Bits of a bucket's number."""
    return max(1, math.ceil(math.log2(max(chars, 1) / bucket_chars)))


def train(docs: DataFrame, text_col: str = "text", order: int = ORDER, base: float = BASE, bits: int = BITS, bucket_chars: int = BUCKET_CHARS) -> Model:
    """Count the corpus and build the filter's segments; see the module's docstring."""
    source = docs.select(F.col(text_col).alias("text")).where(F.length("text") > 0)
    chars = source.agg(F.sum(F.length("text"))).first()[0] or 0
    depth = _depth(chars, bucket_chars)
    sent = source.mapInArrow(lambda it: _count(it, order, depth), "bucket int, grams binary")
    table = materialize(sent.groupBy("bucket").applyInArrow(lambda t: _segment(t, bits, base), "bucket int, bits binary"), "segments")
    totals = table.where(F.col("bucket") == TOTALS).first()
    total, n_words = np.frombuffer(totals.bits, np.int64).tolist() if totals else (0, 0)
    table = table.where(F.col("bucket") != TOTALS)
    return Model(table, depth, base, total, n_words, table.agg(F.sum(F.length("bits"))).first()[0] or 0)


def _all_grams(words: list[str], row: np.ndarray, place: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray, int, np.ndarray | None]]:
    """Hashes of all n-grams that a model has of some texts, by kind: of word unigrams and the two marks; of characters, in blocks of words, by order; of words, by order. With each the number of its hash (None: they
    are in turn), the offsets where n-grams end, the number of offsets, and the word at every offset of a block of words."""
    own = word_keys(words)
    h, at = word_grams(own, np.zeros(len(own), np.int64), 1)
    yield h, None, at, len(own), None
    for lo in range(0, len(words), 50_000):
        data, depth, word = positions(words[lo : lo + 50_000])
        for k in range(1, order + 1):
            h, at = grams(data, depth, k)
            inverse, distinct = pd.factorize(h)  # by hashing: cheaper than sorting
            yield distinct, inverse, at, len(data), word + lo
    own = own[row]
    for k in range(2, WORDS + 1):
        h, at = word_grams(own, place, k)
        yield h, None, at, len(row), None


def _ask(t: pa.Table, order: int, depth: int) -> pa.Table:
    """The n-grams of a chunk (chunk, doc_id, text, n) and how often it has them: a row for each bucket, and one for TOTALS. ``n``: how often a row is repeated."""
    chunk, times = t.column("chunk")[0], t.column("n").to_numpy()
    words, codes, counts = vocabulary(t.column("text").combine_chunks())
    row, place, doc = sequence(codes, counts, len(words))
    own = times[doc]  # at every offset of the documents
    n = np.bincount(row, weights=own, minlength=len(words) + 2).astype(np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    totals = np.array([int((size * n[:-2]).sum()), int(own[place > 0].sum())])
    hashes, weights = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for h, inverse, at, _, word in _all_grams(words, row, place, order) if len(codes) else ():
        hashes.append(h)
        weights.append(own[at] if len(hashes) > 2 and word is None else n if word is None else np.bincount(inverse, weights=n[word[at]], minlength=len(h)).astype(np.int64))
    h, w = np.concatenate(hashes), np.concatenate(weights)
    at = np.argsort(h)
    key = keys(h[at], depth)
    cut = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    sent = _sent(key[cut], np.add.reduceat(w[at], cut) if len(cut) else w, depth)
    give_back()
    bucket = pa.concat_arrays([sent.column(0), pa.array([TOTALS], pa.int32())])
    return pa.table({"bucket": bucket, "chunk": pa.repeat(chunk, len(bucket)), "grams": pa.concat_arrays([sent.column(1), pa.array([totals.tobytes()], pa.binary())])})


def _answers(asked: pa.Table, segment: Callable[[np.ndarray, np.ndarray], bytes]) -> pa.Table:
    """Levels of what chunks asked of a bucket, in the order of their keys. ``segment`` makes the bucket's filter from its sorted keys and their counts; of TOTALS every chunk gets the sum."""
    bucket = asked.column("bucket")[0].as_py()
    if bucket == TOTALS:
        levels = [sum(np.frombuffer(x.as_py(), np.int64) for x in asked.column("grams")).tobytes()] * len(asked)
    else:
        parts = [unplanes(g.as_py()) for g in asked.column("grams")]
        x, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        at = np.argsort(x)
        x = x[at]
        key = x >> _COUNT
        cut = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        whole = key[cut] | (np.uint64(bucket) << _KEY)
        words = np.frombuffer(segment(whole, np.add.reduceat((x & _MOST).astype(np.int64), cut)), np.uint64)
        q = np.empty(len(x), np.uint8)
        q[at] = np.repeat(probe(words, whole, np.zeros(len(whole), np.uint64), np.full(len(whole), len(words) // 4, np.uint64)), np.diff(cut, append=len(x)))
        levels = []
        for p, hi in zip(parts, ends):
            k = p >> _COUNT
            levels.append(squeezed(q[hi - len(p) : hi][np.diff(k, prepend=~k[:1]) != 0].tobytes()))  # a count too large for one number has several
    give_back()
    return pa.table({"chunk": asked.column("chunk"), "bucket": asked.column("bucket"), "levels": pa.array(levels, pa.binary())})


def _score_chunk(t: pa.Table, answers: pa.Table, order: int, lam: float, base: float, depth: int, totals: tuple[int, int] | None) -> pa.Table:
    """Scores of a chunk (chunk, doc_id, text, n), whose n-grams are put in the order in which they were asked."""
    by = dict(zip(answers.column("bucket").to_pylist(), answers.column("levels").to_pylist()))
    total, all_words = totals or np.frombuffer(by.get(TOTALS, bytes(16)), np.int64).tolist()
    known = words, codes, counts = vocabulary(t.column("text").combine_chunks())
    given: list[np.ndarray] = []  # levels of each kind of n-gram, by offset
    if len(codes):
        row, place, _ = sequence(codes, counts, len(words))
        hashes, found = [], []
        for h, inverse, ends, n, _ in _all_grams(words, row, place, order):
            hashes.append(h)
            found.append((len(h), inverse, ends, n))
        h = np.concatenate(hashes)
        del hashes
        at = np.argsort(h)
        key = keys(h[at], depth)
        cut = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        q = np.frombuffer(b"".join(unsqueezed(by[b]) for b in sorted(by) if b != TOTALS), np.uint8)
        if len(q) != len(cut):
            raise ValueError("the levels of a chunk are not those that it asked for")
        out = np.empty(len(h), np.uint8)
        out[at] = np.repeat(q, np.diff(cut, append=len(key)))
        del h, at, key
        lo = 0
        for size, inverse, ends, n in found:
            own = out[lo : lo + size]
            given.append(np.zeros(n, np.uint8))
            given[-1][ends] = own if inverse is None else own[inverse]
            lo += size
        del found
    columns = scores(None, given, total, all_words, order, lam, base, known=known)
    give_back()
    return pa.table([t.column("doc_id"), *columns, t.column("n")], names=[*_OUT, "n"])


def _asked(source: DataFrame, model: Model | None, order: int, lam: float, chunk_chars: int, out: str, bits: int = BITS, base: float = BASE) -> DataFrame:
    """The scores of ``source`` (doc_id, text) by a filter that is not broadcast; without a model, by that of ``source`` itself, whose segments are built from what the chunks ask."""
    rows, chars = source.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    n = max(1, math.ceil((chars + 64 * rows) / chunk_chars))
    depth, base, totals = (model.depth, model.base, (model.total, model.n_words)) if model else (_depth(chars, BUCKET_CHARS), base, None)
    dealt = source.withColumn("chunk", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(n)).cast("int")).repartition("chunk")
    dealt = dealt.groupBy("chunk", "doc_id", "text").agg(F.count("*").alias("n"))  # rows repeated however often are one
    asked = dealt.groupBy("chunk").applyInArrow(lambda t: _ask(t, order, depth), "bucket int, chunk int, grams binary")
    answer = "chunk int, bucket int, levels binary"

    def known(asked: pa.Table, held: pa.Table) -> pa.Table:
        return _answers(asked, lambda key, count: held.column("bits")[0].as_py() if len(held) else bytes(32)) if len(asked) else pa.table({"chunk": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "levels": pa.array([], pa.binary())})

    def built(key: np.ndarray, count: np.ndarray) -> bytes:
        q = level(count - 1, base)
        return enter(key[q > 0], q[q > 0], bits)

    if model:
        answers = asked.groupBy("bucket").cogroup(model.table.groupBy("bucket")).applyInArrow(known, answer)
    else:
        answers = asked.groupBy("bucket").applyInArrow(lambda t: _answers(t, built), answer)
    found = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda t, a: _score_chunk(t, a, order, lam, base, depth, totals), f"{out}, n long")
    return found.withColumn("n", F.explode(F.expr("array_repeat(0, int(n))"))).drop("n")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, lam: float = LAMBDA, model: Model | None = None, max_bytes: int = MAX_BYTES, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``(doc_id, n_symbols, log2_prob, bits_per_char, n_words, word_log2_prob, bits_per_word)`` for every document; symbols are characters and the ends of words, and the end of
    a document counts as a word in ``bits_per_word``."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_symbols long, log2_prob double, bits_per_char double, n_words long, word_log2_prob double, bits_per_word double"
    if model is None or model.size > max_bytes:
        return _asked(source, model, order, lam, chunk_chars, out)
    held = docs.sparkSession.sparkContext.broadcast(model.filter())
    return source.mapInArrow(lambda it: _score(it, held, order, lam), out)
