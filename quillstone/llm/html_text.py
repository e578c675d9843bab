"""Operator 8: text of web pages without the boilerplate of their host, by a suffix array.

Pages become streams of words, with a token of its own before each block and at the end (markup, scripts and comments dropped, entities decoded). The streams of a host are concatenated with a separator of its own after each
page, and a suffix array sorted by the first ``MIN_TOKENS`` tokens is built by prefix doubling. Suffixes that agree that far and stand on ``MIN_PAGES``
distinct pages or more mark a repeated substring; longer ones are chains of such suffixes. Tokens covered by one are dropped, what is left is a page's text.

A page of which nothing would be left is no boilerplate as a whole: it is an article under several addresses, or quoted in full. Of its windows of ``MIN_TOKENS`` tokens the rarest tell on how many pages it stands; if those are at most two,
or a tenth of the host's pages, then what stands on no more pages than that is its own text and is kept, on each of its copies (which one of them stays is a matter of near-dedup), and only what stands on more pages is dropped.

One shuffle, of extracted text by host. A host of more than ``BLOCK`` characters of markup is dealt out over blocks by a hash of the page, each with a suffix array
of its own, so that no task grows with a host (about 30 bytes a token are held). How many pages of such a host hold a window is counted over all its blocks, by a 64-bit fingerprint of every window; those of
``MIN_PAGES`` pages go back to the blocks that hold them, and count there as if their own array had shown them. Results don't depend on the blocks.

Defined cases: null or empty pages give empty text; very long pages are taken whole; a page without a host (null or malformed url) is compared with others of no host; rows that repeat a page_id
are one page, so they don't make each other boilerplate, and so are rows whose page_id is null; substrings that tie or overlap are all dropped; ids may be of any type; an
empty table gives an empty table; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillstone.llm.common import frugal, give_back, materialize, mix64

MIN_TOKENS, MIN_PAGES, BLOCK = 8, 2, 96 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|head)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.IGNORECASE | re.DOTALL)
_INLINE = re.compile(r"</?(?:a|abbr|b|bdi|bdo|cite|code|data|dfn|em|font|i|kbd|mark|q|s|samp|small|span|strong|sub|sup|time|tt|u|var|wbr)(?:\s[^>]*)?>", re.IGNORECASE)
_TAG = re.compile(r"<[/!?a-zA-Z][^>]*>?")
_SPACE = re.compile(r"[^\S\n]+")


def page_text(page: str) -> str:
    """The words of a page, a line for each block."""
    text = html.unescape(_TAG.sub("\n", _INLINE.sub("", _DROP.sub(" ", page))))
    return "\n".join(x for line in text.split("\n") if (x := _SPACE.sub(" ", line).strip()))


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def fingerprints(tokens: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the windows of ``size`` token hashes."""
    n = max(len(tokens) - size + 1, 0)
    f = np.zeros(n, np.uint64)
    for j in range(size):
        f = mix64((f ^ tokens[j : j + n]) * _ODD)
    return f


def token_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")


def _streams(texts: list[str]) -> tuple[list[str], list[np.ndarray], list[np.ndarray]]:
    """The distinct tokens (the first is the break before a block), each text as numbers of tokens, and the line of each."""
    words: dict[str, int] = {"\n": 0}
    put = words.setdefault
    streams, lines = [], []
    for t in texts:
        own = [[0, *[put(w, len(words)) for w in r.split(" ")]] for r in t.split("\n")] if t else []
        streams.append(np.array([*[x for r in own for x in r], 0], np.int32))
        lines.append(np.repeat(np.arange(len(own) + 1, dtype=np.int32), [*[len(r) for r in own], 1]))
    return list(words), streams, lines


def page_counts(ids: np.ndarray, page: np.ndarray, size: int = MIN_TOKENS) -> np.ndarray:
    """For each place, the number of distinct pages that hold the ``size`` tokens which start there (those of the separators are met once).

    ``ids`` are token ids below 2^31, unique for separators; ``page`` numbers the pages of the tokens.
    """
    n = len(ids)
    if n < size:
        return np.ones(n, np.int32)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int32)
    have, order = 1, None
    while have < size or order is None:  # ranks by the first ``have`` tokens to ranks by up to twice as many
        step = min(have, size - have)
        key = rank.astype(np.int64) * (n + 1)
        if step:
            key[:-step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]), dtype=np.int32)
        del key
        rank[order] = new
        have += step
    run, p = rank[order], page[order]
    cut = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    many = np.ones(len(cut), np.int32)
    two = np.flatnonzero(np.minimum.reduceat(p, cut) != np.maximum.reduceat(p, cut))
    if len(two):  # only runs that stand on several pages need counting
        some = np.isin(run, run[cut[two]])
        pair = np.unique((run[some].astype(np.int64) << 32) | p[some])
        at, k = np.unique(pair >> 32, return_counts=True)
        many[at] = k
    out = np.empty(n, np.int32)
    out[order] = many[run]
    return out


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``n`` tokens lie in a window of ``size`` tokens that starts at one of ``starts``."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + size, n), -1)
    return np.cumsum(edge[:-1]) > 0


def repeated(ids: np.ndarray, page: np.ndarray, size: int = MIN_TOKENS, pages: int = MIN_PAGES) -> np.ndarray:
    """Which tokens lie in a substring of ``size`` tokens that stands on ``pages`` distinct pages."""
    return covered(np.flatnonzero(page_counts(ids, page, size) >= pages), len(ids), size) if len(ids) >= size else np.zeros(len(ids), bool)


def dropped(s: np.ndarray, n: np.ndarray, size: int, pages: int, host_pages: int) -> np.ndarray:
    """Which tokens of a page go; ``s`` are its tokens (0: a break), ``n`` the number of pages that hold the window at each of its places."""
    n = n[: max(len(s) - size + 1, 0)]
    gone = covered(np.flatnonzero(n >= pages), len(s), size)
    if (s > 0).any() and gone[s > 0].all() and (least := int(n[n >= pages].min())) <= max(2, host_pages // 10):
        gone = covered(np.flatnonzero(n > least), len(s), size)
    return gone


def unique_runs(ids: list, texts: list[str], size: int = MIN_TOKENS, pages: int = MIN_PAGES, host_pages: int | None = None, shared: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[str, int, int]]:
    """For the pages of one block of a host: the text that is left, tokens in all, and tokens dropped. ``shared``: fingerprints that stand on several pages of the host (sorted), and on how many."""
    back, streams, lines = _streams(texts)
    number: dict = {}
    for i in ids:
        number.setdefault(i, len(number))
    ends = np.cumsum([len(s) + 1 for s in streams])
    all_ids = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
    page = np.repeat(np.array([number[i] for i in ids], np.int32), [len(s) + 1 for s in streams])
    for k, s in enumerate(streams):
        all_ids[ends[k] - 1 - len(s) : ends[k] - 1] = s
        all_ids[ends[k] - 1] = len(back) + k
    many = page_counts(all_ids, page, size)
    del all_ids, page
    h = np.fromiter(map(token_hash, back), np.uint64, len(back)) if shared is not None else None
    out = []
    for k, s in enumerate(streams):
        n = many[ends[k] - 1 - len(s) : ends[k] - 1]
        if shared is not None and len(shared[0]):
            f = fingerprints(h[s], size)
            at = np.minimum(np.searchsorted(shared[0], f), len(shared[0]) - 1)
            n[: len(f)] = np.where(shared[0][at] == f, shared[1][at], n[: len(f)])
        gone = dropped(s, n, size, pages, len(number) if host_pages is None else host_pages)
        keep = np.flatnonzero(~gone & (s > 0))
        parts, last, line = [], -2, -1
        for j, x, ln in zip(keep.tolist(), s[keep].tolist(), lines[k][keep].tolist()):
            parts.append(back[x] if not parts else ("\n" if ln != line or j != last + 1 else " ") + back[x])
            last, line = j, ln
        out.append(("".join(parts), int((s > 0).sum()), int((gone & (s > 0)).sum())))
    return out


@frugal
def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([page_text(h) if h else "" for h in b.columns[-1].to_pylist()], pa.string())], names=["page_id", "host", "block", "pages", "text"])


@frugal
def _windows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Columns (host, block, page, html) to the distinct (host, block, page, fp) of a batch's windows."""
    for b in batches:
        words, streams, _ = _streams([page_text(h) if h else "" for h in b.column(3).to_pylist()])
        h = np.fromiter(map(token_hash, words), np.uint64, len(words))
        each = [np.unique(fingerprints(h[s], size)) for s in streams]
        at = pa.array(np.repeat(np.arange(len(each)), [len(e) for e in each]))
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), pa.array(np.concatenate(each).view(np.int64))], names=["host", "block", "page", "fp"])


def _across(source: DataFrame, size: int, min_pages: int) -> DataFrame:
    """``(host, block, fp, n)``: fingerprints of hosts of several blocks that stand on ``min_pages`` pages or more, and on how many, for each block that holds them."""
    w = source.where("blocks > 1").select("host", "block", F.xxhash64("page_id").alias("page"), "html").mapInArrow(lambda it: _windows(it, size), "host string, block int, page long, fp long")
    many = w.groupBy("host", "fp").agg(F.count_distinct("page").cast("int").alias("n"), F.collect_set("block").alias("b")).where(F.col("n") >= min_pages)
    return many.select("host", F.explode("b").alias("block"), "fp", "n")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", size: int = MIN_TOKENS, min_pages: int = MIN_PAGES, block: int = BLOCK) -> DataFrame:
    """``(page_id, host, text, n_tokens, n_dropped)`` for every page."""
    kind = pages.schema[id_col].dataType.simpleString()
    source = pages.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    sizes = source.groupBy("host").agg(F.ceil(F.sum(F.length("html")) / block).cast("int").alias("blocks")).where("blocks > 1")
    sizes = materialize(sizes, "large-hosts")  # at most one row for each ``block`` characters
    large = not sizes.isEmpty()
    if large:  # the pages of such hosts are counted exactly; a null page_id is a page
        ids = source.join(F.broadcast(sizes), "host", "left_semi").select("host", F.xxhash64("page_id").alias("p"))
        sizes = F.broadcast(materialize(sizes.join(ids.groupBy("host").agg(F.count_distinct("p").alias("pages")), "host"), "large-host-pages"))
        source = source.join(sizes, "host", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    else:
        source = source.withColumn("blocks", F.lit(1)).withColumn("pages", F.lit(None).cast("long"))
    source = source.withColumn("block", F.pmod(F.xxhash64("page_id"), F.col("blocks")).cast("int"))
    texts = source.select("page_id", "host", "block", "pages", "html").mapInArrow(_texts, f"page_id {kind}, host string, block int, pages long, text string")
    out = f"page_id {kind}, host string, text string, n_tokens long, n_dropped long"

    def one(t: pa.Table, fps: pa.Table | None = None) -> pa.Table:
        shared = None
        if fps is not None and len(fps):
            fp, n = fps.column("fp").to_numpy().view(np.uint64), fps.column("n").to_numpy()
            order = np.argsort(fp)
            shared = fp[order], n[order]
        found = unique_runs(t.column("page_id").to_pylist(), t.column("text").to_pylist(), size, min_pages, t.column("pages")[0].as_py() if len(t) else None, shared)
        give_back()
        return pa.table([t.column("page_id"), t.column("host"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64())], names=["page_id", "host", "text", "n_tokens", "n_dropped"])

    if not large:
        return texts.groupBy("host", "block").applyInArrow(lambda t: one(t), out)
    return texts.groupBy("host", "block").cogroup(_across(source, size, min_pages).groupBy("host", "block")).applyInArrow(lambda t, fps: one(t, fps), out)
