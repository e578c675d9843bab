"""Text functions as column builders; Arrow UDFs only where no built-in expression has the meaning."""

from __future__ import annotations

import hashlib
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache
from html.parser import HTMLParser
from unicodedata import normalize as compose

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

PERMUTATIONS, BAND = 32, 4
LINE_BREAKS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


# normal form of the resolver


def normal_form(text: str) -> str:
    """NFKC, case folding, then every run of what is neither letter nor number to one space, none at the ends."""
    folded = compose("NFKC", text).casefold()
    return " ".join("".join(c if c.isalnum() else " " for c in folded).split())


@F.pandas_udf(T.StringType())
def _norm_unicode(s: pd.Series) -> pd.Series:
    return s.map(normal_form, na_action="ignore")


def norm_ascii(text: Column) -> Column:
    """Normal form of ASCII text, inside whole-stage code generation."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def norm_latin(text: Column) -> Column:
    """Normal form of text whose only special case is the sharp s: built-in and so checkable by SQL."""
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}]+", " "))


def norm(text: Column) -> Column:
    """Normal form of any text (an Arrow UDF)."""
    return _norm_unicode(text)


def tokens(normal: Column) -> Column:
    """Tokens of a normal form; the empty one has none."""
    return F.when(normal == "", F.array().cast("array<string>")).otherwise(F.split(normal, " "))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for the empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    parts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(F.length(text) > 0, -F.aggregate(parts, F.lit(0.0), lambda s, p: s + p * F.log2(p))).otherwise(F.lit(0.0))


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with the column ``name``, computed once a row: behind a generator it isn't put into the lambdas that use it, which would compute it for each element."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def ngrams(words: Column, most: int) -> Column:
    """Structs (start, len, gram) of all runs of 1 to ``most`` words. ``words`` is used for each run, so it should be a stored column (see ``computed``)."""
    n = F.size(words)

    def of(k: int) -> Column:
        starts = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(k).alias("len"), F.array_join(F.slice(words, i + 1, k), " ").alias("gram")))

    out = [of(k) for k in range(1, most + 1)]
    return F.concat(*out) if len(out) > 1 else out[0]


def suggest_id(surface_norm: Column, entity_type: Column) -> Column:
    """``type::words_joined``; an error if nothing is left of the surface."""
    return F.when(surface_norm == "", F.raise_error(F.lit("surface normalizes to nothing"))).otherwise(F.concat(entity_type, F.lit("::"), F.replace(surface_norm, F.lit(" "), F.lit("_"))))


def slug(name: Column) -> Column:
    """Lower case, every run of other signs to one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


# lexical


def lexical_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text: the search index's tokenizer, not the resolver's."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def lines(text: Column) -> Column:
    """Lines as ``str.splitlines`` has them: many separators, no empty line after the last one."""
    parts = F.split(text, LINE_BREAKS)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


# vectors


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 for empty vectors, different lengths or a zero norm."""
    na, nb = dot(a, a), dot(b, b)
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (na > 0) & (nb > 0)
    return F.when(usable, dot(a, b) / (F.sqrt(na) * F.sqrt(nb))).otherwise(F.lit(0.0))


def round6(x: Column) -> Column:
    """Six decimals, halves away from zero (the convention of SQL engines)."""
    return F.round(x, 6)


# similarity of strings


def ratio_of_sorted(one: str, other: str) -> float:
    """Matching ratio of two normal forms whose tokens were sorted; argument order matters for long strings."""
    first, second = (" ".join(sorted(x.split())) for x in (one, other))
    return SequenceMatcher(None, first, second).ratio()


@F.pandas_udf(T.DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio_of_sorted(x, y) for x, y in zip(a, b)], dtype="float64")


def ratio_of_at_least(least: float):
    """``token_sort_ratio``, but null where the characters alone, whatever their order, keep it below ``least``."""

    @F.pandas_udf(T.DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        counts: dict[str, Counter] = {}
        out: list[float | None] = []
        for x, y in zip(a, b):
            cx, cy = (counts.get(s) or counts.setdefault(s, Counter(" ".join(s.split()))) for s in (x, y))
            bound = 2.0 * (cx & cy).total() / max(cx.total() + cy.total(), 1)
            out.append(None if bound < least - 1e-9 else ratio_of_sorted(x, y))
        return pd.Series(out, dtype="float64")

    return ratio


def ratio_bound(a: Column, b: Column) -> Column:
    """An upper bound of ``token_sort_ratio`` from the lengths of two normal forms: what can't reach a threshold needs no UDF."""
    la, lb = F.length(a), F.length(b)
    return F.when(la + lb == 0, F.lit(1.0)).otherwise(2.0 * F.least(la, lb) / (la + lb))


# MinHash of short names


def trigrams(normal: str) -> set[bytes]:
    """Byte trigrams of the padded normal form."""
    b = f"  {normal} ".encode()
    return {b[i : i + 3] for i in range(max(1, len(b) - 2))}


@lru_cache(1 << 16)  # names share most of their trigrams
def _digests(gram: bytes) -> list[bytes]:
    return [hashlib.blake2b(gram, digest_size=8, salt=p.to_bytes(2, "big")).digest() for p in range(PERMUTATIONS)]


def signature(normal: str) -> list[int]:
    """Minima of keyed 64-bit digests, as signed integers so that they fit a long."""
    least = [min(d) for d in zip(*map(_digests, trigrams(normal)))]
    return [int.from_bytes(d, "big", signed=True) for d in least]


@F.pandas_udf(T.ArrayType(T.LongType()))
def minhash(normal: pd.Series) -> pd.Series:
    return normal.map(signature, na_action="ignore")


def bands(sig: Column) -> Column:
    """Slices of the signature, numbered: equal structs are collisions."""
    return F.transform(F.sequence(F.lit(0), F.lit(PERMUTATIONS // BAND - 1)), lambda b: F.struct(b.alias("band"), F.slice(sig, b * BAND + 1, BAND).alias("rows")))


# HTML


class _Plain(HTMLParser):
    silent = frozenset({"script", "style"})
    breaking = frozenset(["br", "div", "li", "p", "pre", "tr", "blockquote", *(f"h{i}" for i in range(1, 7))])

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.silent
        if tag in self.breaking:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in self.silent:
            self.hidden = max(0, self.hidden - 1)
        elif tag in self.breaking:
            self.parts.append("\n")

    def handle_data(self, data):
        if self.hidden == 0:
            self.parts.append(data)


def plain_text(page: str) -> str:
    """Text of a page: scripts and styles dropped, a line for each block, spaces collapsed, no blank lines."""
    p = _Plain()
    p.feed(page)
    tidy = (" ".join(x.split()) for x in "".join(p.parts).splitlines())
    return "\n".join(filter(None, tidy))


@F.pandas_udf(T.StringType())
def strip_html(page: pd.Series) -> pd.Series:
    return page.map(plain_text, na_action="ignore")


def redact_paths(text: Column, root: str = r"/(?:home|Users|root|workspace)/[^\s\"']*?/", label: str = "<workspace>/") -> Column:
    """A string leaf without its absolute workspace paths."""
    return F.regexp_replace(text, root, label)


def percent(n: Column, d: Column) -> Column:
    """A percentage with one decimal; 0 of nothing."""
    return F.when(d > 0, F.round(100.0 * n / d, 1)).otherwise(F.lit(0.0))


def is_error_path(path: Column) -> Column:
    """Whether an engine path names an error; a missing one does."""
    p = F.coalesce(path, F.lit(""))
    return p.isin("", "http_error", "exception") | p.startswith("error")
