"""Whether and how to retrieve, decided for each query by column expressions alone."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

TIERS = tuple("none grep semantic graph composite".split())  # the cheapest first
CUE_WORDS = ("between", "compare", "connect", "difference", "path", "related", "versus", "vs", "why")
CUE_PHRASES = ("compared to", "history of", "what changed")
FRESH = ("as of", "current", "latest", "now", "recent", "this month", "this week", "today", "up to date", "up-to-date")  # parts of words count, so longer forms need no entry
VERSION_WORDS = ("changelog", "release", "version")
VERSION = r"(?U)\bv?\d+\.\d+"


def _by_tier(*values: float) -> dict[str, float]:
    return dict(zip(TIERS, values))


@dataclass(frozen=True)
class Settings:
    quality: float = 0.6
    latency: float = 0.2
    cost: float = 0.2
    tail_boost: float = 0.15
    prior: dict[str, float] = field(default_factory=lambda: _by_tier(0.52, 0.64, 0.73, 0.82, 0.86))
    latency_of: dict[str, float] = field(default_factory=lambda: _by_tier(0.0, 0.2, 0.4, 0.6, 0.85))
    tokens_of: dict[str, float] = field(default_factory=lambda: _by_tier(0.0, 0.2, 0.4, 0.5, 0.7))
    gain: dict[str, float] = field(default_factory=lambda: _by_tier(0.0, 0.05, 0.20, 0.30, 0.40))


def _words(q: Column) -> Column:
    return F.filter(F.split(q, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")  # all that is white space in Unicode, not in ASCII alone


def _clean(q: Column) -> Column:
    return F.transform(_words(q), lambda w: F.lower(F.regexp_replace(w, "^[.,;:!?]+|[.,;:!?]+$", "")))


def _among(words: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, words))


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.contains(text, F.lit(parts[0]))
    for p in parts[1:]:
        out = out | F.contains(text, F.lit(p))
    return out


def complexity(q: Column) -> Column:
    """0.6 of the length (20 words are full) and 0.4 of the cues (3 are full), at most 1."""
    cues = F.size(F.filter(_clean(q), lambda w: F.array_contains(_among(CUE_WORDS), w)))
    for p in CUE_PHRASES:
        cues = cues + F.contains(F.lower(q), F.lit(p)).cast("int")
    return F.least(F.lit(1.0), 0.6 * (F.size(_words(q)) / 20.0) + 0.4 * (cues / 3.0))


def relational(q: Column) -> Column:
    return _any(F.lower(q), CUE_PHRASES) | F.arrays_overlap(_clean(q), _among(CUE_WORDS))


def fresh(q: Column) -> Column:
    """Markers of freshness anywhere in the text, version numbers or words."""
    return _any(F.lower(q), FRESH) | F.lower(q).rlike(VERSION) | F.arrays_overlap(_clean(q), _among(VERSION_WORDS))


def decide(queries: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``queries (text, entities, private_ids, tail_ids)`` and others, with strategy, stage, reason, complexity, freshness_required and scores.

    Stage 1: several entities or a relation, freshness, private entities. Stage 2: the tier of the greatest utility, the cheapest of equals.
    """
    q, s = F.col("text"), settings
    empty = F.array().cast("array<string>")
    ents = F.array_distinct(F.coalesce("entities", empty))
    df = queries.withColumn("complexity", complexity(q)).withColumn("freshness_required", fresh(q))
    private = F.arrays_overlap(ents, F.coalesce("private_ids", empty))
    tail = F.coalesce(F.arrays_overlap(ents, F.coalesce("tail_ids", empty)), F.lit(False))
    several = (F.size(ents) >= 2) | (relational(q) & (F.size(ents) >= 1))
    bypass = F.when(several, "composite").when(F.col("freshness_required"), F.when(F.size(ents) > 0, "graph").otherwise("semantic")).when(private, "graph")
    why = F.when(several, "multi-entity relational").when(F.col("freshness_required"), "freshness marker").when(private, "private entity")

    def utility(t: str) -> Column:
        quality = s.prior[t] + F.col("complexity") * s.gain[t] + (F.when(tail, s.tail_boost).otherwise(0.0) if t != "none" else F.lit(0.0))
        return s.quality * quality - s.latency * s.latency_of[t] - s.cost * s.tokens_of[t]

    scored = F.array(*[F.struct(F.lit(t).alias("tier"), utility(t).alias("utility")) for t in TIERS])
    best = F.aggregate(F.slice(scored, 2, len(TIERS)), scored[0], lambda a, x: F.when(x["utility"] > a["utility"], x).otherwise(a))
    df = df.withColumn("bypass", bypass)
    return df.withColumns({
        "strategy": F.coalesce("bypass", best["tier"]), "stage": F.when(F.col("bypass").isNull(), 2).otherwise(1), "reason": F.coalesce(why, F.lit("utility argmax")),
        "scores": F.when(F.col("bypass").isNull(), scored).otherwise(F.array().cast("array<struct<tier:string,utility:double>>")),
    }).drop("bypass")
