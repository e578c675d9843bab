"""Resolution of names to entities: exact, normal form, fuzzy, vectors, arbiter; and the gazetteer scan of free text.

Batches throughout: mentions are ``(mention_ord, surface)``, queries ``(query_id, text)``. Each tier sees only what the ones before missed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillstone.functions.text import computed, entropy, ngrams, norm, ratio_bound, ratio_of_at_least, round6, tokens
from quillstone.operators import dense
from quillstone.sources.world import World

COLUMNS = ["mention_ord", "surface", "canonical_id", "confidence", "tier"]
BAND = 0.70, 0.85
Arbiter = Callable[[str, list[tuple[str, float]]], str | None]


@dataclass(frozen=True)
class Settings:
    fuzzy: bool = True
    fuzzy_threshold: float = 0.85
    least_entropy: float = 1.5
    vector_threshold: float = 0.85
    arbiter: Arbiter | None = None  # asked about scores within the band
    band: tuple[float, float] = BAND
    alias_vectors: DataFrame | None = None  # (norm, ids, vector)
    mention_vectors: DataFrame | None = None  # (surface, vector) of the normal forms


def lookup(mentions: DataFrame, world: World, normalize: Callable[[Column], Column] = norm) -> DataFrame:
    """Exact hits; where there is none, hits of the normal form. Ambiguous names return all their entities."""
    exact = mentions.join(world.exact, "surface").select("mention_ord", "surface", "canonical_id", F.lit(1.0).alias("confidence"), F.lit("exact").alias("tier"))
    missed = mentions.join(world.exact.select("surface").distinct(), "surface", "left_anti")
    by_norm = missed.withColumn("norm", normalize(F.col("surface"))).where("norm <> ''").join(world.normalized, "norm")
    return exact.unionByName(by_norm.select("mention_ord", "surface", "canonical_id", F.lit(1.0).alias("confidence"), F.lit("normalized").alias("tier")))


def _best(scored: DataFrame, threshold: float, tier: str) -> DataFrame:
    """All entities of the names that share the best score, if it reaches the threshold."""
    top = scored.withColumn("top", F.max("score").over(Window.partitionBy("mention_ord")))
    hits = top.where((F.col("score") == F.col("top")) & (F.col("score") >= threshold))
    return hits.select("mention_ord", "surface", F.explode("ids").alias("canonical_id"), round6(F.col("score")).alias("confidence"), F.lit(tier).alias("tier")).distinct()


def fuzzy_scores(missed: DataFrame, world: World, least: float, settings: Settings) -> DataFrame:
    """``(mention_ord, surface, ids, score)`` for the pairs of mention and alias whose score can reach ``least``.

    The entropy gate comes first. Two strings of lengths a and b match to 2 min(a, b) / (a + b) at most, so a mention meets only aliases of the lengths that can do: an equi-join on the length. Of those pairs the UDF drops what
    their characters, whatever their order, keep below ``least``.
    """
    m = missed.select("surface").distinct().withColumn("m", norm(F.col("surface"))).where(entropy(F.col("m")) >= settings.least_entropy).withColumn("ml", F.length("m"))
    g = world.normalized.groupBy("norm").agg(F.array_sort(F.collect_set("canonical_id")).alias("ids"))
    able = F.sequence(F.greatest(F.lit(1), F.ceil(F.col("ml") * (least / (2 - least)) - 1e-9).cast("int")), F.floor(F.col("ml") * ((2 - least) / least) + 1e-9).cast("int"))
    pairs = m.withColumn("al", F.explode(able)).join(g.withColumn("al", F.length("norm")), "al").where(ratio_bound(F.col("m"), F.col("norm")) >= least)
    scored = pairs.select("surface", "ids", ratio_of_at_least(least)("m", "norm").alias("score")).where("score is not null")
    return missed.select("mention_ord", "surface").join(scored, "surface").select("mention_ord", "surface", "ids", "score")


def vector_scores(missed: DataFrame, settings: Settings) -> DataFrame:
    """``(mention_ord, surface, ids, score)`` of the pairs whose score a later step can use: distinct surfaces are asked, in blocks, of all alias vectors."""
    m = missed.select("surface").distinct().join(settings.mention_vectors, "surface").select(F.col("surface").alias("query_id"), "vector")
    aliases = settings.alias_vectors.select(F.col("norm").alias("doc_id"), "ids", "vector")
    least = min(settings.vector_threshold, settings.band[0]) if settings.arbiter else settings.vector_threshold
    found = dense.scored(m, aliases, least)
    return found.join(missed, F.col("query_id") == F.col("surface")).join(aliases.select("doc_id", "ids"), "doc_id").select("mention_ord", "surface", "ids", "score")


def _arbitrate(pool: DataFrame, arbiter: Arbiter) -> DataFrame:
    """Ask about mentions of two candidates or more; an answer that is no candidate counts for nothing."""
    best = pool.groupBy("mention_ord", "surface", "canonical_id").agg(F.max("score").alias("score"))
    cands = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("canonical_id").alias("id")))), lambda x: F.struct(x["id"].alias("id"), (-x["s"]).alias("s")))
    asked = best.groupBy("mention_ord", "surface").agg(cands.alias("cands")).where(F.size("cands") >= 2)

    @F.pandas_udf("string")
    def choose(surface: pd.Series, cands: pd.Series) -> pd.Series:
        return pd.Series([arbiter(s, [(c["id"], round(c["s"], 6)) for c in cs]) for s, cs in zip(surface, cands)], dtype="object")

    picked = asked.withColumn("pick", choose("surface", "cands")).where("pick is not null")
    hit = F.filter("cands", lambda c: c["id"] == F.col("pick"))
    return picked.where(F.size(hit) > 0).select("mention_ord", "surface", F.col("pick").alias("canonical_id"), round6(hit[0]["s"]).alias("confidence"), F.lit("llm").alias("tier"))


def resolve_mentions(mentions: DataFrame, world: World, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """``(resolved, unresolved)``: rows of COLUMNS, ordered by mention, confidence and id; and the mentions without a hit, repeats kept."""
    out = lookup(mentions, world)
    missed = mentions.join(out.select("mention_ord").distinct(), "mention_ord", "left_anti")
    least = settings.band[0] if settings.arbiter else settings.fuzzy_threshold
    pools = []
    if settings.fuzzy:
        scored = fuzzy_scores(missed, world, least, settings)
        out = out.unionByName(_best(scored, settings.fuzzy_threshold, "fuzzy"))
        pools.append(scored)
        missed = mentions.join(out.select("mention_ord").distinct(), "mention_ord", "left_anti")
    if settings.alias_vectors is not None and settings.mention_vectors is not None:
        scored = vector_scores(missed, settings)
        out = out.unionByName(_best(scored.where("score > 0"), settings.vector_threshold, "embedding"))
        pools.append(scored)
        missed = mentions.join(out.select("mention_ord").distinct(), "mention_ord", "left_anti")
    if settings.arbiter and pools:
        pool = pools[0]
        for p in pools[1:]:
            pool = pool.unionByName(p)
        low, high = settings.band
        pool = pool.where((F.col("score") >= low) & (F.col("score") < high)).join(missed.select("mention_ord"), "mention_ord", "left_semi")
        out = out.unionByName(_arbitrate(pool.select("mention_ord", "surface", F.explode("ids").alias("canonical_id"), "score"), settings.arbiter))
        missed = mentions.join(out.select("mention_ord").distinct(), "mention_ord", "left_anti")
    return out.select(*COLUMNS).orderBy("mention_ord", F.desc("confidence"), "canonical_id"), missed.orderBy("mention_ord")


def _suppress(matches: Column) -> Column:
    """Of matches sorted by (longest, leftmost), those which overlap none taken before."""
    kind = "array<struct<neg_len:int,start:int,gram:string,ids:array<string>>>"

    def step(taken: Column, m: Column) -> Column:
        clash = F.exists(taken, lambda t: (t["start"] < m["start"] - m["neg_len"]) & (m["start"] < t["start"] - t["neg_len"]))
        return F.when(clash, taken).otherwise(F.concat(taken, F.array(m)))

    return F.aggregate(matches, F.array().cast(kind), step)


def scan(queries: DataFrame, gazetteer: DataFrame, normalize: Callable[[Column], Column] = norm, most: int | None = None) -> DataFrame:
    """``(query_id, start, surface, canonical_id, confidence, tier)``: aliases found in free text, longest first, then leftmost, none overlapping.

    ``gazetteer`` is ``(norm, ids)``; ``most`` bounds the words of an alias (default: the longest there is). A name that a query repeats is reported once.
    """
    if most is None:
        most = gazetteer.select(F.max(F.size(F.split("norm", " ")))).first()[0] or 0
    spread = queries.repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), "query_id")  # by number: few bytes of short texts make many runs of words, which one task would have to make
    normal = spread.select("query_id", normalize(F.col("text")).alias("n"))
    words = computed(normal, "words", tokens(F.col("n")))
    grams = words.select("query_id", F.explode(ngrams(F.col("words"), max(most, 1))).alias("g")).select("query_id", "g.*")
    found = grams.join(gazetteer.select(F.col("norm").alias("gram"), "ids"), "gram")
    per = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("len")).alias("neg_len"), "start", "gram", "ids"))).alias("m"))
    kept = per.select("query_id", F.explode(_suppress(F.col("m"))).alias("k")).groupBy("query_id", F.col("k.gram").alias("surface"), F.col("k.ids").alias("ids")).agg(F.min("k.start").alias("start"))
    return kept.select("query_id", "start", "surface", F.explode("ids").alias("canonical_id"), F.lit(1.0).alias("confidence"), F.lit("normalized").alias("tier"))


def resolve_text(queries: DataFrame, world: World) -> DataFrame:
    """``scan`` over a world, in order of query, position and id."""
    return scan(queries, world.gazetteer).orderBy("query_id", "start", "canonical_id")
