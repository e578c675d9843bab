"""Ids that entities have in other systems: one entity may have many, an external id has one owner."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillstone.sources.world import _refuse


def from_entities(entities: DataFrame, key: str = "system_ids") -> DataFrame:
    """``(canonical_id, system, external_id)`` from metadata, where a system has one id or a list of them."""
    meta = F.parse_json(F.coalesce("metadata", F.lit("{}")))
    raw = entities.select("canonical_id", F.try_variant_get(meta, f"$.{key}", "variant").alias("v"))
    _refuse(raw.where(F.col("v").isNotNull() & ~F.is_variant_null("v") & ~F.schema_of_variant("v").startswith("OBJECT")), f"metadata.{key} must map systems to ids", "canonical_id")
    each = raw.where(F.col("v").isNotNull()).select("canonical_id", F.explode(F.from_json(F.to_json("v"), "map<string,string>")).alias("system", "value"))
    ids = F.when(F.col("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.array("value"))
    return build(each.select("canonical_id", "system", F.explode(ids).alias("external_id")))


def build(triples: DataFrame) -> DataFrame:
    """Distinct triples; an error if an external id has two owners."""
    out = triples.select("canonical_id", "system", "external_id").distinct()
    _refuse(out.groupBy("system", "external_id").agg(F.count("*").alias("n")).where("n > 1").select(F.concat_ws(":", "system", "external_id").alias("x")), "external ids of two entities", "x")
    return out


def external_ids(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sorted ids for ``wanted (canonical_id, system)``; an empty list where there are none."""
    found = index.groupBy("canonical_id", "system").agg(F.array_sort(F.collect_set("external_id")).alias("external_ids"))
    return wanted.join(found, ["canonical_id", "system"], "left").withColumn("external_ids", F.coalesce("external_ids", F.array().cast("array<string>")))


def bind(index: DataFrame, wanted: DataFrame, strict: bool = False) -> DataFrame:
    """The one id for ``wanted``: null if there is none; of several, null with status ``ambiguous``, or an error if ``strict``."""
    e = external_ids(index, wanted)
    n = F.size("external_ids")
    one = F.when(n == 1, F.col("external_ids")[0])
    if strict:
        one = F.when(n > 1, F.raise_error(F.concat(F.lit("ambiguous binding: "), "canonical_id", F.lit(" in "), "system"))).otherwise(one)
    status = F.when(n == 0, "missing").when(n == 1, "bound").otherwise("ambiguous")
    return e.select("canonical_id", "system", one.alias("external_id"), status.alias("status"))


def owners(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Owner of ``wanted (system, external_id)``, null if unknown."""
    return wanted.join(index, ["system", "external_id"], "left").select("system", "external_id", "canonical_id")


def systems(index: DataFrame) -> DataFrame:
    return index.groupBy("canonical_id").agg(F.array_sort(F.collect_set("system")).alias("systems"))
