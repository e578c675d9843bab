"""The entity world: build (validate, merge, fold), then a read-only handle over Parquet tables.

``WorldBuilder`` gathers entities and merges; ``freeze`` checks, folds and returns a ``World``, which has no mutators. Metadata is JSON text.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillstone.functions.text import norm
from quillstone.plans.components import connected
from quillstone.sources.schema import EDGE_COLUMNS, ENTITY, MERGE, RELATION, VERSION

MOST_MERGES = 100_000  # that the driver replays
RELATION_FIELDS = [f.name for f in RELATION.fields]


def entities_frame(spark: SparkSession, rows: Iterable[dict]) -> DataFrame:
    """Entities from dicts; missing fields get their defaults, metadata may be a dict."""
    out = []
    for r in rows:
        meta = r.get("metadata") or {}
        relations = [{f: x.get(f) for f in RELATION_FIELDS} | {"weight": float(x.get("weight", 1.0) if x.get("weight") is not None else 1.0)} for x in r.get("relations", ())]
        refs = [{"doc_id": x["doc_id"], "locator": x.get("locator")} for x in r.get("refs", ())]
        out.append({f.name: r.get(f.name) for f in ENTITY.fields} | {"aliases": list(r.get("aliases", ())), "merged_from": list(r.get("merged_from", ())), "refs": refs, "relations": relations, "metadata": meta if isinstance(meta, str) else json.dumps(meta, sort_keys=True)})
    return spark.createDataFrame(out, ENTITY)


def _refuse(bad: DataFrame, what: str, column: str) -> None:
    found = [r[0] for r in bad.select(column).limit(5).collect()]
    if found:
        raise ValueError(f"{what}: {found}")


def validate(entities: DataFrame) -> None:
    """Unique ids, and metadata that is a JSON object."""
    _refuse(entities.groupBy("canonical_id").count().where("count > 1"), "duplicate canonical ids", "canonical_id")
    meta = F.try_parse_json("metadata")
    _refuse(entities.where(F.col("metadata").isNotNull() & (meta.isNull() | ~F.schema_of_variant(meta).startswith("OBJECT"))), "metadata is not a JSON object", "canonical_id")


def union_find(merges: Iterable[tuple[str, str]]) -> dict[str, str]:
    """Child to representative. Merges are replayed in order (root of source under root of target), as the order decides who represents."""
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        while x in parent:
            x = parent[x]
        return x

    for source, target in merges:
        a, b = root(source), root(target)
        if a != b:
            parent[a] = b
    return {c: root(c) for c in parent}


def merge_map(spark: SparkSession, merges: DataFrame | None) -> DataFrame:
    """``(child_id, root_id)`` of an ordered merge log. Logs of more than ``MOST_MERGES`` are folded component by component on the cluster, as merges of different components don't touch."""
    kind = "child_id string, root_id string"
    if merges is None or merges.limit(MOST_MERGES + 1).count() <= MOST_MERGES:
        log = [] if merges is None else [(r.source_id, r.target_id) for r in merges.orderBy("seq").toLocalIterator()]
        return spark.createDataFrame(sorted(union_find(log).items()), kind)

    def fold_log(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("seq", kind="stable")
        return pd.DataFrame(sorted(union_find(list(zip(t.source_id, t.target_id))).items()), columns=["child_id", "root_id"])

    label = connected(merges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")))
    return merges.join(label, merges.source_id == label.id).select("label", "seq", "source_id", "target_id").groupBy("label").applyInPandas(fold_log, kind)


def _by_document(refs: Column) -> Column:
    keyed = F.transform(refs, lambda r: F.struct(r["doc_id"].alias("d"), F.coalesce(r["locator"], F.lit("")).alias("l"), r.alias("r")))
    return F.transform(F.array_sort(keyed), lambda x: x["r"])


def fold(entities: DataFrame, roots: DataFrame) -> DataFrame:
    """Representatives, which take in their members' labels, aliases, refs and relations; targets are rewritten, self-loops dropped.

    Without merges this is a projection; with them, the arrays are exploded, joined and gathered again.
    """
    n_merged = roots.count()
    if n_merged == 0:
        tidy = {
            "aliases": F.array_distinct("aliases"), "merged_from": F.array_distinct("merged_from"), "refs": _by_document(F.array_distinct("refs")),
            "relations": F.array_sort(F.array_distinct(F.filter("relations", lambda r: r["target_id"] != F.col("canonical_id")))),
        }
        return entities.withColumns(tidy).select(*[f.name for f in ENTITY.fields])
    to = F.broadcast(roots) if n_merged <= 1_000_000 else roots
    e = entities.join(to, entities.canonical_id == to.child_id, "left").withColumn("root", F.coalesce("root_id", "canonical_id")).drop("child_id", "root_id")
    own = F.col("canonical_id") == F.col("root")
    member = e.select("root", "canonical_id", own.alias("own"), F.when(own, F.col("aliases")).otherwise(F.concat(F.array("label"), "aliases")).alias("names"), F.when(own, F.col("merged_from")).otherwise(F.array("canonical_id")).alias("from_"), "refs")
    order = F.struct((~F.col("own")).alias("later"), F.col("canonical_id").alias("id"))

    def gathered(c: str):
        return F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(c).alias("v")))), lambda x: x["v"])))

    parts = member.groupBy("root").agg(gathered("names").alias("aliases"), gathered("from_").alias("merged_from"), gathered("refs").alias("refs"))
    rel = e.select("root", F.explode("relations").alias("r")).select("root", "r.*")
    rel = rel.join(to.select(F.col("child_id").alias("target_id"), "root_id"), "target_id", "left").withColumn("target_id", F.coalesce("root_id", "target_id")).where(F.col("target_id") != F.col("root"))
    rel = rel.select("root", F.struct(*RELATION_FIELDS).alias("r")).distinct().groupBy("root").agg(F.array_sort(F.collect_list("r")).alias("relations"))
    base = e.where(own).drop("aliases", "merged_from", "refs", "relations", "root")
    out = base.join(parts, base.canonical_id == parts.root).drop("root").withColumn("refs", _by_document(F.col("refs")))
    out = out.join(rel, out.canonical_id == rel.root, "left").withColumn("relations", F.coalesce("relations", F.array().cast(ENTITY["relations"].dataType)))
    return out.select(*[f.name for f in ENTITY.fields])


def surfaces(entities: DataFrame) -> DataFrame:
    """``(surface, canonical_id)`` of labels and aliases."""
    return entities.select(F.explode(F.array_distinct(F.concat(F.array("label"), "aliases"))).alias("surface"), "canonical_id")


def index(pairs: DataFrame, key: str) -> DataFrame:
    """``(key, ids)``: the sorted distinct ids of each key."""
    return pairs.groupBy(key).agg(F.array_sort(F.collect_set("canonical_id")).alias("ids"))


def alias_conflicts(pairs: DataFrame, key: str = "norm") -> DataFrame:
    """Keys that name two entities or more."""
    return index(pairs, key).where(F.size("ids") >= 2)


class World:
    """A frozen world. ``entities`` are representatives, ``records`` all ids ever added, ``roots`` the merges."""

    def __init__(self, entities: DataFrame, records: DataFrame, roots: DataFrame) -> None:
        self.entities, self.records, self.roots = entities, records, roots

    @cached_property
    def exact(self) -> DataFrame:
        return surfaces(self.entities)

    @cached_property
    def normalized(self) -> DataFrame:
        return self.exact.withColumn("norm", norm(F.col("surface"))).where("norm <> ''").select("norm", "canonical_id").distinct()

    @property
    def gazetteer(self) -> DataFrame:
        """``(norm, ids)`` sorted by norm."""
        return index(self.normalized, "norm").orderBy("norm")

    @property
    def canonical_entities(self) -> DataFrame:
        return self.entities.orderBy("canonical_id")

    @property
    def edges(self) -> DataFrame:
        return self.entities.select(F.col("canonical_id").alias("src_id"), F.explode("relations").alias("r")).select("src_id", "r.*").select(*EDGE_COLUMNS)

    @property
    def refs(self) -> DataFrame:
        return self.entities.select(F.col("canonical_id").alias("entity_id"), F.explode("refs").alias("r")).select("entity_id", "r.*")

    @property
    def edge_capable(self) -> bool:
        return not self.edges.isEmpty()

    def edges_of(self, ids: DataFrame) -> DataFrame:
        """Out-edges of ``ids (id)``, ordered by predicate and target."""
        return self.edges.join(ids.select(F.col("id").alias("src_id")), "src_id", "left_semi").orderBy("src_id", "predicate", "target_id")

    def refs_of(self, ids: DataFrame) -> DataFrame:
        return self.refs.join(ids.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").orderBy("entity_id", "doc_id", F.coalesce("locator", F.lit("")))

    def has_id(self, ids: DataFrame) -> DataFrame:
        """Those of ``ids (id)`` that can be resolved to."""
        return ids.join(self.entities.select(F.col("canonical_id").alias("id")), "id", "left_semi")

    def has_record(self, ids: DataFrame) -> DataFrame:
        """Those of ``ids (id)`` that were ever added, merged away or not."""
        return ids.join(self.records.select(F.col("canonical_id").alias("id")), "id", "left_semi")

    def write(self, path: str) -> World:
        """Parquet tables with a version; name indexes are written too, sorted by key so that files can be skipped."""
        spark = self.entities.sparkSession
        for name, df in (("entities", self.entities), ("records", self.records), ("roots", self.roots)):
            df.write.parquet(f"{path}/{name}")
        self.exact.sortWithinPartitions("surface").write.parquet(f"{path}/exact")
        self.normalized.sortWithinPartitions("norm").write.parquet(f"{path}/norm")
        spark.createDataFrame([(VERSION,)], "schema_version int").write.parquet(f"{path}/meta")
        return World.read(spark, path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> World:
        try:
            version = spark.read.parquet(f"{path}/meta").first()
        except Exception as e:
            raise ValueError(f"no world at {path}") from e
        if version is None or version.schema_version != VERSION:
            raise ValueError(f"the world at {path} has version {version and version.schema_version}, not {VERSION}")
        w = World(*(spark.read.parquet(f"{path}/{n}") for n in ("entities", "records", "roots")))
        w.__dict__["exact"] = spark.read.parquet(f"{path}/exact")
        w.__dict__["normalized"] = spark.read.parquet(f"{path}/norm")
        return w


class WorldBuilder:
    """Gathers entities and merges; after ``freeze`` it takes no more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._entities, self._merges, self._frozen = spark, None, [], False

    def _open(self) -> None:
        if not self._frozen:
            return
        raise RuntimeError("the world is frozen")

    def add(self, entities: DataFrame | Iterable[dict]) -> WorldBuilder:
        self._open()
        df = entities if isinstance(entities, DataFrame) else entities_frame(self.spark, entities)
        self._entities = df if self._entities is None else self._entities.unionByName(df)
        return self

    def merge(self, source_id: str, target_id: str) -> WorldBuilder:
        self._open()
        self._merges.append((len(self._merges), source_id, target_id))
        return self

    def freeze(self, merges: DataFrame | None = None) -> World:
        """``merges`` may add a log ``(seq, source_id, target_id)`` of its own."""
        self._open()
        self._frozen = True
        all_ = self._entities if self._entities is not None else self.spark.createDataFrame([], ENTITY)
        validate(all_)
        log = self.spark.createDataFrame(self._merges, MERGE)
        roots = merge_map(self.spark, log if merges is None else log.unionByName(merges))
        named = roots.select(F.explode(F.array("child_id", "root_id")).alias("canonical_id")).distinct()
        _refuse(named.join(all_, "canonical_id", "left_anti"), "merges name unknown ids", "canonical_id")
        return World(fold(all_, roots), all_.select("canonical_id"), roots)


def with_mirrors(entities: DataFrame, mirrors: dict[str, str] | None = None) -> DataFrame:
    """For each edge whose predicate has a mirror, the reverse edge on its target, same valid time and weight, known time open."""
    spark = entities.sparkSession
    names = dict(links_to="linked_from", mentions="mentioned_in") if mirrors is None else mirrors
    table = F.broadcast(spark.createDataFrame(sorted(names.items()), "predicate string, mirror string"))
    rel = entities.select(F.col("canonical_id").alias("src"), F.explode("relations").alias("r")).select("src", "r.*")
    ids = entities.select(F.col("canonical_id").alias("target_id"))
    back = rel.join(table, "predicate").join(ids, "target_id", "left_semi")
    made = back.select(F.col("target_id").alias("owner"), F.struct(F.col("mirror").alias("predicate"), F.col("src").alias("target_id"), "valid_from", "valid_until", F.lit(None).cast("string").alias("known_from"), F.lit(None).cast("string").alias("known_until"), "weight").alias("r"))
    more = made.distinct().groupBy("owner").agg(F.array_sort(F.collect_list("r")).alias("more"))
    both = F.concat("relations", F.filter("more", lambda r: ~F.array_contains(F.col("relations"), r)))
    out = entities.join(more, entities.canonical_id == more.owner, "left").withColumn("relations", F.when(F.col("more").isNull(), F.col("relations")).otherwise(both))
    return out.select(*entities.columns)


# JSON


def to_json_lines(entities: DataFrame) -> DataFrame:
    """``value``: an entity for each line, keys in alphabetical order, ordered by id."""
    fields = sorted(f.name for f in ENTITY.fields)
    inner = {"refs": sorted(["doc_id", "locator"]), "relations": sorted(RELATION_FIELDS)}

    def col(n: str):
        return F.transform(n, lambda x: F.struct(*[x[k].alias(k) for k in inner[n]])).alias(n) if n in inner else F.parse_json(F.coalesce(n, F.lit("{}"))).alias(n) if n == "metadata" else F.col(n)

    return entities.orderBy("canonical_id").select(F.to_json(F.struct(*[col(n) for n in fields]), {"ignoreNullFields": "false"}).alias("value"))


def dump_document(entities: DataFrame) -> str:
    """One JSON document, byte for byte the same for the same entities. For exports that a person reads; ``to_json_lines`` is for large ones."""
    rows = [json.loads(r.value) for r in to_json_lines(entities).toLocalIterator()]
    return json.dumps({"version": VERSION, "entities": rows}, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def load_document(spark: SparkSession, text: str) -> DataFrame:
    data = json.loads(text)
    if data.get("version") != VERSION:
        raise ValueError(f"unknown version {data.get('version')!r}")
    return entities_frame(spark, data["entities"])


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Entities written by ``to_json_lines``; missing fields get their defaults."""
    df = spark.read.schema(ENTITY).json(path)
    empty = {c: F.coalesce(c, F.array().cast(ENTITY[c].dataType)) for c in ("aliases", "merged_from", "refs", "relations")}
    weighted = F.transform("relations", lambda r: r.withField("weight", F.coalesce(r["weight"], F.lit(1.0))))
    return df.withColumns(empty).withColumn("relations", weighted).withColumn("metadata", F.coalesce("metadata", F.lit("{}")))
