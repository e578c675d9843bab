"""From questions to contexts: scan, gate, signals, fusion, assembly, for a batch of questions at once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window, functions as F

from quillstone.operators import assemble, dense, fusion, gate, graph, lexical, resolve
from quillstone.sources.world import World


@dataclass(frozen=True)
class Engine:
    world: World
    corpus: DataFrame  # doc_id, content, tokens, embedding
    lexical: lexical.Index | None = None
    vectors: DataFrame | None = None  # doc_id, vector
    embedder: dense.Embedder | None = None
    use_graph: bool = True
    private_ids: tuple[str, ...] = ()
    tail_ids: tuple[str, ...] = ()
    settings: gate.Settings = field(default_factory=gate.Settings)
    lam: float = 0.5
    floor: float = 0.6
    depth: int = 2

    def decide(self, queries: DataFrame) -> DataFrame:
        """``queries (query_id, text, budget)`` with the entities found and the gate's decision."""
        hits = resolve.scan(queries, self.world.gazetteer)
        at = hits.groupBy("query_id", "canonical_id").agg(F.min(F.struct("start", "canonical_id")).alias("o"))
        ents = at.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list("o")), lambda o: o["canonical_id"]).alias("entities"))
        ids = [F.array(*map(F.lit, x)).cast("array<string>") for x in (self.private_ids, self.tail_ids)]
        q = queries.join(ents, "query_id", "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))
        return gate.decide(q.withColumn("private_ids", ids[0]).withColumn("tail_ids", ids[1]), self.settings).drop("private_ids", "tail_ids")

    def signals(self, decided: DataFrame, k: int = 20) -> DataFrame:
        """``(query_id, signal, rank0, doc_id)``: each signal runs for the queries whose strategy wants it."""
        out = []

        def wanting(*strategies: str) -> DataFrame:
            return decided.where(F.col("strategy").isin(*strategies))

        if self.lexical is not None:
            out.append(lexical.search(wanting("grep", "composite"), self.lexical, k).withColumn("signal", F.lit("lexical")))
        if self.vectors is not None and self.embedder is not None:
            q = dense.embed(wanting("semantic", "composite").select("query_id", "text"), "text", self.embedder)
            out.append(dense.search(q, self.vectors, k, self.floor).withColumn("signal", F.lit("semantic")))
        if self.use_graph:
            seeds = wanting("graph", "composite").select("query_id", F.explode("entities").alias("seed"))
            w = self.world
            hits = graph.traverse(seeds.select("seed"), w.entities.select(F.col("canonical_id").alias("id")), w.edges, w.refs, self.depth).join(seeds, "seed")
            order = Window.partitionBy("query_id").orderBy("hop", F.desc("score"), "doc_id")
            docs = graph.graph_documents(hits).withColumn("rank0", F.row_number().over(order)).where(F.col("rank0") <= k).withColumn("rank0", F.col("rank0") - 1)
            out.append(docs.withColumn("signal", F.lit("graph")))
        all_ = None
        for s in out:
            s = s.select("query_id", "signal", "rank0", "doc_id")
            all_ = s if all_ is None else all_.unionByName(s)
        if all_ is None:
            return decided.sparkSession.createDataFrame([], f"query_id {decided.schema['query_id'].dataType.simpleString()}, signal string, rank0 int, doc_id string")
        return all_

    def retrieve(self, queries: DataFrame, k: int = 20) -> tuple[DataFrame, DataFrame]:
        """``(results, fused)``: a row for each query with decision, entities and, where retrieval ran and found content, text, manifest and total_tokens."""
        decided = self.decide(queries)
        fused = fusion.fuse(self.signals(decided, k), top_k=k)
        rel = F.col("score") / F.max("score").over(Window.partitionBy("query_id"))
        cands = fused.withColumn("rel", F.when(F.col("score") > 0, rel).otherwise(0.0)).join(self.corpus, "doc_id").join(decided.select("query_id", "budget"), "query_id")
        return decided.join(assemble.assemble(cands, self.lam), "query_id", "left"), fused


def ground(engine: Engine, queries: DataFrame) -> DataFrame:
    """``(query_id, doc_id, score, content)``: documents near the entities a question names, each at its best score."""
    w = engine.world
    found = resolve.scan(queries, w.gazetteer).select("query_id", F.col("canonical_id").alias("seed")).distinct()
    hits = graph.traverse(found.select("seed"), w.entities.select(F.col("canonical_id").alias("id")), w.edges, w.refs, engine.depth).join(found, "seed")
    return hits.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")).join(engine.corpus.select("doc_id", "content"), "doc_id").orderBy("query_id", F.desc("score"), "doc_id")
