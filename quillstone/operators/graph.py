"""Bounded traversal of a graph whose edges carry validity: unrolled joins for batches of seeds, or recursive SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from quillstone.functions.temporal import Instant, as_at

MOST_DEPTH = 3


def _checked(depth: int) -> None:
    if not 0 <= depth <= MOST_DEPTH:
        raise ValueError(f"depth must lie in 0..{MOST_DEPTH}, not {depth}")


def reach(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 2, as_of: Instant = None, known_as_of: Instant = None) -> DataFrame:
    """``(seed, node, hop)``: nodes within ``depth`` edges of each seed, at their least hop.

    ``seeds (seed)``, ``nodes (id)``, ``edges (src_id, target_id, times)``. Times are tested before the joins; a node met before doesn't spread again.
    """
    _checked(depth)
    live = as_at(edges, as_of, known_as_of).select("src_id", "target_id").distinct()
    live = live.join(nodes.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    front = seeds.select("seed").distinct().join(nodes.select(F.col("id").alias("seed")), "seed", "left_semi").select("seed", F.col("seed").alias("node"))
    seen = front.withColumn("hop", F.lit(0))
    for hop in range(1, depth + 1):
        step = front.join(live, front.node == live.src_id).select("seed", F.col("target_id").alias("node")).distinct()
        front = step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        seen = seen.unionByName(front.withColumn("hop", F.lit(hop)))
    return seen


def traverse(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, refs: DataFrame, depth: int = 2, as_of: Instant = None, known_as_of: Instant = None) -> DataFrame:
    """``(seed, entity_id, doc_id, locator, hop, score, mode)``: documents of the nodes reached. Mode is ``flat`` if no edge exists at all, valid or not."""
    mode = "flat" if edges.isEmpty() else "graph"
    hits = reach(seeds, nodes, edges, depth, as_of, known_as_of).withColumnRenamed("node", "entity_id").join(refs, "entity_id")
    return hits.select("seed", "entity_id", "doc_id", "locator", "hop", (1.0 / (1 + F.col("hop"))).alias("score"), F.lit(mode).alias("mode"))


def ordered(hits: DataFrame) -> DataFrame:
    return hits.orderBy("seed", "hop", "entity_id", "doc_id", F.coalesce("locator", F.lit("")))


def traversal_sql(depth: int = 2, as_of: Instant = None, known_as_of: Instant = None) -> tuple[str, dict[str, str]]:
    """The traversal of one seed as recursive SQL over views ``nodes``, ``edges``, ``refs``, and its named arguments (but ``seed``).

    Only the axes given are tested; depth is a checked literal, every string an argument.
    """
    _checked(depth)
    args, tests = {}, []
    for axis, name, at in (("valid", "as_of", as_of), ("known", "known_as_of", known_as_of)):
        if at is not None:
            args[name] = at
            tests.append(f"AND (e.{axis}_from IS NULL OR e.{axis}_from <= :{name}) AND (e.{axis}_until IS NULL OR :{name} < e.{axis}_until)")
    text = f"""WITH RECURSIVE walk(node, hop) AS (
  SELECT id, 0 FROM nodes WHERE id = :seed
  UNION ALL
  SELECT e.target_id, w.hop + 1 FROM walk w JOIN edges e ON e.src_id = w.node JOIN nodes n ON n.id = e.target_id WHERE w.hop < {depth} {' '.join(tests)}
), least AS (SELECT node, min(hop) AS hop FROM walk GROUP BY node)
SELECT l.node AS entity_id, l.hop AS hop, r.doc_id AS doc_id, r.locator AS locator FROM least l JOIN refs r ON r.entity_id = l.node
ORDER BY hop, entity_id, doc_id, coalesce(locator, '')"""
    return text, args


def traverse_with(seed: str, run: Callable[[str, dict[str, str]], DataFrame], depth: int = 2, as_of: Instant = None, known_as_of: Instant = None) -> DataFrame:
    """Hand the compiled traversal to an executor, ``spark.sql`` or another engine's, and map its rows; rows without a document are dropped."""
    text, args = traversal_sql(depth, as_of, known_as_of)
    rows = run(text, args | {"seed": seed}).where("doc_id IS NOT NULL")
    return rows.select("entity_id", "doc_id", "locator", "hop", (1.0 / (1 + F.col("hop"))).alias("score"), F.lit("graph").alias("mode")).orderBy("hop", "entity_id", "doc_id", F.coalesce("locator", F.lit("")))


def graph_documents(hits: DataFrame, key: str = "query_id") -> DataFrame:
    """``(key, doc_id, hop, score)``: the best hit of each document over all seeds."""
    best = hits.groupBy(key, "doc_id").agg(F.min(F.struct("hop", (-F.col("score")).alias("n"))).alias("b"))
    return best.select(key, "doc_id", F.col("b.hop").alias("hop"), (-F.col("b.n")).alias("score"))


def adjacency(edges: DataFrame) -> DataFrame:
    """``(node, nbr)``: undirected neighbours, once each, none of itself."""
    e = edges.where("src_id <> target_id")
    return e.select(F.col("src_id").alias("node"), F.col("target_id").alias("nbr")).union(e.select("target_id", "src_id")).distinct()


def degrees(adj: DataFrame) -> DataFrame:
    return adj.groupBy("node").agg(F.count("*").alias("degree"))
