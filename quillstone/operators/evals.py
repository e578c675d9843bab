"""Scores of resolvers and pipelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillstone.functions.text import is_error_path, percent


def pass_at_k(trials: DataFrame, by: list[str]) -> DataFrame:
    """Whether all trials of a task passed (and there was one)."""
    return trials.groupBy(*by).agg((F.every("ok") & (F.count("*") > 0)).alias("passed"), F.count("*").alias("trials"))


def accuracy(results: DataFrame, category: str) -> DataFrame:
    return results.groupBy(category).agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok")).withColumn("percent", percent(F.col("n_ok"), F.col("n")))


def table_hash(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``(sha, n)`` of a table of any size: the sum of 60-bit digests of its rows, which does not depend on their order and counts repeats. Every value is followed by a zero byte."""
    one = F.concat(*[F.concat(F.coalesce(F.col(c).cast("string"), F.lit("")), F.decode(F.unhex(F.lit("00")), "UTF-8")) for c in columns])
    part = F.conv(F.substring(F.sha2(one, 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return rows.agg(F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("sha"), F.count("*").alias("n"))


def corpus_hash(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``(sha, n)``: 16 hex digits of a list of files, in order of its key, all at once; ``table_hash`` is for tables. Every value is followed by a zero byte."""
    one = F.concat(*[F.concat(F.coalesce(F.col(c).cast("string"), F.lit("")), F.decode(F.unhex(F.lit("00")), "UTF-8")) for c in columns])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), one.alias("v")))), lambda x: x["v"]), "")
    return rows.agg(F.substring(F.sha2(text, 256), 1, 16).alias("sha"), F.count("*").alias("n"))


def evaluate(items: DataFrame, resolved: DataFrame) -> DataFrame:
    """``items (item_ord, canonical_id, category)`` with the first hit of ``resolved (mention_ord, canonical_id, confidence)`` and whether it is right."""
    first = resolved.groupBy("mention_ord").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "canonical_id")).alias("f"))
    out = items.join(first, items.item_ord == first.mention_ord, "left").withColumn("got", F.col("f.canonical_id")).drop("f", "mention_ord")
    return out.withColumn("ok", F.coalesce(F.col("got") == F.col("canonical_id"), F.lit(False)))


def score_row(artefacts: DataFrame) -> DataFrame:
    """One row of scores for each benchmark artefact ``(aggregate struct, results array)``."""
    a, total = F.col("aggregate"), F.coalesce(F.col("aggregate.total_prompts"), F.size("results"))
    passed = F.coalesce(a["passed"], F.lit(0))
    policy = F.round(0.5 * F.coalesce(a["detection_rate_blocked_categories"], F.lit(0.0)) + 0.5 * F.greatest(F.lit(0.0), 100.0 - F.coalesce(a["false_positive_rate_safe_harbor"], F.lit(0.0))), 1)
    safe = F.size(F.filter("results", lambda r: ~is_error_path(r["engine_path"])))
    n = F.size("results")
    return artefacts.select(total.alias("n_tasks"), percent(passed, total).alias("correctness"), F.coalesce(a["pass_at_k_rate"], percent(passed, total)).alias("pass_at_k"), policy.alias("policy_pass"), F.when(n > 0, percent(safe, n)).alias("path_safety"), a["api_latency_ms"]["p99"].alias("latency_ms_p99"))


def leaderboard(rows: DataFrame) -> str:
    """A Markdown table of score rows, ordered by domain and contestant; for a report of a few rows."""
    names = rows.columns
    found = sorted(([str(v) if v is not None else "-" for v in r] for r in rows.collect()))
    return "\n".join(f"| {' | '.join(x)} |" for x in [names, ["---"] * len(names), *found]) + "\n"


def ndcg(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, ndcg, recall)`` of ``ranked (query_id, doc_id, rank0)`` against ``relevant (query_id, doc_id, gain)``."""

    def gain(g: Column, r: Column) -> Column:
        return g / F.log2(r + 2)

    hit = ranked.where(F.col("rank0") < k).join(relevant, ["query_id", "doc_id"]).groupBy("query_id").agg(F.sum(gain(F.col("gain"), F.col("rank0"))).alias("dcg"), F.count("*").alias("hits"))
    best = relevant.groupBy("query_id").agg(F.reverse(F.array_sort(F.collect_list("gain"))).alias("g"), F.count("*").alias("n"))
    ideal = F.aggregate(F.transform(F.slice("g", 1, k), lambda x, i: gain(x, i)), F.lit(0.0), lambda s, x: s + x)
    return best.join(hit, "query_id", "left").select("query_id", (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"), (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("recall"))
