"""BM25 over an inverted index of DataFrames, and line search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillstone.functions.text import lexical_tokens, lines
from quillstone.plans.tables import materialize

K1, B = 1.2, 0.75
SLACK = 1e-6  # by which sums in another order may differ, and far more


@dataclass(frozen=True)
class Index:
    postings: DataFrame  # term, doc_id, tf
    lengths: DataFrame  # doc_id, dl
    stats: DataFrame  # n, avgdl: one row


def inverse_frequency(n: Column, df: Column) -> Column:
    """ln(1 + (n - df + 1/2) / (df + 1/2)), put together over one denominator."""
    return F.log((n + 1) / (df + 0.5))


def build(docs: DataFrame) -> Index:
    """Index of ``docs (doc_id, text)``, as tables in the shared folder; ids must be unique."""
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        raise ValueError("duplicate document ids")
    t = docs.select("doc_id", F.explode(lexical_tokens(F.col("text"))).alias("term"))
    postings = materialize(t.groupBy("term", "doc_id").agg(F.count("*").alias("tf")), "postings")  # the one pass that reads texts
    dl = postings.groupBy("doc_id").agg(F.sum("tf").alias("dl"))
    lengths = materialize(docs.select("doc_id").join(dl, "doc_id", "left").select("doc_id", F.coalesce("dl", F.lit(0)).cast("int").alias("dl")), "lengths")
    return Index(postings, lengths, lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))


def write(index: Index, path: str) -> Index:
    """Keep an index as Parquet; postings sorted by term, so that a query skips files."""
    spark = index.stats.sparkSession
    index.postings.repartition("term").sortWithinPartitions("term").write.parquet(f"{path}/postings")
    index.lengths.write.parquet(f"{path}/lengths")
    index.stats.write.parquet(f"{path}/stats")
    return Index(*(spark.read.parquet(f"{path}/{n}") for n in ("postings", "lengths", "stats")))


def _terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(lexical_tokens(F.col("text")))).alias("term"))


def _parts(hits: DataFrame, df: DataFrame, stats: DataFrame, k1: float, b: float) -> DataFrame:
    """``(term, doc_id, part)``: what a term adds to a document's score."""
    idf = inverse_frequency(F.col("n"), F.col("df"))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hits.join(df, "term").crossJoin(F.broadcast(stats)).select("term", "doc_id", part.alias("part"))


def scores(queries: DataFrame, index: Index, k1: float = K1, b: float = B) -> DataFrame:
    """``(query_id, doc_id, score)`` of ``queries (query_id, text)``: terms count once, documents need one of them."""
    terms = _terms(queries)
    live = index.postings.join(terms.select("term").distinct(), "term", "left_semi")
    hit = _parts(live.join(index.lengths, "doc_id"), live.groupBy("term").agg(F.count("*").alias("df")), index.stats, k1, b)
    summed = hit.join(terms, "term").groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))
    return summed.withColumn("score", F.round("score", 10))  # equal documents tie, whatever order their terms were summed in


def top(scored: DataFrame, k: int, key: str = "query_id") -> DataFrame:
    """The ``k`` best of each query, ties to the smaller id, with their rank from 0."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "doc_id")
    ranked = scored.withColumn("rank0", F.row_number().over(w)).where(F.col("rank0") <= k)  # in this form the limit is applied before the shuffle
    return ranked.withColumn("rank0", F.col("rank0") - 1)


def search(queries: DataFrame, index: Index, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """The ``k`` best of ``scores``, with their rank from 0; what can't be among them is not scored.

    A query's score to beat is the ``k``-th best of the sums over the documents in which its terms add most. Its terms that can't reach that even together only add to documents which others find, and only to those that may
    still get there. Or, where that leaves less to do, it is the commonest term alone that isn't spread: a document that has no other of the terms comes after those in which that one adds more, of which ``k`` are enough.
    """
    terms = materialize(_terms(queries), "terms")
    live = index.postings.join(terms.select("term").distinct(), "term", "left_semi")
    df = materialize(live.groupBy("term").agg(F.count("*").alias("df")), "df")
    parts = materialize(_parts(live.join(index.lengths, "doc_id"), df, index.stats, k1, b), "parts")
    best = parts.withColumn("r", F.row_number().over(Window.partitionBy("term").orderBy(F.desc(F.round("part", 10)), "doc_id"))).where(F.col("r") <= k)
    best = materialize(best, "best")

    def kth(sums: DataFrame) -> DataFrame:
        return sums.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s")))).where(F.col("r") <= k).where(F.col("r") == k).select("query_id", F.col("s").alias("beat"))

    known = kth(best.join(terms, "term").groupBy("query_id", "doc_id").agg(F.sum("part").alias("s")))
    most = terms.join(best.where("r = 1").select("term", F.col("part").alias("most")), "term").join(df, "term").join(known, "query_id", "left")
    own = Window.partitionBy("query_id")
    together = F.sum("most").over(own.orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0))
    most = most.withColumn("low", F.coalesce(together < F.col("beat") - SLACK, F.lit(False))).withColumn("common", F.row_number().over(own.orderBy(F.desc("df"), "term")) == 1)
    fill = F.sum(F.when(~F.col("common"), F.col("df")).otherwise(0)).over(own) < F.sum(F.when(~F.col("low"), F.col("df")).otherwise(0)).over(own)
    weighed = materialize(most.withColumn("fill", fill).withColumn("weak", F.when(F.col("fill"), F.col("common")).otherwise(F.col("low"))), "weighed")
    weak, strong = weighed.where("weak"), weighed.where("not weak")
    found = parts.join(strong.select("query_id", "term"), "term").select("query_id", "doc_id", F.col("part").alias("s"))
    first = best.join(weak.where("fill").select("query_id", "term"), "term").select("query_id", "doc_id", F.lit(0.0).alias("s"))
    sums = materialize(found.unionByName(first).groupBy("query_id", "doc_id").agg(F.sum("s").alias("s")), "sums")
    zero = F.lit(0.0)
    bars = materialize(weak.groupBy("query_id").agg(F.sum("most").alias("rest"), F.max("beat").alias("known")).join(kth(sums), "query_id", "left").select("query_id", "rest", F.greatest("known", F.coalesce("beat", zero)).alias("bar")), "bars")
    able = materialize(sums.join(bars, "query_id", "left").where(F.col("bar").isNull() | (F.col("s") + F.col("rest") >= F.col("bar") - SLACK)).select("query_id", "doc_id", "s"), "able")
    asked = able.join(weak.select("query_id", "term"), "query_id")
    near = parts.join(asked.select("doc_id").distinct(), "doc_id", "left_semi").join(weak.select("term").distinct(), "term", "left_semi")
    more = asked.join(near, ["doc_id", "term"]).groupBy("query_id", "doc_id").agg(F.sum("part").alias("more"))
    full = able.join(more, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.round(F.col("s") + F.coalesce("more", zero), 10).alias("score"))
    return top(full, k)


def bm25_once(docs: DataFrame, text: str, k: int = 10) -> DataFrame:
    """One query over texts without an index: postings are made for its terms only, in one pass with one small aggregation."""
    spark = docs.sparkSession
    wanted = [r.t for r in spark.range(1).select(F.explode(F.array_distinct(lexical_tokens(F.lit(text)))).alias("t")).collect()]
    t = docs.select("doc_id", F.explode(F.array(lexical_tokens(F.coalesce("text", F.lit(""))))).alias("t"))  # behind a generator, texts are tokenised once and not for each use
    counts = [F.size("t") - F.size(F.array_remove("t", w)) for w in wanted]
    rows = materialize(t.select("doc_id", F.size("t").alias("dl"), F.array(*counts).alias("tf")), "counts")
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.array(*[F.sum((F.col("tf")[i] > 0).cast("long")) for i in range(len(wanted))]).alias("df"))

    def part(i: int):
        n, df, tf = F.col("n"), F.col("df")[i], F.col("tf")[i]
        return inverse_frequency(n, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))

    total = sum((part(i) for i in range(1, len(wanted))), part(0))
    live = rows.where(F.exists("tf", lambda x: x > 0)).crossJoin(F.broadcast(stats))
    return live.select("doc_id", total.alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def scan(docs: DataFrame, query: str, regex: bool = False) -> DataFrame:
    """``(doc_id, line_no, line)`` of the lines that contain the text or match the expression; the document is tested first, so most are never split."""
    whole = docs.where(F.col("text").contains(query)) if not regex else docs
    each = whole.select("doc_id", F.posexplode(lines(F.col("text"))).alias("pos", "line"))
    test = F.col("line").rlike(query) if regex else F.col("line").contains(query)
    return each.where(test).select("doc_id", (F.col("pos") + 1).alias("line_no"), "line")
