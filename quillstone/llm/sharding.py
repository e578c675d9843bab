"""Operator 4: sharding by weighted rendezvous hashing.

Every record scores every shard with ``-weight / ln(u)``, where ``u`` in (0, 1) comes from a digest of the record's key
and the shard's name; the best score wins. Adding a shard moves only the records it wins, removing one moves only its own.
The plan is one projection: no shuffle, no state, and a record's shard depends on nothing but its key.

Defined cases: a null key is hashed as the text ``\\N``, so such records share a shard; equal keys always share one (repeated
rows stay together); a tie in the score goes to the smaller shard name; shards of weight zero get nothing; an
empty table gives an empty table; other columns are neither read nor returned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

SHARDS = {f"shard-{i:03d}": (2.0 if i % 8 == 0 else 1.0) for i in range(48)}
DIGITS = 12


def _checked(shards: dict[str, float]) -> list[tuple[str, float]]:
    bad = [n for n, w in shards.items() if not (math.isfinite(w) and w >= 0) or "'" in n]
    live = [(n, w) for n, w in sorted(shards.items()) if w > 0]
    if bad or not live:
        raise ValueError(f"weights must be finite and not negative, one of them positive: {bad}")
    return live


def shard_of(key: Column, shards: dict[str, float]) -> Column:
    """The shard of ``key`` (any type that casts to string) among ``shards`` (name -> weight)."""
    k = F.coalesce(key.cast("string"), F.lit("\\N"))
    top = float(16**DIGITS)
    table = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(n).alias("n")) for n, w in _checked(shards)])

    def score(s: Column) -> Column:
        u = (F.conv(F.substring(F.md5(F.concat(k, F.lit("|"), s["n"])), 1, DIGITS), 16, 10).cast("double") + 0.5) / top
        return F.struct((s["w"] / F.log(u)).alias("s"), s["n"].alias("n"))

    return F.array_min(F.transform(table, score))["n"]  # the least w / ln(u) is the largest -w / ln(u)


def shard(docs: DataFrame, id_col: str = "doc_id", shards: dict[str, float] = SHARDS, after: dict[str, float] | None = None) -> DataFrame:
    """``(doc_id, shard, shard_after, moved)``: the shard now and after the change to ``after`` (default: one shard more)."""
    grown = after if after is not None else shards | {f"shard-{len(shards):03d}": 1.0}
    out = docs.select(F.col(id_col).alias("doc_id"), shard_of(F.col(id_col), shards).alias("shard"), shard_of(F.col(id_col), grown).alias("shard_after"))
    return out.withColumn("moved", F.col("shard") != F.col("shard_after"))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", shards: dict[str, float] = SHARDS, files_per_shard: int = 1) -> None:
    """Write ``docs`` under ``path``, a folder for each shard, by one shuffle on (shard, salt); raise the salt for large shards."""
    from quillstone.llm.common import fresh

    s, salt = fresh(docs, "shard"), fresh(docs, "shard_salt")
    out = docs.withColumn(s, shard_of(F.col(id_col), shards)).withColumn(salt, F.pmod(F.xxhash64(F.col(id_col)), F.lit(files_per_shard)))
    out.repartition(len(shards) * files_per_shard, s, salt).drop(salt).write.partitionBy(s).parquet(path)


def sql(shards: dict[str, float] = SHARDS) -> str:
    """The same for DuckDB over ``documents``."""
    grown = shards | {f"shard-{len(shards):03d}": 1.0}

    def pick(t: dict[str, float]) -> str:
        live = _checked(t)
        names = ", ".join(f"'{n}'" for n, _ in live)
        weights = ", ".join(f"CAST({w!r} AS DOUBLE)" for _, w in live)
        return (
            f"SELECT k, arg_min(n, w / ln((CAST(('0x' || substr(md5(k || '|' || n), 1, {DIGITS})) AS BIGINT) + 0.5::DOUBLE) / {float(16**DIGITS)!r}::DOUBLE)) AS shard "
            f"FROM keys, (SELECT unnest([{names}]) AS n, unnest([{weights}]) AS w) s GROUP BY k"
        )

    return (
        "WITH docs AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '\\N') AS k FROM documents), keys AS (SELECT DISTINCT k FROM docs), "
        f"a AS ({pick(shards)}), b AS ({pick(grown)}) "
        "SELECT doc_id, a.shard AS shard, b.shard AS shard_after, a.shard <> b.shard AS moved FROM docs JOIN a USING (k) JOIN b USING (k)"
    )
