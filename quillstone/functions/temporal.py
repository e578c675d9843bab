"""Half-open validity intervals on two axes. A null bound is open, and a null instant switches its axis off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

Instant = str | None


def within(start: Column, end: Column, at: str | Column | None) -> Column | None:
    """``start <= at < end``; None if there is nothing to test."""
    if at is None:
        return None
    t = at if isinstance(at, Column) else F.lit(at)
    return (start.isNull() | (start <= t)) & (end.isNull() | (t < end))


def as_at(facts: DataFrame, valid_as_of: Instant = None, known_as_of: Instant = None) -> DataFrame:
    """The facts true at one instant as known at another; a filter, so it is pushed into the scan."""
    for axis, at in (("valid", valid_as_of), ("known", known_as_of)):
        test = within(F.col(f"{axis}_from"), F.col(f"{axis}_until"), at)
        if test is not None:
            facts = facts.where(test)
    return facts


def as_at_each(facts: DataFrame, instants: DataFrame, key: str) -> DataFrame:
    """The facts of each row of ``instants (key, valid_as_of, known_as_of)``: an equi-join on the key with interval tests."""
    f, i = facts.alias("f"), instants.alias("i")

    def test(axis: str) -> Column:
        t = F.col(f"i.{axis}_as_of")
        return t.isNull() | within(F.col(f"f.{axis}_from"), F.col(f"f.{axis}_until"), t)

    return f.join(i, (F.col(f"f.{key}") == F.col(f"i.{key}")) & test("valid") & test("known")).select("f.*", "i.valid_as_of", "i.known_as_of")


def supersede(history: DataFrame, new: DataFrame, at: str) -> DataFrame:
    """Append-only correction: open versions end at ``at``; the new facts are known from then, their own end untouched."""
    closed = history.withColumn("known_until", F.coalesce("known_until", F.lit(at)))
    return closed.unionByName(new.withColumn("known_from", F.lit(at)))


def close_chain(versions: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """A whole history at once: each version is known until the next of its key begins."""
    w = Window.partitionBy(*key).orderBy("known_from", *order)
    return versions.withColumn("known_until", F.lead("known_from").over(w))
