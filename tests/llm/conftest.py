import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Make documents from (id, text) or (id, text, lang)."""

    def make(*rows, schema=DOC):
        return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows], schema)

    return make


@pytest.fixture(scope="session")
def clashing():
    """A table with columns more, named like operators' results and inner columns."""
    from pyspark.sql import functions as F

    def add(df):
        names = "id key rank a b x1 shard h c seg general removed n_entities n_terms doc_key accepted confidence kept cluster_id window_id slot piece bin salt len item_id start end license rule c0 c1 host page dim block v".split()
        return df.withColumns({n: F.lit(None).cast("string") if i % 2 else F.lit(i) for i, n in enumerate(names) if n not in df.columns})

    return add
