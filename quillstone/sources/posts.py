"""A blog's REST dump: pages of posts as JSON, to one cleaned row for each post."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from quillstone.functions.text import strip_html

RAW = "array<struct<id:long,slug:string,title:struct<rendered:string>,link:string,date:string,content:struct<rendered:string>>>"


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def read_posts(spark: SparkSession, glob: str) -> DataFrame:
    """``(id, slug, title, link, date, text)`` ordered by slug; each file holds an array of posts."""
    raw = spark.read.text(glob, wholetext=True).select(F.explode(F.from_json("value", RAW)).alias("p"))
    return raw.select("p.id", "p.slug", _unescape("p.title.rendered").alias("title"), "p.link", "p.date", strip_html("p.content.rendered").alias("text")).orderBy("slug")


def write_posts(posts: DataFrame, path: str) -> None:
    """JSON lines with keys in alphabetical order, ordered by slug."""
    posts.select(*sorted(posts.columns)).orderBy("slug").write.json(path)
