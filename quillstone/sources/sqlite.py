"""A world in one SQLite file, for worlds that one machine holds: rows stream through the driver. Larger ones use ``World.write``."""

from __future__ import annotations

import sqlite3
from pathlib import Path

from pyspark.sql import SparkSession, functions as F

from quillstone.sources.schema import ENTITY, VERSION
from quillstone.sources.world import World, to_json_lines

_TABLES = {
    "meta": "schema_version INTEGER", "entity": "body TEXT", "record": "canonical_id TEXT PRIMARY KEY", "root": "child_id TEXT PRIMARY KEY, root_id TEXT",
    "exact": "surface TEXT, canonical_id TEXT", "norm": "norm TEXT, canonical_id TEXT",
}


def write(world: World, path: str) -> None:
    """Write a new file; name tables are indexed by name."""
    if Path(path).exists():
        raise ValueError(f"{path} exists")
    frames = {"entity": to_json_lines(world.entities), "record": world.records.select("canonical_id"), "root": world.roots.select("child_id", "root_id"), "exact": world.exact.select("surface", "canonical_id"), "norm": world.normalized.select("norm", "canonical_id")}
    with sqlite3.connect(path) as db:
        for name, columns in _TABLES.items():
            db.execute(f"CREATE TABLE {name} ({columns})")
        db.execute("INSERT INTO meta VALUES (?)", (VERSION,))
        for name, df in frames.items():
            marks = ", ".join("?" * len(df.columns))
            db.executemany(f"INSERT INTO {name} VALUES ({marks})", (tuple(r) for r in df.toLocalIterator()))
        for name, key in (("exact", "surface"), ("norm", "norm")):
            db.execute(f"CREATE INDEX by_{name} ON {name} ({key})")
    db.close()


def read(spark: SparkSession, path: str) -> World:
    """Open a file read-only; anything that is not a world of this version is a ValueError."""
    try:
        db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
        version = db.execute("SELECT schema_version FROM meta").fetchone()
        if version != (VERSION,):
            raise ValueError(f"{path} has version {version and version[0]}, not {VERSION}")
        held = {n: db.execute(f"SELECT * FROM {n}").fetchall() for n in _TABLES if n != "meta"}
    except sqlite3.Error as e:
        raise ValueError(f"{path} is not a world") from e
    db.close()
    bodies = spark.createDataFrame(held["entity"], "body string").select(F.from_json("body", ENTITY).alias("e")).select("e.*")
    w = World(bodies, spark.createDataFrame(held["record"], "canonical_id string"), spark.createDataFrame(held["root"], "child_id string, root_id string"))
    w.__dict__["exact"] = spark.createDataFrame(held["exact"], "surface string, canonical_id string")
    w.__dict__["normalized"] = spark.createDataFrame(held["norm"], "norm string, canonical_id string")
    return w
