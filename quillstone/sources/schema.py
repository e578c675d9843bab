"""Schemas of the entity world. Nested as one table, or exploded into entities, aliases, refs and edges."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D = T.StringType(), T.DoubleType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


TIMES = [("valid_from", _S), ("valid_until", _S), ("known_from", _S), ("known_until", _S)]
REF = _struct(("doc_id", _S), ("locator", _S))
RELATION = _struct(("predicate", _S), ("target_id", _S), *TIMES, ("weight", _D))
ENTITY = _struct(
    ("canonical_id", _S), ("label", _S), ("entity_type", _S), ("aliases", T.ArrayType(_S)), *TIMES, ("source", _S), ("description", _S),
    ("merged_from", T.ArrayType(_S)), ("refs", T.ArrayType(REF)), ("relations", T.ArrayType(RELATION)), ("metadata", _S),
)
MERGE = _struct(("seq", T.IntegerType()), ("source_id", _S), ("target_id", _S))
CANDIDATE = _struct(("ord", T.IntegerType()), ("surface", _S), ("entity_type", _S), ("source", _S), ("extractor", _S), ("status", _S))
EDGE_COLUMNS = ["src_id", *[f.name for f in RELATION.fields]]
VERSION = 1
