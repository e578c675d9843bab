"""Queries of the library on the driver's tables, with SQL where SQL can express them.

Convention for the entity world: ids are ``type::key``; regions, nations, customers, suppliers, parts and orders are nodes; a nation lies in its region, a customer in its
nation, an order is placed by its customer (valid from its date) and contains its parts (weight: quantity).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillstone.functions import temporal, text
from quillstone.operators import assemble, authoring, dense, evals, fusion, gate, graph, lexical, links, resolve, retrieve
from quillstone.plans.tables import materialize, shared_dir
from quillstone.sources import cross_system, world

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BUDGET = 8000  # tokens of a context
Frame = DataFrame


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> Frame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rows(spark: SparkSession, values: list[tuple], schema: str) -> Frame:
    return spark.createDataFrame(values, schema)


def joined(c: str):
    """Arrays as text, so that any engine compares them alike."""
    return F.array_join(c, ",").alias(c)


def big(c: str):
    return F.col(c).cast("long").alias(c)


# lexical

TERMS = "the of en"
_BM25 = """
postings AS (SELECT doc_id, unnest(t) AS term FROM toks), tf AS (SELECT term, doc_id, count(*) AS tf FROM postings GROUP BY ALL), stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), dl AS (SELECT doc_id, len(t) AS dl FROM toks),
scored AS (SELECT query_id, doc_id, round(sum(ln((n + 1) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 10) AS score FROM terms JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), stats GROUP BY 1, 2)"""
_TOKS = "toks AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM documents)"


@query(f"WITH {_TOKS}, terms AS (SELECT 0 AS query_id, unnest(['the', 'of', 'en']) AS term), {_BM25} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY score DESC, doc_id LIMIT 10")
def lexical_bm25_topk(spark: SparkSession, d: str) -> Frame:
    return lexical.bm25_once(table(spark, d, "documents"), TERMS, 10).withColumn("score", text.round6(F.col("score")))


@query(f"""WITH {_TOKS}, terms AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark), {_BM25}
SELECT query_id, doc_id, CAST(rank0 AS BIGINT) AS rank0, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank0 FROM scored) WHERE rank0 < 10""")
def lexical_bm25_batch(spark: SparkSession, d: str) -> Frame:
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    out = lexical.search(q, lexical.build(table(spark, d, "documents").select("doc_id", "text")), 10)
    return out.select("query_id", "doc_id", big("rank0"), text.round6(F.col("score")).alias("score"))


_LINES = r"""WITH l AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS p FROM documents),
e AS (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) AS line_no, len(p) AS n FROM l)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line FROM e WHERE NOT (line_no = n AND line = '') AND """


@query(_LINES + "contains(line, 'License')")
def lexical_scan_substring(spark: SparkSession, d: str) -> Frame:
    return lexical.scan(table(spark, d, "documents"), "License").select("doc_id", big("line_no"), "line")


@query(_LINES + r"regexp_matches(line, '\bversion [0-9]|CC BY')")
def lexical_scan_regex(spark: SparkSession, d: str) -> Frame:
    return lexical.scan(table(spark, d, "documents"), r"\bversion [0-9]|CC BY", regex=True).select("doc_id", big("line_no"), "line")


# dense

_COS = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT vec_id AS query_id, v AS qv FROM e WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id AS doc_id, round(list_dot_product(qv, v) / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(v, v))), 10) AS score FROM q, e)
"""


def _vectors(spark: SparkSession, d: str) -> Frame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


def _asked(spark: SparkSession, d: str) -> Frame:
    """Every twentieth vector, asked of all."""
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query(_COS + "SELECT query_id, doc_id, CAST(rank0 AS BIGINT) AS rank0, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank0 FROM s WHERE score >= 0) WHERE rank0 < 10")
def semantic_topk(spark: SparkSession, d: str) -> Frame:
    return dense.search(_asked(spark, d), _vectors(spark, d), 10).select("query_id", "doc_id", big("rank0"), F.round("score", 4).alias("score"))


@query(_COS + "SELECT query_id, CAST(count(*) AS BIGINT) AS n, round(min(score), 4) AS least FROM s WHERE score >= 0.2 GROUP BY 1")
def semantic_floor(spark: SparkSession, d: str) -> Frame:
    return dense.scored(_asked(spark, d), _vectors(spark, d), 0.2).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.min("score"), 4).alias("least"))


# fusion


def _signals(spark: SparkSession, d: str) -> Frame:
    docs = table(spark, d, "documents").select(F.col("lang").alias("query_id"), "doc_id", "n_chars")
    out = None
    for signal, order in (("long", [F.desc("n_chars"), "doc_id"]), ("recent", [F.desc("doc_id")])):
        s = docs.withColumn("rank0", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)) - 1).withColumn("signal", F.lit(signal))
        out = s if out is None else out.unionByName(s)
    return out.select("query_id", "signal", "rank0", "doc_id")


def _fused(f: Frame) -> Frame:
    each = F.transform("contributions", lambda c: F.concat_ws(":", c["signal"], c["rank"].cast("string")))
    return f.select("query_id", "doc_id", text.round6(F.col("score")).alias("score"), F.array_join(each, ",").alias("contributions"))


def _rrf(w: str) -> str:
    return f"""WITH s AS (SELECT lang, doc_id, 'long' AS signal, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) - 1 AS r FROM documents
UNION ALL SELECT lang, doc_id, 'recent', row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) - 1 FROM documents),
f AS (SELECT lang AS query_id, doc_id, sum({w} / (1.0 + r)) AS score, string_agg(signal || ':' || r, ',' ORDER BY signal) AS contributions FROM s GROUP BY 1, 2)
SELECT query_id, doc_id, round(score, 6) AS score, contributions FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS k FROM f) WHERE k <= 20"""


@query(_rrf("1.0::DOUBLE"))
def rrf_fuse(spark: SparkSession, d: str) -> Frame:
    return _fused(fusion.fuse(_signals(spark, d), top_k=20))


@query(_rrf("(CASE signal WHEN 'long' THEN 0.25::DOUBLE ELSE 2.0::DOUBLE END)"))
def rrf_weighted(spark: SparkSession, d: str) -> Frame:
    w = rows(spark, [("long", 0.25), ("recent", 2.0)], "signal string, w double")
    return _fused(fusion.fuse(_signals(spark, d), top_k=20, weights=w))


# gate

_ASKED = [
    ("capital of France", []), ("compare why these connect", ["e::a"]), ("compare why these connect", []), ("what is the latest plan", []), ("what is known", ["e::a"]), ("plan of v1.2", ["e::a"]),
    ("tell me about it", ["e::b", "e::a"]), ("tell me about it", ["e::private"]), ("tell me about it", ["e::tail"]), ("history of everything, and why?", ["e::tail"]), ("release notes; now", []),
    ("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen", []), ("", []),
]
_VALUES = ", ".join(f"('{q}', [{', '.join(repr(x) for x in e)}]::VARCHAR[])" for q, e in _ASKED)
_GATE = rf"""WITH q AS (SELECT text, entities FROM (VALUES {_VALUES}) v(text, entities) UNION ALL SELECT text, []::VARCHAR[] FROM conversations WHERE role = 'user'),
w AS (SELECT *, lower(text) AS l, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM q),
c AS (SELECT *, list_transform(ws, lambda x: lower(regexp_replace(regexp_replace(x, '^[.,;:!?]+', ''), '[.,;:!?]+$', ''))) AS cw FROM w),
k AS (SELECT *, len(list_filter(cw, lambda x: x IN ({', '.join(map(repr, gate.CUE_WORDS))}))) AS n_cue,
 CAST(contains(l, 'history of') AS INT) + CAST(contains(l, 'what changed') AS INT) + CAST(contains(l, 'compared to') AS INT) AS n_phrase,
 regexp_matches(l, '{'|'.join(gate.FRESH)}') OR regexp_matches(l, '\bv?[0-9]+\.[0-9]+') OR len(list_filter(cw, lambda x: x IN ('version', 'release', 'changelog'))) > 0 AS fresh FROM c),
g AS (SELECT *, least(1.0::DOUBLE, 0.6::DOUBLE * len(ws) / 20 + 0.4::DOUBLE * (n_cue + n_phrase) / 3) AS x FROM k)
"""


def _gated(spark: SparkSession, d: str) -> Frame:
    talk = table(spark, d, "conversations").where("role = 'user'").select("text", F.array().cast("array<string>").alias("entities"))
    q = rows(spark, _ASKED, "text string, entities array<string>").unionByName(talk)
    return gate.decide(q.withColumn("private_ids", F.array(F.lit("e::private"))).withColumn("tail_ids", F.array(F.lit("e::tail"))))


@query(_GATE + "SELECT text, array_to_string(entities, ',') AS entities, round(x, 6) AS complexity FROM g")
def gate_complexity(spark: SparkSession, d: str) -> Frame:
    return _gated(spark, d).select("text", joined("entities"), text.round6(F.col("complexity")).alias("complexity"))


@query(_GATE + """, u AS (SELECT *, len(entities) AS n_e, (n_cue + n_phrase) > 0 AS rel, CASE WHEN list_contains(entities, 'e::tail') THEN 0.09::DOUBLE ELSE 0::DOUBLE END AS b FROM g),
s AS (SELECT *, [0.312::DOUBLE, 0.304 + 0.03 * x + b, 0.278 + 0.12 * x + b, 0.272 + 0.18 * x + b, 0.206 + 0.24 * x + b] AS us FROM u)
SELECT text, array_to_string(entities, ',') AS entities, CAST(CASE WHEN n_e >= 2 OR (rel AND n_e > 0) OR fresh OR list_contains(entities, 'e::private') THEN 1 ELSE 2 END AS BIGINT) AS stage,
CASE WHEN n_e >= 2 OR (rel AND n_e > 0) THEN 'composite' WHEN fresh THEN CASE WHEN n_e > 0 THEN 'graph' ELSE 'semantic' END WHEN list_contains(entities, 'e::private') THEN 'graph'
 ELSE ['none', 'grep', 'semantic', 'graph', 'composite'][list_position(us, list_max(us))] END AS strategy FROM s""")
def gate_decision(spark: SparkSession, d: str) -> Frame:
    return _gated(spark, d).select("text", joined("entities"), big("stage"), "strategy")


# text

_NORM = r"trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


@query(f"SELECT p_partkey, n AS norm, CAST(len(string_split(n, ' ')) AS BIGINT) AS n_tokens FROM (SELECT p_partkey, {_NORM.format('p_name')} AS n FROM part)")
def normalize_tokens(spark: SparkSession, d: str) -> Frame:
    return table(spark, d, "part").select("p_partkey", text.norm(F.col("p_name")).alias("norm")).withColumn("n_tokens", F.size(text.tokens(F.col("norm"))).cast("long"))


@query(f"SELECT doc_id, md5({_NORM.format('text')}) AS norm_md5 FROM documents")
def normalize_documents(spark: SparkSession, d: str) -> Frame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.norm_latin(F.col("text"))).alias("norm_md5"))


@query("""WITH c AS (SELECT p_partkey, p_name, unnest(string_split(p_name, '')) AS ch FROM part), n AS (SELECT p_partkey, p_name, ch, count(*) AS k FROM c GROUP BY ALL)
SELECT p_partkey, round(-sum(k / length(p_name) * log2(k / length(p_name))), 6) AS bits FROM n GROUP BY p_partkey""")
def entropy_bits(spark: SparkSession, d: str) -> Frame:
    return table(spark, d, "part").select("p_partkey", text.round6(text.entropy(F.col("p_name"))).alias("bits"))


@query(r"SELECT c_custkey, trim(regexp_replace(lower(c_name || ' / ' || c_mktsegment), '[^\p{L}\p{N}]+', '-', 'g'), '-') AS slug FROM customer")
def slugify(spark: SparkSession, d: str) -> Frame:
    return table(spark, d, "customer").select("c_custkey", text.slug(F.concat("c_name", F.lit(" / "), "c_mktsegment")).alias("slug"))


@query(rf"SELECT p_partkey, 'part::' || replace({_NORM.format('p_name')}, ' ', '_') AS suggested FROM part")
def suggest_canonical_id(spark: SparkSession, d: str) -> Frame:
    return table(spark, d, "part").select("p_partkey", text.suggest_id(text.norm(F.col("p_name")), F.lit("part")).alias("suggested"))


@query()
def html_strip(spark: SparkSession, d: str) -> Frame:
    return table(spark, d, "pages").select("page_id", text.strip_html("html").alias("text"))


# aliases


def _part_names(spark: SparkSession, d: str) -> Frame:
    return table(spark, d, "part").select(F.col("p_name").alias("surface"), F.concat(F.lit("part::"), F.col("p_partkey").cast("string")).alias("canonical_id"))


@query(f"SELECT {_NORM.format('p_name')} AS norm, string_agg(DISTINCT 'part::' || p_partkey, ',' ORDER BY 'part::' || p_partkey) AS ids FROM part GROUP BY 1")
def alias_index(spark: SparkSession, d: str) -> Frame:
    return world.index(_part_names(spark, d).withColumn("norm", text.norm(F.col("surface"))), "norm").select("norm", joined("ids"))


@query(f"SELECT {_NORM.format('p_name')} AS norm, CAST(count(DISTINCT p_partkey) AS BIGINT) AS n FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) >= 2")
def alias_conflicts(spark: SparkSession, d: str) -> Frame:
    return world.alias_conflicts(_part_names(spark, d).withColumn("norm", text.norm(F.col("surface")))).select("norm", F.size("ids").cast("long").alias("n"))


def _geo_rows(spark: SparkSession, d: str) -> Frame:
    """Regions, nations, customers and suppliers as entities; nations have an alias of another form."""
    none = F.array().cast("array<string>")
    rel = "array<struct<predicate:string,target_id:string,valid_from:string,valid_until:string,known_from:string,known_until:string,weight:double>>"

    def ent(df: Frame, kind: str, key: str, label: str, aliases, target=None, predicate: str = "") -> Frame:
        null = F.lit(None).cast("string")
        edges = F.array(F.struct(F.lit(predicate).alias("predicate"), target.alias("target_id"), null.alias("valid_from"), null.alias("valid_until"), null.alias("known_from"), null.alias("known_until"), F.lit(1.0).alias("weight"))) if target is not None else F.array()
        cid = F.concat(F.lit(f"{kind}::"), F.col(key).cast("string"))
        return df.select(
            cid.alias("canonical_id"), F.col(label).alias("label"), F.lit(kind).alias("entity_type"), aliases.alias("aliases"), *[null.alias(c) for c in ("valid_from", "valid_until", "known_from", "known_until", "source", "description")],
            none.alias("merged_from"), F.array(F.struct(cid.alias("doc_id"), null.alias("locator"))).alias("refs"), edges.cast(rel).alias("relations"), F.to_json(F.struct(F.struct(F.col(label).alias("crm"), F.array(F.col(key).cast("string"), F.concat(F.lit("x"), F.col(key).cast("string"))).alias("erp")).alias("system_ids"))).alias("metadata"),
        )

    def to(kind: str, key: str):
        return F.concat(F.lit(f"{kind}::"), F.col(key).cast("string"))

    r, n, c, s = (table(spark, d, t) for t in ("region", "nation", "customer", "supplier"))
    return (
        ent(r, "region", "r_regionkey", "r_name", none)
        .unionByName(ent(n, "nation", "n_nationkey", "n_name", F.array(F.lower(F.replace("n_name", F.lit("_"), F.lit(" ")))), to("region", "n_regionkey"), "in_region"))
        .unionByName(ent(c, "customer", "c_custkey", "c_name", none, to("nation", "c_nationkey"), "in_nation"))
        .unionByName(ent(s, "supplier", "s_suppkey", "s_name", none, to("nation", "s_nationkey"), "in_nation"))
    )


def _geo(spark: SparkSession, d: str) -> world.World:
    return world.WorldBuilder(spark).add(_geo_rows(spark, d)).freeze()


_SURF = """surf AS (SELECT n_name AS s, 'nation::' || n_nationkey AS id FROM nation UNION SELECT lower(replace(n_name, '_', ' ')), 'nation::' || n_nationkey FROM nation UNION SELECT r_name, 'region::' || r_regionkey FROM region
UNION SELECT c_name, 'customer::' || c_custkey FROM customer UNION SELECT s_name, 'supplier::' || s_suppkey FROM supplier)"""
_FORMS = """(SELECT c_custkey AS k, c_name AS f FROM customer UNION ALL SELECT c_custkey + 100000000, lower(replace(c_name, '#', ' ')) FROM customer UNION ALL SELECT s_suppkey + 200000000, s_name || '!' FROM supplier
UNION ALL SELECT n_nationkey + 300000000, n_name FROM nation UNION ALL SELECT n_nationkey + 400000000, replace(n_name, '_', '--') FROM nation UNION ALL SELECT o_orderkey + 500000000, 'order ' || o_orderkey FROM orders)"""


def _mentions(spark: SparkSession, d: str) -> Frame:
    """Names of customers, suppliers and nations in several forms, and as many that nothing is called."""
    c, s, n, o = (table(spark, d, t) for t in ("customer", "supplier", "nation", "orders"))
    forms = [
        c.select("c_custkey", "c_name"), c.select(F.col("c_custkey") + 100000000, F.lower(F.replace("c_name", F.lit("#"), F.lit(" ")))), s.select(F.col("s_suppkey") + 200000000, F.concat("s_name", F.lit("!"))),
        n.select(F.col("n_nationkey") + 300000000, "n_name"), n.select(F.col("n_nationkey") + 400000000, F.replace("n_name", F.lit("_"), F.lit("--"))), o.select(F.col("o_orderkey") + 500000000, F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))),
    ]
    out = None
    for f in forms:
        f = f.toDF("mention_ord", "surface").withColumn("mention_ord", F.col("mention_ord").cast("long"))
        out = f if out is None else out.unionByName(f)
    return out


_LOOKED_UP = f"""WITH m AS (SELECT k AS mention_ord, f AS surface FROM {_FORMS}), {_SURF},
ex AS (SELECT mention_ord, surface, id, 'exact' AS tier FROM m JOIN surf ON surface = s), miss AS (SELECT * FROM m WHERE mention_ord NOT IN (SELECT mention_ord FROM ex)),
mn AS (SELECT *, {_NORM.format('surface')} AS n FROM miss), sn AS (SELECT *, {_NORM.format('s')} AS n FROM surf), nm AS (SELECT DISTINCT mention_ord, surface, id, 'normalized' AS tier FROM mn JOIN sn USING (n) WHERE n <> ''), hit AS (SELECT * FROM ex UNION ALL SELECT * FROM nm)"""


@query(_LOOKED_UP + " SELECT CAST(mention_ord AS BIGINT) AS mention_ord, surface, id AS canonical_id, tier FROM hit")
def lookup_exact_then_norm(spark: SparkSession, d: str) -> Frame:
    return resolve.lookup(_mentions(spark, d), _geo(spark, d)).select("mention_ord", "surface", "canonical_id", "tier")


@query(_LOOKED_UP + " SELECT CAST(mention_ord AS BIGINT) AS mention_ord, surface, id AS canonical_id, 1.0::DOUBLE AS confidence, tier FROM hit UNION ALL SELECT CAST(mention_ord AS BIGINT), surface, NULL, NULL, 'unresolved' FROM m WHERE mention_ord NOT IN (SELECT mention_ord FROM hit)")
def resolve_cascade(spark: SparkSession, d: str) -> Frame:
    """All tiers that need no model but the fuzzy one (its scores are beyond SQL), and what none resolves."""
    found, missed = resolve.resolve_mentions(_mentions(spark, d), _geo(spark, d), resolve.Settings(fuzzy=False))
    return found.select("mention_ord", "surface", "canonical_id", "confidence", "tier").unionByName(missed.select("mention_ord", "surface", F.lit(None).cast("string").alias("canonical_id"), F.lit(None).cast("double").alias("confidence"), F.lit("unresolved").alias("tier")))


def _misspelt(spark: SparkSession, d: str) -> Frame:
    """Every part's name without its third letter, and with its words swapped and the last letter doubled."""
    p = table(spark, d, "part")
    name, words = F.col("p_name"), F.split("p_name", " ")
    one = p.select((F.col("p_partkey") * 2).cast("long").alias("mention_ord"), F.concat(F.substring(name, 1, 2), name.substr(F.lit(4), F.length(name))).alias("surface"))
    return one.unionByName(p.select((F.col("p_partkey") * 2 + 1).cast("long"), F.concat(words[1], F.substring(words[1], -1, 1), F.lit(" "), words[0])).toDF("mention_ord", "surface"))


@query()
def resolve_fuzzy(spark: SparkSession, d: str) -> Frame:
    parts = _part_names(spark, d).groupBy("surface").agg(F.min("canonical_id").alias("canonical_id"))
    w = world.World(None, None, None)
    w.__dict__["exact"] = parts
    w.__dict__["normalized"] = parts.select(text.norm(F.col("surface")).alias("norm"), "canonical_id").distinct()
    return resolve.resolve_mentions(_misspelt(spark, d), w)[0]


_ALIASES = f"""names AS (SELECT {_NORM.format('p_name')} AS norm, min(p_partkey) AS id FROM part GROUP BY 1), single AS (SELECT unnest(string_split(norm, ' ')) AS norm, min(id) AS id FROM names GROUP BY 1),
brands AS (SELECT 'brand ' || substr(p_brand, 7) AS norm, min(p_partkey) AS id FROM part GROUP BY 1)"""


@query(f"""WITH {_ALIASES}, q AS (SELECT p_partkey AS query_id, p_name, p_brand FROM part)
SELECT query_id, norm AS surface, 'part::' || id AS canonical_id FROM q JOIN names ON norm = {_NORM.format('p_name')} UNION ALL SELECT query_id, norm, 'part::' || id FROM q JOIN brands ON norm = {_NORM.format('p_brand')}
UNION ALL SELECT query_id, norm, 'part::' || id FROM q JOIN single ON norm = split_part({_NORM.format('p_name')}, ' ', 2) AND norm <> split_part({_NORM.format('p_name')}, ' ', 1)""")
def gazetteer_scan(spark: SparkSession, d: str) -> Frame:
    """Aliases nest and overlap: a part's name holds two shorter ones, which are suppressed there and found where the second word stands alone."""
    part = table(spark, d, "part")
    name = text.norm(F.col("p_name"))
    q = part.select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("we need "), "p_name", F.lit(", "), "p_brand", F.lit(" or some "), F.split(name, " ")[1], F.lit(", no other")).alias("text"))
    names = part.groupBy(name.alias("norm")).agg(F.min("p_partkey").alias("id"))
    single = names.select(F.explode(F.split("norm", " ")).alias("norm"), "id").groupBy("norm").agg(F.min("id").alias("id"))
    brands = part.groupBy(text.norm(F.col("p_brand")).alias("norm")).agg(F.min("p_partkey").alias("id"))
    g = names.unionByName(single).unionByName(brands).select("norm", F.array(F.concat(F.lit("part::"), F.col("id").cast("string"))).alias("ids"))
    return resolve.scan(q, g).select("query_id", "surface", "canonical_id")


# graph


def _nodes_edges(spark: SparkSession, d: str) -> tuple[Frame, Frame, Frame]:
    null = F.lit(None).cast("string")

    def key(kind: str, c: str):
        return F.concat(F.lit(f"{kind}::"), F.col(c).cast("string"))

    r, n, c, o = (table(spark, d, t) for t in ("region", "nation", "customer", "orders"))
    nodes = r.select(key("region", "r_regionkey").alias("id"))
    edges = None
    for df, kind, k, to, tk, since in ((n, "nation", "n_nationkey", "region", "n_regionkey", None), (c, "customer", "c_custkey", "nation", "c_nationkey", None), (o, "order", "o_orderkey", "customer", "o_custkey", "o_orderdate")):
        nodes = nodes.unionByName(df.select(key(kind, k).alias("id")))
        vf = F.date_format(since, "yyyy-MM-dd") if since else null
        e = df.select(key(kind, k).alias("src_id"), key(to, tk).alias("target_id"), vf.alias("valid_from"), null.alias("valid_until"), vf.alias("known_from"), null.alias("known_until"))
        edges = e if edges is None else edges.unionByName(e)
    return nodes, edges, nodes.select(F.col("id").alias("entity_id"), F.col("id").alias("doc_id"), null.alias("locator"))


def _walk(depth: int, test: str = "") -> str:
    return f"""WITH RECURSIVE n AS (SELECT 'region::' || r_regionkey AS id FROM region UNION ALL SELECT 'nation::' || n_nationkey FROM nation UNION ALL SELECT 'customer::' || c_custkey FROM customer UNION ALL SELECT 'order::' || o_orderkey FROM orders),
e AS (SELECT 'nation::' || n_nationkey AS s, 'region::' || n_regionkey AS t, CAST(NULL AS VARCHAR) AS vf FROM nation UNION ALL SELECT 'customer::' || c_custkey, 'nation::' || c_nationkey, NULL FROM customer
UNION ALL SELECT 'order::' || o_orderkey, 'customer::' || o_custkey, strftime(o_orderdate, '%Y-%m-%d') FROM orders),
w(seed, node, hop) AS (SELECT 'order::' || o_orderkey, 'order::' || o_orderkey, 0 FROM orders UNION ALL SELECT w.seed, e.t, w.hop + 1 FROM w JOIN e ON e.s = w.node JOIN n ON n.id = e.t WHERE w.hop < {depth} {test})
SELECT seed, node AS entity_id, CAST(min(hop) AS BIGINT) AS hop, round(1.0 / (1 + min(hop)), 6)::DOUBLE AS score FROM w GROUP BY seed, node"""


def _traversed(spark: SparkSession, d: str, depth: int, **at) -> Frame:
    nodes, edges, refs = _nodes_edges(spark, d)
    seeds = table(spark, d, "orders").select(F.concat(F.lit("order::"), F.col("o_orderkey").cast("string")).alias("seed"))
    return graph.traverse(seeds, nodes, edges, refs, depth, **at).select("seed", "entity_id", big("hop"), text.round6(F.col("score")).alias("score"))


for _d in range(4):
    query(_walk(_d), f"traverse_depth{_d}")(lambda s, d, k=_d: _traversed(s, d, k))
query(_walk(2, "AND (e.vf IS NULL OR e.vf <= '1997-06-01')"), "traverse_as_of")(lambda s, d: _traversed(s, d, 2, as_of="1997-06-01"))
query(_walk(3, "AND (e.vf IS NULL OR e.vf <= '1996-01-15')"), "traverse_known_as_of")(lambda s, d: _traversed(s, d, 3, known_as_of="1996-01-15"))


@query(_walk(3, "AND (e.vf IS NULL OR e.vf <= '1999-06-01')").replace("'order::' || o_orderkey, 'order::' || o_orderkey, 0 FROM orders", "'order::6', 'order::6', 0").replace("SELECT seed, node AS entity_id", "SELECT node AS entity_id"))
def traverse_compiled_sql(spark: SparkSession, d: str) -> Frame:
    """One seed through the compiled recursive query."""
    for name, df in zip(("nodes", "edges", "refs"), _nodes_edges(spark, d)):
        df.createOrReplaceTempView(name)
    out = graph.traverse_with("order::6", lambda q, a: spark.sql(q, a), 3, as_of="1999-06-01")
    return out.select("entity_id", big("hop"), text.round6(F.col("score")).alias("score"))


_ADJ = """WITH e AS (SELECT DISTINCT 'nation::' || c_nationkey AS a, 'seg::' || c_mktsegment AS b FROM customer UNION SELECT 'nation::' || n_nationkey, 'region::' || n_regionkey FROM nation), adj AS (SELECT a AS node, b AS nbr FROM e UNION SELECT b, a FROM e),
deg AS (SELECT node, count(*) AS degree FROM adj GROUP BY 1) """


def _adj(spark: SparkSession, d: str) -> Frame:
    c = table(spark, d, "customer").select(F.concat(F.lit("nation::"), F.col("c_nationkey").cast("string")).alias("src_id"), F.concat(F.lit("seg::"), "c_mktsegment").alias("target_id"))
    n = table(spark, d, "nation").select(F.concat(F.lit("nation::"), F.col("n_nationkey").cast("string")), F.concat(F.lit("region::"), F.col("n_regionkey").cast("string")))
    return graph.adjacency(c.union(n))


@query(_ADJ + "SELECT node, degree FROM deg")
def degree(spark: SparkSession, d: str) -> Frame:
    return graph.degrees(_adj(spark, d))


@query(_ADJ + "SELECT adj.node AS target_id, round(sum(1.0::DOUBLE / degree) / 3, 6) AS structural, string_agg(nbr, ',' ORDER BY nbr) AS via FROM adj JOIN deg ON deg.node = nbr WHERE nbr IN ('nation::0', 'nation::1', 'seg::MACHINERY') GROUP BY 1")
def resource_allocation(spark: SparkSession, d: str) -> Frame:
    seeds = rows(spark, [("nation::0",), ("nation::1",), ("seg::MACHINERY",)], "seed string")
    return links.resource_allocation(_adj(spark, d), seeds).select("target_id", text.round6(F.col("structural")).alias("structural"), joined("via"))


# time

_CHAIN = "WITH v AS (SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS valid_from, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS known_from FROM events), c AS (SELECT *, lead(known_from) OVER (PARTITION BY user_id, event_type ORDER BY known_from, event_id) AS known_until FROM v) "


def _versions(spark: SparkSession, d: str) -> Frame:
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, d, "events").select("event_id", "user_id", "event_type", at.alias("valid_from"), F.lit(None).cast("string").alias("valid_until"), at.alias("known_from"))


def _chain(spark: SparkSession, d: str) -> Frame:
    return temporal.close_chain(_versions(spark, d), ["user_id", "event_type"], ["event_id"])


@query(_CHAIN + "SELECT event_id, known_from, known_until FROM c")
def version_chain(spark: SparkSession, d: str) -> Frame:
    return _chain(spark, d).select("event_id", "known_from", "known_until")


@query(_CHAIN + "SELECT event_id FROM c WHERE valid_from <= '2024-01-08T00:00:00'")
def as_at_valid(spark: SparkSession, d: str) -> Frame:
    return temporal.as_at(_chain(spark, d), valid_as_of="2024-01-08T00:00:00").select("event_id")


@query(_CHAIN + "SELECT event_id, user_id, event_type FROM c WHERE valid_from <= '2024-01-20T00:00:00' AND known_from <= '2024-01-10T12:00:00' AND (known_until IS NULL OR '2024-01-10T12:00:00' < known_until)")
def as_at_both(spark: SparkSession, d: str) -> Frame:
    return temporal.as_at(_chain(spark, d), "2024-01-20T00:00:00", "2024-01-10T12:00:00").select("event_id", "user_id", "event_type")


@query(_CHAIN + "SELECT event_id, known_from, coalesce(known_until, '2030-01-01') AS known_until FROM c UNION ALL SELECT -1, '2030-01-01', NULL")
def supersede_append(spark: SparkSession, d: str) -> Frame:
    new = rows(spark, [(-1, 0, "view", "2030-01-01", None, None, None)], "event_id long, user_id long, event_type string, valid_from string, valid_until string, known_from string, known_until string")
    return temporal.supersede(_chain(spark, d), new, "2030-01-01").select("event_id", "known_from", "known_until")


# worlds

_RELS = "r AS (SELECT 'nation::' || n_nationkey AS s, 'in_region' AS p, 'region::' || n_regionkey AS t FROM nation UNION ALL SELECT 'customer::' || c_custkey, 'in_nation', 'nation::' || c_nationkey FROM customer UNION ALL SELECT 'supplier::' || s_suppkey, 'in_nation', 'nation::' || s_nationkey FROM supplier)"


@query(f"WITH {_RELS} SELECT s AS src_id, p AS predicate, t AS target_id FROM r UNION ALL SELECT t, 'has_nation', s FROM r WHERE p = 'in_region' UNION ALL SELECT t, 'home_of', s FROM r WHERE p = 'in_nation'")
def mirror_edges(spark: SparkSession, d: str) -> Frame:
    out = world.with_mirrors(_geo_rows(spark, d), {"in_region": "has_nation", "in_nation": "home_of"})
    return out.select(F.col("canonical_id").alias("src_id"), F.explode("relations").alias("r")).select("src_id", "r.predicate", "r.target_id")


@query("""WITH g AS (SELECT s_suppkey, s_nationkey, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS root, s_name FROM supplier)
SELECT 'supplier::' || root AS canonical_id, CAST(count(*) FILTER (WHERE s_suppkey <> root) AS BIGINT) AS n_merged, coalesce(string_agg('supplier::' || s_suppkey, ',' ORDER BY 'supplier::' || s_suppkey) FILTER (WHERE s_suppkey <> root), '') AS merged_from,
coalesce(string_agg(s_name, ',' ORDER BY 'supplier::' || s_suppkey) FILTER (WHERE s_suppkey <> root), '') AS aliases, 'nation::' || s_nationkey AS target FROM g GROUP BY root, s_nationkey""")
def fold_merge(spark: SparkSession, d: str) -> Frame:
    w = _merged(spark, d)
    return w.entities.where("entity_type = 'supplier'").select("canonical_id", F.size("merged_from").cast("long").alias("n_merged"), joined("merged_from"), joined("aliases"), F.col("relations")[0]["target_id"].alias("target"))


def _merged(spark: SparkSession, d: str) -> world.World:
    """Suppliers of a nation merged into the first of them."""
    e = _geo_rows(spark, d)
    s = table(spark, d, "supplier").withColumn("root", F.min("s_suppkey").over(Window.partitionBy("s_nationkey"))).where("s_suppkey <> root")
    log = s.select(F.col("s_suppkey").cast("int").alias("seq"), F.concat(F.lit("supplier::"), F.col("s_suppkey").cast("string")).alias("source_id"), F.concat(F.lit("supplier::"), F.col("root").cast("string")).alias("target_id"))
    return world.WorldBuilder(spark).add(e).freeze(log)


_XS = "x AS (SELECT 'customer::' || c_custkey AS canonical_id, 'crm' AS system, c_name AS e FROM customer UNION ALL SELECT 'customer::' || c_custkey, 'erp', CAST(c_custkey AS VARCHAR) FROM customer UNION ALL SELECT 'customer::' || c_custkey, 'erp', 'x' || c_custkey FROM customer)"


def _xs(spark: SparkSession, d: str) -> Frame:
    return cross_system.from_entities(_geo_rows(spark, d).where("entity_type = 'customer'"))


@query(f"WITH {_XS}, w AS (SELECT DISTINCT canonical_id, s AS system FROM x, (VALUES ('crm'), ('erp'), ('none')) v(s)) SELECT canonical_id, system, CASE WHEN count(e) = 1 THEN min(e) END AS external_id, CASE count(e) WHEN 0 THEN 'missing' WHEN 1 THEN 'bound' ELSE 'ambiguous' END AS status FROM w LEFT JOIN x USING (canonical_id, system) GROUP BY ALL")
def cross_system_bind(spark: SparkSession, d: str) -> Frame:
    x = _xs(spark, d)
    wanted = x.select("canonical_id").distinct().crossJoin(rows(spark, [("crm",), ("erp",), ("none",)], "system string"))
    return cross_system.bind(x, wanted)


@query(f"WITH {_XS} SELECT 'erp' AS system, 'x' || o_custkey AS external_id, canonical_id, CAST(count(*) AS BIGINT) AS n FROM orders LEFT JOIN x ON system = 'erp' AND e = 'x' || o_custkey GROUP BY ALL")
def cross_system_reverse(spark: SparkSession, d: str) -> Frame:
    wanted = table(spark, d, "orders").select(F.lit("erp").alias("system"), F.concat(F.lit("x"), F.col("o_custkey").cast("string")).alias("external_id"))
    return cross_system.owners(_xs(spark, d), wanted).groupBy("system", "external_id", "canonical_id").agg(F.count("*").alias("n"))


@query("SELECT 'customer::' || c_custkey AS canonical_id, 'crm,erp' AS systems FROM customer")
def cross_system_systems(spark: SparkSession, d: str) -> Frame:
    return cross_system.systems(_xs(spark, d)).select("canonical_id", joined("systems"))


@query(f"WITH {_RELS}, k AS (SELECT s, count(*) AS n FROM r GROUP BY 1) SELECT id AS canonical_id, label, CAST(coalesce(n, 0) AS BIGINT) AS n_relations FROM (SELECT 'region::' || r_regionkey AS id, r_name AS label FROM region UNION ALL SELECT 'nation::' || n_nationkey, n_name FROM nation UNION ALL SELECT 'customer::' || c_custkey, c_name FROM customer UNION ALL SELECT 'supplier::' || s_suppkey, s_name FROM supplier) LEFT JOIN k ON s = id")
def json_roundtrip(spark: SparkSession, d: str) -> Frame:
    """Entities to JSON text and back."""
    from quillstone.sources.schema import ENTITY

    text_rows = world.to_json_lines(_geo_rows(spark, d))
    back = text_rows.select(F.from_json("value", ENTITY).alias("e")).select("e.*")
    return back.select("canonical_id", "label", F.size("relations").cast("long").alias("n_relations"))


# links

_TF = "tf AS (SELECT l_orderkey AS doc, l_partkey AS concept, sum(l_quantity) AS tf FROM lineitem GROUP BY ALL), n AS (SELECT count(DISTINCT doc) AS n FROM tf), idf AS (SELECT concept, count(*) AS df, ln(any_value(n) / count(*)) AS idf FROM tf, n GROUP BY concept), v AS (SELECT doc, concept, tf * idf AS w FROM tf JOIN idf USING (concept) WHERE idf > 0), nm AS (SELECT doc, sqrt(sum(w * w)) AS norm FROM v GROUP BY doc)"


def _tf(spark: SparkSession, d: str) -> Frame:
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("concept")).agg(F.sum("l_quantity").alias("tf"))


def _idf(tf: Frame) -> Frame:
    return links.concept_idf(tf, tf.agg(F.count_distinct("doc").alias("n")))


@query(f"WITH {_TF} SELECT concept, df, round(idf, 6) AS idf FROM idf")
def concept_idf(spark: SparkSession, d: str) -> Frame:
    return _idf(_tf(spark, d)).select("concept", "df", text.round6(F.col("idf")).alias("idf"))


@query(f"WITH {_TF} SELECT doc, concept, round(w, 6) AS w FROM v")
def tfidf_vectors(spark: SparkSession, d: str) -> Frame:
    tf = _tf(spark, d)
    return links.tfidf(tf, _idf(tf)).withColumn("w", text.round6(F.col("w")))


@query(f"""WITH {_TF}, u AS (SELECT doc, concept, w / norm AS w FROM v JOIN nm USING (doc)), p AS (SELECT a.doc AS source_id, b.doc AS target_id, round(sum(a.w * b.w), 6) AS score, string_agg(CAST(a.concept AS VARCHAR), ',' ORDER BY a.concept) AS shared FROM u a JOIN u b ON a.concept = b.concept AND a.doc <> b.doc GROUP BY ALL HAVING sum(a.w * b.w) > 0)
SELECT source_id, target_id, CAST(rank AS BIGINT) AS rank, score, shared FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, target_id) AS rank FROM p) WHERE rank <= 3""")
def rank_links(spark: SparkSession, d: str) -> Frame:
    tf = materialize(_tf(spark, d), "tf")
    vectors = materialize(links.tfidf(tf, _idf(tf)), "tfidf")
    return links.rank_links(vectors, 3).select("source_id", "target_id", big("rank"), "score", F.array_join(F.transform("shared", lambda c: c.cast("string")), ",").alias("shared"))


def _doc_world(spark: SparkSession, d: str) -> tuple[Frame, Frame]:
    """Nations as documents, the segments of their customers (and the nations' regions) as concepts, nations of a region linked to the region's first."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    doc = F.concat(F.lit("nation::"), F.col("n_nationkey").cast("string"))
    e = c.select(F.concat(F.lit("nation::"), F.col("c_nationkey").cast("string")).alias("src_id"), F.concat(F.lit("bal::"), F.floor(F.col("c_acctbal") / 100).cast("string")).alias("target_id"), F.lit(1.0).alias("weight"))
    first = n.select(doc.alias("src_id"), F.concat(F.lit("nation::"), F.min("n_nationkey").over(Window.partitionBy("n_regionkey")).cast("string")).alias("target_id"), F.lit(1.0).alias("weight"))
    ents = n.select(doc.alias("canonical_id"), F.lit("document").alias("entity_type")).unionByName(e.select(F.col("target_id").alias("canonical_id"), F.lit("concept").alias("entity_type")).distinct())
    return e.unionByName(first), ents


_SG = """WITH e AS (SELECT 'nation::' || c_nationkey AS doc, 'bal::' || CAST(floor(c_acctbal / 100) AS BIGINT) AS concept FROM customer), tf AS (SELECT doc, concept, CAST(count(*) AS DOUBLE) AS tf FROM e GROUP BY ALL), n AS (SELECT count(*) AS n FROM nation),
idf AS (SELECT concept, ln(any_value(n) / count(*)) AS idf FROM tf, n GROUP BY concept), v AS (SELECT doc, concept, tf * idf AS w FROM tf JOIN idf USING (concept) WHERE idf > 0), nm AS (SELECT doc, sqrt(sum(w * w)) AS norm FROM v GROUP BY doc),
cand AS (SELECT concept, idf AS cw FROM idf WHERE concept IN ('bal::3', 'bal::50', 'bal::99') AND idf > 0), cn AS (SELECT sqrt(sum(cw * cw)) AS cn FROM cand),
ct AS (SELECT doc, sum(w * cw) / (any_value(norm) * any_value(cn)) AS content FROM v JOIN cand USING (concept) JOIN nm USING (doc), cn GROUP BY doc) """


def _suggested(spark: SparkSession, d: str, seeds: Frame | None) -> Frame:
    edges, ents = _doc_world(spark, d)
    cand = rows(spark, [("bal::3", 1.0), ("bal::50", 1.0), ("bal::99", 1.0), ("unknown", 1.0)], "target_id string, weight double")
    return links.suggest(cand, edges, ents, seeds, k=5).select("target_id", "score", "content_score", "structural_score")


@query(_SG + "SELECT doc AS target_id, round(content, 6) AS score, round(content, 6) AS content_score, 0.0::DOUBLE AS structural_score FROM ct WHERE content > 0 ORDER BY score DESC, target_id LIMIT 5")
def suggest_connections(spark: SparkSession, d: str) -> Frame:
    return _suggested(spark, d, None)


@query(_SG + """, l AS (SELECT 'nation::' || n_nationkey AS a, 'nation::' || min(n_nationkey) OVER (PARTITION BY n_regionkey) AS b FROM nation), adj AS (SELECT a AS node, b AS nbr FROM l WHERE a <> b UNION SELECT b, a FROM l WHERE a <> b), deg AS (SELECT node, count(*) AS g FROM adj GROUP BY 1),
st AS (SELECT adj.node AS doc, sum(1.0::DOUBLE / g) / 2 AS structural FROM adj JOIN deg ON deg.node = nbr WHERE nbr IN ('nation::0', 'nation::1') GROUP BY 1),
t AS (SELECT coalesce(ct.doc, st.doc) AS target_id, coalesce(content, 0) AS c, coalesce(structural, 0) AS s FROM ct FULL JOIN st ON ct.doc = st.doc)
SELECT target_id, round(c + 0.25 * s, 6) AS score, round(c, 6) AS content_score, round(s, 6) AS structural_score FROM t WHERE target_id NOT IN ('nation::0', 'nation::1') AND c + 0.25 * s > 0 ORDER BY score DESC, target_id LIMIT 5""")
def suggest_connections_seeded(spark: SparkSession, d: str) -> Frame:
    return _suggested(spark, d, rows(spark, [("nation::0",), ("nation::1",), ("nobody",)], "seed string"))


@query("WITH tf AS (SELECT l_orderkey AS doc, l_partkey AS concept, sum(l_quantity) AS tf FROM lineitem GROUP BY ALL) SELECT concept, doc, tf FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY tf DESC, doc) AS r FROM tf) WHERE r = 1")
def authority_doc(spark: SparkSession, d: str) -> Frame:
    return links.authorities(_tf(spark, d))


@query("WITH tf AS (SELECT l_orderkey AS doc, l_partkey AS concept, sum(l_quantity) AS tf FROM lineitem GROUP BY ALL), a AS (SELECT concept, doc AS target_id FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY tf DESC, doc) AS r FROM tf) WHERE r = 1) SELECT doc, concept, target_id, tf FROM tf JOIN a USING (concept) WHERE doc <> target_id")
def link_anchors(spark: SparkSession, d: str) -> Frame:
    return links.anchors(_tf(spark, d))


@query("""WITH h AS (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey), s AS (SELECT c_custkey AS doc, p_partkey AS doc_id, p_retailprice / (1 + p_size) AS score FROM customer JOIN h ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey WHERE c_custkey <> p_partkey)
SELECT doc, doc_id, CAST(r AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, doc_id) AS r FROM s) WHERE r <= 3""")
def next_reads(spark: SparkSession, d: str) -> Frame:
    """Parts a customer bought, the three of the best score."""
    o, li, p = (table(spark, d, t) for t in ("orders", "lineitem", "part"))
    bought = o.join(li, o.o_orderkey == li.l_orderkey).select(F.col("o_custkey").alias("doc"), F.col("l_partkey").alias("seed"))
    hits = p.select(F.col("p_partkey").alias("seed"), F.col("p_partkey").alias("doc_id"), (F.col("p_retailprice") / (1 + F.col("p_size"))).alias("score"))
    return links.next_reads(hits, bought).select("doc", "doc_id", big("rank"))


_PHRASES = ["the", "of the", "de la", "und"]


@query(f"""WITH n AS (SELECT doc_id, string_split({_NORM.format('text')}, ' ') AS t FROM documents), g AS (SELECT doc_id, unnest(t) AS a, unnest(list_concat(t[2:], [''])) AS b FROM n)
SELECT doc_id, p AS canonical_id, count(*) AS tf FROM (SELECT doc_id, a AS p FROM g WHERE a IN ('the', 'und') UNION ALL SELECT doc_id, a || ' ' || b FROM g WHERE a || ' ' || b IN ('of the', 'de la')) GROUP BY ALL""")
def phrase_tf(spark: SparkSession, d: str) -> Frame:
    docs = table(spark, d, "documents").select("doc_id", text.tokens(text.norm_latin(F.col("text"))).alias("tokens"))
    g = rows(spark, [(p, [p]) for p in _PHRASES], "norm string, ids array<string>")
    return links.phrase_counts(docs, F.broadcast(g), 2)


# authoring


@query()
def author_extract(spark: SparkSession, d: str) -> Frame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source"), "text")
    return authoring.author(docs)


@query()
def cross_doc_candidates(spark: SparkSession, d: str) -> Frame:
    """Candidates by the number of documents that hold them."""
    c = author_extract(spark, d).withColumn("norm", text.norm(F.col("surface")))
    return c.groupBy("norm").agg(F.count_distinct("source").alias("n_docs"), F.min("surface").alias("surface")).where("n_docs >= 2")


def _candidates(spark: SparkSession, d: str) -> Frame:
    part = table(spark, d, "part")
    return part.select(F.col("p_partkey").cast("int").alias("ord"), F.col("p_name").alias("surface"), F.lit("part").alias("entity_type"), F.lit("part").alias("source"), F.lit("table").alias("extractor"), F.lit("pending_review").alias("status"))


@query(f"WITH n AS (SELECT p_partkey, {_NORM.format('p_name')} AS norm FROM part) SELECT norm, CAST(min(p_partkey) AS BIGINT) AS ord, CAST(count(*) - 1 AS BIGINT) AS n_duplicates FROM n GROUP BY norm")
def dedup_tier1(spark: SparkSession, d: str) -> Frame:
    kept, dups = authoring.dedup_exact(_candidates(spark, d))
    n = dups.groupBy(F.col("kept_ord").alias("ord")).agg(F.count("*").alias("n_duplicates"))
    return kept.select("norm", "ord").join(n, "ord", "left").select("norm", big("ord"), F.coalesce("n_duplicates", F.lit(0)).cast("long").alias("n_duplicates"))


@query()
def dedup_minhash(spark: SparkSession, d: str) -> Frame:
    unique, dups, review = authoring.dedup(_candidates(spark, d))
    tag = unique.select(F.col("ord").alias("i"), F.lit(None).cast("int").alias("j"), F.lit("unique").alias("verdict"))
    tag = tag.unionByName(dups.select(F.col("kept_ord").alias("i"), F.col("ord").alias("j"), F.col("reason").alias("verdict")))
    return tag.unionByName(review.select("i", "j", F.lit("review").alias("verdict")))


# assembly and retrieval


@query("""WITH r AS (SELECT lang, doc_id, CAST(n_chars AS DOUBLE) AS rel, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, CAST(doc_id AS VARCHAR)) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang AS query_id, CAST(doc_id AS VARCHAR) AS doc_id, CAST(CASE WHEN i % 2 = 0 THEN i // 2 ELSE n - 1 - (i - 1) // 2 END AS BIGINT) AS position FROM r""")
def fold_order(spark: SparkSession, d: str) -> Frame:
    docs = table(spark, d, "documents").select(F.col("lang").alias("query_id"), F.col("doc_id").cast("string").alias("doc_id"), F.col("n_chars").cast("double").alias("rel"))
    return assemble.fold_order(docs).select("query_id", "doc_id", big("position"))


@query()
def mmr_assemble(spark: SparkSession, d: str) -> Frame:
    """A context for each benchmark item: the twenty best documents by BM25, whole, with the vector of their number if there is one."""
    docs, vecs = table(spark, d, "documents"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    hits = materialize(lexical.search(asked, lexical.build(docs.select("doc_id", "text")), 20), "pools")
    rel = F.col("score") / F.max("score").over(Window.partitionBy("query_id"))
    c = hits.withColumn("rel", rel).join(docs.select("doc_id", "n_chars"), "doc_id").join(vecs, "doc_id", "left")
    c = c.select("query_id", F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).cast("long").alias("print"), F.greatest(F.lit(1), F.col("n_chars") / 4).cast("int").alias("tokens"), "embedding", "rel", F.lit(BUDGET).alias("budget"))
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("content"))
    chosen = materialize(assemble.choice(c), "chosen")
    return assemble.emit(assemble.fold_order(texts.join(chosen, "doc_id"))).select("query_id", "text", "total_tokens", F.transform("manifest", lambda m: m["doc_id"]).alias("doc_ids"))


def _engine(spark: SparkSession, d: str) -> retrieve.Engine:
    w = _geo(spark, d)
    corpus = w.entities.select(F.col("canonical_id").alias("doc_id"), F.concat_ws(" ", "label", "entity_type").alias("content"), F.lit(8).alias("tokens"), F.array().cast("array<double>").alias("embedding"))
    index = lexical.build(corpus.select("doc_id", F.col("content").alias("text")))
    return retrieve.Engine(w, corpus, lexical=index, tail_ids=("nation::7",))


def _questions(spark: SparkSession, d: str) -> Frame:
    """A question about every nation, one about every customer, and what users say."""
    n, c, t = (table(spark, d, x) for x in ("nation", "customer", "conversations"))
    k = F.col("n_nationkey")
    one = n.select(k.cast("long").alias("query_id"), F.concat(F.lit("compare nation "), k.cast("string"), F.lit(" and nation "), ((k + 1) % 25).cast("string")).alias("text"))
    two = c.select((F.col("c_custkey") + 1000).cast("long").alias("query_id"), F.concat(F.lit("the latest on "), "c_name").alias("text"))
    three = t.where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn") + 1000000000).cast("long").alias("query_id"), "text")
    return one.unionByName(two).unionByName(three).withColumn("budget", F.lit(60))


@query()
def retrieve_e2e(spark: SparkSession, d: str) -> Frame:
    out, _ = _engine(spark, d).retrieve(materialize(_questions(spark, d), "questions"))
    return out.select("query_id", "strategy", "stage", joined("entities"), "total_tokens", F.transform("manifest", lambda m: m["doc_id"]).alias("doc_ids"))


@query("""WITH seed AS (SELECT n_nationkey AS query_id, 'nation::' || n_nationkey AS e FROM nation UNION ALL SELECT n_nationkey, 'nation::' || ((n_nationkey + 1) % 25) FROM nation UNION ALL SELECT c_custkey + 1000, 'customer::' || c_custkey FROM customer),
w AS (SELECT query_id, e, 1.0::DOUBLE AS score FROM seed UNION ALL SELECT query_id, 'region::' || n_regionkey, 0.5 FROM seed JOIN nation ON e = 'nation::' || n_nationkey UNION ALL SELECT query_id, 'nation::' || c_nationkey, 0.5 FROM seed JOIN customer ON e = 'customer::' || c_custkey
UNION ALL SELECT query_id, 'region::' || n_regionkey, 1.0::DOUBLE / 3 FROM seed JOIN customer ON e = 'customer::' || c_custkey JOIN nation ON n_nationkey = c_nationkey),
lab AS (SELECT 'region::' || r_regionkey AS e, r_name || ' region' AS content FROM region UNION ALL SELECT 'nation::' || n_nationkey, n_name || ' nation' FROM nation UNION ALL SELECT 'customer::' || c_custkey, c_name || ' customer' FROM customer)
SELECT query_id, e AS doc_id, round(max(score), 6) AS score, content FROM w JOIN lab USING (e) GROUP BY query_id, e, content""")
def agent_ground(spark: SparkSession, d: str) -> Frame:
    return retrieve.ground(_engine(spark, d), materialize(_questions(spark, d), "questions")).select("query_id", "doc_id", text.round6(F.col("score")).alias("score"), "content")


# scores


@query("SELECT o_custkey, bool_and(o_orderstatus <> 'P') AS passed, count(*) AS trials FROM orders GROUP BY 1")
def pass_at_k(spark: SparkSession, d: str) -> Frame:
    return evals.pass_at_k(table(spark, d, "orders").withColumn("ok", F.col("o_orderstatus") != "P"), ["o_custkey"])


@query("SELECT o_orderpriority, count(*) AS n, count_if(o_orderstatus = 'F') AS n_ok, round(100.0::DOUBLE * count_if(o_orderstatus = 'F') / count(*), 1) AS percent FROM orders GROUP BY 1")
def category_accuracy(spark: SparkSession, d: str) -> Frame:
    return evals.accuracy(table(spark, d, "orders").withColumn("ok", F.col("o_orderstatus") == "F"), "o_orderpriority")


@query("SELECT CAST(sum(CAST('0x' || substr(sha256(doc_id || chr(0) || text || chr(0)), 1, 15) AS BIGINT)::HUGEINT) AS VARCHAR) AS sha, count(*) AS n FROM documents")
def table_hash(spark: SparkSession, d: str) -> Frame:
    return evals.table_hash(table(spark, d, "documents"), ["doc_id", "text"])


@query("SELECT substr(sha256(string_agg(r_name || chr(0) || r_regionkey || chr(0), '' ORDER BY r_regionkey)), 1, 16) AS sha, count(*) AS n FROM region")
def corpus_hash(spark: SparkSession, d: str) -> Frame:
    """The list of regions, as a list of files would be."""
    return evals.corpus_hash(table(spark, d, "region"), "r_regionkey", ["r_name", "r_regionkey"])


@query(_LOOKED_UP + """, t AS (SELECT k, f, CASE WHEN k < 200000000 THEN 'customer' WHEN k < 300000000 THEN 'supplier' WHEN k < 500000000 THEN 'nation' ELSE 'order' END AS category FROM """ + _FORMS + """),
g AS (SELECT k, category, min(id) AS got FROM t LEFT JOIN hit ON mention_ord = k GROUP BY 1, 2), o AS (SELECT category, coalesce(got = category || '::' || (k % 100000000), false) AS ok FROM g)
SELECT category, count(*) AS n, count_if(ok) AS n_ok, round(100.0::DOUBLE * count_if(ok) / count(*), 1) AS percent FROM o GROUP BY 1""")
def resolution_benchmark(spark: SparkSession, d: str) -> Frame:
    """Every name in every form, resolved and scored by kind; what nothing is called counts as missed."""
    k = F.col("mention_ord")
    kind = F.when(k < 200000000, "customer").when(k < 300000000, "supplier").when(k < 500000000, "nation").otherwise("order")
    m = _mentions(spark, d)
    items = m.select(k.alias("item_ord"), "surface", kind.alias("category"), F.concat(kind, F.lit("::"), (k % 100000000).cast("string")).alias("canonical_id"))
    return evals.accuracy(evals.evaluate(items, resolve.lookup(m, _geo(spark, d))), "category")


# worlds, read back


@query(f"WITH {_RELS}, l AS (SELECT 'region::' || r_regionkey AS id, r_name AS label FROM region UNION ALL SELECT 'nation::' || n_nationkey, n_name FROM nation UNION ALL SELECT 'customer::' || c_custkey, c_name FROM customer UNION ALL SELECT 'supplier::' || s_suppkey, s_name FROM supplier) SELECT id AS canonical_id, label, coalesce(t, '') AS targets, 'v1' AS form FROM l LEFT JOIN r ON s = id")
def json_lines_read_back(spark: SparkSession, d: str) -> Frame:
    """A world written as JSON lines and read again, from files."""
    path = f"{shared_dir(spark)}/json-{uuid.uuid4().hex}"
    world.to_json_lines(_geo(spark, d).entities).write.text(path)
    back = world.read_json_lines(spark, path)
    return back.select("canonical_id", "label", F.array_join(F.transform("relations", lambda r: r["target_id"]), ",").alias("targets"), F.lit("v1").alias("form"))


@query(f"WITH {_RELS} SELECT s AS src_id, p AS predicate, t AS target_id, row_number() OVER (PARTITION BY s ORDER BY p, t) AS n FROM r")
def edges_scan(spark: SparkSession, d: str) -> Frame:
    """Out-edges of all entities, through the handle."""
    w = _geo(spark, d)
    e = w.edges_of(w.entities.select(F.col("canonical_id").alias("id")))
    return e.select("src_id", "predicate", "target_id", F.row_number().over(Window.partitionBy("src_id").orderBy("predicate", "target_id")).cast("long").alias("n"))


@query("SELECT 'region::' || r_regionkey AS entity_id, 'region::' || r_regionkey AS doc_id FROM region UNION ALL SELECT 'nation::' || n_nationkey, 'nation::' || n_nationkey FROM nation UNION ALL SELECT 'customer::' || c_custkey, 'customer::' || c_custkey FROM customer UNION ALL SELECT 'supplier::' || s_suppkey, 'supplier::' || s_suppkey FROM supplier")
def refs_scan(spark: SparkSession, d: str) -> Frame:
    w = _geo(spark, d)
    return w.refs_of(w.entities.select(F.col("canonical_id").alias("id"))).select("entity_id", "doc_id")


@query("WITH g AS (SELECT s_suppkey, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS root FROM supplier) SELECT 'supplier::' || s_suppkey AS id, true AS recorded, s_suppkey = root AS resolvable FROM g UNION ALL SELECT 'order::' || o_orderkey, false, false FROM orders")
def membership(spark: SparkSession, d: str) -> Frame:
    """Which ids were ever added, and which still stand after the suppliers of each nation were merged."""
    w = _merged(spark, d)
    ids = table(spark, d, "supplier").select(F.concat(F.lit("supplier::"), F.col("s_suppkey").cast("string")).alias("id")).unionByName(table(spark, d, "orders").select(F.concat(F.lit("order::"), F.col("o_orderkey").cast("string")).alias("id")))
    had, has = w.has_record(ids).withColumn("recorded", F.lit(True)), w.has_id(ids).withColumn("resolvable", F.lit(True))
    return ids.join(had, "id", "left").join(has, "id", "left").select("id", F.coalesce("recorded", F.lit(False)).alias("recorded"), F.coalesce("resolvable", F.lit(False)).alias("resolvable"))


@query("SELECT 'part::' || p_partkey AS canonical_id, p_name AS label, 'part' AS entity_type, 'part' AS source FROM part WHERE p_partkey % 3 = 0")
def approved(spark: SparkSession, d: str) -> Frame:
    """Of all candidates, those that a third of all parts' numbers approve."""
    c = _candidates(spark, d).withColumn("surface", F.concat_ws("#", "surface", "ord"))
    ok = table(spark, d, "part").where("p_partkey % 3 = 0").select(F.concat_ws("#", "p_name", "p_partkey").alias("surface"), F.concat(F.lit("part::"), F.col("p_partkey").cast("string")).alias("canonical_id"))
    return authoring.approve(c, ok).withColumn("label", F.substring_index("label", "#", 1)).select("canonical_id", "label", "entity_type", "source")


@query(f"""WITH n AS (SELECT p_partkey, {_NORM.format('p_name')} AS norm FROM part), k AS (SELECT DISTINCT norm FROM n WHERE norm LIKE 'b%'), f AS (SELECT norm, min(p_partkey) AS first FROM n WHERE norm NOT IN (SELECT norm FROM k) GROUP BY 1)
SELECT CAST(p_partkey AS BIGINT) AS ord, CASE WHEN norm IN (SELECT norm FROM k) THEN 'existing' WHEN p_partkey = first THEN 'kept' ELSE 'same_form' END AS verdict FROM n LEFT JOIN f USING (norm)""")
def dedup_existing(spark: SparkSession, d: str) -> Frame:
    """Candidates against what exists already (all names that begin with b) and each other."""
    known = table(spark, d, "part").select(text.norm(F.col("p_name")).alias("norm")).where("norm LIKE 'b%'")
    kept, dups = authoring.dedup_exact(_candidates(spark, d), known)
    return kept.select(big("ord"), F.lit("kept").alias("verdict")).unionByName(dups.select(big("ord"), F.col("reason").alias("verdict")))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT a.vec_id AS m, b.vec_id AS k, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 10) AS score FROM e a, e b WHERE a.vec_id % 20 = 0 AND b.vec_id % 20 <> 0),
t AS (SELECT *, max(score) OVER (PARTITION BY m) AS top FROM s) SELECT m AS mention_ord, 'v' || k AS canonical_id, round(score, 6) AS confidence, 'embedding' AS tier FROM t WHERE score = top AND score >= 0.3""")
def resolve_vectors(spark: SparkSession, d: str) -> Frame:
    """Every twentieth vector as a mention, the others as aliases: the vector tier."""
    e = table(spark, d, "embeddings")
    m = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("mention_ord"), F.concat(F.lit("q"), F.col("vec_id").cast("string")).alias("surface"), F.col("embedding").alias("vector"))
    a = e.where("vec_id % 20 <> 0").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("norm"), F.array(F.concat(F.lit("v"), F.col("vec_id").cast("string"))).alias("ids"), F.col("embedding").alias("vector"))
    w = world.World(None, None, None)
    w.__dict__["exact"] = rows(spark, [], "surface string, canonical_id string")
    w.__dict__["normalized"] = rows(spark, [], "norm string, canonical_id string")
    s = resolve.Settings(fuzzy=False, vector_threshold=0.3, alias_vectors=a, mention_vectors=m.select("surface", "vector"))
    return resolve.resolve_mentions(m.select("mention_ord", "surface"), w, s)[0].select("mention_ord", "canonical_id", "confidence", "tier")
