"""The registered queries over the engine's tables, and the SQL of the same results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import authors, chunks, graph, python_code, vectors

from . import code_queries, health_queries, portable, retrieval_queries
from .dialect import load, oracle, plan

QUERIES = {name: plan(sql) for name, sql in portable.SQL.items()}
ORACLES = {name: oracle(sql) for name, sql in portable.SQL.items()}


def _ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of five tables as a graph that stays sparse as it grows: regions hold nations, these customers, orders, parts.

    Ids of the five kinds are told apart by their remainder by 5; parts have 0.
    """
    line, orders, customer, nation = (load(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    parts = [
        line.select((F.col("l_orderkey") * 5 + 1).alias("src"), (F.col("l_partkey") * 5).alias("dst"), F.col("l_returnflag").alias("type")),
        orders.select((F.col("o_custkey") * 5 + 2).alias("src"), (F.col("o_orderkey") * 5 + 1).alias("dst"), F.lit("order").alias("type")),
        customer.select((F.col("c_nationkey").cast("bigint") * 5 + 3).alias("src"), (F.col("c_custkey") * 5 + 2).alias("dst"), F.lit("customer").alias("type")),
        nation.select((F.col("n_regionkey").cast("bigint") * 5 + 4).alias("src"), (F.col("n_nationkey").cast("bigint") * 5 + 3).alias("dst"), F.lit("nation").alias("type")),
    ]
    return reduce(DataFrame.unionByName, parts)


def _anchor(edges: DataFrame) -> DataFrame:
    return edges.agg(F.min("dst").alias("node"))


def graph_rag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = load(spark, sf_dir, "embeddings").withColumn("vec_id", F.col("vec_id") * 5)
    query = v.orderBy("vec_id").limit(1)
    return vectors.anchored_search(v, query, _ownership(spark, sf_dir), 16, 2)


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = load(spark, sf_dir, "embeddings")
    return vectors.nearest(v, v.orderBy("vec_id").limit(1), 16).select("vec_id", F.round("distance", 6).alias("distance"), F.round(1 / (1 + F.col("distance")), 6).alias("similarity"))


def vector_topk_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = load(spark, sf_dir, "embeddings")
    return vectors.nearest_per_group(v, v.orderBy("vec_id").limit(1), "label", 3).select("label", "vec_id", "rank", F.round("distance", 6).alias("distance"))


def semantic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = load(spark, sf_dir, "embeddings")
    return vectors.pair_stats(v, "label").select("label", "pairs", F.round("mean", 6).alias("mean"), F.round("most", 6).alias("most"), "alike")


def bfs_khop(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _ownership(spark, sf_dir)
    return graph.bfs(e, _anchor(e), 3, "both")


def bfs_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _ownership(spark, sf_dir)
    return graph.bfs(e, _anchor(e), 2, "both", ["R", "A"])


def caller_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _ownership(spark, sf_dir)
    return graph.bfs(e, _anchor(e), 5, "in")


def node_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _ownership(spark, sf_dir)
    return graph.neighbours(e, e.agg(F.min("src").alias("node")), "both", ["R", "N"])


def all_simple_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first part to the last part within four hops, along edges either way, by six nodes and fewer."""
    e = _ownership(spark, sf_dir)
    last = graph.bfs(e, _anchor(e), 4, "both").where("node % 5 = 0").agg(F.max("node").alias("node"))
    paths = graph.simple_paths(graph.directed(e, "both"), _anchor(e), last, 6)
    return paths.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), F.size("path").cast("bigint").alias("nodes"))


def focus_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _ownership(spark, sf_dir)
    return graph.induced(e, graph.bfs(e, _anchor(e), 2, "both")).select("src", "dst", "type").distinct()


def shortest_distance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bfs_khop(spark, sf_dir).select("node", F.round(F.exp(F.col("depth") * -0.5), 6).alias("score"))


def node_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.importance(_ownership(spark, sf_dir))


def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.windows(load(spark, sf_dir, "documents").select("doc_id", "text"), 20, 4).select("doc_id", "start_line", "end_line", F.md5("chunk").alias("chunk_md5"))


def token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("a"))
    b = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("b"))
    return d.join(b, "doc_id").select("doc_id", F.round(tx.jaccard(tx.tokens(F.col("a")), tx.tokens(F.col("b"))), 6).alias("jaccard"))


def fuzzy_merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return authors.candidates(load(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct())


def fuzzy_merge_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("commits"))
    return authors.groups(p)


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


def url_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^(https?)://", 1).alias("scheme"), F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", "^https?://[^/?#]+(/[^?#]*)", 1).alias("path"))


def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.streaming import events

    return events.counted(load(spark, sf_dir, "events"))


_EDGES = """SELECT l_orderkey * 5 + 1 AS src, l_partkey * 5 AS dst, l_returnflag AS type FROM lineitem
    UNION ALL SELECT o_custkey * 5 + 2, o_orderkey * 5 + 1, 'order' FROM orders
    UNION ALL SELECT c_nationkey::BIGINT * 5 + 3, c_custkey * 5 + 2, 'customer' FROM customer
    UNION ALL SELECT n_regionkey::BIGINT * 5 + 4, n_nationkey::BIGINT * 5 + 3, 'nation' FROM nation"""


def _hops(depth: int, anchors: str, where: str = "TRUE") -> str:
    steps = [f"n0 AS (SELECT node, 0 AS depth FROM ({anchors}) q)"]
    for k in range(1, depth + 1):
        steps.append(f"n{k} AS (SELECT node, depth FROM n{k - 1} UNION ALL SELECT DISTINCT b.y AS node, {k} AS depth FROM n{k - 1} JOIN b ON b.x = n{k - 1}.node WHERE b.y NOT IN (SELECT node FROM n{k - 1}))")
    return f"e AS ({_EDGES}), b AS (SELECT src AS x, dst AS y FROM e WHERE {where} UNION SELECT dst, src FROM e WHERE {where}), " + ", ".join(steps)


_DIST = "sqrt(list_sum(list_transform(range(1, 65), lambda i: (v.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE) ** 2)))"
_MIN = "SELECT min(dst) AS node FROM e"
_NEAR = f"SELECT v.vec_id, v.label, {_DIST} AS d FROM embeddings v, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q"

_DATAFRAME = [graph_rag_search, vector_topk, vector_topk_per_label, semantic_pairs, bfs_khop, bfs_types, caller_chain, node_neighbours, all_simple_paths, focus_subgraph, shortest_distance_score, node_importance, chunk_windows, token_jaccard, fuzzy_merge_candidates, fuzzy_merge_groups, json_props, url_parse, window_counts]
QUERIES |= {f.__name__: f for f in _DATAFRAME}
QUERIES |= {f"py_{k}": (lambda spark, sf_dir, k=k: python_code.extract(python_code.fixture(spark), k)) for k in python_code.KINDS}

ORACLES |= {
    "graph_rag_search": f"WITH {_hops(2, f'SELECT vec_id * 5 AS node FROM (SELECT * FROM ({_NEAR}) z ORDER BY d, vec_id LIMIT 16) y WHERE vec_id * 5 IN (SELECT src FROM e UNION SELECT dst FROM e)')} SELECT node, depth, depth = 0 AS is_anchor FROM n2",
    "vector_topk": f"SELECT vec_id, round(d, 6) AS distance, round(1 / (1 + d), 6) AS similarity FROM ({_NEAR}) z ORDER BY d, vec_id LIMIT 16",
    "vector_topk_per_label": f"SELECT label, vec_id, rank, round(d, 6) AS distance FROM (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS INTEGER) AS rank FROM ({_NEAR}) z) y WHERE rank <= 3",
    "semantic_pairs": "SELECT a.label, count(*) AS pairs, round(avg(c), 6) AS mean, round(max(c), 6) AS most, count(*) FILTER (WHERE c > 0.9) AS alike FROM (SELECT a.label, list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) / (sqrt(list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE ** 2))) * sqrt(list_sum(list_transform(range(1, 65), lambda i: b.embedding[i]::DOUBLE ** 2))) + 1e-8) AS c FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id) a GROUP BY a.label",
    "bfs_khop": f"WITH {_hops(3, _MIN)} SELECT node, depth FROM n3",
    "bfs_types": "WITH " + _hops(2, _MIN, "type IN ('R', 'A')") + " SELECT node, depth FROM n2",
    "caller_chain": f"WITH RECURSIVE e AS ({_EDGES}), n AS (SELECT min(dst) AS node, 0 AS depth FROM e UNION SELECT src, depth + 1 FROM n JOIN e ON dst = node WHERE depth < 5) SELECT node, min(depth) AS depth FROM n GROUP BY node",
    "node_neighbours": f"WITH e AS ({_EDGES}), a AS (SELECT min(src) AS node FROM e) SELECT node, dst AS neighbour, type FROM e JOIN a ON src = node WHERE type IN ('R', 'N') UNION ALL SELECT node, src, type FROM e JOIN a ON dst = node WHERE type IN ('R', 'N')",
    "all_simple_paths": f"WITH RECURSIVE {_hops(4, _MIN)}, g AS (SELECT DISTINCT * FROM (SELECT src AS x, dst AS y, type FROM e UNION ALL SELECT dst, src, type FROM e) u), goal AS (SELECT max(node) AS goal FROM n4 WHERE node % 5 = 0), p AS (SELECT [node] AS path FROM ({_MIN}) m UNION ALL SELECT list_append(path, y) FROM p JOIN g ON x = path[len(path)] JOIN goal ON path[len(path)] <> goal WHERE len(path) < 6 AND NOT list_contains(path, y)) SELECT array_to_string(path, '>') AS path, CAST(len(path) AS BIGINT) AS nodes FROM p JOIN goal ON path[len(path)] = goal",
    "focus_subgraph": f"WITH {_hops(2, _MIN)} SELECT DISTINCT src, dst, type FROM e WHERE src IN (SELECT node FROM n2) AND dst IN (SELECT node FROM n2)",
    "shortest_distance_score": f"WITH {_hops(3, _MIN)} SELECT node, round(exp(depth * -0.5), 6) AS score FROM n3",
    "node_importance": f"WITH e AS ({_EDGES}), u AS (SELECT src AS node, 1 AS o, 0 AS i, type FROM e UNION ALL SELECT dst, 0, 1, type FROM e) SELECT node, CAST(sum(o) AS BIGINT) AS outgoing, CAST(sum(i) AS BIGINT) AS incoming, count(DISTINCT type) AS types, round_even(1.2 * sum(o) + sum(i) + 1.5 * count(DISTINCT type), 3)::DOUBLE AS score FROM u GROUP BY node",
    "chunk_windows": chunks.ORACLE_SQL,
    "token_jaccard": "WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(d.text), '[a-z0-9_]+')) AS a, list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9_]+')) AS b FROM documents d JOIN benchmark b ON doc_id = item_id) SELECT doc_id, round(CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) * 1.0 / len(list_distinct(list_concat(a, b))) END, 6) AS jaccard FROM t",
    "fuzzy_merge_candidates": authors.ORACLE_SQL,
    "json_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "url_parse": "SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1) AS path FROM pages",
    "window_counts": "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}

QUERIES |= code_queries.QUERIES | health_queries.QUERIES | retrieval_queries.QUERIES
ORACLES |= code_queries.ORACLES | health_queries.ORACLES | retrieval_queries.ORACLES
