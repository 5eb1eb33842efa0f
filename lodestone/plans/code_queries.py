"""Registered queries of questions, re-ranking, ordered walks, pieces of text and the knowledge graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import chunks, file_stats, graph, knowledge, python_code, questions, ranking, vectors

from .dialect import load

QUESTION = "Where is the import of src3 used in utils?"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", "text")


def query_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", questions.intent(F.col("text")).alias("intent"))


def query_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).withColumn("c", questions.constraints(F.col("text"))).select("conv_id", "turn", "c.*")


def query_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).withColumn("f", questions.filters(F.col("text"))).select("conv_id", "turn", "f.*")


def query_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", F.array_join(questions.keywords(F.col("text")), ",").alias("keywords"))


def query_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return questions.symbols(turns, "id", "text").groupBy("is_primary").agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"))


def contribution_query_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", questions.about_contributions(F.col("text")).alias("is_contribution"))


def chunk_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.split_at(load(spark, sf_dir, "documents").select("doc_id", "text"), "[A-Z]").select("doc_id", "start_line", "end_line", F.length("chunk").cast("bigint").alias("size"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 nearest vectors' documents as chunks: part names as symbols, sources as paths."""
    v = load(spark, sf_dir, "embeddings")
    near = vectors.nearest(v, v.orderBy("vec_id").limit(1), 100).select(F.col("vec_id").alias("doc_id"), "distance")
    d = load(spark, sf_dir, "documents").join(F.broadcast(near), "doc_id")
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("symbol_name"), F.col("p_brand").alias("parent_class"))
    return d.join(p, "doc_id", "left").select("doc_id", "distance", F.col("source").alias("path"), F.col("lang").alias("language"), F.lit("function_definition").alias("node_type"), "symbol_name", "parent_class", F.array(F.col("lang")).alias("params"), F.array().cast("array<string>").alias("decorators"), F.array().cast("array<string>").alias("imports"), "text")


def hybrid_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = ranking.hybrid(_candidates(spark, sf_dir), QUESTION)
    return x.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


def unified_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _candidates(spark, sf_dir)
    near = x.select("symbol_name", F.pmod("doc_id", F.lit(4)).alias("depth"))
    return ranking.unified(x, x.orderBy("doc_id").limit(1), ["steel"], near, 10, "doc_id")


def symbol_driven_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _candidates(spark, sf_dir)
    least = x.groupBy().agg(F.min("symbol_name").alias("symbol_name"))
    depths = x.where("doc_id % 3 = 0").select("symbol_name", F.pmod("doc_id", F.lit(4)).alias("depth"))
    return ranking.symbol_driven(x, least.withColumn("confidence", F.lit(0.9)), depths, QUESTION, 10, "doc_id")


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that call the part on the next line of an order, over all of lineitem: at most three calls of each part.

    A part calls the next part of its first order, passes data to that of its last order and contains that of its
    greatest line. So ways are long and cycles few, at any size.
    """
    line = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    following = F.lead("l_partkey").over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))  # an order has few lines
    at = F.struct("l_orderkey", "l_linenumber", "dst")
    x = line.withColumn("dst", following).where("dst IS NOT NULL").groupBy(F.col("l_partkey").alias("src"))
    x = x.agg(F.min(at)["dst"].alias("calls"), F.max(at)["dst"].alias("dataflow"), F.max(F.struct("l_quantity", "l_orderkey", "l_linenumber", "dst"))["dst"].alias("contains"))
    return x.unpivot("src", ["calls", "dataflow", "contains"], "type", "dst").select("src", "dst", "type")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name"))


def keyword_match_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All part names as symbols; these and their words as keywords."""
    names = load(spark, sf_dir, "part").select(F.col("p_name").alias("symbol_name")).distinct()
    words = names.select(F.explode(F.concat(F.array("symbol_name"), F.split("symbol_name", " "))).alias("word"))
    return ranking.keyword_matches(names, words).select("word", "symbol_name", F.round("confidence", 6).alias("confidence"))


def boot_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = _calls(spark, sf_dir), _names(spark, sf_dir)
    return graph.boot_chain(e, graph.boot_entries(e, n), n, 4)


def preferred_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _calls(spark, sf_dir)
    found = graph.preferred_path(e.withColumn("downstream", F.col("dst") % 5 == 0), e.agg(F.min("src").alias("node")), None, 4)
    return found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "score")


def depth_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _calls(spark, sf_dir)
    return graph.dfs(e, e.agg(F.min("src").alias("node")), 4)


def cycle_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycle_roots(_calls(spark, sf_dir))


def cyclic_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cyclic(_calls(spark, sf_dir).where("type = 'dataflow'"))


def py_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.build(python_code.fixture(spark))[0]


def py_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.build(python_code.fixture(spark))[1]


def file_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Python files: words of any language count where they look like its keywords."""
    d = load(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.col("text").alias("content"))
    return file_stats.metrics(d).select("path", "loc", "loc_code", "loc_blank", "cyclomatic_complexity", "num_functions", "num_imports")


def naming_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    return file_stats.naming_violations(p.select(F.col("p_name").alias("name"), F.lit("function").alias("kind"), F.lit("java").alias("language"))).groupBy("kind", "expected", "actual").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in [query_intent, query_constraints, query_filters, query_keywords, query_symbols, contribution_query_flag, chunk_boundaries, hybrid_rerank, unified_rank, symbol_driven_rank, keyword_match_symbols, boot_chain, preferred_path, depth_first, cycle_roots, cyclic_part, py_graph_nodes, py_graph_edges, file_metrics, naming_violations]}


def _re2(patterns: list[str]) -> str:
    """The patterns for an engine whose classes know ASCII only."""
    return "|".join(f"(?:{p})" for p in patterns).replace(r"\w", r"[\p{L}\p{N}\p{M}_]").replace(r"\s", r"[\s\p{Z}]").replace("'", "''")


def _pick(columns: dict[str, str], source: str) -> str:
    return "SELECT conv_id, turn, " + ", ".join(f"{sql} AS {name}" for name, sql in columns.items()) + f" FROM {source}"


_INTENT = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{_re2(p)}') THEN '{name}'" for name, p in questions.INTENTS.items()) + " WHEN text IS NOT NULL THEN 'custom' END"
_LANGUAGE = "CASE " + " ".join(f"WHEN contains(lower(text), '{k}') THEN '{v}'" for k, v in reversed(questions.LANGUAGES.items())) + " END"
_WORDS = ", ".join(f"'{w}'" for w in questions.KEYWORDS)
_V = "sqrt(list_sum(list_transform(range(1, 65), lambda i: (v.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE) ** 2)))"
_CANDIDATES = f"""c AS (SELECT doc_id, d, source AS path, lang, p_name AS sym, p_brand AS parent, text FROM documents
  JOIN (SELECT v.vec_id, {_V} AS d FROM embeddings v, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q ORDER BY d, v.vec_id LIMIT 100) z ON doc_id = vec_id LEFT JOIN part ON p_partkey = doc_id)"""
_LOW = QUESTION.lower().replace("'", "''")
_ON = lambda condition, by: f"(CASE WHEN {condition} THEN {by}::DOUBLE ELSE 0 END)"
_HYBRID = " + ".join(
    [
        "1 / (1 + d)",
        _ON(f"contains('{_LOW}', lower(sym)) AND sym <> ''", 0.6),
        _ON(f"contains('{_LOW}', lower(parent)) AND parent <> ''", 0.4),
        _ON("contains(text, 'def ') OR contains(text, 'function ')", 0.2),
        _ON("contains(text, 'class ')", 0.2),
        _ON("contains(lower(substr(text, 1, 400)), 'import ')", 0.15),
        _ON("contains(lower(text), 'todo') OR contains(lower(text), 'fixme')", 0.05),
        _ON("list_bool_or(list_transform(regexp_extract_all('" + _LOW + "', '[a-z_][a-z0-9_]*'), lambda w: contains(lower(path), w)))", 0.2),
        _ON("regexp_matches(lower(path), 'views|controllers|routes|api')", 0.25),
        _ON("regexp_matches(lower(path), 'models|schemas')", 0.2),
        _ON("regexp_matches(lower(path), 'utils|helpers|lib')", 0.15),
    ]
)
_E = """s AS (SELECT l_partkey AS src, l_orderkey AS o, l_linenumber AS n, l_quantity AS q, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem),
        r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY o, n, dst) AS first, row_number() OVER (PARTITION BY src ORDER BY o DESC, n DESC, dst DESC) AS last,
        row_number() OVER (PARTITION BY src ORDER BY q DESC, o DESC, n DESC, dst DESC) AS most FROM s WHERE dst IS NOT NULL),
        e AS (SELECT src, dst, 'calls' AS type FROM r WHERE first = 1 UNION ALL SELECT src, dst, 'dataflow' FROM r WHERE last = 1 UNION ALL SELECT src, dst, 'contains' FROM r WHERE most = 1)"""


def _stem(word: str) -> str:
    fits = (f"WHEN ends_with({word}, '{x}') AND length({word}) > {len(x) + 2} THEN left({word}, length({word}) - {len(x)})" for x in text.SUFFIXES)
    return f"CASE {' '.join(fits)} ELSE {word} END"


def _levels(depth: int) -> str:
    steps = ["n0 AS (SELECT node, 0 AS depth, [node] AS path FROM entries)"]
    for k in range(1, depth + 1):
        steps.append(f"n{k} AS (SELECT * FROM n{k - 1} UNION ALL SELECT dst, {k}, min(list_append(path, dst)) FROM n{k - 1} JOIN u ON src = node WHERE depth = {k - 1} AND dst NOT IN (SELECT node FROM n{k - 1}) GROUP BY dst)")
    return ", ".join(steps)


ORACLES = {
    "query_intent": _pick({"intent": _INTENT}, "conversations"),
    "query_constraints": _pick(
        {
            "file": r"regexp_extract_all(text, '(?i)(?:in|from|file)\s+(?:the\s+)?file\s+[\"'']?([^\s\"'']+)[\"'']?', 1)[1]",
            "line": r"CAST(regexp_extract_all(text, '(?i)(?:at|around|line)\s+(\d+)', 1)[1] AS BIGINT)",
            "type": r"CASE WHEN regexp_matches(text, '(?i)async\s+(?:function|method)') THEN 'async' END",
            "method_type": r"CASE WHEN regexp_matches(text, '(?i)(?:static|class)\s+method') THEN 'static' END",
            "visibility": r"CASE WHEN regexp_matches(text, '(?i)(?:public|private)\s+(?:method|function)') THEN CASE WHEN contains(text, 'public') THEN 'public' ELSE 'private' END END",
        },
        "conversations",
    ),
    "query_filters": _pick(
        {
            "language": _LANGUAGE,
            "node_type": "CASE WHEN contains(lower(text), 'class') THEN 'class_definition' WHEN contains(lower(text), 'function') OR contains(lower(text), 'def ') THEN 'function_definition' END",
            "path": "regexp_extract_all(lower(text), '" + _re2([r"\w+\.(py|js|ts|java|cpp|c|rs|go)"]) + "', 1)[1]",
        },
        "conversations",
    ),
    "query_keywords": _pick({"keywords": f"array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '" + _re2([r"\w+"]) + f"')), lambda w: w IN ({_WORDS}))), ',')"}, "conversations"),
    "contribution_query_flag": _pick({"is_contribution": f"coalesce(regexp_matches(lower(text), '{_re2(questions.CONTRIBUTION)}'), FALSE)"}, "conversations"),
    "chunk_boundaries": chunks.SPLIT_SQL,
    "file_metrics": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), l AS (SELECT *, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS lines FROM d)
        SELECT doc_id || '.py' AS path, CAST(len(lines) AS INTEGER) AS loc, len(list_filter(lines, lambda x: x <> '' AND NOT starts_with(x, '#'))) AS loc_code, len(list_filter(lines, lambda x: x = '')) AS loc_blank,
        1 + len(list_filter(regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+'), lambda w: w IN ('if', 'elif', 'else', 'for', 'while', 'except', 'finally', 'and', 'or', 'with'))) AS cyclomatic_complexity,
        len(regexp_extract_all(text, '(?m)^\s*def\s+\w+\s*\(')) AS num_functions, len(regexp_extract_all(text, '(?m)^\s*(?:import|from)\s+')) AS num_imports FROM l""",
    "naming_violations": "SELECT 'function' AS kind, 'camelCase' AS expected, CASE WHEN regexp_matches(substr(p_name, 2), '[A-Z]') THEN 'camelCase' ELSE 'snake_case' END AS actual, count(*) AS n FROM part WHERE NOT starts_with(p_name, '_') AND NOT regexp_matches(p_name, '^[a-z][a-zA-Z0-9]*$') GROUP BY ALL",
    "hybrid_rerank": f"WITH {_CANDIDATES} SELECT doc_id, round({_HYBRID}, 6) AS score FROM c ORDER BY score DESC, doc_id LIMIT 10",
    "keyword_match_symbols": f"""WITH n AS (SELECT DISTINCT p_name AS name, {_stem("lower(p_name)")} AS s FROM part), k AS (SELECT DISTINCT lower(word) AS word FROM (SELECT unnest(list_append(string_split(name, ' '), name)) AS word FROM n) z WHERE length(word) > 2),
        t AS (SELECT word, {_stem("word")} AS t FROM k), m AS (SELECT *, least(length(s), length(t)) / greatest(length(s), length(t))::DOUBLE AS ratio FROM n JOIN t ON contains(s, t) OR contains(t, s))
        SELECT word, name AS symbol_name, round(ratio, 6) AS confidence FROM m WHERE ratio >= 0.6::DOUBLE""",
    "boot_chain": f"""WITH {_E}, u AS (SELECT DISTINCT src, dst FROM e), o AS (SELECT src AS node, count(*) AS callees FROM u GROUP BY src), i AS (SELECT dst AS node, count(*) AS callers FROM u GROUP BY dst),
        entries AS (SELECT node FROM o LEFT JOIN i USING (node) ORDER BY least(callees, 5) - least(coalesce(callers, 0), 3) DESC, coalesce(callers, 0) DESC, callees, node DESC LIMIT 5), {_levels(4)}
        SELECT node, depth, CASE WHEN depth > 0 THEN path[-2] END AS called_by, coalesce(callees, 0) AS callees, depth = 0 AS is_entry, depth > 0 AND callees IS NULL AS is_ready FROM n4 LEFT JOIN o USING (node)""",
    "symbol_driven_rank": f"""WITH {_CANDIDATES}, m AS (SELECT min(sym) AS sym FROM c), h AS (SELECT sym, min(doc_id % 4) AS hops FROM c WHERE doc_id % 3 = 0 GROUP BY sym),
        s AS (SELECT doc_id, m.sym IS NOT NULL AS is_direct, round(0.35 * CASE WHEN m.sym IS NOT NULL THEN 0.9::DOUBLE WHEN hops IS NOT NULL THEN 0.1 ELSE 0 END + 0.25 * CASE WHEN m.sym IS NOT NULL THEN 1.0::DOUBLE WHEN hops <= 1 THEN 0.8 WHEN hops <= 2 THEN 0.5 WHEN hops IS NOT NULL THEN 0.2 ELSE 0.1 END
          + 0.15 * (0.8::DOUBLE + CASE WHEN list_has_any(regexp_extract_all(lower(path), '[a-z0-9_]+'), regexp_extract_all('{_LOW}', '[a-z0-9_]+')) THEN 0.15::DOUBLE ELSE 0 END) + 0.25 / (1 + d), 9) AS score
          FROM c LEFT JOIN m ON c.sym = m.sym LEFT JOIN h ON c.sym = h.sym),
        r AS (SELECT *, row_number() OVER (PARTITION BY is_direct ORDER BY score DESC, doc_id) AS r, count(*) FILTER (WHERE is_direct) OVER () AS n FROM s)
        SELECT doc_id, is_direct, score FROM r WHERE CASE WHEN is_direct THEN r <= 2 ELSE r <= 10 - n END""",
    "cyclic_part": f"""WITH RECURSIVE {_E}, u AS (SELECT DISTINCT src, dst FROM e WHERE type = 'dataflow'), w AS (SELECT src, dst FROM u UNION SELECT w.src, u.dst FROM w JOIN u ON w.dst = u.src),
        k AS (SELECT DISTINCT src AS node FROM w WHERE src = dst), h AS (SELECT node FROM k UNION SELECT dst FROM w WHERE src IN (SELECT node FROM k)), t AS (SELECT node FROM k UNION SELECT src FROM w WHERE dst IN (SELECT node FROM k))
        SELECT src, dst FROM u WHERE src IN (SELECT node FROM h) AND dst IN (SELECT node FROM t)""",
}
