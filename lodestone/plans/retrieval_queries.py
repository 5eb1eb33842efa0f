"""Registered queries of retrieved chunks, call graph figures, sessions and incremental refresh, with SQL written apart.

As in ``health_queries``, whole driver tables stand in for chunks, symbols and calls by the same text in both dialects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import call_stats, chunks, passages, vectors
from lodestone.streaming import events

from .dialect import load, plan
from .health_queries import _CHUNKS, _NODES, _SYMBOLS, _duck

_CALLS = "SELECT concat('f', l_suppkey, '.py:g', l_partkey) AS caller, CASE WHEN l_returnflag = 'R' THEN concat('ext', l_linenumber) ELSE concat('f', l_linenumber, '.py:g', l_orderkey) END AS callee FROM {lineitem}"
_CONTAINS = "SELECT concat('r', n_regionkey) AS src, concat('n', n_nationkey) AS dst FROM {nation} UNION ALL SELECT concat('n', c_nationkey), concat('c', c_custkey) FROM {customer}"
_HOLDERS = "SELECT concat('r', r_regionkey) AS id, 'class' AS type, r_name AS name, 'r.py' AS file FROM {region} UNION ALL SELECT concat('n', n_nationkey), 'class', n_name, 'n.py' FROM {nation} UNION ALL SELECT concat('c', c_custkey), CASE WHEN c_custkey % 2 = 0 THEN 'method' ELSE 'function' END, c_name, 'c.py' FROM {customer}"
_WALKED = "SELECT l_orderkey * 5 + 1 AS src, l_partkey * 5 AS dst, l_returnflag = 'N' AS half FROM {lineitem} UNION ALL SELECT o_custkey * 5 + 2, o_orderkey * 5 + 1, o_orderstatus = 'F' FROM {orders} UNION ALL SELECT CAST(c_nationkey AS BIGINT) * 5 + 3, c_custkey * 5 + 2, FALSE FROM {customer} UNION ALL SELECT CAST(n_regionkey AS BIGINT) * 5 + 4, CAST(n_nationkey AS BIGINT) * 5 + 3, FALSE FROM {nation}"
_COMPARED = "SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'added' WHEN o_orderpriority = '2-HIGH' THEN 'removed' WHEN o_orderpriority = '3-MEDIUM' THEN 'renamed' ELSE 'modified' END AS status, concat('f', o_orderkey) AS filename, CASE WHEN o_orderpriority = '3-MEDIUM' THEN concat('f', o_custkey) END AS previous_filename FROM {orders}"
_LOG = "SELECT concat('s', o_orderkey) AS sha, concat('u', o_custkey) AS author, o_orderdate AS at, -o_orderkey AS ord FROM {orders}"

_calls, _contains, _holders, _walked, _compared, _log, _chunks, _nodes, _symbols = map(plan, (_CALLS, _CONTAINS, _HOLDERS, _WALKED, _COMPARED, _LOG, _CHUNKS, _NODES, _SYMBOLS))


def chunk_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = passages.prefixed(F.lit("repo"), F.concat(F.lit("src\\"), F.col("path")))
    return _chunks(spark, sf_dir).select("chunk_id", passages.title(path, F.col("symbol_name"), F.lit(None).cast("string")).alias("title"), passages.breadcrumb(passages.unprefixed(path)).alias("breadcrumb"))


def chunk_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(passages.summary(F.col("text"))).alias("summary_md5"))


def matched_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    b = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("question"))
    return d.join(b, "doc_id").select("doc_id", F.array_join(passages.matched_terms(F.col("question"), F.col("text")), ",").alias("terms"))


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    x = chunks.windows(d, 20, 4).select("doc_id", F.concat(F.lit("repo:d"), "doc_id").alias("path"), "start_line", "end_line", F.col("chunk").alias("text"), F.col("start_line").alias("rank"))
    return passages.expanded(x, d.select(F.concat(F.lit("d"), "doc_id").alias("path"), F.col("text").alias("content")), 10)


def expanded_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).select("doc_id", "start_line", F.md5("context").alias("context_md5"))


def assembled_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.assembled(_windows(spark, sf_dir), "doc_id").select("doc_id", F.md5("context").alias("context_md5"), "sources")


def followup_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.followups(_chunks(spark, sf_dir).withColumn("path", F.concat(F.lit("lib/"), "path")).withColumn("start_line", F.col("start_line").cast("int")), "start_line", "chunk_id").select("start_line", F.col("ord").cast("bigint").alias("ord"), "question")


def answer_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.diversity(_chunks(spark, sf_dir).withColumn("language", F.col("parent_class")), "start_line")


def distinct_in_meaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the hundred vectors of each label nearest to the first one, those that aren't like a nearer one."""
    v = load(spark, sf_dir, "embeddings")
    near = vectors.nearest_per_group(v, v.orderBy("vec_id").limit(1), "label", 100).select("vec_id", "rank")
    return passages.distinct_in_meaning(v.join(near, "vec_id"), "label", "rank", 0.3)


def file_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return call_stats.file_dependencies(_calls(spark, sf_dir))


def call_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return call_stats.payload(_calls(spark, sf_dir))


def class_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return call_stats.structures(_holders(spark, sf_dir), _contains(spark, sf_dir)).withColumn("children", F.array_join("children", ","))


def kinds_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return call_stats.kinds_per_file(_symbols(spark, sf_dir))


def _depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _walked(spark, sf_dir)
    entries = e.select(F.col("src").alias("node")).distinct().join(e.select(F.col("dst").alias("node")), "node", "left_anti")
    return call_stats.depths(e.where("NOT half"), e.where("half"), entries)


def call_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _depths(spark, sf_dir)


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), (F.col("p_partkey") * 5).alias("fqn"))
    return call_stats.reading_order(s, _depths(spark, sf_dir))


def file_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return call_stats.file_tree(_nodes(spark, sf_dir).select(F.concat(F.lit("src/"), F.replace("id", F.lit(":"), F.lit("/"))).alias("path")))


def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.counted(load(spark, sf_dir, "events"), "1 hour", slide="20 minutes")


def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.sessions(load(spark, sf_dir, "events"), "6 hours")


def changed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.changes(_compared(spark, sf_dir))


def refreshed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = load(spark, sf_dir, "customer").select(F.concat(F.lit("f"), "c_custkey").alias("path"), F.lit("old").alias("version"))
    return events.refreshed(old, "b", "a", lambda: _compared(spark, sf_dir), lambda paths: paths.withColumn("version", F.lit("new")))


def counted_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits since the order in the middle of the keys, counted on a state of one commit each customer."""
    log = _log(spark, sf_dir)
    last = log.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY ord)").alias("ord")).first().ord
    fresh = events.fresh_commits(log, None if last is None else f"s{-int(last)}")
    state = load(spark, sf_dir, "customer").select(F.concat(F.lit("u"), "c_custkey").alias("author"), F.lit(1).cast("bigint").alias("commits"), F.lit("2000-01-01").cast("date").alias("first"), F.lit("2000-01-01").cast("date").alias("last"))
    lines = load(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_orderkey").alias("sha"), F.col("l_quantity").cast("bigint").alias("added"), F.col("l_linenumber").cast("bigint").alias("deleted")).join(fresh.select("sha", "author"), "sha")
    return events.counted_on(state, fresh.withColumn("at", F.col("at").cast("date")), lines).withColumnsRenamed({"first": "first_at", "last": "last_at"})


_QUERIES = [chunk_titles, chunk_summaries, matched_terms, expanded_context, assembled_context, followup_questions, answer_diversity, distinct_in_meaning, file_dependencies, call_payload, class_structures, kinds_per_file, call_depths, reading_order, file_tree, sliding_counts, session_counts, changed_paths, refreshed_rows, counted_on]

QUERIES = {f.__name__: f for f in _QUERIES}

_LINES = "regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+')"
_W = f"""l AS (SELECT doc_id, string_split(text, chr(10)) AS lines, {_LINES} AS kept FROM documents WHERE text IS NOT NULL),
    k AS (SELECT *, unnest(range(0, CAST(greatest(0, ceil((len(lines) - 20) / 16)) AS BIGINT) + 1)) AS k FROM l),
    w AS (SELECT doc_id, k * 16 + 1 AS s, least(k * 16 + 20, len(lines)) AS e, array_to_string(list_slice(lines, k * 16 + 1, k * 16 + 20), chr(10)) AS chunk, array_to_string(list_slice(kept, greatest(0, k * 16 + 1 - 10) + 1, least(len(kept), least(k * 16 + 20, len(lines)) + 10)), '') AS context FROM k)"""
_DEPTHS = f"e AS ({_duck(_WALKED)}), n AS (SELECT DISTINCT src AS node, 0 AS steps FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT dst, steps + CASE WHEN half THEN 1 ELSE 2 END FROM n JOIN e ON src = node), m AS (SELECT node, min(steps) / 2.0 AS depth FROM n GROUP BY node)"
_CHANGED = f"r AS ({_duck(_COMPARED)}), u AS (SELECT filename AS path, CASE status WHEN 'added' THEN 1 WHEN 'removed' THEN 2 ELSE 0 END AS k FROM r UNION ALL SELECT previous_filename, 2 FROM r WHERE status = 'renamed'), h AS (SELECT path, CASE min(k) WHEN 0 THEN 'modified' WHEN 1 THEN 'added' ELSE 'removed' END AS change FROM u GROUP BY path)"

ORACLES = {
    "chunk_titles": f"SELECT chunk_id, 'repo:src/' || path || ' → ' || coalesce(nullif(symbol_name, ''), 'chunk') AS title, 'src › ' || path AS breadcrumb FROM ({_duck(_CHUNKS)}) x",
    "chunk_summaries": """WITH l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\r\\n|[\\n\\r]'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS lines FROM documents),
        c AS (SELECT doc_id, lines, list_filter(lines, lambda s: s[1] = '#' OR s[1:3] = '\"\"\"' OR s[1:3] = '''''''')[1] AS said FROM l)
        SELECT doc_id, md5(CASE WHEN said IS NOT NULL THEN trim(trim(trim(trim(said, '# ')), '"'), '''') WHEN len(lines) > 0 THEN lines[1][1:120] ELSE 'Code chunk with no visible content.' END) AS summary_md5 FROM c""",
    "matched_terms": "WITH t AS (SELECT doc_id, regexp_extract_all(lower(b.text), '[a-z_][A-Za-z0-9_]*') AS a, regexp_extract_all(lower(coalesce(d.text, '')), '[a-z_][A-Za-z0-9_]*') AS b FROM documents d JOIN benchmark b ON doc_id = item_id) SELECT doc_id, array_to_string(list_sort(list_distinct(list_intersect(a, b)))[1:10], ',') AS terms FROM t",
    "expanded_context": f"WITH {_W} SELECT doc_id, CAST(s AS INTEGER) AS start_line, md5(context) AS context_md5 FROM w",
    "assembled_context": f"""WITH {_W}, p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS i FROM w)
        SELECT doc_id, md5(string_agg('### Source ' || i || ': repo:d' || doc_id || ' (' || s || '–' || e || ')' || chr(10) || substr(chunk || chr(10) || chr(10) || '# Additional Context' || chr(10) || context, 1, 1200), chr(10) || chr(10) || '-----' || chr(10) || chr(10) ORDER BY i)) AS context_md5,
        string_agg(i || '. repo:d' || doc_id || ': ' || s || '–' || e, chr(10) ORDER BY i) AS sources FROM p GROUP BY doc_id""",
    "followup_questions": f"""WITH c AS (SELECT chunk_id, start_line, path AS file, replace(path, '.py', '') AS module, coalesce(symbol_name, '') AS sy, coalesce(parent_class, '') AS pa FROM ({_duck(_CHUNKS)}) x),
        q AS (SELECT chunk_id, start_line, unnest(range(6)) AS rule, unnest([CASE WHEN sy <> '' THEN sy || ' implementation in ' || file END, CASE WHEN sy <> '' THEN sy || ' usage ' || module END, CASE WHEN pa <> '' THEN pa || ' class methods in ' || file END, CASE WHEN pa <> '' THEN pa || ' initialization ' || module END,
            trim(module || ' logic ' || CASE WHEN sy <> '' THEN sy ELSE pa END), replace('lib ' || CASE WHEN sy <> '' THEN sy ELSE pa END || ' flow', '  ', ' ')]) AS question FROM c),
        f AS (SELECT start_line, question, min(chunk_id * 10 + rule) AS place FROM q WHERE question IS NOT NULL GROUP BY ALL)
        SELECT start_line, ord, question FROM (SELECT *, row_number() OVER (PARTITION BY start_line ORDER BY place) AS ord FROM f) y WHERE ord <= 3""",
    "answer_diversity": f"SELECT start_line, count(DISTINCT path) AS files, count(DISTINCT symbol_name) AS symbols, count(DISTINCT parent_class) AS languages FROM ({_duck(_CHUNKS)}) x GROUP BY start_line",
    "file_dependencies": f"WITH c AS (SELECT DISTINCT split_part(caller, ':', 1) AS file, CASE WHEN contains(callee, ':') THEN split_part(callee, ':', 1) ELSE 'unknown' END AS depends_on FROM ({_duck(_CALLS)}) x) SELECT file, depends_on FROM c WHERE file <> depends_on UNION ALL SELECT file, NULL FROM c GROUP BY file HAVING bool_and(file = depends_on)",
    "call_payload": f"""WITH c AS (SELECT DISTINCT caller, callee FROM ({_duck(_CALLS)}) x), i AS (SELECT * FROM c WHERE contains(callee, ':')), n AS (SELECT caller AS node FROM c UNION SELECT callee FROM i)
        SELECT count(*) AS functions, (SELECT count(*) FROM i) AS edges, count(*) FILTER (WHERE node NOT IN (SELECT callee FROM i)) AS entry_points, (SELECT max(k) FROM (SELECT count(*) AS k FROM i GROUP BY caller) z) AS max_fan_out FROM n""",
    "class_structures": f"""WITH n AS ({_duck(_HOLDERS)}), c AS ({_duck(_CONTAINS)}), t AS (SELECT id, name, file, (SELECT count(*) FROM c WHERE src = id) AS contained FROM n WHERE type = 'class' ORDER BY contained DESC, name, file, id LIMIT 20),
        k AS (SELECT src, n.name, n.type, dst, row_number() OVER (PARTITION BY src ORDER BY n.type, n.name, dst) AS k FROM c JOIN n ON n.id = dst)
        SELECT id, name, file, contained, coalesce((SELECT string_agg(k.name, ',' ORDER BY k.k) FROM k WHERE src = id AND k.k <= 25), '') AS children FROM t""",
    "kinds_per_file": f"SELECT path, count(*) AS symbols, count(*) FILTER (WHERE kind = 'class') AS classes, count(*) FILTER (WHERE kind = 'function') AS functions, count(*) FILTER (WHERE kind = 'method') AS methods FROM ({_duck(_SYMBOLS)}) x GROUP BY path",
    "call_depths": f"WITH RECURSIVE {_DEPTHS} SELECT node, CAST(depth AS DOUBLE) AS depth FROM m",
    "reading_order": f"WITH RECURSIVE {_DEPTHS} SELECT p_brand AS path, CAST(min(depth) AS DOUBLE) AS min_depth, count(*) AS symbols FROM part LEFT JOIN m ON node = p_partkey * 5 GROUP BY p_brand",
    "file_tree": f"""WITH s AS (SELECT DISTINCT string_split('src/' || replace(id, ':', '/'), '/') AS p FROM ({_duck(_NODES)}) x), k AS (SELECT p, unnest(range(1, len(p) + 1)) AS k FROM s)
        SELECT DISTINCT array_to_string(p[1:k - 1], '/') AS folder, p[k] AS name, k = len(p) AS is_file FROM k""",
    "sliding_counts": "WITH w AS (SELECT *, unnest([0, 20, 40]) AS back FROM events) SELECT time_bucket(INTERVAL '20 minutes', ts) - to_minutes(back) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2",
    "session_counts": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '6 hours' AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
    "changed_paths": f"WITH {_CHANGED} SELECT path, change FROM h",
    "refreshed_rows": f"WITH {_CHANGED} SELECT path, 'new' AS version FROM h WHERE change <> 'removed' UNION ALL SELECT 'f' || c_custkey, 'old' FROM customer WHERE 'f' || c_custkey NOT IN (SELECT path FROM h)",
    "counted_on": """WITH m AS (SELECT quantile_disc(-o_orderkey, 0.5) AS ord FROM orders), f AS (SELECT o.* FROM orders o, m WHERE -o_orderkey < ord), s AS (SELECT 'u' || c_custkey AS author, 1 AS n, DATE '2000-01-01' AS day FROM customer UNION ALL SELECT 'u' || o_custkey, 1, CAST(o_orderdate AS DATE) FROM f),
        d AS (SELECT 'u' || o_custkey AS author, sum(CAST(l_quantity AS BIGINT)) AS added, sum(l_linenumber) AS deleted FROM f JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
        SELECT s.author, CAST(sum(n) AS BIGINT) AS commits, min(day) AS first_at, max(day) AS last_at, CAST(coalesce(max(added), 0) AS BIGINT) AS added, CAST(coalesce(max(deleted), 0) AS BIGINT) AS deleted FROM s LEFT JOIN d ON d.author = s.author GROUP BY s.author""",
}
