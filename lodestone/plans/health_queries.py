"""Registered queries of code health, contributors, resolution and the scan filter, with SQL written apart.

The tables that stand in for file metrics, commits and symbols are made of whole driver tables by the same text in both
dialects (``_FILES`` and the like); what is computed from them is not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import contributors, file_stats, health, resolution
from lodestone.sources import files

from .dialect import load, oracle, plan

_FILES = """SELECT CASE WHEN p_partkey % 50 = 0 THEN concat('f', p_partkey, '.py') WHEN p_partkey % 97 = 0 THEN concat('__f', p_partkey, '.py') ELSE concat('m', p_size % 7, '/f', p_partkey, '.py') END AS path,
    CASE WHEN p_partkey % 41 = 0 THEN p_size * 60 + 900 ELSE p_size * 8 END AS loc, p_size * 5 AS loc_code, p_size AS loc_blank, p_size % 9 AS loc_comment, p_size % 11 AS num_functions, p_size % 4 AS num_classes,
    p_partkey * 7 % 23 AS cyclomatic_complexity, CAST(p_partkey * 13 % 120 AS DOUBLE) AS average_function_length, CAST(p_partkey * 11 % 101 AS DOUBLE) AS docstring_coverage, CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE p_partkey * 3 % 31 END AS fan_out, p_partkey % 4 AS fan_in FROM {part}"""
_SYMBOLS = "SELECT concat('repo:m', p_size % 7, '/f', p_partkey % 400, CASE WHEN p_partkey % 400 % 9 = 0 THEN '.txt' ELSE '.py' END) AS path, CASE WHEN p_partkey % 3 = 0 THEN 'class' WHEN p_partkey % 3 = 1 THEN 'function' ELSE 'method' END AS kind, p_size AS line, CASE WHEN p_partkey % 5 > 0 THEN p_size + p_partkey % 60 END AS end_line, CASE WHEN p_partkey % 2 = 0 THEN 'doc' END AS docstring FROM {part}"
_COMMITS = "SELECT concat('s', o_orderkey) AS sha, CASE WHEN o_custkey % 37 = 0 THEN 'ci[bot]' WHEN o_orderkey % 3 = 0 THEN concat('u', o_custkey) ELSE concat('Ann ', o_custkey) END AS name, concat('user', o_custkey, '@x.org') AS email, o_orderdate AS at FROM {orders}"
_DETAILS = "SELECT concat('s', l_orderkey) AS sha, concat(CASE WHEN l_linenumber = 7 THEN 'Build/f' ELSE 'src/f' END, l_partkey, CASE WHEN l_returnflag = 'R' THEN '.py' WHEN l_returnflag = 'A' THEN '.min.js' ELSE '.PNG' END) AS path, CAST(l_quantity AS BIGINT) AS added, CAST(l_linenumber AS BIGINT) AS deleted FROM {lineitem}"
_WORD = "substr(p_name, 1, instr(concat(p_name, ' '), ' ') - 1)"
_SCOPES = "SELECT concat('r', r_regionkey) AS scope, 'global' AS parent FROM {region} UNION ALL SELECT concat('r', n_regionkey, ':n', n_nationkey), concat('r', n_regionkey) FROM {nation} UNION ALL SELECT 'global', NULL"
_NAMED = f"SELECT CASE WHEN p_partkey % 3 = 0 THEN 'global' WHEN p_partkey % 3 = 1 THEN concat('r', n_regionkey) ELSE concat('r', n_regionkey, ':n', n_nationkey) END AS scope, {_WORD} AS name, CAST(p_partkey AS STRING) AS fqn, CASE WHEN p_size % 3 > 0 THEN replace(p_brand, '#', '') END AS type_hint, p_partkey AS ord FROM {{part}} JOIN {{nation}} ON n_nationkey = p_size % 25"
_MEMBERS = "SELECT concat('k:', replace(p_brand, '#', '')) AS scope, concat('a', p_size % 5) AS name, concat('k', p_partkey) AS fqn, CAST(NULL AS STRING) AS type_hint, p_partkey AS ord FROM {part}"
_USES = f"SELECT c_custkey AS use_id, concat('r', n_regionkey, ':n', n_nationkey) AS scope, {_WORD} AS name, concat('a', c_custkey % 7) AS attr FROM {{customer}} JOIN {{nation}} ON n_nationkey = c_nationkey JOIN {{part}} ON p_partkey = c_custkey"
_NODES = f"SELECT CASE WHEN p_partkey % 11 = 0 THEN concat('f', p_size, '.py:', {_WORD}) ELSE concat('f', p_size, '.py:', CASE WHEN p_partkey % 2 = 0 THEN 'K:' ELSE 'g:' END, p_partkey) END AS id, concat('f', p_size, '.py') AS file, {_WORD} AS name, CAST(p_partkey % 300 AS INT) AS line FROM {{part}}"
_CHUNKS = f"SELECT c_custkey AS chunk_id, concat('f', p_size, '.py') AS path, CAST(c_custkey % 280 AS INT) AS start_line, CAST(c_custkey % 280 + 40 AS INT) AS end_line, CASE WHEN c_custkey % 13 > 0 THEN {_WORD} END AS symbol_name, CASE WHEN c_custkey % 2 = 0 THEN 'K' END AS parent_class, c_acctbal AS rank FROM {{customer}} JOIN {{part}} ON p_partkey = c_custkey"


_files, _symbols, _commits, _details, _scopes, _named, _members, _uses, _nodes, _chunks = map(plan, (_FILES, _SYMBOLS, _COMMITS, _DETAILS, _SCOPES, _NAMED, _MEMBERS, _USES, _NODES, _CHUNKS))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*((F.round(c, 6) if t == "double" else F.col(c)).alias(c) for c, t in df.dtypes))


def fs_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(health.modules(_files(spark, sf_dir)))


def fs_repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(health.repository(_files(spark, sf_dir)))


def fs_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(health.overall(_files(spark, sf_dir), 0.1))


def fs_file_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(health.file_scores(_files(spark, sf_dir))).select("path", "score", "grade")


def fs_score_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.score_deciles(_rounded(health.file_scores(_files(spark, sf_dir))))


def fs_smells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(health.smells(_files(spark, sf_dir))).select("type", "path", "severity", "value", "threshold")


def fs_smell_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.smell_counts(health.smells(_files(spark, sf_dir)))


def fs_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = health.suggestions(health.smells(_files(spark, sf_dir)))
    return x.select("type", "path", "effort", "priority", F.array_join("strategies", "; ").alias("strategies"))


def fs_first_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.ranked_suggestions(health.smells(_files(spark, sf_dir))).select("type", "path", "priority")


def fs_enhanced_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.enhanced_suggestions(health.smells(_files(spark, sf_dir)))


def fs_enhanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir)
    return _rounded(health.enhanced(f, f.select(F.col("path").alias("caller"), "fan_out"), "java").withColumn("priorities", F.array_join("priorities", ",")))


def fs_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.risks(_files(spark, sf_dir)).select("path", "risk_score", F.size("reasons").alias("n_reasons"))


def fs_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(health.trends(_files(spark, sf_dir)))


def fs_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _rounded(health.payload(_files(spark, sf_dir)))
    return x.select("overall_score", "grade", "num_files", "num_smells", F.size("suggestions").alias("n_suggestions"), F.col("lowest_files")[0]["path"].alias("lowest"))


def fs_from_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = health.from_symbols(_symbols(spark, sf_dir), file_stats.language(F.col("path")))
    return _rounded(x).select("path", "loc", "loc_code", "loc_comment", "loc_blank", "num_functions", "num_classes", F.col("cyclomatic_complexity").cast("bigint").alias("cyclomatic_complexity"), "average_function_length", "docstring_coverage", "has_docstring")


def dead_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = load(spark, sf_dir, "part").select(F.concat(F.when(F.col("p_partkey") % 10 == 0, "_").otherwise(""), F.lit("n"), "p_partkey").alias("name"))
    callers = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_linenumber = 6").select(F.concat(F.lit("n"), "l_partkey").alias("name"))
    return health.dead_code(symbols, callers).select("unused", F.array_join("examples", ",").alias("examples"))


def contributor_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contributors.author_totals(_commits(spark, sf_dir), _details(spark, sf_dir)).drop("names")


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = contributor_totals(spark, sf_dir)
    number = F.regexp_extract("email", "([0-9]+)", 1).cast("bigint")
    return contributors.merged_totals(t, t.where(number % 2 == 0).select("email", F.concat(F.lit("p"), number % 100).alias("person")))


def contributor_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).withColumn("emails", F.array_join("emails", ","))


def contributor_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contributors.find_author(_merged(spark, sf_dir), "aNN 7").select("person", "name", "commits")


def author_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit(" "), "c_name"))
    mail = F.when(F.col("c_custkey") % 4 > 0, F.concat(F.lit("A+x"), "c_custkey", F.lit("@X.org ")))
    x = load(spark, sf_dir, "customer").select("c_custkey", contributors.identity(name, mail, F.when(F.col("c_custkey") % 5 == 0, "login"), F.lit(None).cast("string")).alias("i"))
    return x.select("c_custkey", "i.name", "i.email", contributors.username(F.col("i.email")).alias("username"))


def resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.lookup(_uses(spark, sf_dir), _named(spark, sf_dir), _scopes(spark, sf_dir)).select("use_id", "fqn", "distance")


def resolve_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = _named(spark, sf_dir).unionByName(_members(spark, sf_dir))
    return resolution.attributes(_uses(spark, sf_dir), symbols, _scopes(spark, sf_dir)).select("use_id", "attr", "attr_fqn")


def chunk_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.nodes_of_chunks(_chunks(spark, sf_dir), _nodes(spark, sf_dir)).select("chunk_id", "node")


def node_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = resolution.nodes_of_chunks(_chunks(spark, sf_dir), _nodes(spark, sf_dir))
    return resolution.chunks_of_nodes(_nodes(spark, sf_dir).select(F.col("id").alias("node")).distinct(), mapped).groupBy("node").agg(F.count("*").alias("chunks"), F.min("chunk_id").alias("first"))


def anchored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chunks(spark, sf_dir).select("chunk_id", "path", (F.col("start_line") % 5).alias("start_line"), "end_line", F.struct("rank", "chunk_id").alias("rank"))
    return resolution.anchors_then_expanded(c.where("chunk_id % 2 = 0"), c).select("path", "start_line", "chunk_id", "is_anchor")


def chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chunks(spark, sf_dir).select("chunk_id", "path", (F.col("start_line") % 5).alias("start_line"), F.lit(9).alias("end_line"), F.struct("rank", "chunk_id").alias("rank"))
    return resolution.distinct_chunks(c).select("path", "start_line", "chunk_id")


def scan_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _details(spark, sf_dir).select("path").distinct().withColumn("path", F.concat("path", F.when(F.length("path") % 2 == 0, ".Go").otherwise("")))
    return x.where(files.scannable(F.col("path"), F.lit(10)))


_QUERIES = [fs_modules, fs_repository, fs_overall, fs_file_scores, fs_score_deciles, fs_smells, fs_smell_counts, fs_suggestions, fs_first_suggestions, fs_enhanced_suggestions, fs_enhanced, fs_risks, fs_trends, fs_payload, fs_from_symbols, dead_symbols]
_QUERIES += [contributor_totals, contributor_merged, contributor_lookup, author_identities, resolve_names, resolve_attributes, chunk_nodes, node_chunks, anchored_documents, chunk_dedup, scan_paths]
QUERIES = {f.__name__: f for f in _QUERIES}


def _duck(sql: str) -> str:
    return oracle(sql).replace("AS STRING", "AS VARCHAR")


_F = f"WITH f AS ({_duck(_FILES)}), r AS (SELECT avg(loc) AS m, avg(fan_out) AS fo FROM f)"
_SCORE = "least(100, greatest(0, (greatest(0, (15 - cyclomatic_complexity) / 15) * 0.4 + greatest(0, (50 - average_function_length) / 50) * 0.3 + docstring_coverage / 100 * 0.3) * 100))"
_HOT = "least(cyclomatic_complexity / 10, 1) * 0.4 + least(loc / 500, 1) * 0.3 + least(fan_out / 20, 1) * 0.3"
_SMELLS = f"""{_F}, h AS (SELECT path, num_functions, num_classes, {_HOT} AS v FROM f WHERE {_HOT} > 0.5 ORDER BY v DESC, path LIMIT 5),
s AS (SELECT 'God File' AS type, path, CASE WHEN loc > 6 * m THEN 'high' ELSE 'medium' END AS severity, CAST(loc AS DOUBLE) AS value, 3 * m AS threshold, num_functions, num_classes FROM f, r WHERE loc > 3 * m
 UNION ALL SELECT 'Long Functions', path, CASE WHEN average_function_length < 100 THEN 'medium' ELSE 'high' END, average_function_length, 50, num_functions, num_classes FROM f WHERE average_function_length > 50
 UNION ALL SELECT 'High Cyclomatic Complexity', path, CASE WHEN cyclomatic_complexity > 15 THEN 'critical' ELSE 'high' END, cyclomatic_complexity, 10, num_functions, num_classes FROM f WHERE cyclomatic_complexity > 10
 UNION ALL SELECT 'Tight Coupling', path, 'medium', fan_out, 2 * fo, num_functions, num_classes FROM f, r WHERE fan_out > 2 * fo
 UNION ALL SELECT 'Orphaned File', path, 'medium', 0, 0, num_functions, num_classes FROM f WHERE fan_in = 0 AND fan_out = 0 AND NOT starts_with(path, '__')
 UNION ALL SELECT 'Change Hotspot', path, CASE WHEN v < 0.7 THEN 'medium' ELSE 'high' END, v, 0.5, num_functions, num_classes FROM h)"""
_PLAN = """CASE type WHEN 'God File' THEN 'high' WHEN 'Tight Coupling' THEN 'high' WHEN 'Change Hotspot' THEN 'high' WHEN 'Orphaned File' THEN 'low' ELSE 'medium' END AS effort,
 CASE type WHEN 'Tight Coupling' THEN 'medium' WHEN 'Orphaned File' THEN 'low' ELSE 'high' END AS priority"""
_DIMENSIONS = f"""{_F}, t AS (SELECT count(*) AS n, sum(loc) AS loc, sum(loc_code) AS code, sum(loc_comment) AS comments, avg(cyclomatic_complexity) AS cc, sum(average_function_length * num_functions) / greatest(sum(num_functions), 1) AS len, avg(docstring_coverage) AS doc FROM f),
g AS (SELECT count(*) AS gods FROM f, r WHERE loc > 3 * m),
d AS (SELECT (greatest(0, (15 - cc) / 15) * 0.6 + greatest(0, (50 - len) / 50) * 0.4) * 100 AS maintainability, least(100, greatest(0, greatest(0, (20 - fo) / 20) * 100 - gods / n * 30)) AS modularity,
 least(100, doc * 0.6 + least(100, comments / greatest(code, 1) / 0.3 * 100) * 0.4) AS readability, greatest(0, (15 - cc) / 15) * 100 AS change_risk, greatest(0, greatest(0, (15 - loc / n) / 15) * 100 - CYCLES * 20) AS dependency_hygiene FROM t, g, r),
o AS (SELECT *, 0.25 * maintainability + 0.25 * modularity + 0.25 * readability + 0.15 * change_risk + 0.1 * dependency_hygiene AS overall_score FROM d)"""
_GRADE = "CASE WHEN {0} >= 80 THEN 'A' WHEN {0} >= 60 THEN 'B' WHEN {0} >= 40 THEN 'C' ELSE 'D' END"
_MODULE = "CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE 'root' END"
_TOTALS = f"""WITH c AS (SELECT * FROM ({_duck(_COMMITS)}) x WHERE name <> 'ci[bot]'), d AS (SELECT * FROM ({_duck(_DETAILS)}) x WHERE NOT starts_with(path, 'Build') AND path LIKE '%.py'),
l AS (SELECT email, CAST(sum(added) AS BIGINT) AS lines_added, CAST(sum(deleted) AS BIGINT) AS lines_deleted, count(DISTINCT path) AS files_changed FROM c JOIN d USING (sha) GROUP BY email),
w AS (SELECT email, count(*) AS commits, min(c.at) AS first_commit, max(c.at) AS last_commit, coalesce(max(CASE WHEN name LIKE '% %' THEN name END), max(name)) AS display FROM c GROUP BY email),
totals AS (SELECT email, commits, first_commit, last_commit, coalesce(lines_added, 0) AS lines_added, coalesce(lines_deleted, 0) AS lines_deleted, coalesce(files_changed, 0) AS files_changed, coalesce(lines_added, 0) - coalesce(lines_deleted, 0) AS net_lines, display FROM w LEFT JOIN l USING (email)),
p AS (SELECT *, CAST(regexp_extract(email, '([0-9]+)', 1) AS BIGINT) AS k FROM totals),
merged AS (SELECT CASE WHEN k % 2 = 0 THEN concat('p', k % 100) ELSE email END AS person, CAST(sum(commits) AS BIGINT) AS commits, CAST(sum(files_changed) AS BIGINT) AS files_changed, CAST(sum(lines_added) AS BIGINT) AS lines_added, CAST(sum(lines_deleted) AS BIGINT) AS lines_deleted, CAST(sum(net_lines) AS BIGINT) AS net_lines,
 min(first_commit) AS first_commit, max(last_commit) AS last_commit, string_agg(email, ',' ORDER BY email) AS emails, coalesce(min(CASE WHEN display LIKE '% %' THEN display END), min(display)) AS name FROM p GROUP BY 1)"""
_LOOKUP = f"""WITH s AS ({_duck(_NAMED)}), m AS ({_duck(_MEMBERS)}), u AS ({_duck(_USES)}),
c AS (SELECT use_id, name, attr, unnest([scope, split_part(scope, ':', 1), 'global']) AS at, unnest([0, 1, 2]) AS distance FROM u),
b AS (SELECT use_id, fqn, type_hint, distance FROM (SELECT c.use_id, fqn, type_hint, c.distance, row_number() OVER (PARTITION BY c.use_id ORDER BY c.distance, ord DESC) AS k FROM c JOIN s ON s.scope = c.at AND s.name = c.name) x WHERE k = 1)"""
_NEAREST = f"""WITH c AS ({_duck(_CHUNKS)}), n AS ({_duck(_NODES)}),
e AS (SELECT DISTINCT chunk_id, id AS node FROM c JOIN n ON id = concat(path, ':', symbol_name) WHERE symbol_name IS NOT NULL),
x AS (SELECT chunk_id, id, CASE WHEN parent_class IS NULL OR contains(id, concat(':', parent_class, ':')) THEN 0 ELSE 1 END AS p, CASE WHEN start_line = 0 OR line = 0 OR line BETWEEN start_line AND end_line THEN 0 ELSE least(abs(line - start_line), abs(line - end_line)) END AS d FROM c JOIN n ON path = file AND symbol_name = name),
y AS (SELECT chunk_id, id AS node FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY p, d, id) AS k FROM x WHERE chunk_id NOT IN (SELECT chunk_id FROM e)) z WHERE k = 1),
g AS (SELECT * FROM e UNION ALL SELECT * FROM y)"""

ORACLES = {
    "fs_modules": f"{_F} SELECT {_MODULE} AS module, count(*) AS num_files, CAST(sum(loc) AS BIGINT) AS loc, CAST(sum(loc_code) AS BIGINT) AS loc_code, CAST(sum(num_functions) AS BIGINT) AS num_functions, CAST(sum(num_classes) AS BIGINT) AS num_classes, round(avg(cyclomatic_complexity), 6) AS avg_cyclomatic_complexity, round(avg(average_function_length), 6) AS avg_function_length FROM f GROUP BY 1",
    "fs_repository": f"{_F} SELECT count(*) AS num_files, CAST(sum(loc) AS BIGINT) AS total_loc, CAST(sum(loc_code) AS BIGINT) AS total_loc_code, CAST(sum(loc_comment) AS BIGINT) AS total_loc_comment, CAST(sum(loc_blank) AS BIGINT) AS loc_blank, CAST(sum(num_functions) AS BIGINT) AS num_functions, CAST(sum(num_classes) AS BIGINT) AS num_classes, count(DISTINCT {_MODULE}) AS num_modules, round(sum(average_function_length * num_functions) / greatest(sum(num_functions), 1), 6) AS avg_function_length, round(sum(loc) / greatest(sum(num_classes), 1), 6) AS avg_class_size, round(sum(loc_comment) / greatest(sum(loc_code), 1), 6) AS comment_to_code_ratio, round(sum(cyclomatic_complexity) / count(*), 6) AS avg_cyclomatic_complexity FROM f",
    "fs_overall": f"{_DIMENSIONS.replace('CYCLES', '0.1')} SELECT round(maintainability, 6) AS maintainability, round(modularity, 6) AS modularity, round(readability, 6) AS readability, round(change_risk, 6) AS change_risk, round(dependency_hygiene, 6) AS dependency_hygiene, round(overall_score, 6) AS overall_score, {_GRADE.format('overall_score')} AS grade, CASE WHEN overall_score >= 80 THEN 'Excellent' WHEN overall_score >= 60 THEN 'Good' WHEN overall_score >= 40 THEN 'Fair' ELSE 'Poor' END AS level FROM o",
    "fs_file_scores": f"{_F}, s AS (SELECT path, {_SCORE} AS score FROM f) SELECT path, round(score, 6) AS score, {_GRADE.format('score')} AS grade FROM s",
    "fs_score_deciles": f"{_F}, s AS (SELECT round({_SCORE}, 6) AS score FROM f) SELECT CAST(floor(score / 10) * 10 AS INTEGER) AS decile, count(*) AS files FROM s GROUP BY 1",
    "fs_smells": f"{_SMELLS} SELECT type, path, severity, round(value, 6) AS value, round(threshold, 6) AS threshold FROM s",
    "fs_smell_counts": f"{_SMELLS} SELECT type, severity, count(*) AS n FROM s GROUP BY 1, 2",
    "fs_suggestions": f"""{_SMELLS} SELECT type, path, {_PLAN}, CASE type WHEN 'God File' THEN concat(CASE WHEN num_classes > 1 THEN 'Split by Class; ' ELSE '' END, CASE WHEN num_functions > 5 THEN 'Split by Functionality; ' ELSE '' END, 'Extract to Package')
        WHEN 'Long Functions' THEN 'Extract Helper Methods; Extract to Separate Functions; Use Guard Clauses' WHEN 'High Cyclomatic Complexity' THEN 'Extract Methods; Use Polymorphism; Simplify Logic'
        WHEN 'Tight Coupling' THEN 'Extract Interface/Abstract Class; Apply Dependency Injection; Reorganize Module Structure' WHEN 'Orphaned File' THEN 'Remove Orphaned File; Integrate Into Existing Module; Establish Connections'
        ELSE 'Stabilize Through Refactoring; Isolate Volatile Code; Improve Test Coverage' END AS strategies FROM s""",
    "fs_first_suggestions": f"{_SMELLS}, q AS (SELECT type, path, {_PLAN} FROM s) SELECT type, path, priority FROM q ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, type, path LIMIT 20",
    "fs_enhanced_suggestions": f"{_SMELLS} SELECT type, path, severity, effort, impact_score FROM (SELECT type, path, severity, {_PLAN}, CASE type WHEN 'God File' THEN 85 WHEN 'Long Functions' THEN 75 WHEN 'High Cyclomatic Complexity' THEN 80 WHEN 'Tight Coupling' THEN 70 WHEN 'Change Hotspot' THEN 90 END AS impact_score FROM s WHERE type <> 'Orphaned File') q UNION ALL SELECT 'Preventive - Architecture', NULL, 'medium', 'medium', 60 UNION ALL SELECT 'Preventive - Testing', NULL, 'medium', 'medium', 65",
    "fs_enhanced": f"""{_F}, a AS (SELECT avg(cyclomatic_complexity) AS cc, avg(average_function_length) AS len, avg(docstring_coverage / 100) AS doc, avg(loc) AS loc, max(loc) AS most, avg(fan_out) AS fo FROM f),
        b AS (SELECT *, CASE WHEN cc >= 10 THEN 100 WHEN cc >= 15 THEN 75 WHEN cc >= 20 THEN 50 ELSE 25 END AS complexity, CASE WHEN len <= 30 THEN 100 WHEN len <= 60 THEN 75 WHEN len <= 120 THEN 50 ELSE 25 END AS function_length, CASE WHEN doc >= 0.8 THEN 100 WHEN doc >= 0.5 THEN 75 WHEN doc >= 0.2 THEN 50 ELSE 25 END AS documentation, greatest(0, 100 - fo * 2) AS modularity, greatest(0, 100 - cc * 3) AS testing FROM a),
        s AS (SELECT *, complexity * 0.3 + function_length * 0.2 + documentation * 0.2 + modularity * 0.15 + testing * 0.15 AS score FROM b)
        SELECT complexity, function_length, documentation, round(modularity, 6) AS modularity, round(testing, 6) AS testing, round(CAST(score AS DOUBLE), 6) AS score, round(least(100, greatest(0, 171 - 5.2 * pow(cc, 1.5) - 0.023 * loc + 50 * doc)), 6) AS maintainability_index, CASE WHEN score >= 80 THEN 'Low' WHEN score >= 60 THEN 'Moderate' WHEN score >= 40 THEN 'High' ELSE 'Critical' END AS debt,
        concat_ws(',', CASE WHEN cc > 8 THEN 'complexity' END, CASE WHEN most > 500 THEN 'size' END, CASE WHEN doc < 0.5 THEN 'documentation' END) AS priorities FROM s""",
    "fs_risks": f"{_F}, m AS (SELECT path, CAST(cyclomatic_complexity > 10 AS INT) AS a, CAST(loc > 500 AS INT) AS b, CAST(docstring_coverage < 30 AS INT) AS c FROM f) SELECT path, 30 * a + 25 * b + 15 * c AS risk_score, a + b + c AS n_reasons FROM m WHERE a + b + c > 0",
    "fs_trends": f"{_F} SELECT round(stddev_samp(cyclomatic_complexity), 6) AS complexity_deviation, CASE WHEN stddev_samp(cyclomatic_complexity) < 3 THEN 'high' WHEN stddev_samp(cyclomatic_complexity) < 7 THEN 'medium' ELSE 'low' END AS consistency FROM f",
    "fs_payload": f"{_DIMENSIONS.replace('CYCLES', '0')}, {_SMELLS.split(', r AS ', 1)[1].split('FROM f),', 1)[1]} SELECT round(overall_score, 6) AS overall_score, {_GRADE.format('overall_score')} AS grade, (SELECT count(*) FROM f) AS num_files, (SELECT count(*) FROM s) AS num_smells, (SELECT CAST(least(20, count(*)) AS INTEGER) FROM s) AS n_suggestions, (SELECT path FROM f ORDER BY {_SCORE}, path LIMIT 1) AS lowest FROM o",
    "fs_from_symbols": f"""WITH s AS (SELECT substr(path, 6) AS path, kind, line, coalesce(end_line, line) AS e, docstring FROM ({_duck(_SYMBOLS)}) x WHERE path LIKE '%.py'), f AS (SELECT *, kind <> 'class' AS fn, greatest(1, e - line + 1) AS n FROM s)
        SELECT path, greatest(1, max(e)) AS loc, CAST(floor(greatest(1, max(e)) * 0.78) AS INTEGER) AS loc_code, CAST(floor(greatest(1, max(e)) * 0.10) AS INTEGER) AS loc_comment, CAST(floor(greatest(1, max(e)) * 0.12) AS INTEGER) AS loc_blank, count(*) FILTER (WHERE fn) AS num_functions, count(*) FILTER (WHERE NOT fn) AS num_classes,
        CAST(1 + count(*) FILTER (WHERE fn) + coalesce(sum(CASE WHEN fn THEN greatest(0, n - 10) // 5 END), 0) AS BIGINT) AS cyclomatic_complexity, round(coalesce(avg(CASE WHEN fn THEN n END), 0), 6) AS average_function_length, round(coalesce(avg(CASE WHEN fn THEN CASE WHEN docstring IS NULL THEN 0 ELSE 100 END END), 0), 6) AS docstring_coverage, bool_or(docstring IS NOT NULL) AS has_docstring FROM f GROUP BY path""",
    "dead_symbols": "WITH u AS (SELECT concat('n', p_partkey) AS name FROM part WHERE p_partkey % 10 <> 0 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 6)) SELECT count(*) AS unused, (SELECT string_agg(name, ',' ORDER BY name) FROM (SELECT name FROM u ORDER BY name LIMIT 10) x) AS examples FROM u HAVING count(*) > 0",
    "contributor_totals": f"{_TOTALS} SELECT * FROM totals",
    "contributor_merged": f"{_TOTALS} SELECT * FROM merged",
    "contributor_lookup": f"{_TOTALS} SELECT person, name, commits FROM merged WHERE contains(lower(name), 'ann 7') OR contains('ann 7', lower(name)) ORDER BY commits DESC, name LIMIT 1",
    "author_identities": """WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name WHEN c_custkey % 5 = 0 THEN 'login' WHEN c_custkey % 4 > 0 THEN concat('A+x', c_custkey, '@X.org') ELSE 'unknown' END AS name,
        CASE WHEN c_custkey % 4 > 0 THEN concat('a+x', c_custkey, '@x.org') WHEN c_custkey % 5 = 0 THEN 'login@users.noreply.github.com' WHEN c_custkey % 3 <> 0 THEN concat(lower(c_name), '@local') ELSE 'unknown@local' END AS email FROM customer)
        SELECT c_custkey, name, email, CASE WHEN contains(email, '+') THEN split_part(split_part(email, '+', 2), '@', 1) ELSE concat(upper(substr(email, 1, 1)), split_part(substr(email, 2), '@', 1)) END AS username FROM x""",
    "resolve_names": f"{_LOOKUP} SELECT u.use_id, fqn, distance FROM u LEFT JOIN b USING (use_id)",
    "resolve_attributes": f"{_LOOKUP}, h AS (SELECT b.use_id, m.fqn, row_number() OVER (PARTITION BY b.use_id ORDER BY m.scope, m.ord DESC) AS k FROM b JOIN u USING (use_id) JOIN m ON m.scope = concat('k:', b.type_hint) AND m.name = u.attr) SELECT u.use_id, u.attr, h.fqn AS attr_fqn FROM u LEFT JOIN h ON u.use_id = h.use_id AND k = 1",
    "chunk_nodes": f"{_NEAREST} SELECT c.chunk_id, node FROM c LEFT JOIN g USING (chunk_id)",
    "node_chunks": f"{_NEAREST} SELECT node, count(*) AS chunks, min(chunk_id) AS first FROM g GROUP BY node",
    "anchored_documents": f"WITH c AS (SELECT chunk_id, path, start_line % 5 AS start_line, rank, chunk_id % 2 = 0 AS is_anchor FROM ({_duck(_CHUNKS)}) x) SELECT path, start_line, chunk_id, is_anchor FROM (SELECT *, row_number() OVER (PARTITION BY path, start_line ORDER BY is_anchor DESC, rank, chunk_id) AS k FROM c) y WHERE k = 1",
    "chunk_dedup": f"WITH c AS (SELECT chunk_id, path, start_line % 5 AS start_line, rank FROM ({_duck(_CHUNKS)}) x) SELECT path, start_line, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY path, start_line ORDER BY rank, chunk_id) AS k FROM c) y WHERE k = 1",
    "scan_paths": f"WITH p AS (SELECT DISTINCT path FROM ({_duck(_DETAILS)}) x), q AS (SELECT concat(path, CASE WHEN length(path) % 2 = 0 THEN '.Go' ELSE '' END) AS path FROM p) SELECT path FROM q WHERE NOT starts_with(path, 'Build') AND (path LIKE '%.py' OR path LIKE '%.Go')",
}
