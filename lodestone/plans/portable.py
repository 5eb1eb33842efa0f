"""Plans that both SQL dialects read: graph metrics, contributions, code health, evaluation and text measures."""

from __future__ import annotations

#: Edges of the thin graph: suppliers call parts, with the return flag as the type of edge.
EDGES = "SELECT l_suppkey + 1000000 AS src, l_partkey AS dst, l_returnflag AS type, l_orderkey, l_linenumber FROM {lineitem}"

#: File statistics from documents. Keywords stand for branches; a sentence end stands for the end of a function.
FILES = """
fs0 AS (SELECT doc_id, source AS module, lang, n_chars,
  CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS loc,
  RC(text, '[^ \\t\\n]+') AS words,
  RC(text, '[.][ \\n]') AS functions,
  1 + RC(text, '[ \\n](is|to|and|or|if|for|der|die|la|de)[ .,\\n]') AS cc
  FROM {documents}),
fan AS (SELECT l_partkey AS doc_id, count(DISTINCT l_suppkey) AS fan_out FROM {lineitem} GROUP BY l_partkey),
fs AS (SELECT fs0.*, coalesce(fan.fan_out, 0) AS fan_out, CASE WHEN l.quality = 1 THEN 100.0 ELSE 0.0 END AS doc_pct,
  loc * 1.0 / greatest(functions, 1) AS avg_len
  FROM fs0 LEFT JOIN fan ON fs0.doc_id = fan.doc_id LEFT JOIN {labels} l ON fs0.doc_id = l.doc_id)
"""

_F = f"WITH {FILES}"

SQL = {
    "edge_dedup": f"""WITH e AS ({EDGES}), r AS (SELECT *, row_number() OVER (PARTITION BY src, dst, type ORDER BY l_orderkey, l_linenumber) AS rn FROM e)
        SELECT src, dst, type, l_orderkey, l_linenumber FROM r WHERE rn = 1""",
    "degree_in_out": f"""WITH e AS ({EDGES}), o AS (SELECT src AS node, count(*) AS n_out FROM e GROUP BY src), i AS (SELECT dst AS node, count(*) AS n_in FROM e GROUP BY dst)
        SELECT coalesce(o.node, i.node) AS node, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in FROM o FULL OUTER JOIN i ON o.node = i.node""",
    "node_roles": """WITH c AS (SELECT DISTINCT l_suppkey AS node FROM {lineitem} WHERE l_returnflag = 'R'), d AS (SELECT DISTINCT l_partkey AS node FROM {lineitem} WHERE l_returnflag = 'A'),
        u AS (SELECT node FROM c UNION SELECT node FROM d)
        SELECT u.node, CASE WHEN c.node IS NOT NULL AND d.node IS NULL THEN 'entry' WHEN c.node IS NOT NULL THEN 'core' ELSE 'helper' END AS role
        FROM u LEFT JOIN c ON u.node = c.node LEFT JOIN d ON u.node = d.node""",
    "entry_points": "SELECT c_custkey, c_name FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey)",
    "exit_points": "SELECT o_orderkey, o_custkey FROM {orders} o WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey)",
    "edge_type_histogram": "SELECT l_returnflag AS type, count(*) AS n, count(DISTINCT l_suppkey) AS callers, count(DISTINCT l_partkey) AS callees FROM {lineitem} GROUP BY l_returnflag",
    "edge_resolve_calls": """WITH sym AS (SELECT p_partkey, p_partkey % 50 AS file, p_name AS name, p_partkey AS ord FROM {part}),
        own AS (SELECT file, name, min(ord) AS id FROM sym GROUP BY file, name), anywhere AS (SELECT name, min(ord) AS id FROM sym GROUP BY name),
        raw AS (SELECT DISTINCT l_suppkey AS caller, l_suppkey % 50 AS file, p_name AS callee FROM {lineitem} JOIN {part} ON l_partkey = p_partkey)
        SELECT DISTINCT caller, coalesce(own.id, anywhere.id) AS callee_id, own.id IS NOT NULL AS same_file
        FROM raw LEFT JOIN own ON raw.file = own.file AND raw.callee = own.name LEFT JOIN anywhere ON raw.callee = anywhere.name""",
    "call_graph_metrics": """WITH f AS (SELECT l_suppkey AS caller, count(DISTINCT l_partkey) AS fan_out FROM {lineitem} GROUP BY l_suppkey), c AS (SELECT count(DISTINCT l_partkey) AS callees FROM {lineitem})
        SELECT count(*) AS callers, count(*) + max(callees) AS nodes, CAST(sum(fan_out) AS BIGINT) AS edges, round(avg(fan_out), 6) AS avg_fan_out, max(fan_out) AS max_fan_out,
        round(sum(fan_out) / ((count(*) + max(callees)) * (count(*) + max(callees) - 1) / 2.0), 9) AS density FROM f, c""",
    "roadmap_modules": """SELECT l_suppkey AS module, count(DISTINCT l_partkey) AS dependencies FROM {lineitem} GROUP BY l_suppkey ORDER BY dependencies, module LIMIT 15""",
    "hotspot_functions": "SELECT l_partkey AS callee, count(*) AS calls FROM {lineitem} GROUP BY l_partkey ORDER BY calls DESC, callee LIMIT 5",
    "def_use_pairs": """SELECT d.user_id, d.event_type, count(*) AS pairs, min(u.event_id - d.event_id) AS least_gap FROM {events} d JOIN {events} u
        ON d.user_id = u.user_id AND d.event_type = u.event_type AND u.ts > d.ts GROUP BY d.user_id, d.event_type""",
    "first_occurrence": "SELECT user_id, min_by(event_id, struct_key) AS first_event FROM (SELECT user_id, event_id, event_id AS struct_key FROM {events}) t GROUP BY user_id",
    "last_wins": "SELECT user_id, event_type, max_by(value, event_id) AS value, max(event_id) AS event_id FROM {events} GROUP BY user_id, event_type",
    "param_binding": """SELECT a.conv_id, a.turn AS position, a.role AS parameter, b.role AS argument, length(b.text) AS size FROM {conversations} a JOIN {conversations} b
        ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
    "author_totals": """SELECT c.c_custkey, c.c_name, count(*) AS commits, round(sum(o_totalprice), 2) AS lines, count(DISTINCT o_orderpriority) AS files, min(o_orderdate) AS first_commit, max(o_orderdate) AS last_commit
        FROM {customer} c JOIN {orders} o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey, c.c_name""",
    "active_authors": "SELECT o_custkey, count(*) AS commits FROM {orders} GROUP BY o_custkey HAVING count(*) >= 2",
    "top_contributors": "SELECT o_custkey, count(*) AS commits FROM {orders} GROUP BY o_custkey ORDER BY commits DESC, o_custkey LIMIT 10",
    "contributor_share": "SELECT o_custkey, count(*) AS commits, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share, round(count(*) * 1.0 / max(count(*)) OVER (), 6) AS of_most FROM {orders} GROUP BY o_custkey",
    "recent_per_author": """SELECT o_custkey, o_orderkey, o_orderdate, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM {orders}) t WHERE n <= 5""",
    "commit_frequency_day": "SELECT CAST(ts AS DATE) AS day, count(*) AS commits, count(DISTINCT user_id) AS authors FROM {events} GROUP BY CAST(ts AS DATE)",
    "commit_frequency_week": "SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS commits, count(DISTINCT user_id) AS authors FROM {events} GROUP BY CAST(date_trunc('week', ts) AS DATE)",
    "commit_frequency_month": "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS commits, count(DISTINCT o_custkey) AS authors FROM {orders} GROUP BY CAST(date_trunc('month', o_orderdate) AS DATE)",
    "commits_in_range": "SELECT event_id, user_id, ts FROM {events} WHERE ts >= TIMESTAMP '2024-01-08 00:00:00' AND ts < TIMESTAMP '2024-01-15 00:00:00'",
    "timeline_summary": """SELECT count(*) AS commits, min(o_orderdate) AS first_commit, max(o_orderdate) AS last_commit, count(DISTINCT CAST(o_orderdate AS DATE)) AS active_days,
        round(count(*) * 1.0 / count(DISTINCT CAST(o_orderdate AS DATE)), 6) AS per_active_day FROM {orders}""",
    "line_counts": "SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS lines, RC(text, '\\n[ \\t]*\\n') AS blank_gaps, length(text) AS chars FROM {documents}",
    "text_metrics": _F + " SELECT doc_id, loc, words, functions, cc, fan_out, round(avg_len, 6) AS avg_len FROM fs",
    "keyword_complexity": "SELECT doc_id, greatest(1, 1 + RC(text, '\\b(if|for|while|and|or)\\b')) AS complexity FROM {documents}",
    "loc_bands": _F + """ SELECT CASE WHEN loc < 50 THEN 'tiny' WHEN loc < 200 THEN 'small' WHEN loc < 500 THEN 'medium' WHEN loc < 1000 THEN 'large' ELSE 'very_large' END AS band, count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc FROM fs GROUP BY 1""",
    "module_rollup": _F + " SELECT module, count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc, CAST(sum(functions) AS BIGINT) AS functions, round(avg(cc), 6) AS avg_cc, round(avg(fan_out), 6) AS avg_fan_out, round(avg(doc_pct), 6) AS doc_pct FROM fs GROUP BY module",
    "repo_rollup": _F + """ SELECT count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc, CAST(sum(functions) AS BIGINT) AS functions, round(avg(cc), 6) AS avg_cc,
        round(sum(avg_len * functions) / greatest(sum(functions), 1), 6) AS avg_len, max(cc) AS max_cc, round(sum(loc) * 1.0 / greatest(count(*), 1), 6) AS loc_per_file FROM fs""",
    "health_score": _F + """, r AS (SELECT avg(cc) AS cc, sum(avg_len * functions) / greatest(sum(functions), 1) AS len, avg(fan_out) AS fo, avg(doc_pct) AS doc, sum(loc) * 1.0 / count(*) AS lpf FROM fs),
        g AS (SELECT sum(CASE WHEN fs.loc > 3 * a.m THEN 1 ELSE 0 END) * 1.0 / count(*) AS gods FROM fs, (SELECT avg(loc) AS m FROM fs) a),
        d AS (SELECT 100 * (0.6 * greatest(0, (15 - cc) / 15) + 0.4 * greatest(0, (50 - len) / 50)) AS maintainability,
                     least(100, greatest(0, 100 * greatest(0, (20 - fo) / 20) - 30 * gods)) AS modularity, least(100, 0.6 * doc + 0.4 * 0) AS readability,
                     100 * greatest(0, (15 - cc) / 15) AS change_risk, 100 * greatest(0, (15 - lpf) / 15) AS hygiene FROM r, g)
        SELECT round(maintainability, 6) AS maintainability, round(modularity, 6) AS modularity, round(readability, 6) AS readability, round(change_risk, 6) AS change_risk, round(hygiene, 6) AS hygiene,
               round(0.25 * maintainability + 0.25 * modularity + 0.25 * readability + 0.15 * change_risk + 0.1 * hygiene, 6) AS overall FROM d""",
    "file_scores": _F + ", s AS (SELECT doc_id, round(100 * (0.4 * greatest(0, (15 - cc) / 15.0) + 0.3 * greatest(0, (50 - avg_len) / 50) + 0.3 * doc_pct / 100), 6) AS score FROM fs) SELECT doc_id, score, CASE WHEN score >= 80 THEN 'A' WHEN score >= 60 THEN 'B' WHEN score >= 40 THEN 'C' ELSE 'D' END AS grade FROM s",
    "lowest_files": _F + " SELECT doc_id, round(100 * (0.4 * greatest(0, (15 - cc) / 15.0) + 0.3 * greatest(0, (50 - avg_len) / 50) + 0.3 * doc_pct / 100), 6) AS score FROM fs ORDER BY score, doc_id LIMIT 20",
    "largest_files": _F + " SELECT doc_id, loc FROM fs ORDER BY loc DESC, doc_id LIMIT 5",
    "maintainability_index": _F + " SELECT doc_id, round(least(100, greatest(0, 171 - 5.2 * pow(cc, 1.5) - 0.023 * loc + 50 * doc_pct / 100)), 6) AS mi FROM fs",
    "enhanced_score": _F + """, t AS (SELECT *, CASE WHEN cc >= 20 THEN 100 WHEN cc >= 15 THEN 75 WHEN cc >= 10 THEN 50 ELSE 25 END AS complexity FROM fs)
        SELECT doc_id, round(0.30 * complexity + 0.20 * doc_pct + 0.20 * greatest(0, 100 - 2 * fan_out) + 0.15 * greatest(0, 100 - 3 * cc) + 0.15 * greatest(0, 100 - 5 * fan_out), 6) AS score FROM t""",
    "risk_areas": _F + ", r AS (SELECT doc_id, CASE WHEN cc > 10 THEN 30 ELSE 0 END + CASE WHEN loc > 500 THEN 25 ELSE 0 END + CASE WHEN doc_pct < 30 THEN 15 ELSE 0 END AS risk FROM fs) SELECT doc_id, least(risk, 100) AS risk FROM r WHERE risk > 0",
    "metric_summary": _F + " SELECT lang, round(avg(cc), 6) AS mean_cc, round(stddev_samp(cc), 6) AS sd_cc, min(cc) AS min_cc, max(cc) AS max_cc, round(avg(loc), 6) AS mean_loc FROM fs GROUP BY lang",
    "smell_god_file": _F + ", a AS (SELECT avg(loc) AS m FROM fs) SELECT doc_id, loc, CASE WHEN loc > 6 * m THEN 'high' ELSE 'medium' END AS severity FROM fs, a WHERE loc > 3 * m",
    "smell_long_functions": _F + " SELECT doc_id, round(avg_len, 6) AS avg_len, CASE WHEN avg_len >= 100 THEN 'high' ELSE 'medium' END AS severity FROM fs WHERE avg_len > 50",
    "smell_complexity": _F + " SELECT doc_id, cc, CASE WHEN cc > 15 THEN 'critical' ELSE 'high' END AS severity FROM fs WHERE cc > 10",
    "smell_coupling": _F + ", a AS (SELECT avg(fan_out) AS m FROM fs) SELECT doc_id, fan_out FROM fs, a WHERE fan_out > 2 * m",
    "smell_orphan": _F + " SELECT doc_id FROM fs WHERE fan_out = 0",
    "smell_hotspot": _F + ", h AS (SELECT doc_id, round(0.4 * least(cc / 10.0, 1) + 0.3 * least(loc / 500.0, 1) + 0.3 * least(fan_out / 20.0, 1), 6) AS score FROM fs) SELECT doc_id, score FROM h WHERE score > 0.5 ORDER BY score DESC, doc_id LIMIT 5",
    "smell_dead_code": "SELECT count(*) AS unused, min(p_partkey) AS first_unused FROM {part} p WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_partkey = p.p_partkey AND l_returnflag = 'R') AND p_name NOT LIKE '\\_%'",
    "suggestions_ranked": _F + """, s AS (SELECT doc_id, 'Complexity' AS smell FROM fs WHERE cc > 10 UNION ALL SELECT doc_id, 'Orphan' FROM fs WHERE fan_out = 0 UNION ALL SELECT doc_id, 'Long Functions' FROM fs WHERE avg_len > 50),
        dim AS (SELECT 'Complexity' AS smell, 2 AS effort, 1 AS priority UNION ALL SELECT 'Orphan', 1, 3 UNION ALL SELECT 'Long Functions', 2, 1)
        SELECT s.doc_id, s.smell, effort, priority, row_number() OVER (PARTITION BY s.smell ORDER BY s.doc_id) AS place FROM s JOIN dim ON s.smell = dim.smell""",
    "retrieval_log_agg": """SELECT event_type, count(*) AS queries, round(avg(value), 6) AS avg_latency, min(value) AS least, max(value) AS most, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS slow,
        round(avg(CASE WHEN value > 0 THEN value END), 6) AS avg_positive FROM {events} GROUP BY event_type""",
    "percentile_nearest_rank": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM {events})
        SELECT event_type, max(CASE WHEN i = least(CAST(floor(n * 50 / 100) AS BIGINT), n - 1) THEN value END) AS p50, max(CASE WHEN i = least(CAST(floor(n * 95 / 100) AS BIGINT), n - 1) THEN value END) AS p95 FROM r GROUP BY event_type""",
    "lang_distribution": "SELECT lang, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS pct FROM {documents} GROUP BY lang",
    "dominant_lang": "SELECT source, lang FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM {documents} WHERE lang IS NOT NULL GROUP BY source, lang) t WHERE r = 1",
    "exact_dedup_docs": "SELECT md5(text) AS text_md5, min(doc_id) AS doc_id, count(*) AS copies FROM {documents} GROUP BY md5(text)",
    "duplicate_names": "SELECT p_name, count(DISTINCT p_brand) AS files FROM {part} GROUP BY p_name HAVING count(DISTINCT p_brand) > 1",
    "scan_filter": """SELECT page_id, url FROM {pages} WHERE length(html) <= 1500000 AND RC(url, '/(de|fr)/') > 0 AND url NOT LIKE '%#top'""",
    "priority_order": "SELECT page_id, CASE WHEN url LIKE '%/en/%' THEN 0 WHEN url LIKE '%utm_source%' THEN 1 ELSE 2 END AS priority, length(html) AS size FROM {pages}",
    "api_rows": "SELECT doc_id, coalesce(lang, '') AS lang, substr(text, 1, 2000) AS text FROM {documents}",
    "risk_by_module": _F + " SELECT module, sum(CASE WHEN cc > 10 THEN 1 ELSE 0 END) AS complex_files, sum(CASE WHEN fan_out > 10 THEN 1 ELSE 0 END) AS coupled, round(greatest(0, 100 - 5 * avg(fan_out)), 6) AS dependency_score FROM fs GROUP BY module",
    "parser_coverage": "SELECT lang, count(*) AS chunks, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct, count(DISTINCT source) AS files, round(count(*) * 1.0 / count(DISTINCT source), 6) AS per_file FROM {documents} GROUP BY lang",
    "incremental_upsert": """WITH old AS (SELECT doc_id, n_chars, 0 AS version FROM {documents} WHERE doc_id % 3 <> 0), new AS (SELECT doc_id, n_chars + 1 AS n_chars, 1 AS version FROM {documents} WHERE doc_id % 2 = 0), gone AS (SELECT doc_id FROM {documents} WHERE doc_id % 7 = 0)
        SELECT * FROM (SELECT * FROM new UNION ALL SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.doc_id = old.doc_id)) t WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = t.doc_id)""",
}
