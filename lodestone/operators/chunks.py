"""Overlapping line windows over texts, and the oversize test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Fixed value: lines that begin a definition.
BOUNDARY = r"def |class |(?:export\s+)?function\s+\w+\s*\(|\w+\s*:\s*function\s*\(|\w+\s*=\s*\(.*\)\s*=>"


def oversized(text: Column, max_lines: int = 200, max_tokens: int = 1600) -> Column:
    """More lines than allowed, or more tokens at four characters each."""
    return (F.size(F.split(text, "\n")) > max_lines) | (F.floor(F.length(text) / 4) > max_tokens)


def windows(docs: DataFrame, size: int = 200, overlap: int = 40) -> DataFrame:
    """(keys, start_line, end_line, chunk): windows of ``size`` lines, ``overlap`` shared by neighbours, from line 1.

    The last window ends at the last line; a text of up to ``size`` lines is one window; null texts have none.
    """
    keys = [c for c in docs.columns if c != "text"]
    x = docs.where("text IS NOT NULL").select(*keys, F.split("text", "\n").alias("lines"))
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.size("lines") - size) / F.lit(step)).cast("int"))
    x = x.withColumn("k", F.explode(F.sequence(F.lit(0), last)))
    begin = F.col("k") * step + 1
    return x.select(*keys, begin.alias("start_line"), F.least(begin + size - 1, F.size("lines")).alias("end_line"), F.array_join(F.slice("lines", begin, size), "\n").alias("chunk"))


def split_at(docs: DataFrame, boundary: str = BOUNDARY) -> DataFrame:
    """(keys, start_line, end_line, name, chunk): texts cut before each line that matches ``boundary`` after its indent.

    The first piece starts at line 1 whether a boundary or not; pieces of white space only are left out. Lines stay in
    their text's array, so no line leaves its row and a text of any length needs no shuffle. Null texts have no pieces.
    """
    keys = [c for c in docs.columns if c != "text"]
    x = docs.where("text IS NOT NULL").select(*keys, F.split("text", "\n").alias("lines"))
    at = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda k: (k == 1) | F.element_at("lines", k).rlike(r"^\s*(?:" + boundary + ")"))
    x = x.select(*keys, "lines", F.posexplode(at).alias("_k", "start_line"), at.alias("_at"))
    last = F.coalesce(F.get("_at", F.col("_k") + 1) - 1, F.size("lines"))
    x = x.select(*keys, "start_line", last.alias("end_line"), F.slice("lines", F.col("start_line"), last - F.col("start_line") + 1).alias("_piece"))
    text = F.regexp_replace(F.array_join("_piece", "\n"), r"^\s+|\s+$", "")
    name = F.regexp_extract(F.get("_piece", F.lit(0)), r"^\s*(?:def|class|function)\s+([A-Za-z0-9_]+)", 1)
    return x.select(*keys, "start_line", "end_line", F.when(name != "", name).alias("name"), text.alias("chunk")).where("chunk <> ''")


ORACLE_SQL = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, lines, unnest(range(0, CAST(greatest(0, ceil((len(lines) - 20) / 16)) AS BIGINT) + 1)) AS k FROM d)
SELECT doc_id, CAST(k * 16 + 1 AS INTEGER) AS start_line, CAST(least(k * 16 + 20, len(lines)) AS INTEGER) AS end_line, md5(array_to_string(list_slice(lines, k * 16 + 1, k * 16 + 20), chr(10))) AS chunk_md5 FROM k
"""

SPLIT_SQL = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS k, unnest(lines) AS line FROM d),
b AS (SELECT *, sum(CASE WHEN k = 1 OR regexp_matches(line, '^\\s*[A-Z]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS piece FROM l)
SELECT doc_id, CAST(min(k) AS INTEGER) AS start_line, CAST(max(k) AS INTEGER) AS end_line, length(regexp_replace(string_agg(line, chr(10) ORDER BY k), '^\\s+|\\s+$', '', 'g')) AS size
FROM b GROUP BY doc_id, piece HAVING regexp_matches(string_agg(line, chr(10)), '[^\\s]')
"""
