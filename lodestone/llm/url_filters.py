"""URL filters: a temporal list join. Dated list entries become validity intervals; captures meet those active then.

An entry adds or removes a pattern (a domain with its subdomains, or a path prefix of a host) at a date. The entries
of one pattern, in order, give half-open intervals in which it is listed. A capture is spread over the few patterns
that could match it, its host's suffixes and its path's prefixes, and joined on the pattern with the interval that
holds its fetch time: the latest entry as of that time decides. Captures of one URL at one time are evaluated once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import quoted, saved, table

# Entries made by hand, (date, action, pattern). A pattern with a slash is a path prefix of one host.
ENTRIES = [
    ("2023-11-02", "add", "spam-farm.example.org"),
    ("2024-01-12", "remove", "spam-farm.example.org"),
    ("2024-01-21", "add", "spam-farm.example.org"),
    ("2024-01-06", "add", "cheap-pills.example.com"),
    ("2024-01-09", "add", "tionsh.example.net/en"),
    ("2024-01-19", "remove", "tionsh.example.net/en"),
    ("2024-01-15", "add", "ththan.example.net"),
    ("2024-01-25", "remove", "ththan.example.net"),
    ("2024-01-03", "add", "thther.example.org/fr"),
    ("2024-01-28", "add", "casino.example.com"),
]


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, from, to) from (at, action, pattern): when each pattern is listed; ``to`` null is open.

    Entries at one time are ordered by action, so ``remove`` wins over ``add``. Null times or patterns are ignored.
    """
    e = entries.where("at IS NOT NULL AND pattern IS NOT NULL").select(F.lower("pattern").alias("pattern"), F.col("at").cast("timestamp_ntz").alias("from"), "action").distinct()
    by = W.partitionBy("pattern").orderBy("from", "action")
    return e.withColumn("to", F.lead("from").over(by)).where("action = 'add' AND (to IS NULL OR `from` < to)").select("pattern", "from", "to")


def host(url: F.Column) -> F.Column:
    """Lower-case host, without user, port and last dot; null where there is none."""
    h = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(F.rtrim(h, F.lit(".")), F.lit(""))


def path(url: F.Column) -> F.Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def patterns(h: F.Column, p: F.Column) -> F.Column:
    """What could match: suffixes of the host, and the host with each prefix of its path by segment."""
    labels = F.split(h, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(p, "/"), lambda x: x != "")
    prefixes = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(h, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(suffixes, prefixes))


#: Up to so many intervals (of about 100 bytes) are sent to every task; more are joined by shuffle.
FEW = 200_000


def screened(captures: DataFrame, entries: DataFrame, *, few: int = FEW) -> DataFrame:
    """``captures`` (url, fetched, others) with host, n_active and matched (the longest pattern active then, or null).

    A capture without a URL, a host or a fetch time meets no entry. Repeated captures each keep their row. Columns
    already named host, n_active or matched are replaced. An empty list or table is no special case.

    The list's intervals are counted: up to ``few`` they are broadcast; beyond, captures and intervals meet by pattern in a
    plain join of two shuffles, in which Spark splits patterns that very many captures could match (such as ``com``).
    """
    own = [c for c in captures.columns if c not in ("host", "n_active", "matched")]
    all_ = captures.select(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(own)), F.col("url").cast("string").alias("_url"), F.col("fetched").cast("timestamp_ntz").alias("_at"))
    c = all_.select("_url", "_at").where("_url IS NOT NULL AND _at IS NOT NULL").distinct()
    keys = c.withColumn("_h", host(F.col("_url"))).where("_h IS NOT NULL").select("_url", "_at", F.explode(patterns(F.col("_h"), path(F.col("_url")))).alias("pattern"))
    listed = saved(intervals(entries))
    hits = keys.join(F.broadcast(listed) if listed.count() <= few else listed, "pattern").where("_at >= `from` AND (to IS NULL OR _at < to)")
    longest = F.max(F.struct(F.length("pattern").alias("l"), "pattern"))["pattern"]
    found = saved(hits.groupBy(F.col("_url").alias("_u"), F.col("_at").alias("_t")).agg(F.count("*").alias("_n"), longest.alias("_p")))
    out = all_.join(found, (F.col("_url") == F.col("_u")) & (F.col("_at") == F.col("_t")), "left")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(own)), host(F.col("_url")).alias("host"), F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_active"), F.col("_p").alias("matched"))


def _digit(text: F.Column, k: int) -> F.Column:
    """The k-th hex digit of the text's MD5."""
    return F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(text), k, 1)) - 1


def drawn_entries(pages: DataFrame) -> DataFrame:
    """(at, action, pattern): a list that grows with ``pages`` (url), by rule, as the tables have none.

    Of hosts and of their path prefixes of one and two segments, those whose MD5 starts with 0, 1 or 2 are listed from
    a day of January 2024 on; half of them are removed some days later, and half of these come back. The digits say when.
    """
    h, parts = host(F.col("url")), F.filter(F.split(path(F.col("url")), "/"), lambda x: x != "")
    prefixes = F.transform(F.sequence(F.lit(0), F.least(F.size(parts), F.lit(2))), lambda i: F.array_join(F.concat(F.array(h), F.slice(parts, F.lit(1), i)), "/"))
    p = pages.where(h.isNotNull()).select(F.explode(prefixes).alias("pattern")).distinct().where(_digit(F.col("pattern"), 1) < 3)
    d = lambda k: _digit(F.col("pattern"), k)
    first, then = d(2), d(2) + 1 + d(4)
    step = lambda day, action: F.struct(F.date_add(F.lit("2024-01-01").cast("date"), day.cast("int")).cast("timestamp_ntz").alias("at"), F.lit(action).alias("action"))
    steps = F.array(step(first, "add"), F.when(d(3) < 8, step(then, "remove")), F.when(d(3) < 4, step(then + 1 + d(5), "add")))
    return p.select("pattern", F.explode(F.filter(steps, lambda x: x.isNotNull())).alias("e")).select("e.at", "e.action", "pattern")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, fetched when the event of the same number took place; pages without one have no fetch time.

    The list is ENTRIES and what ``drawn_entries`` makes of the pages.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    times = saved(table(spark, sf_dir, "events").groupBy(F.col("event_id").alias("e")).agg(F.min("ts").alias("fetched")))
    captures = pages.join(times, pages["page_id"] == times["e"], "left").drop("e")
    entries = spark.createDataFrame(ENTRIES, "at string, action string, pattern string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    out = screened(captures, entries.unionByName(drawn_entries(pages)))
    return out.select("page_id", "url", "host", "n_active", "matched", (F.col("n_active") > 0).alias("blocked"))


_VALUES = ", ".join(f"(TIMESTAMP '{a} 00:00:00', '{b}', '{c}')" for a, b, c in ENTRIES)
ORACLE_SQL = rf"""
WITH fixed(day, action, pattern) AS (VALUES {_VALUES}),
u AS (SELECT DISTINCT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS h,
             list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages),
c AS (SELECT DISTINCT array_to_string(list_concat([h], parts[1:k]), '/') AS pattern FROM u, range(0, 3) r(k) WHERE h <> '' AND k <= len(parts)),
g AS (SELECT pattern, {", ".join(f"strpos('0123456789abcdef', substr(md5(pattern), {k}, 1)) - 1 AS d{k}" for k in range(1, 6))} FROM c),
e AS (SELECT * FROM fixed
      UNION ALL SELECT TIMESTAMP '2024-01-01' + to_days(CAST(d2 AS INTEGER)), 'add', pattern FROM g WHERE d1 < 3
      UNION ALL SELECT TIMESTAMP '2024-01-01' + to_days(CAST(d2 + 1 + d4 AS INTEGER)), 'remove', pattern FROM g WHERE d1 < 3 AND d3 < 8
      UNION ALL SELECT TIMESTAMP '2024-01-01' + to_days(CAST(d2 + 1 + d4 + 1 + d5 AS INTEGER)), 'add', pattern FROM g WHERE d1 < 3 AND d3 < 4),
i AS (SELECT pattern, day AS f, action, lead(day) OVER (PARTITION BY pattern ORDER BY day, action) AS t FROM (SELECT DISTINCT * FROM e) x),
v AS (SELECT pattern, f, t FROM i WHERE action = 'add' AND (t IS NULL OR f < t)),
p AS (SELECT page_id, url, min(ts) AS fetched, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS host,
             regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
      FROM pages LEFT JOIN events ON page_id = event_id GROUP BY page_id, url),
m AS (SELECT page_id, count(*) AS n, arg_max(pattern, length(pattern)) AS matched FROM p JOIN v
      ON fetched >= f AND (t IS NULL OR fetched < t) AND (host = pattern OR ends_with(host, '.' || pattern) OR starts_with(host || path || '/', pattern || '/'))
      GROUP BY page_id)
SELECT page_id, url, host, CAST(coalesce(n, 0) AS BIGINT) AS n_active, matched, coalesce(n, 0) > 0 AS blocked
FROM p LEFT JOIN m USING (page_id)
"""
