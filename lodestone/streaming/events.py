"""Event streams: windows and sessions with a watermark, batch or streaming; upserts by key and incremental refresh."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    x = events.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs the zoned type
    if events.isStreaming:
        x = x.withWatermark("ts", late)
    return x


def counted(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total) per window of ``ts``, tumbling or sliding by ``slide``; a stream leaves out rows later than the watermark."""
    x = _timed(events, late).groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return x.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events less than ``gap`` apart; ``end`` is ``gap`` after the last one."""
    x = _timed(events, late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return x.select("user_id", F.col("s.start").cast("timestamp_ntz").alias("start"), F.col("s.end").cast("timestamp_ntz").alias("end"), "n")


def changes(entries: DataFrame) -> DataFrame:
    """(path, change) of a comparison of two commits (status, filename, previous_filename).

    A rename removes the old path and modifies the new one; unknown statuses modify; entries without a name are left out.
    A path both removed and changed, as after a swap of names, is only changed: its content is read again.
    """
    kind = F.when(F.col("status").isin("added", "removed"), F.col("status")).otherwise("modified")
    old = F.when((F.col("status") == "renamed") & F.col("previous_filename").isNotNull(), F.struct(F.col("previous_filename").alias("path"), F.lit("removed").alias("change")))
    x = entries.where("filename IS NOT NULL").select(F.explode(F.array(F.struct(F.col("filename").alias("path"), kind.alias("change")), old)).alias("c")).where("c IS NOT NULL").select("c.*")
    rank = {"modified": 0, "added": 1, "removed": 2}
    return x.groupBy("path").agg(F.min_by("change", F.create_map(*(F.lit(v) for kv in rank.items() for v in kv))[F.col("change")]).alias("change"))


def refreshed(old: DataFrame, head: str, last: str | None, compared: Callable[[], DataFrame], rebuilt: Callable[[DataFrame], DataFrame], key: str = "path") -> DataFrame:
    """Rows of ``old`` after the commits from ``last`` to ``head``: changed paths rebuilt, removed ones gone.

    The same head, or no last one, changes nothing, and neither function is called. ``compared`` gives entries as ``changes`` takes them,
    ``rebuilt`` the new rows of the paths (``key``) it is given; a path it gives no row for has none afterwards.
    """
    if last is None or last == head:
        return old
    c = changes(compared()).withColumnRenamed("path", key)
    fresh = c.where("change <> 'removed'").select(key)
    new = rebuilt(fresh)
    kept = old.join(c.select(key), key, "left_anti")
    return kept.unionByName(new)


def fresh_commits(commits: DataFrame, last: str | None) -> DataFrame:
    """Commits (sha, ord; the newest has the least) before the one seen ``last``; all where it isn't among them."""
    if last is None:
        return commits
    seen = commits.where(F.col("sha") == last).agg(F.min("ord").alias("_seen"))
    return commits.crossJoin(F.broadcast(seen)).where("_seen IS NULL OR ord < _seen").drop("_seen")


def counted_on(state: DataFrame, commits: DataFrame, details: DataFrame) -> DataFrame:
    """(author, commits, first, last, added, deleted): ``state`` with new commits (author, sha, at) counted on.

    Counts and dates go on from the state. Line totals don't: they are those of ``details`` (author, added, deleted) alone, 0 without.
    """
    x = commits.groupBy("author").agg(F.count_distinct("sha").alias("commits"), F.min("at").alias("first"), F.max("at").alias("last"))
    x = state.select("author", "commits", "first", "last").unionByName(x).groupBy("author").agg(F.sum("commits").alias("commits"), F.min("first").alias("first"), F.max("last").alias("last"))
    lines = details.groupBy("author").agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))
    return x.join(lines, "author", "left").fillna(0, ["added", "deleted"])


def upserted(old: DataFrame, changed: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """``old`` with rows of ``changed`` in place of those with their key, and without the keys of ``removed``.

    Keys that changed are taken out first even where nothing replaces them, so no stale row stays.
    """
    gone = changed.select(key).unionByName(removed.select(key)).distinct()
    return old.join(gone, key, "left_anti").unionByName(changed.join(removed.select(key), key, "left_anti"))
