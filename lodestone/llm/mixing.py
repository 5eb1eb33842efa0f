"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame functions only.

Slots are numbered; the van der Corput point of a slot (its bits reversed) falls into one source's stretch of the
cumulative target weights, so every stretch of the schedule holds each source nearly in proportion. Slots are ranked
per source. The documents of a source, shuffled by a hash, lie end to end on a line of words that is cut into blocks
of equal length, one for each slot of the source; the line is walked again where the target exceeds the source. The
join of ranked slots with blocks says which words of which document each slot takes.

A source's line is summed in two steps, within hash ranges and over ranges, and ranks are counted the same way, so no
task holds a whole source. Only the list of sources (a row each) is handled in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import quoted, saved, table

BITS = 40
#: Up to so many sources, their stretches of the schedule are broadcast.
FEW_SOURCES = 20_000
WORDS = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h): the columns the mix works on; ``h`` orders a source's documents at random."""
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("bigint").alias("size"), h.alias("h"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, size): weights repeat over sources by code point, null last.

    Filling: sources are ordered by the level (most * size / weight) at which they are full. The common level is that
    of the first source, in this order, that is not full when all before it are; nobody is above its limit then.
    """
    by = W.orderBy(F.col("source").asc_nulls_last())
    full = W.orderBy("ceiling", F.col("source").asc_nulls_last())
    before = full.rowsBetween(W.unboundedPreceding, -1)
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by) - 1) % len(weights) + 1))
    s = s.withColumn("ceiling", F.col("source_size") * most / F.col("weight"))
    all_ = W.partitionBy()
    level = (F.sum("source_size").over(all_) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("level", level)
    s = s.withColumn("common", F.min(F.when(F.col("level") <= F.col("ceiling"), F.struct("ceiling", "level"))).over(all_)["level"])
    at = F.when(F.col("ceiling") <= F.col("common"), (F.col("source_size") * most).cast("double")).otherwise(F.col("common") * F.col("weight"))
    return s.select("source", "source_size", F.coalesce(at, F.lit(0.0)).alias("target"))


def lines(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """``sizes`` with ``begin``, the words before the document on its source's line, and the columns of ``sources``.

    Documents meet their source's row by source and hash range at once, so a hot source is not one task.
    """
    cut = sizes.withColumn("range", F.substring("h", 1, 3))
    part = cut.groupBy("source", "range").agg(F.sum("size").alias("n"))
    over = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    part = part.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    also = [c for c in sources.columns if c != "source"]
    part = part.join(sources, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    within = W.partitionBy("source", "range").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    cut = cut.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return cut.join(part, cut["source"].eqNullSafe(part["s"]) & (cut["range"] == part["r"])).select("doc_id", "source", "size", (F.col("base") + F.col("inside")).alias("begin"), *also)


def slots(spark: SparkSession, goal: DataFrame, block: int) -> DataFrame:
    """(slot, source, rank): the schedule. A source whose target is above 0 but that no point hits gets one slot."""
    by = W.orderBy(F.col("source").asc_nulls_last())
    g = goal.where("target > 0").withColumn("to", F.sum("target").over(by.rowsBetween(W.unboundedPreceding, 0))).withColumn("from", F.coalesce(F.lag("to").over(by), F.lit(0.0)))
    total = g.agg(F.sum("target")).first()[0] or 0
    n = -(-int(total) // block)
    g = g.withColumns({"from": F.col("from") / (total or 1), "to": F.when(F.row_number().over(W.orderBy(F.col("source").desc_nulls_first())) == 1, 2.0).otherwise(F.col("to") / (total or 1))})
    point = F.conv(F.reverse(F.lpad(F.bin("slot"), BITS, "0")), 2, 10).cast("double") / float(1 << BITS)
    s = spark.range(n).select(F.col("id").alias("slot"), point.alias("point"))
    # Sources per 1/256 of the weights: an equi-join on the cell, so that no task pairs every slot with every source.
    # There are few cells unless there are very many sources; few are sent whole, so that slots stay where they are.
    cells = g.select("source", "from", "to", F.explode(F.sequence(F.floor(F.col("from") * 256), F.least(F.floor(F.col("to") * 256), F.lit(255)).cast("bigint"))).alias("cell"))
    few = g.count() <= FEW_SOURCES
    s = s.withColumn("cell", F.floor(F.col("point") * 256)).join(F.broadcast(cells) if few else cells, "cell").where("point >= `from` AND point < `to`").select("slot", "source")
    s = s.withColumn("stretch", F.floor(F.col("slot") / 65536))
    part = s.groupBy("source", "stretch").agg(F.count("*").alias("n"))
    part = part.select(F.col("source").alias("s"), F.col("stretch").alias("r"), F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    s = s.withColumn("inside", F.row_number().over(W.partitionBy("source", "stretch").orderBy("slot")) - 1)
    s = s.join(part, s["source"].eqNullSafe(part["s"]) & (s["stretch"] == part["r"])).select("slot", "source", (F.col("base") + F.col("inside")).alias("rank"))
    none = g.join(s.select(F.col("source").alias("s")).distinct(), F.col("source").eqNullSafe(F.col("s")), "left_anti")
    return s.unionByName(none.select((F.lit(n) + F.row_number().over(by) - 1).cast("bigint").alias("slot"), "source", F.lit(0).cast("bigint").alias("rank")))


def mixture(docs: DataFrame, *, block: int = 512, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What each slot of the schedule takes: (slot, rank, source, doc_id, begin, size, round, from, to).

    Words ``from`` to ``to`` (exclusive) of the document, on walk ``round`` (from 0) over its source. Also returns the
    documents (doc_id, source, size, begin and their source's columns) and the sources (source, source_size, target). ``docs`` needs doc_id, text
    and source. A null or empty text has size 0 and is never taken; a null source is a source, the last; rows that
    repeat a doc_id are documents of their own; an empty table gives empty results. Reruns agree: the shuffle is a
    hash of doc_id.
    """
    spark = docs.sparkSession
    sizes = saved(sized(docs))
    goal = saved(targets(sizes, weights, most))
    plan = saved(slots(spark, goal, block))
    per = plan.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("slots"))
    goal_ = goal.join(per, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", F.round("target").cast("bigint").alias("end"), F.coalesce(F.ceil(F.round("target") / F.col("slots")), F.lit(0)).cast("bigint").alias("length"))
    line = saved(lines(sizes, goal_))
    x = line.where("size > 0")
    x = x.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("a", F.col("round") * F.col("source_size") + F.col("begin"))
    x = x.where("a < end AND length > 0").withColumn("b", F.least(F.col("a") + F.col("size"), F.col("end")))
    x = x.withColumn("r", F.explode(F.sequence(F.expr("a div length"), F.expr("(b - 1) div length"))))
    x = x.join(plan.select(F.col("source").alias("ps"), "rank", "slot"), F.col("source").eqNullSafe(F.col("ps")) & (F.col("r") == F.col("rank")))
    low, high = F.greatest(F.col("a"), F.col("r") * F.col("length")), F.least(F.col("b"), (F.col("r") + 1) * F.col("length"))
    taken = x.select("slot", "rank", "source", "doc_id", "begin", "size", "round", (low - F.col("a")).alias("from"), (high - F.col("a")).alias("to"))
    return taken, line, goal


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken) for each row of ``docs``: see ``mixture``."""
    taken, line, _ = mixture(docs, **parameters)
    got = taken.groupBy("doc_id", "source", "begin", "size").agg(F.sum(F.col("to") - F.col("from")).alias("got"))
    got = got.withColumnsRenamed({c: f"_{c}" for c in ("doc_id", "source", "begin", "size")})
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("begin") == F.col("_begin")) & (F.col("size") == F.col("_size"))
    out = line.join(got, same, "left")
    return out.select("doc_id", "size", "source", "source_size", "target", F.coalesce("got", F.lit(0)).cast("bigint").alias("taken"))


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """The mix as a corpus: ``docs`` (any columns), with ``size``, ``taken`` (words) and ``slots``.

    ``slots`` is an array of (slot, round, from, to) by slot: which words of the text stand at which place of the schedule, so
    that the mixed text is the union of slots in order. A document fills at most 3 times its size in slots. Documents it
    takes nothing of (empty and null texts, and those past their source's target) have no slots; rows that repeat a
    doc_id, source and size have one of their places each. Columns already named like the new ones are replaced.
    """
    taken, _, _ = mixture(docs, **parameters)
    same = ["doc_id", "source", "size", "begin"]
    got = taken.groupBy(*same).agg(F.array_sort(F.collect_list(F.struct("slot", "round", "from", "to"))).alias("slots"), F.sum(F.col("to") - F.col("from")).cast("bigint").alias("taken"))
    nth = F.row_number().over(W.partitionBy("_d", "_s", "_z").orderBy("_b"))
    got = saved(got.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("begin").alias("_b"), "slots", "taken").withColumn("_n", nth))
    own = [c for c in docs.columns if c not in ("size", "taken", "slots")]
    x = docs.select(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(own)), F.col("doc_id").cast("bigint").alias("_doc"), F.col("source").cast("string").alias("_src"), F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("bigint").alias("_size"))
    x = x.withColumn("_k", F.row_number().over(W.partitionBy("_doc", "_src", "_size").orderBy(F.lit(1))))
    out = x.join(got, F.col("_doc").eqNullSafe(F.col("_d")) & F.col("_src").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z")) & (F.col("_k") == F.col("_n")), "left")
    none = F.array().cast("array<struct<slot:bigint,round:int,from:bigint,to:bigint>>")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(own)), F.col("_size").alias("size"), F.coalesce("taken", F.lit(0).cast("bigint")).alias("taken"), F.coalesce("slots", none).alias("slots"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document; see ``mixture`` for nulls, empties, ties and repeats."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The line of a source is taken from its start up to the target, over and over; the schedule orders the blocks.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
c AS (SELECT *, source_size * 3 / weight AS ceiling FROM s),
l AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
      FROM c WINDOW w AS (ORDER BY ceiling, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT level AS common FROM l WHERE level <= ceiling ORDER BY ceiling, level LIMIT 1),
t AS (SELECT source, source_size, CAST(CASE WHEN ceiling <= common THEN source_size * 3 ELSE common * weight END AS DOUBLE) AS target FROM l, m),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS stop,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST((SELECT sum(greatest(0, least(stop, k * source_size + begin + size) - (k * source_size + begin))) FROM range(0, 3) r(k)) AS BIGINT) AS taken
FROM p
"""
