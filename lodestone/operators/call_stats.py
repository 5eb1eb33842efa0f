"""Figures of call graphs and symbol tables: file dependencies, payload totals, structures, reading order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import kept


def file_of(symbol: Column) -> Column:
    """The part of a symbol before its first colon; ``unknown`` where it has none, as external names do."""
    return F.when(F.contains(symbol, F.lit(":")), F.substring_index(symbol, ":", 1)).otherwise("unknown")


def internal(calls: DataFrame) -> DataFrame:
    """Calls (caller, callee) whose callee is a symbol of the repository."""
    return calls.where(F.contains("callee", F.lit(":")))


def file_dependencies(calls: DataFrame) -> DataFrame:
    """(file, depends_on) distinct: files called from another file; null where a file calls none."""
    x = calls.select(file_of(F.col("caller")).alias("file"), file_of(F.col("callee")).alias("depends_on"))
    other = x.where("file <> depends_on").distinct()
    return x.select("file").distinct().join(other, "file", "left")


def payload(calls: DataFrame, external: bool = False) -> DataFrame:
    """One row: functions, edges, entry points (called by none) and the largest fan-out of distinct calls."""
    e = (calls if external else internal(calls)).select("caller", "callee").distinct()
    callers = calls.select(F.col("caller").alias("node")).distinct()  # a caller of external names only is a node
    degree = e.groupBy("caller").agg(F.count("*").alias("out"))
    ends = e.select(F.col("callee").alias("node"), F.lit(1).alias("called")).distinct()
    x = callers.join(ends, "node", "full").join(degree, F.col("node") == F.col("caller"), "left")
    return x.agg(F.count("*").alias("functions"), F.coalesce(F.sum("out"), F.lit(0)).alias("edges"), F.count_if(F.col("called").isNull()).alias("entry_points"), F.coalesce(F.max("out"), F.lit(0)).alias("max_fan_out"))


def structures(nodes: DataFrame, contains: DataFrame, most: int = 20, shown: int = 25) -> DataFrame:
    """(id, name, file, contained, children): the classes that contain most, with their first ``shown`` by type and name.

    ``nodes`` has id, type, name, file; ``contains`` src and dst. Children that aren't nodes count but aren't shown. A rank
    within a hash of the child cuts what a class sends on, so a class of any size isn't collected whole.
    """
    classes = nodes.where("type = 'class'")
    n = contains.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("contained"))
    top = kept(classes.join(n, "id", "left").select("id", "name", "file", F.coalesce("contained", F.lit(0)).alias("contained")).orderBy(F.desc("contained"), "name", "file", "id").limit(most))
    child = contains.join(F.broadcast(top.select(F.col("id").alias("src"))), "src").join(nodes.select(F.col("id").alias("dst"), "type", F.col("name").alias("child")), "dst")
    for keys in (["src", F.pmod(F.xxhash64("dst"), F.lit(64))], ["src"]):
        child = child.withColumn("k", F.row_number().over(W.partitionBy(*keys).orderBy("type", "child", "dst"))).where(F.col("k") <= shown)
    first = child.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("type", "child", "dst"))).alias("some"))
    return top.join(first, F.col("id") == F.col("src"), "left").select("id", "name", "file", "contained", F.coalesce(F.transform("some", lambda s: s["child"]), F.array().cast("array<string>")).alias("children"))


def kinds_per_file(symbols: DataFrame) -> DataFrame:
    """(path, symbols, classes, functions, methods) of a symbol table (path, kind)."""
    count = lambda kind: F.count_if(F.col("kind") == kind)
    return symbols.groupBy("path").agg(F.count("*").alias("symbols"), count("class").alias("classes"), count("function").alias("functions"), count("method").alias("methods"))


def depths(calls: DataFrame, depends: DataFrame, entries: DataFrame) -> DataFrame:
    """(node, depth): the least depth from ``entries`` (node), a call (src, dst) one step and a data-flow dependency half.

    Nodes are settled in order of depth, half a step a round, so none is joined twice; it ends when nothing is
    reached for a whole step. Nodes out of reach have no row.
    """
    e = kept(calls.select("src", "dst", F.lit(2).alias("w")).unionByName(depends.select("src", "dst", F.lit(1).alias("w"))).where("src IS NOT NULL AND dst IS NOT NULL"))
    seen = kept(entries.select("node").where("node IS NOT NULL").distinct().withColumn("at", F.lit(0)))
    layers, k = {0: seen}, 1
    while layers:
        near = [e.where(F.col("w") == k - at).join(x, F.col("src") == F.col("node")).select(F.col("dst").alias("node")) for at, x in layers.items()]
        new = kept(reduce(DataFrame.unionByName, near).distinct().join(seen.select("node"), "node", "left_anti").withColumn("at", F.lit(k)))
        layers = {at: x for at, x in layers.items() if at == k - 1}
        if not new.isEmpty():
            layers[k] = new
            seen = seen.unionByName(new)
        k += 1
    return seen.select("node", (F.col("at") / 2).alias("depth"))


def reading_order(symbols: DataFrame, depth: DataFrame) -> DataFrame:
    """(path, min_depth, symbols): files by the depth of their nearest symbol; files out of reach have none and come last.

    ``symbols`` has fqn and path. ``depth`` is what ``depths`` gives.
    """
    x = symbols.select("path", F.col("fqn").alias("node")).join(depth, "node", "left")
    return x.groupBy("path").agg(F.min("depth").alias("min_depth"), F.count("*").alias("symbols"))


def file_tree(paths: DataFrame) -> DataFrame:
    """(folder, name, is_file) of every level of ``paths`` (path): the rows of a nested tree, the root folder empty."""
    p = F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/")
    x = paths.where("path <> ''").select(p.alias("p")).select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("k"))
    return x.select(F.array_join(F.slice("p", F.lit(1), F.col("k") - 1), "/").alias("folder"), F.element_at("p", F.col("k")).alias("name"), (F.col("k") == F.size("p")).alias("is_file")).distinct()
