"""Resolution: names through lexical scopes, attributes through types, chunks to graph nodes and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lookup(uses: DataFrame, symbols: DataFrame, scopes: DataFrame, levels: int = 32) -> DataFrame:
    """``uses`` (use_id, scope, name) with the symbol each name means: fqn, type_hint and distance (scopes further out).

    ``symbols`` has (scope, name, fqn, type_hint, ord), ``scopes`` (scope, parent). The innermost scope that has the name
    decides, there the last symbol by ``ord``, as later ones replace it; uses that no scope resolves have nulls. Only
    unresolved uses go on outwards, up to ``levels`` scopes; more raises an error rather than losing any.
    """
    by = W.partitionBy("scope", "name").orderBy(F.col("ord").desc(), "fqn")
    own = symbols.withColumn("_k", F.row_number().over(by)).where("_k = 1").select(F.col("scope").alias("_scope"), F.col("name").alias("_name"), "fqn", "type_hint")
    up = scopes.select(F.col("scope").alias("_in"), "parent").dropDuplicates(["_in"])
    chain = uses.select("scope").distinct().select("scope", F.col("scope").alias("at"), F.lit(0).alias("distance"))
    chains = chain
    for k in range(1, levels + 1):
        chain = chain.join(up, F.col("at") == F.col("_in")).where("parent IS NOT NULL").select("scope", F.col("parent").alias("at"), F.lit(k).alias("distance"))
        if chain.isEmpty():
            break
        chains = chains.unionByName(chain)
    else:
        raise ValueError(f"scopes nested deeper than {levels}")
    found = uses.join(chains, "scope").join(own, (F.col("at") == F.col("_scope")) & (F.col("name") == F.col("_name")))
    best = found.groupBy("use_id").agg(F.min(F.struct("distance", "fqn", "type_hint")).alias("b"))
    return uses.join(best, "use_id", "left").select(*(uses[c] for c in uses.columns), "b.fqn", "b.type_hint", "b.distance")


def attributes(uses: DataFrame, symbols: DataFrame, scopes: DataFrame) -> DataFrame:
    """``uses`` (use_id, scope, name, attr) of ``obj.attr`` with the attribute's fqn, through the type hint of ``obj``.

    The object is looked up by scope; its type names a class, and the attribute is that of the first scope, by name, one
    of whose parts is that class. Objects without a type, and attributes that no such scope has, have null.
    """
    typed = lookup(uses, symbols, scopes).select("use_id", "attr", "type_hint").where("type_hint IS NOT NULL")
    held = symbols.select(F.explode(F.array_distinct(F.split("scope", ":"))).alias("_class"), F.col("scope").alias("_scope"), F.col("name").alias("_attr"), F.col("fqn").alias("_fqn"), "ord")
    # the first of a class's attributes by name is found before uses meet it: a class may have as many as the symbols are
    own = held.groupBy("_class", "_attr").agg(F.min(F.struct("_scope", -F.col("ord"), "_fqn")).alias("_first"))
    hit = typed.join(own, (F.col("type_hint") == F.col("_class")) & (F.col("attr") == F.col("_attr"))).groupBy("use_id").agg(F.min("_first")["_fqn"].alias("attr_fqn"))
    return uses.join(hit, "use_id", "left").select(*(uses[c] for c in uses.columns), "attr_fqn")


def nodes_of_chunks(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """``chunks`` (path, start_line, end_line, symbol_name, parent_class) with ``node``: the graph node each stands for.

    The node named ``path:symbol_name``, or else of the nodes (id, file, name, line) of that file and name the one with the
    least class penalty, then line distance, then id. Chunks without a symbol or a match have a null node. Paths are
    compared with forward slashes.
    """
    slash = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    key = ["path", "start_line", "end_line", "symbol_name", "parent_class"]
    own = chunks.where("path <> '' AND symbol_name <> ''").select(*key).distinct()
    n = nodes.select("id", slash(F.col("file")).alias("_file"), F.col("name").alias("_name"), F.coalesce("line", F.lit(0)).alias("_line"))
    exact = own.join(nodes.select("id").distinct(), F.col("id") == F.concat_ws(":", "path", "symbol_name")).select(*key, F.col("id").alias("node"))
    renamed = lambda df, more=(): df.select(*(F.col(c).alias(f"_{c}_") for c in key), *more)
    same = lambda: [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in key]
    rest = own.join(renamed(exact), same(), "left_anti")
    start = F.coalesce("start_line", F.lit(0))
    end = F.coalesce("end_line", start)
    away = F.when((start == 0) | (F.col("_line") == 0) | F.col("_line").between(start, F.greatest(start, end)), 0).otherwise(F.least(F.abs(F.col("_line") - start), F.abs(F.col("_line") - end)))
    penalty = F.when(F.coalesce("parent_class", F.lit("")) == "", 0).when(F.contains("id", F.concat(F.lit(":"), F.col("parent_class"), F.lit(":"))), 0).otherwise(1)
    near = rest.join(n, (slash(F.col("path")) == F.col("_file")) & (F.col("symbol_name") == F.col("_name"))).groupBy(*key).agg(F.min(F.struct(penalty.alias("p"), away.alias("d"), "id"))["id"].alias("node"))
    found = renamed(exact.unionByName(near), ["node"])
    return chunks.join(found, same(), "left").select(*chunks.columns, "node")


def chunks_of_nodes(nodes: DataFrame, mapped: DataFrame) -> DataFrame:
    """Every chunk of ``mapped`` (from ``nodes_of_chunks``) that stands for a node of ``nodes`` (node, others)."""
    return nodes.join(mapped, "node")


def anchors_then_expanded(anchors: DataFrame, expanded: DataFrame) -> DataFrame:
    """Both, with one row for each path and start line: an anchor before an expanded chunk, then by ``rank``.

    Both have path, start_line and rank; the other columns are the same in both.
    """
    both = anchors.withColumn("is_anchor", F.lit(True)).unionByName(expanded.withColumn("is_anchor", F.lit(False)))
    by = W.partitionBy("path", F.coalesce("start_line", F.lit(0))).orderBy(F.col("is_anchor").desc(), "rank")
    return both.withColumn("_k", F.row_number().over(by)).where("_k = 1").drop("_k")


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    """The first by ``rank`` of the chunks with one (path, start_line, end_line)."""
    by = W.partitionBy("path", "start_line", "end_line").orderBy("rank")
    return chunks.withColumn("_k", F.row_number().over(by)).where("_k = 1").drop("_k")
