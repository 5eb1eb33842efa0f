"""The knowledge graph of Python sources: symbols as nodes; calls, inheritance and data flow as edges.

Names are resolved by equi-joins on sides cut to one row per name beforehand, so a join never multiplies rows. First means
by (file, line, fqn), which no order of processing changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import python_code
from .graph import first_edges


def nodes(symbols: DataFrame) -> DataFrame:
    """(id, type, name, file, line, is_private): one per fqn, its last definition."""
    last = F.max_by(F.struct("kind", "name", "path", "line", "is_private"), "line").alias("s")
    return symbols.groupBy(F.col("fqn").alias("id")).agg(last).select("id", F.col("s.kind").alias("type"), "s.name", F.col("s.path").alias("file"), "s.line", "s.is_private")


def _firsts(nodes: DataFrame, by: list[str], prefer: Column, out: str) -> DataFrame:
    return nodes.groupBy(*by).agg(F.min_by("id", F.struct(prefer.alias("p"), "file", "line", "id")).alias(out))


def resolved(names: DataFrame, nodes: DataFrame, name: str, out: str, prefer: list[str] | None = None) -> DataFrame:
    """``names`` (with path and ``name``) with ``out``: the node of that name in the same file, else the first anywhere.

    ``prefer`` puts nodes of these types first. Null where no node has the name.
    """
    rank = F.when(F.col("type").isin(prefer), 0).otherwise(1) if prefer else F.lit(0)
    own = _firsts(nodes.select("id", "type", "line", "file", F.col("file").alias("path"), F.col("name").alias(name)), ["path", name], rank, "_own")
    anywhere = _firsts(nodes.select("id", "type", "line", "file", F.col("name").alias(name)), [name], rank, "_any")
    return names.join(own, ["path", name], "left").join(anywhere, name, "left").withColumn(out, F.coalesce("_own", "_any")).drop("_own", "_any")


def calls(nodes: DataFrame, raw: DataFrame) -> DataFrame:
    """(src, dst), distinct: calls (path, caller, callee) with both ends resolved; imports count as symbols of their file."""
    x = resolved(resolved(raw.select("path", "caller", "callee").distinct(), nodes, "caller", "src"), nodes, "callee", "dst")
    return x.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()


def inherits(symbols: DataFrame, bases: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst): from the members of a class to its bases, as a class's scope knows the bases and the class symbol doesn't."""
    x = symbols.select("path", "scope", F.col("fqn").alias("src")).join(bases.select("path", "scope", "base"), ["path", "scope"])
    return resolved(x, nodes, "base", "dst", ["class"]).where("dst IS NOT NULL").select("src", "dst").distinct()


def def_use(dataflow: DataFrame) -> DataFrame:
    """(path, func, var, def_line, use_line): uses below a definition of the same variable; later definitions don't end it."""
    d = dataflow.where("role <> 'use'").select("path", "func", "var", F.col("line").alias("def_line")).distinct()
    u = dataflow.where("role = 'use'").select("path", "func", "var", F.col("line").alias("use_line")).distinct()
    return d.join(u, ["path", "func", "var"]).where("use_line > def_line")


def bindings(parameters: Column, args: Column, keywords: Column) -> Column:
    """Parameters bound to the arguments in their places, then those named."""
    placed = F.transform(F.slice(F.arrays_zip(parameters.alias("name"), args.alias("expr")), F.lit(1), F.least(F.size(parameters), F.size(args))), lambda z: F.struct(z["name"].alias("name"), z["expr"].alias("expr")))
    return F.concat(placed, keywords)


def flows(nodes: DataFrame, called: DataFrame, dataflow: DataFrame, sites: DataFrame, returned: DataFrame) -> DataFrame:
    """(src, dst, kind, props, ord): data flow inside functions, into callees and back to whom keeps the result."""
    kinds = ["function", "method"]
    place = lambda df, c: resolved(df, nodes, c, "node", kinds).where("node IS NOT NULL")
    inside = place(def_use(dataflow), "func").select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit("def_use").alias("kind"), F.to_json(F.struct("var", "def_line", "use_line")).alias("props"), F.col("def_line").alias("ord"))
    functions = place(dataflow.select("path", "func").distinct(), "func").select("node").distinct()
    params = place(dataflow.where("role = 'parameter'").groupBy("path", "func").agg(F.collect_list("var").alias("parameters")), "func").groupBy("node").agg(F.first("parameters").alias("parameters"))
    first_site = place(sites, "func").groupBy("node", "callee").agg(F.min_by(F.struct("line", "args", "keywords", "assigned_to"), "ord").alias("site"))
    short = called.withColumn("callee", F.element_at(F.split("dst", ":"), -1))
    x = short.join(first_site.withColumnRenamed("node", "src"), ["src", "callee"]).join(functions.withColumnRenamed("node", "dst"), "dst", "left_semi")
    x = x.join(params.withColumnRenamed("node", "dst"), "dst", "left").withColumn("bound", bindings(F.coalesce("parameters", F.array().cast("array<string>")), F.col("site.args"), F.col("site.keywords")))
    into = x.select("src", "dst", F.lit("interprocedural_call").alias("kind"), F.to_json(F.struct(F.col("site.line").alias("call_line"), "bound", "site.assigned_to")).alias("props"), F.col("site.line").alias("ord"))
    gives = place(returned, "func").select(F.col("node").alias("dst")).distinct()
    back = x.where("site.assigned_to IS NOT NULL").join(gives, "dst", "left_semi").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("return_propagation").alias("kind"), F.to_json(F.struct(F.col("site.line").alias("call_line"), "site.assigned_to")).alias("props"), F.col("site.line").alias("ord"))
    return inside.unionByName(into).unionByName(back)


def build(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of ``files`` (path, content). Edges: (src, dst, type, kind, props), the first of each (src, dst, type)."""
    facts = {k: python_code.extract(files, k) for k in ("symbols", "calls", "dataflow", "bases", "call_sites", "returns")}
    n = nodes(facts["symbols"])
    called = calls(n, facts["calls"])
    plain = lambda df, t: df.select("src", "dst", F.lit(t).alias("type"), F.lit(t).alias("kind"), F.lit("{}").alias("props"), F.lit(0).alias("ord"))
    f = flows(n, called, facts["dataflow"], facts["call_sites"], facts["returns"])
    edges = plain(called, "calls").unionByName(plain(inherits(facts["symbols"], facts["bases"], n), "inherits")).unionByName(f.withColumn("type", F.lit("dataflow")))
    return n, first_edges(edges, ["ord", "kind", "props"]).select("src", "dst", "type", "kind", "props")
