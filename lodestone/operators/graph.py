"""Graph operators on edge tables (src, dst, type): breadth-first expansion, roles, importance.

Expansions are frontier joins: each hop joins the frontier with the edges and drops what was seen, so a hop costs one
pass over the edges at the frontier and cycles end by themselves. Seen nodes are written out hop by hop (checkpoint), which cuts
the lineage of long expansions.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """Checkpointed in the folder named by spark.checkpoint.dir; a folder of its own only where none is set."""
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir", None) and sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
    return df.checkpoint()


#: Frontiers of at most this many nodes, counted, are sent to the edges; wider ones are joined by shuffle.
BROADCAST_NODES = 1_000_000


def directed(edges: DataFrame, direction: str = "out", types: list[str] | None = None) -> DataFrame:
    """Edges as (src, dst, type) to walk along: out, in or both; only of the types given."""
    e = edges.select("src", "dst", "type")
    if types is not None:
        e = e.where(F.col("type").isin(types))
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type")
    return {"out": e, "in": back, "both": e.unionByName(back)}[direction]


def bfs(edges: DataFrame, anchors: DataFrame, depth: int, direction: str = "out", types: list[str] | None = None) -> DataFrame:
    """(node, depth) of all nodes at most ``depth`` hops from ``anchors`` (node); anchors have depth 0.

    Equal edges need no removal: what a hop reaches is made distinct, and only that is shuffled while the frontier is small.
    """
    e = directed(edges, direction, types).select("src", "dst")
    seen = kept(anchors.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for hop in range(1, depth + 1):
        n = frontier.count()
        if n == 0:
            break
        near = F.broadcast(frontier) if n <= BROADCAST_NODES else frontier
        reached = e.join(near, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = kept(reached.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return seen


def neighbours(edges: DataFrame, nodes: DataFrame, direction: str = "out", types: list[str] | None = None) -> DataFrame:
    """(node, neighbour, type): one hop from each of ``nodes`` (node), a row per edge and direction."""
    e = directed(edges, direction, types).withColumnsRenamed({"src": "node", "dst": "neighbour"})
    return e.join(nodes.select("node").distinct(), "node", "left_semi")


def simple_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, longest: int = 5, types: list[str] | None = None) -> DataFrame:
    """(path): paths along edges from ``sources`` to ``targets`` (node) of at most ``longest`` nodes, none twice.

    A path ends at the first target it meets; edges of several types between two nodes give a path each. Every node of a
    path lies in its first half, near the sources, or in its second, near the targets, so only edges among these nodes are
    walked. A walk back along them from the targets first tells how far every node is, so only paths that can still
    arrive in time are carried on.
    """
    half = max(longest - 2, 0) // 2
    near = bfs(edges, sources, half, "out", types).select("node").unionByName(bfs(edges, targets, max(longest - 2 - half, 0), "in", types).select("node"))
    near = kept(near.distinct())
    near = F.broadcast(near) if near.count() <= BROADCAST_NODES else near
    edges = kept(induced(directed(edges, "out", types), near).distinct())
    far = kept(bfs(edges, targets, longest - 1, "in")).select(F.col("node").alias("end"), F.col("depth").alias("left"))
    step = edges.select(F.col("src").alias("at"), F.col("dst").alias("end")).join(far, "end")
    paths = kept(sources.select(F.col("node").alias("end")).distinct().join(far, "end").select(F.array("end").alias("path"), "end", "left"))
    done = paths.where("left = 0")
    for n in range(2, longest + 1):
        longer = paths.where("left > 0").select("path", F.col("end").alias("at")).join(step, "at").where(~F.array_contains("path", F.col("end")) & (F.col("left") <= longest - n))
        paths = kept(longer.select(F.concat("path", F.array("end")).alias("path"), "end", "left"))
        if paths.isEmpty():
            break
        done = done.unionByName(paths.where("left = 0"))
    return done.select("path")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes`` (node)."""
    n = nodes.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi")


def first_edges(edges: DataFrame, order: list[str]) -> DataFrame:
    """One edge per (src, dst, type), the first by ``order``: later properties never replace earlier ones."""
    keep = F.min_by(F.struct(*(c for c in edges.columns if c not in ("src", "dst", "type"))), F.struct(*order))
    return edges.groupBy("src", "dst", "type").agg(keep.alias("p")).select("src", "dst", "type", "p.*")


def importance(edges: DataFrame) -> DataFrame:
    """(node, outgoing, incoming, types, score): 1.2 * out + in + 1.5 * distinct edge types, to three places."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), "type").unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"), "type"))
    x = ends.groupBy("node").agg(F.sum("o").cast("bigint").alias("outgoing"), F.sum("i").cast("bigint").alias("incoming"), F.count_distinct("type").alias("types"))
    return x.withColumn("score", F.bround(F.col("outgoing") * 1.2 + F.col("incoming") + F.col("types") * 1.5, 3))


# Names of startup functions, marks of readiness and of targets downstream, and what an edge is worth on a path.
BOOT_NAMES = ["main", "app", "run", "start", "__main__"]
READY = ["ready", "listen", "serve", "mount", "init", "setup"]
DOWNSTREAM = ["repo", "repository", "dao", "db", "database", "model", "query", "save", "fetch", "store"]
EDGE_WORTH = {"dataflow": 3, "calls": 2, "contains": 1}


def first_paths(steps: DataFrame, anchors: DataFrame, depth: int) -> DataFrame:
    """(node, depth, path, score): the path on which a breadth-first walk in sorted order first meets each node.

    ``steps`` has (src, dst, rank, worth): a node's neighbours are visited by (rank, dst), those of nodes met earlier
    first; worth adds up to the score. A queue's order within a depth is the order of the (rank, node) lists from the anchor
    on, so the least list of each node says who met it first, and no queue is needed.
    """
    start = anchors.select("node").distinct()
    seen = kept(start.select("node", F.lit(0).alias("depth"), F.array("node").alias("path"), F.lit(0).cast("bigint").alias("score"), F.array(F.struct(F.lit(0).alias("rank"), "node")).alias("_order")))
    frontier = seen
    for hop in range(1, depth + 1):
        x = frontier.join(steps, F.col("node") == F.col("src")).join(seen.select(F.col("node").alias("dst")), "dst", "left_anti")
        longer = F.struct(F.concat("_order", F.array(F.struct(F.col("rank").cast("int").alias("rank"), F.col("dst").alias("node")))).alias("_order"), F.concat("path", F.array("dst")).alias("path"), (F.col("score") + F.col("worth")).alias("score"))
        x = x.select(F.col("dst").alias("node"), longer.alias("m")).groupBy("node").agg(F.min("m").alias("m"))
        frontier = kept(x.select("node", F.lit(hop).alias("depth"), "m.path", "m.score", "m._order"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def preferred_path(edges: DataFrame, entry: DataFrame, target: DataFrame | None = None, depth: int = 8) -> DataFrame:
    """(path, score), one row or none: data flow before calls before containment, downstream targets first.

    ``edges`` has (src, dst, type) and may have ``bonus`` (of the kind of data flow) and ``downstream``. With a target
    (node): the first path to it, of fewer than ``depth`` edges. Without: the path of the highest score, the first met
    of equal ones.
    """
    down = F.coalesce(F.col("downstream"), F.lit(False)) if "downstream" in edges.columns else F.lit(False)
    bonus = F.coalesce(F.col("bonus"), F.lit(0)) if "bonus" in edges.columns else F.lit(0)
    rank, worth = F.lit(len(EDGE_WORTH)), F.lit(0)
    for k, (name, w) in enumerate(EDGE_WORTH.items()):
        rank, worth = F.when(F.col("type") == name, k).otherwise(rank), F.when(F.col("type") == name, w).otherwise(worth)
    steps = edges.select("src", "dst", (2 * rank + F.when(down, 0).otherwise(1)).alias("rank"), (worth + bonus + F.when(down, 2).otherwise(0)).alias("worth"))
    met = first_paths(steps, entry, depth)
    if target is not None:
        return met.where(F.col("depth") < depth).join(target.select("node").distinct(), "node", "left_semi").orderBy("depth", "_order").limit(1).select("path", "score")
    return met.where("depth > 0").orderBy(F.desc("score"), "depth", "_order").limit(1).select("path", "score")


def downstream(*texts: Column) -> Column:
    """Whether ids, names or files look like those of a data layer."""
    return F.lower(F.concat_ws(" ", *texts)).rlike("|".join(DOWNSTREAM))


def boot_entries(edges: DataFrame, names: DataFrame, most: int = 5) -> DataFrame:
    """(node): callers with a startup name; if there are none, the ``most`` best by names that hold one, many callees and few callers.

    ``edges`` are calls (src, dst), taken once each; ``names`` has (node, name).
    """
    e = edges.select("src", "dst").distinct()
    out, into = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out")), e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"))
    x = out.join(into, "node", "left").join(names.groupBy("node").agg(F.lower(F.min("name")).alias("name")), "node", "left").fillna({"n_in": 0, "name": ""})
    looks = F.when(F.col("name").rlike("|".join(BOOT_NAMES)), 4).otherwise(0)
    x = kept(x.withColumn("score", looks + F.least("n_out", F.lit(5)) - F.least("n_in", F.lit(3))))
    named = x.where(F.col("name").isin(BOOT_NAMES)).select("node")
    if not named.isEmpty():
        return named
    return x.orderBy(F.desc("score"), F.desc("n_in"), "n_out", F.desc("node")).limit(most).select("node")


def boot_chain(edges: DataFrame, entries: DataFrame, names: DataFrame, depth: int = 50) -> DataFrame:
    """(node, depth, called_by, callees, is_entry, is_ready): what the entries start, each by the caller that meets it first.

    Ready: not an entry's depth, and a leaf or with a name that says so.
    """
    e = edges.select("src", "dst").distinct()
    met = first_paths(e.select("src", "dst", F.lit(0).alias("rank"), F.lit(0).alias("worth")), entries, depth)
    n = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("callees"))
    x = met.join(n, "node", "left").join(names.groupBy("node").agg(F.lower(F.min("name")).alias("name")), "node", "left").fillna({"callees": 0, "name": ""})
    ready = (F.col("depth") > 0) & ((F.col("callees") == 0) | F.col("name").rlike("|".join(READY)))
    return x.select("node", "depth", F.try_element_at("path", F.when(F.col("depth") > 0, -2).otherwise(-1000)).alias("called_by"), "callees", (F.col("depth") == 0).alias("is_entry"), ready.alias("is_ready"))


def _bounded(edges: DataFrame, most: int) -> None:
    if edges.limit(most + 1).count() > most:
        raise ValueError(f"a walk in order runs in one task: over {most} edges")


def _sequential(edges: DataFrame, walk: Callable, schema: str, most: int) -> DataFrame:
    """``walk`` over the sorted adjacency of ``edges`` in one task. More than ``most`` edges are refused, not cut."""
    _bounded(edges, most)

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["src", "dst"])
        near = {n: list(g) for n, g in pdf.groupby("src")["dst"]}
        return pd.DataFrame(walk(near), columns=[c.split()[0] for c in schema.split(", ")])

    return edges.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda pdf: f(pdf), schema)


def dfs(edges: DataFrame, anchors: DataFrame, depth: int, direction: str = "out", types: list[str] | None = None, most: int = 5_000_000) -> DataFrame:
    """(node, depth): visited depth first in sorted order; a node met deep isn't expanded again from a shorter way.

    The order makes it sequential. It can't leave what a breadth-first walk of the same depth reaches, so only the edges
    inside that are walked, at most ``most`` of them.
    """
    at = anchors.select("node").distinct()
    ball = kept(bfs(edges, at, depth, direction, types))
    e = directed(edges, direction, types).select("src", "dst").distinct()
    e = kept(induced(e, ball).select("src", "dst").unionByName(at.select(F.col("node").alias("src"), F.lit(None).alias("dst"))))
    kind = at.schema["node"].dataType.simpleString()

    _bounded(e, most)

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        walk = pdf[pdf["dst"].notna()].astype({"dst": pdf["src"].dtype})
        near = {n: sorted(g, reverse=True) for n, g in walk.groupby("src")["dst"]}
        met: dict = {}
        for a in sorted(pdf.loc[pdf["dst"].isna(), "src"]):
            todo = [(a, 0)]
            while todo:  # a node is marked when taken off, as a recursion marks it when entered
                node, d = todo.pop()
                if node in met or d > depth:
                    continue
                met[node] = d
                todo += [(x, d + 1) for x in near.get(node, ()) if x not in met]
        return pd.DataFrame(list(met.items()), columns=["node", "depth"])

    return e.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda pdf: f(pdf), f"node {kind}, depth int")


def cycle_roots(edges: DataFrame, most: int = 5_000_000) -> DataFrame:
    """(cycles, callers, penalty): roots of a depth-first walk that meet a cycle, over the number of callers.

    Nodes stay on the walk's stack after a hit, so a later root that reaches them counts too.
    """

    def walk(near: dict) -> list[tuple]:
        visited: set = set()
        stack: set = set()
        cycles = 0
        for root in near:
            if root in visited:
                continue
            visited.add(root)
            stack.add(root)
            todo, hit = [(root, iter(near[root]))], False
            while todo and not hit:
                node, rest = todo[-1]
                nxt = next((x for x in rest if x not in visited or x in stack), None)
                if nxt is None:
                    stack.discard(node)
                    todo.pop()
                elif nxt in visited:
                    hit = True
                else:
                    visited.add(nxt)
                    stack.add(nxt)
                    todo.append((nxt, iter(near.get(nxt, ()))))
            cycles += hit
        return [(cycles, len(near), cycles / max(len(near), 1))]

    return _sequential(edges.select("src", "dst").distinct(), walk, "cycles long, callers long, penalty double", most)


#: Distinct edges up to which the ends are peeled off by one task, some 100 bytes an edge.
PEEL_EDGES = 1 << 22


def _peeled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (src, dst) that are left when ends are taken off one by one; each edge is met once from either side."""
    held = list(batches)
    if not held:
        return
    t = pa.Table.from_batches(held).combine_chunks()
    names = pc.unique(pa.chunked_array([*t.column("src").chunks, *t.column("dst").chunks]))
    ends = [pc.index_in(t.column(c), names).to_numpy().astype(np.int64) for c in ("src", "dst")]
    degree, near = [], []  # of every node, out and in: its edges still there; the nodes at their other ends
    for own, other in (ends, ends[::-1]):
        count = np.bincount(own, minlength=len(names))
        degree.append(count)
        near.append((memoryview(np.concatenate([[0], np.cumsum(count)])), memoryview(other[np.argsort(own, kind="stable")])))
    gone = (degree[0] == 0) | (degree[1] == 0)
    todo, left, out = np.flatnonzero(gone).tolist(), [memoryview(d) for d in degree], memoryview(gone)
    while todo:
        node = todo.pop()
        for side in (0, 1):
            first, others = near[side]
            for x in others[first[node] : first[node + 1]]:
                left[1 - side][x] -= 1
                if not left[1 - side][x] and not out[x]:
                    out[x] = True
                    todo.append(x)
    yield from t.filter(pa.array(~(gone[ends[0]] | gone[ends[1]]))).to_batches(max_chunksize=10_000)


def cyclic(edges: DataFrame) -> DataFrame:
    """Edges of the part in which every node has a way in and a way out: all cycles and what lies between them.

    Ends are peeled off; without cycles nothing stays. Up to PEEL_EDGES edges, counted, that is one task's work, as long
    chains take as many rounds as half their length. More edges are peeled round by round until so few are left.
    """
    e = kept(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    n = e.count()
    while n > PEEL_EDGES:
        into, out = e.select(F.col("dst").alias("src")).distinct(), e.select(F.col("src").alias("dst")).distinct()
        e = kept(e.join(into, "src", "left_semi").join(out, "dst", "left_semi").select("src", "dst"))
        m = e.count()
        if m == n:
            return e
        n = m
    return e.coalesce(1).mapInArrow(_peeled, e.schema)
