"""Vector operators: similarities inside code generation, top-k, and search anchored in a graph."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import bfs


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(1e-8))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v))


def nearest(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """The k vectors (vec_id, embedding) nearest by L2 to the single row of ``query`` (embedding), ties by vec_id.

    One query row, so it is broadcast whatever the size of ``vectors``; the top k are kept in each task first.
    """
    q = query.select(F.col("embedding").alias("_q")).limit(1)
    return vectors.crossJoin(F.broadcast(q)).withColumn("distance", l2(F.col("embedding"), F.col("_q"))).drop("_q").orderBy("distance", "vec_id").limit(k)


def nearest_per_group(vectors: DataFrame, query: DataFrame, group: str, k: int) -> DataFrame:
    """As ``nearest`` for each value of ``group``, with ``rank``. A first cut within 32 parts bounds every sort."""
    q = query.select(F.col("embedding").alias("_q")).limit(1)
    x = vectors.crossJoin(F.broadcast(q)).withColumn("distance", l2(F.col("embedding"), F.col("_q"))).drop("_q", "embedding")
    for keys in ([group, F.pmod(F.xxhash64("vec_id"), F.lit(32))], [group]):
        x = x.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy("distance", "vec_id"))).where(F.col("rank") <= k)
    return x


def pair_stats(vectors: DataFrame, group: str, threshold: float = 0.9, block: int = 2_000) -> DataFrame:
    """(group, pairs, mean, most, alike) of the cosines of all pairs in a group, those above ``threshold`` counted.

    A group is cut into blocks of about ``block`` vectors by a hash of vec_id and every pair of blocks is one matrix product,
    in a task of its own where the group is hot. No pair is emitted and memory is two blocks. Null vectors are left out, and groups
    of fewer than two vectors have no row. The work is quadratic in a group, as all its pairs are asked for.
    """
    x = vectors.where("embedding IS NOT NULL").select(F.col(group).alias("g"), "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    parts = x.groupBy(F.col("g").alias("_g")).agg(F.ceil(F.count("*") / block).alias("n"))
    x = x.join(parts, F.col("g").eqNullSafe(F.col("_g"))).select("g", "n", F.pmod(F.xxhash64("vec_id"), F.col("n")).alias("b"), "v")
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("o")
    x = x.select("g", "b", "v", other).select("g", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), (F.col("b") > F.col("o")).alias("second"), "v")

    def compared(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.stack(pdf["v"][~pdf["second"]]) if (~pdf["second"]).any() else np.zeros((0, 1))
        if key[1] == key[2]:
            b, left = a, np.triu_indices(len(a), 1)
        else:
            b = np.stack(pdf["v"][pdf["second"]]) if pdf["second"].any() else np.zeros((0, a.shape[1]))
            left = ...
        if not len(a) or not len(b):
            return pd.DataFrame({"g": [], "pairs": [], "total": [], "most": [], "alike": []})
        c = (a @ b.T / (np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)) + 1e-8))[left].ravel()
        if not len(c):
            return pd.DataFrame({"g": [], "pairs": [], "total": [], "most": [], "alike": []})
        return pd.DataFrame({"g": [key[0]], "pairs": [len(c)], "total": [c.sum()], "most": [c.max()], "alike": [int((c > threshold).sum())]})

    part = x.groupBy("g", "lo", "hi").applyInPandas(compared, f"g {dict(x.dtypes)['g']}, pairs long, total double, most double, alike long")
    out = part.groupBy("g").agg(F.sum("pairs").alias("pairs"), (F.sum("total") / F.sum("pairs")).alias("mean"), F.max("most").alias("most"), F.sum("alike").alias("alike"))
    return out.withColumnRenamed("g", group)


def anchored_search(vectors: DataFrame, query: DataFrame, edges: DataFrame, k: int, depth: int) -> DataFrame:
    """(node, depth, is_anchor): nearest vectors that are graph nodes, expanded along edges both ways.

    Vectors without a node are dropped. Anchors come first by depth; a node that is both keeps the anchor row.
    """
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    found = F.broadcast(nearest(vectors, query, k).select(F.col("vec_id").alias("node")))  # k rows
    anchors = ends.join(found, "node").distinct()
    return bfs(edges, anchors, depth, "both").withColumn("is_anchor", F.col("depth") == 0)
