"""Author identities: candidate pairs by shared name parts, and merged groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parts(name: Column, least: int = 3) -> Column:
    """Lower-case name parts of at least ``least`` characters, without digits at the end."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(F.trim(name)), "[^a-z ]+", " "), " +"), lambda x: F.length(x) >= least))


def candidates(names: DataFrame) -> DataFrame:
    """(a, b), a < b: names with a part in common, by an equi-join on parts."""
    p = names.select("name", F.explode(parts(F.col("name"))).alias("part"))
    return p.alias("x").join(p.alias("y"), "part").where("x.name < y.name").select(F.col("x.name").alias("a"), F.col("y.name").alias("b")).distinct()


def groups(totals: DataFrame) -> DataFrame:
    """(name, anchor): greedily by (-commits, name), a name joins the first anchor it shares a part with.

    The order of anchors makes this sequential. It takes the names after filtering by activity, of which the caller
    keeps few (the engine's reports take the top 20); it runs as one group.
    """

    def f(pdf):
        pdf = pdf.sort_values(["commits", "name"], ascending=[False, True])
        anchors: list[tuple[str, set]] = []
        out = []
        for name, own in zip(pdf["name"], pdf["parts"], strict=True):
            hit = next((a for a, p in anchors if p & set(own)), None)
            if hit is None:
                anchors.append((name, set(own)))
            out.append(hit or name)
        return pdf.assign(anchor=out)[["name", "anchor", "commits"]]

    return totals.withColumn("parts", parts(F.col("name"))).withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(f, "name string, anchor string, commits long")


ORACLE_SQL = """
WITH n AS (SELECT DISTINCT p_name AS name FROM part),
p AS (SELECT name, unnest(list_distinct(string_split_regex(regexp_replace(lower(trim(name)), '[^a-z ]+', ' ', 'g'), ' +'))) AS part FROM n)
SELECT DISTINCT x.name AS a, y.name AS b FROM p x JOIN p y ON x.part = y.part WHERE length(x.part) >= 3 AND x.name < y.name
"""
