"""Sinks: an artefact store by repository and kind, graphs as JSON lines and back, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Artefacts:
    """Tables by (repository, kind) under one shared folder, one Parquet folder each. Writing again replaces a table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, repo: str, kind: str) -> str:
        for part in (repo, kind):
            if not part or part.startswith(".") or "/" in part:
                raise ValueError(f"not a name of one folder: {part!r}")
        return f"{self.root}/{repo}/{kind}"

    def save(self, repo: str, kind: str, df: DataFrame) -> str:
        """Written beside the old table and moved over it, so a table may be saved from its own rows."""
        at = self._at(repo, kind)
        new = f"{self.root}/{repo}/.new-{kind}"
        df.write.mode("overwrite").parquet(new)
        self._fs.delete(self._path(at), True)
        if not self._fs.rename(self._path(new), self._path(at)):
            raise OSError(f"{new} could not be moved to {at}")
        return at

    def load(self, repo: str, kind: str) -> DataFrame | None:
        return self.spark.read.parquet(self._at(repo, kind)) if self.exists(repo, kind) else None

    def exists(self, repo: str, kind: str) -> bool:
        return self._fs.exists(self._path(self._at(repo, kind)))

    def _names(self, folder: str) -> list[str]:
        p = self._path(folder)
        if not self._fs.exists(p):
            return []
        return sorted(n for s in self._fs.listStatus(p) if s.isDirectory() and not (n := s.getPath().getName()).startswith("."))

    def repos(self) -> list[str]:
        return self._names(self.root)

    def kinds(self, repo: str) -> list[str]:
        return self._names(f"{self.root}/{repo}")

    def delete(self, repo: str, kind: str | None = None) -> int:
        """The number of tables that are gone."""
        gone = [k for k in self.kinds(repo) if kind in (None, k)]
        for k in gone:
            self._fs.delete(self._path(self._at(repo, k)), True)
        return len(gone)


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    nodes.write.mode("overwrite").json(f"{folder}/nodes")
    edges.write.mode("overwrite").json(f"{folder}/edges")


def read_graph(spark: SparkSession, folder: str, nodes: StructType | str, edges: StructType | str) -> tuple[DataFrame, DataFrame]:
    """With the schemas given, so nothing is read to guess them and empty tables keep their columns."""
    return spark.read.schema(nodes).json(f"{folder}/nodes"), spark.read.schema(edges).json(f"{folder}/edges")


def report_lines(suggestions: DataFrame, most: int = 20) -> DataFrame:
    """(ord, line): a Markdown report of suggestions (smell, file, priority, effort, strategies): counts, then the first ``most``."""
    rank = F.array_position(F.array(*map(F.lit, ["high", "medium", "low"])), F.lower("priority"))
    x = suggestions.withColumn("_r", F.when(rank > 0, rank).otherwise(4))
    n = x.groupBy().agg(F.count("*").alias("n"), *[F.count_if(F.col("_r") == k).alias(f"n{k}") for k in (1, 2, 3)])
    head = n.select(F.posexplode(F.array(F.lit("# Refactoring suggestions"), F.format_string("Total: %d", "n"), F.format_string("- High priority: %d", "n1"), F.format_string("- Medium priority: %d", "n2"), F.format_string("- Low priority: %d", "n3"))).alias("ord", "line"))
    top = x.orderBy("_r", "file", "smell").limit(most)
    body = top.select((F.lit(100) * F.col("_r")).alias("ord"), F.format_string("## %s in %s (%s, effort %s): %s", "smell", "file", "priority", "effort", F.array_join(F.coalesce("strategies", F.array().cast("array<string>")), "; ")).alias("line"))
    return head.unionByName(body)


def write_report(suggestions: DataFrame, folder: str, most: int = 20) -> None:
    """The report as one Markdown text, the suggestions as JSON and as CSV."""
    report_lines(suggestions, most).orderBy("ord", "line").select("line").coalesce(1).write.mode("overwrite").text(f"{folder}/markdown")
    suggestions.write.mode("overwrite").json(f"{folder}/json")
    suggestions.withColumn("strategies", F.array_join("strategies", "; ")).write.mode("overwrite").option("header", True).csv(f"{folder}/csv")
