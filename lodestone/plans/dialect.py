"""Plans written once: Spark SQL over named DataFrames, and the same text for the SQL the results are compared with.

``{table}`` names a table. ``RC(column, 'pattern')`` counts matches of a pattern that both regex engines read alike.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _doubles(sql: str) -> str:
    """Numbers with a point as doubles, in both dialects; quoted text stays."""
    return re.sub(r"'[^']*'|(?<![\w.])\d+\.\d+(?![\w.])", lambda m: m[0] if m[0][0] == "'" else f"{m[0]}e0", sql)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plan(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    used = [t for t in TABLES if f"{{{t}}}" in sql]
    text = re.sub(r"RC\((\w+(?:\.\w+)?), '([^']*)'\)", r"CAST(regexp_count(\1, r'\2') AS BIGINT)", _doubles(sql))
    return lambda spark, sf_dir: spark.sql(text, **{t: load(spark, sf_dir, t) for t in used})


def oracle(sql: str) -> str:
    text = re.sub(r"RC\((\w+(?:\.\w+)?), '([^']*)'\)", r"CAST(len(regexp_extract_all(\1, '\2')) AS BIGINT)", _doubles(sql))
    return re.sub(r"\{(\w+)\}", r"\1", text)
