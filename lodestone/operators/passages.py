"""What a retrieved chunk is shown and asked with: summaries, titles, context, sources, follow-up questions, duplicates.

Chunks are rows with any of: path, start_line, end_line, symbol_name, parent_class, node_type, text. All but the greedy
removal of look-alikes are expressions or one aggregate over the chunks of a question.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_QUOTES = ('"""', "'''")


def prefixed(repo: Column, path: Column) -> Column:
    """A path with its repository in front, as nodes and chunks are keyed."""
    return F.concat_ws(":", repo, path)


def unprefixed(path: Column) -> Column:
    """A path without the repository in front of its first colon; a path without one stays."""
    return F.regexp_replace(path, "^[^:]*:", "")


def _slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def title(path: Column, symbol: Column, node_type: Column) -> Column:
    """Path and symbol, or the kind of node where there is no symbol; null and empty values count as absent."""
    some = lambda c, other: F.when(c != "", c).otherwise(F.lit(other))
    return F.concat(_slashes(some(path, "unknown")), F.lit(" → "), F.when(symbol != "", symbol).otherwise(some(node_type, "chunk")))


def breadcrumb(path: Column) -> Column:
    return F.when(F.contains(_slashes(path), F.lit("/")), F.replace(_slashes(path), F.lit("/"), F.lit(" › "))).otherwise(path)


def summary(text: Column) -> Column:
    """The first line that is a comment or begins a docstring, without its marks; else 120 characters of the first line."""
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r]"), trim), lambda s: s != "")
    said = F.get(F.filter(lines, lambda s: s.startswith("#") | s.startswith(_QUOTES[0]) | s.startswith(_QUOTES[1])), F.lit(0))
    bare = trim(F.regexp_replace(said, "^[# ]+|[# ]+$", ""))
    for mark in ('"', "'"):
        bare = F.regexp_replace(bare, f"^{mark}+|{mark}+$", "")
    return F.coalesce(trim(bare), F.substring(F.get(lines, F.lit(0)), 1, 120), F.lit("Code chunk with no visible content."))


def matched_terms(question: Column, text: Column, most: int = 10) -> Column:
    """The first ``most`` in order of the words that both have, in lower case; null texts have none."""
    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z_][A-Za-z0-9_]*"), F.lit(0))
    return F.slice(F.array_sort(F.array_intersect(words(question), words(text))), 1, most)


def segment(content: Column, start: Column, end: Column, padding: int = 20) -> Column:
    """(text, start_line, end_line) of the lines around a chunk.

    The first ``start + 1 - padding`` lines are left out, not ``start - padding``: line numbers are taken as offsets.
    Null content gives null; a chunk beyond the end gives an empty text.
    """
    lines = F.regexp_extract_all(content, F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0))
    first = F.greatest(F.lit(0), F.coalesce(start, F.lit(1)) - padding)
    last = F.least(F.size(lines), F.coalesce(end, F.lit(1)) + padding)
    text = F.array_join(F.slice(lines, first + 1, F.greatest(F.lit(0), last - first)), "")
    return F.when(content.isNotNull(), F.struct(text.alias("text"), (first + 1).alias("start_line"), last.alias("end_line")))


def expanded(chunks: DataFrame, files: DataFrame, window: int = 20) -> DataFrame:
    """``chunks`` with ``context``: the lines around each in its file (path, content); empty where the file is missing."""
    f = files.select(F.col("path").alias("_path"), F.col("content").alias("_content"))
    x = chunks.join(f, unprefixed(F.col("path")) == F.col("_path"), "left")
    return x.withColumn("context", F.coalesce(segment(F.col("_content"), F.col("start_line"), F.col("end_line"), window)["text"], F.lit(""))).drop("_path", "_content")


def assembled(chunks: DataFrame, by: str, order: str = "rank", most_chars: int = 1200) -> DataFrame:
    """(by, context, sources): the chunks of a question in order, each cut to ``most_chars``, and the list of their places.

    Needs path, start_line, end_line, text, context. The chunks of one question are what a search returned, a few.
    """
    path = _slashes(F.when(F.col("path") != "", F.col("path")).otherwise("unknown"))
    line = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    merged = F.concat(F.coalesce("text", F.lit("")), F.lit("\n\n# Additional Context\n"), F.coalesce("context", F.lit("")))
    x = chunks.select(by, order, path.alias("path"), line("start_line").alias("s"), line("end_line").alias("e"), F.substring(merged, 1, most_chars).alias("text"))
    x = x.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, "path", "s", "e", "text"))).alias("c"))
    place = lambda c: F.concat(c["path"], F.lit(" ("), c["s"], F.lit("–"), c["e"], F.lit(")\n"))
    context = F.transform("c", lambda c, k: F.concat(F.lit("### Source "), (k + 1).cast("string"), F.lit(": "), place(c), c["text"]))
    sources = F.transform("c", lambda c, k: F.concat((k + 1).cast("string"), F.lit(". "), c["path"], F.lit(": "), c["s"], F.lit("–"), c["e"]))
    return x.select(by, F.array_join(context, "\n\n-----\n\n").alias("context"), F.array_join(sources, "\n").alias("sources"))


def followups(chunks: DataFrame, by: str, order: str = "rank", most: int = 3, words: int = 12) -> DataFrame:
    """(by, ord, question): what to ask next from the chunks found, the first ``most`` by chunk and rule.

    Distinct, longer than three characters and of at most ``words`` words.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    path = _slashes(F.coalesce("path", F.lit("")))
    file = F.element_at(F.split(path, "/"), -1)
    module = F.regexp_replace(file, r"(?<=[^.])\.[^.]*$", "")
    parts = F.split(path, "/")
    folder = F.when(F.size(parts) > 1, F.get(parts, F.size(parts) - 2)).otherwise("")
    symbol, parent = text("symbol_name"), text("parent_class")
    either = F.when(symbol != "", symbol).otherwise(parent)
    asked = F.array(
        F.when(symbol != "", F.concat(symbol, F.lit(" implementation in "), file)),
        F.when(symbol != "", F.concat(symbol, F.lit(" usage "), module)),
        F.when(parent != "", F.concat(parent, F.lit(" class methods in "), file)),
        F.when(parent != "", F.concat(parent, F.lit(" initialization "), module)),
        F.when(module != "", F.concat(module, F.lit(" logic "), either)),
        F.when(folder != "", F.concat(folder, F.lit(" "), either, F.lit(" flow"))),
    )
    x = chunks.select(by, order, F.posexplode(asked).alias("rule", "question")).where("question IS NOT NULL")
    x = x.withColumn("question", F.trim(F.regexp_replace("question", r"\s+", " "))).where((F.length("question") > 3) & (F.size(F.split("question", " ")) <= words))
    x = x.groupBy(by, "question").agg(F.min(F.struct(order, "rule")).alias("at"))
    return x.withColumn("ord", F.row_number().over(W.partitionBy(by).orderBy("at", "question"))).where(F.col("ord") <= most).select(by, "ord", "question")


def two_hops(questions: DataFrame, search: Callable[[DataFrame, int], DataFrame], rerank: Callable[[DataFrame, int], DataFrame], by: str = "question_id", k: int = 16, more: int = 12, top: int = 6) -> DataFrame:
    """The ``top`` chunks of a search for (by, question), widened by a second search with questions that the first suggests.

    ``search(questions, k)`` gives chunks by question with ``rank``; ``rerank(candidates, k)`` scores them against the first
    question and gives the best with ``rank``. Places found by both searches count once, by their better rank.
    """
    first = search(questions, k)
    asked = followups(rerank(first, top), by).select(by, "question")
    both = first.unionByName(search(asked, more), allowMissingColumns=True)
    return rerank(deduplicated(both, by), top)


def deduplicated(chunks: DataFrame, by: str, order: str = "rank") -> DataFrame:
    """The first chunk of each place (path, start_line, end_line) a question has found; nulls are a place."""
    w = W.partitionBy(by, "path", "start_line", "end_line").orderBy(order)
    return chunks.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def distinct_in_meaning(chunks: DataFrame, by: str, order: str = "rank", threshold: float = 0.9, most: int = 1_000) -> DataFrame:
    """(by, order) of chunks left when each, in order, is dropped if its cosine with one kept before exceeds ``threshold``.

    The removal is sequential by nature; a question's chunks are what a search returned. More than ``most`` of them are
    refused with an error, never cut. Chunks without a vector stay. Equal places should go first (``deduplicated``).
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > most:
            raise ValueError(f"{len(pdf)} chunks of one question, at most {most} are compared")
        pdf, kept, seen = pdf.sort_values(order, kind="stable"), [], []
        for k, v in enumerate(pdf["embedding"]):
            if v is not None:
                v = np.asarray(v, float)
                v = v / (np.linalg.norm(v) + 1e-8)
                if seen and (np.stack(seen) @ v).max() > threshold:
                    continue
                seen.append(v)
            kept.append(k)
        return pdf.iloc[kept][[by, order]]

    x = chunks.select(by, order, "embedding")
    types = dict(x.dtypes)
    return x.groupBy(by).applyInPandas(walk, f"`{by}` {types[by]}, `{order}` {types[order]}")


def diversity(chunks: DataFrame, by: str) -> DataFrame:
    """(by, files, symbols, languages): how many different ones an answer draws on; empty values don't count."""
    some = lambda c: F.count_distinct(F.when(F.col(c) != "", F.col(c)))
    return chunks.groupBy(by).agg(some("path").alias("files"), some("symbol_name").alias("symbols"), some("language").alias("languages"))
