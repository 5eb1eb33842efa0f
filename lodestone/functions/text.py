"""Text functions as expressions that stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes stripped by the stemmer, in order of trial.
SUFFIXES = ("ing", "ed", "es", "s", "er", "est", "ly")


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0)))


def stem(word: Column) -> Column:
    """The first suffix that fits goes, where more than two characters stay before it."""
    out = word
    for s in reversed(SUFFIXES):
        out = F.when(F.endswith(word, F.lit(s)) & (F.length(word) > len(s) + 2), F.substring(word, F.lit(1), F.length(word) - len(s))).otherwise(out)
    return out


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays taken as sets; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)
