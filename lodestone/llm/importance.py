"""Quality classifier: importance resampling with hashed n-gram generative models, sampled by Gumbel top-k.

Bags of hashed n-grams (folded words and pairs of them; shapes of words, alone and in pairs; whether a word repeats the
one before) are counted in a bounded sample of labelled documents: the target (good, not toxic) and the raw text, which
is the whole sample as the corpus mixes it. A document's log weight is the log ratio of the target's model to the raw
one's over all its n-grams. A few insults stand in an otherwise good text and vanish in that sum, so toxic text is a
second raw component, judged over the distinct n-grams whose counts differ significantly and by STRONG; the weight
is the target's probability over the sum of both components', each with MARGIN of prior odds.

Sampling without replacement by weight is a top-k of ``sharpness`` * log weight + Gumbel noise (from a hash of the row, so
reruns agree). k is a parameter; by default it is the expected number of good documents, the sum of weights capped at 1,
so good documents are not thinned out. The k-th key is found by narrowing histograms.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, quoted, saved, table
from .words import MULTIPLIERS, Tokens, mix, text_slices

#: Positions of the n-grams, and of the pairs of words behind them.
BUCKETS, PAIRS = 1 << 20, 1 << 20
#: Buckets that the driver works on at a time.
SLICE = 1 << 16
#: Log odds that a text is good before its n-grams are seen: one n-gram that is there by chance turns nothing away.
MARGIN = 4.0
#: Least log ratio of an n-gram that counts as toxic: many weaker ones only tell one language from another.
STRONG = 3.0
_SHAPE = np.array([97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256)], np.uint64)


def ngrams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every n-gram of every whole text, texts in any order."""
    fold, x = Tokens(texts, fold=True), Tokens(texts)
    row = lambda t: np.repeat(np.arange(len(t.lengths)), t.lengths)
    b = np.frombuffer(x.raw, np.uint8)
    shape = np.zeros(len(x.ids), np.uint64)
    for k in range(4):  # the last four bytes
        at = x.ends - 1 - k
        shape = shape << np.uint64(8) | np.where(at >= x.starts, _SHAPE[b[np.maximum(at, 0)]], 0).astype(np.uint64)
    rows = row(x)
    pair = np.flatnonzero(rows[1:] == rows[:-1])
    twice = (x.ids[1:] == x.ids[:-1])[pair].astype(np.uint64)
    own = row(fold)
    near = np.flatnonzero(own[1:] == own[:-1])
    words = mix(fold.ids[near] * MULTIPLIERS[0] + fold.ids[near + 1]) & np.uint64(PAIRS - 1)
    parts = [(own, fold.ids), (rows, mix(shape + np.uint64(1 << 33))), (rows[pair], mix(shape[pair] << np.uint64(32) | shape[pair + 1])), (rows[pair], mix(twice + np.uint64(1 << 34)))]
    single = (np.concatenate([h for _, h in parts]) & np.uint64(BUCKETS - 1)).astype(np.int64)
    return np.concatenate([*(r for r, _ in parts), own[near]]), np.concatenate([single, words.astype(np.int64) + BUCKETS])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of occurrences and of documents by class (0 target, 1 junk, 2 toxic), of one partition of the sample."""
    size = BUCKETS + PAIRS
    total = np.zeros((3, 2, size), np.int32)
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        for first, texts in text_slices(batch):
            rows, buckets = ngrams(texts)
            once = np.unique(rows * size + buckets)
            for k in range(3):
                total[k, 0] += np.bincount(buckets[kinds[first + rows] == k], minlength=size).astype(np.int32)
                total[k, 1] += np.bincount(once[kinds[first + once // size] == k] % size, minlength=size).astype(np.int32)
    for k in range(3):
        for i in range(2):
            at = np.flatnonzero(total[k, i])
            yield pa.RecordBatch.from_pydict({"kind": pa.array([k], pa.int64()), "what": pa.array([i], pa.int64()), "counts": pa.array([zlib.compress(at.astype(np.int32).tobytes() + total[k, i][at].tobytes(), 1)], pa.binary())})


def log_ratio(target: np.ndarray, raw: np.ndarray, smooth: float, significant: float = 0.0) -> np.ndarray:
    """log p(target) - log p(raw) by bucket, shrunk to 0 by ``smooth`` counts of what both would have in common.

    Buckets where the raw count is less than ``significant`` deviations from that are 0, as are all without data.
    """
    n, m, out = float(target.sum()), float(raw.sum()), np.zeros(len(target), np.float32)
    if not n or not m:
        return out
    for i in range(0, len(out), SLICE):
        x, y = target[i : i + SLICE].astype(float), raw[i : i + SLICE].astype(float)
        both = (x + y) / (n + m)
        part = np.log((x + smooth) / (both * n + smooth)) - np.log((y + smooth) / (both * m + smooth))
        if significant:
            part[np.abs(y - both * m) < significant * np.sqrt(both * m * n / (n + m) + 0.5)] = 0
        out[i : i + SLICE] = part
    return out


class Model:
    """Of the counts of occurrences in the target and in all, and of documents in the target and the toxic ones."""

    def __init__(self, target: np.ndarray, everything: np.ndarray, target_docs: np.ndarray, toxic_docs: np.ndarray):
        self.raw = log_ratio(target, everything, 5)
        toxic = log_ratio(target_docs, toxic_docs, 2, 4)
        self.toxic = np.where(toxic <= -STRONG, toxic, np.float32(0))

    def log_weights(self, texts: list[bytes | None]) -> np.ndarray:
        rows, buckets = ngrams(texts)
        raw = np.bincount(rows, self.raw[buckets], len(texts))
        single = np.flatnonzero(buckets < BUCKETS)
        at = single[self.toxic[buckets[single]] != 0]
        once = np.unique(rows[at] * BUCKETS + buckets[at])
        toxic = np.bincount(once // BUCKETS, self.toxic[once % BUCKETS], len(texts))
        return -np.logaddexp(-(raw + MARGIN), -(toxic + MARGIN))


def _add(total: np.ndarray, counts: bytes) -> None:
    """Adds what ``_counted`` packed, as far as ``total`` reaches."""
    at, n = np.frombuffer(zlib.decompress(counts), np.int32).reshape(2, -1)
    for i in range(0, int(np.searchsorted(at, len(total))), SLICE):
        part = at[i : i + SLICE]
        part = part[part < len(total)]
        total[part] += n[i : i + len(part)]


def train(docs: DataFrame, labels: DataFrame, train_rows: int) -> Model:
    """From at most ``train_rows`` labelled documents, by a hash of doc_id; texts that repeat count once."""
    spark = docs.sparkSession
    kind = F.when((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), 0).when(F.col("quality") == 0, 1).when(F.col("toxic") == 1, 2)
    some = labels.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), kind.cast("bigint").alias("kind")).where("doc_id IS NOT NULL AND kind IS NOT NULL").groupBy("doc_id").agg(F.max("kind").alias("kind"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = docs.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id").where("text IS NOT NULL")
    parts = max(1, train_rows // 2_500)
    rows = rows.groupBy(F.md5("text").alias("h")).agg(F.max("kind").alias("kind"), F.first("text").alias("text")).select("kind", "text").repartition(parts, F.xxhash64("text"))
    # of documents only the n-grams without pairs are counted: a pair says no more of an insult than its word
    target, everything, *docs_of = (np.zeros(size, np.int64) for size in (BUCKETS + PAIRS, BUCKETS + PAIRS, BUCKETS, BUCKETS))
    into = {(0, 0): [target, everything], (1, 0): [everything], (2, 0): [everything], (0, 1): docs_of[:1], (2, 1): docs_of[1:]}
    for r in rows.mapInArrow(_counted, "kind long, what long, counts binary").toLocalIterator():
        for total in into.get((r.kind, r.what), ()):
            _add(total, r.counts)
    bounded_batches(spark)
    return Model(target, everything, *docs_of)


def _weigh(model: Model, columns: int) -> Callable:
    """The first ``columns`` of a batch and the log weight of its last one, the text."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [model.log_weights(texts) for _, texts in text_slices(batch, "_weighed")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:columns], pa.array(np.concatenate(out) if out else [], pa.float64())], names=[*batch.schema.names[:columns], "_log_weight"])

    return f


def kth_largest(values: DataFrame, column: str, k: int, bins: int = 1024) -> float:
    """Of a column without nulls; each pass keeps the bin that holds it, until the bin has one value."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    if low is None or k <= 0:
        return math.inf
    x = values.select(F.col(column).alias("v"))
    while low < high:
        width = (high - low) / bins
        bin_ = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(width)), F.lit(bins - 1)) if width > 0 else F.lit(0)
        part = {r.b: r for r in x.where(F.col("v").between(F.lit(low), F.lit(high))).groupBy(bin_.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")).collect()}
        for b in sorted(part, reverse=True):
            if k <= part[b].n:
                narrower = part[b].least > low or part[b].most < high
                low, high = part[b].least, part[b].most
                break
            k -= part[b].n
        if not narrower:
            break
    return low


def weighed(docs: DataFrame, labels: DataFrame, *, columns: list[str] | None = None, k: int | None = None, train_rows: int = 20_000, sharpness: float = 3.0, seed: int = 7) -> tuple[DataFrame, Callable[[], float]]:
    """The ``columns`` of ``docs`` (all by default) with ``_log_weight`` and ``_key``, written once, and a function that gives
    the k-th key: rows at or above it are the sample (ties at it are all in).

    ``docs`` needs doc_id and text, ``labels`` doc_id, quality and toxic. Null and empty texts have no n-grams, so nothing
    speaks against them. Repeated rows have one key. Without labels of a kind nothing is turned away for it; ids that are
    no numbers meet no label. Columns already named ``_log_weight`` or ``_key`` are replaced; empty tables give no rows.
    """
    model = train(docs, labels, train_rows)
    kept = [c for c in columns or docs.columns if c not in ("_log_weight", "_key")]
    x = docs.select(*(F.col(quoted(c)) for c in kept), F.xxhash64(F.lit(seed), F.col("doc_id")).alias("_noise"), F.col("text").cast("string").alias("_weighed"))
    schema = "".join(f"{quoted(f.name)} {f.dataType.simpleString()}, " for f in x.schema.fields[:-1])
    x = x.mapInArrow(_weigh(model, len(kept) + 1), f"{schema}_log_weight double")
    u = (F.pmod(F.col("_noise"), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52)
    out = saved(x.withColumn("_key", F.col("_log_weight") * sharpness - F.log(-F.log(u))).drop("_noise"))

    def threshold() -> float:
        most = k
        if most is None:
            most = round(out.agg(F.sum(F.exp(F.least(F.col("_log_weight") * sharpness, F.lit(0.0))))).first()[0] or 0)
        return kth_largest(out, "_key", most)

    return out, threshold


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log weight, key and verdict of every document; see ``weighed`` for nulls, empties and repeats."""
    out, threshold = weighed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), columns=["doc_id"])
    return out.select("doc_id", F.col("_log_weight").alias("log_weight"), F.col("_key").alias("sample_key"), (F.col("_key") >= threshold()).alias("kept"))
