"""Language ID: blended-spectrum presence kernels, Nyström landmarks, one-versus-rest kernel ridge regression.

The kernel of two texts is the number of n-grams of 1 to ``ORDER`` code points that both have, over the root of the
product of their numbers (presence, so length doesn't matter); n-grams are hashed to ``DIMENSIONS`` positions.
Landmarks are texts of the training sample; with their kernel matrix, a text's Nyström features are its kernel values
against them times the inverse root. As the kernel is a product of presence vectors, landmarks, root and regression
weights multiply out to one matrix (positions x languages), which scores batches of presence vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import bounded_batches, table
from .words import MULTIPLIERS, as_bytes, mix, slices

ORDER, DIMENSIONS = 4, 1 << 15
_PLAIN = np.arange(128, dtype=np.uint32)
_PLAIN[[i for i in range(128) if not chr(i).isalpha()]] = 32


def presence(texts: list[str]) -> np.ndarray:
    """Boolean matrix, texts x DIMENSIONS: the n-grams each whole text has, lower-cased, ASCII non-letters as blanks."""
    low = [f" {t.lower()} " for t in texts]
    sizes = np.array([len(t) for t in low], np.int64)
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(codes < 128, _PLAIN[np.minimum(codes, 127)], codes).astype(np.uint64) + np.uint64(1)
    row = np.repeat(np.arange(len(texts)), sizes)
    end = np.repeat(np.cumsum(sizes), sizes)
    out = np.zeros(len(texts) * DIMENSIONS, bool)
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, ORDER + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = h[:m] * MULTIPLIERS[0] + codes[n - 1 :]
        at = np.flatnonzero(np.arange(m) + n <= end[:m])
        out[row[at] * DIMENSIONS + (mix(h[at] + np.uint64(n)) & np.uint64(DIMENSIONS - 1)).astype(np.int64)] = True
    return out.reshape(len(texts), DIMENSIONS)


def _text_slices(texts: list[bytes | None], rows: int = 128) -> Iterator[tuple[int, int]]:
    for a, b in slices([len(t) if t else 0 for t in texts], 1 << 20):
        yield from ((i, min(i + rows, b)) for i in range(a, b, rows))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_bytes(batch.column("text"))
        bits: list[bytes] = []
        for a, b in _text_slices(texts):
            bits += [np.packbits(x).tobytes() for x in presence([(t or b"").decode("utf-8", "replace") for t in texts[a:b]])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(bits, pa.binary())], names=["doc_id", "lang", "bits"])


def sample(docs: DataFrame, per_language: int, most_languages: int, where: F.Column) -> DataFrame:
    """At most ``per_language`` rows (doc_id, lang) of each of the ``most_languages`` most frequent languages, by a hash.

    A language's rows are first thinned by the hash to about four times what is taken, so no task sorts a language.
    """
    x = docs.where(where & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    often = x.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(most_languages)
    x = x.join(F.broadcast(often), "lang").where(F.pmod("h", F.lit(1 << 30)).cast("double") * F.col("n") <= F.lit(float(4 * per_language << 30)))
    x = x.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("k") <= per_language)
    return x.select("doc_id", "lang").distinct()


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray):
        self.languages, self.weights = languages, weights

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language and its score from 0 to 1."""
        x = presence(texts)
        s = (x.astype(np.float32) @ self.weights) / np.sqrt(np.maximum(x.sum(1), 1))[:, None]
        best = s.argmax(1)
        return best, np.clip((s[np.arange(len(texts)), best] + 1) / 2, 0, 1)


def fit(rows: list[tuple[str, bytes]], landmarks: int, ridge: float) -> Model | None:
    """From (language, packed presence); None without rows. Both the sample and the landmarks are bounded by parameters."""
    if not rows:
        return None
    languages = sorted({r[0] for r in rows})
    turns: dict[str, int] = {}
    order = []
    for i, (language, _) in enumerate(rows):
        turns[language] = turns.get(language, -1) + 1
        order.append((turns[language], i))
    chosen = [i for _, i in sorted(order)[:landmarks]]  # languages in turn
    marks = _unpacked([rows[i][1] for i in chosen])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    features = np.concatenate([_unpacked([r[1] for r in rows[i : i + 512]]) @ marks.T for i in range(0, len(rows), 512)]) @ root
    place = {x: i for i, x in enumerate(languages)}
    own = np.array([place[r[0]] for r in rows])
    goal = np.where(own[:, None] == np.arange(len(languages)), 1.0, -1.0)
    w = 1 / np.bincount(own)[own]  # languages count alike
    w *= len(rows) / w.sum()
    a = features.T @ (features * w[:, None]) + ridge * np.eye(len(chosen))
    return Model(languages, (marks.T @ (root @ np.linalg.solve(a, features.T @ (goal * w[:, None])))).astype(np.float32))


def _unpacked(bits: list[bytes]) -> np.ndarray:
    x = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8)).reshape(len(bits), -1).astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def _predict(model: Model | None) -> Callable:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            for a, b in _text_slices(texts) if model else ():
                part = [(t or b"").decode("utf-8", "replace") for t in texts[a:b]]
                best, score = model.predict(part)
                for i, t in enumerate(part):
                    if any(map(str.isalpha, t)):
                        langs[a + i], scores[a + i] = model.languages[best[i]], float(score[i])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return f


def identify(docs: DataFrame, *, learn_where: F.Column, per_language: int = 250, most_rows: int = 10_000, most_languages: int = 400, landmarks: int = 256, ridge: float = 0.1) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of ``docs`` (doc_id, text, lang).

    Learns from at most ``per_language`` labelled rows of each language among ``learn_where``, from ``most_languages`` at
    most (the most frequent) and ``most_rows`` in all: the driver holds 4 KB of each, and unpacks 512 and the landmarks at
    a time. Null texts and texts without a letter are ``und`` with score 0, as is everything when no labelled row is there;
    ties go to the language first by name. Predictions read the text alone. Repeated rows are predicted each; rows without
    an id can't be told apart and are learned from only as one. Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    ids = sample(docs, per_language, most_languages, learn_where)
    packed = docs.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").where("text IS NOT NULL").dropDuplicates(["doc_id", "lang"]).select("doc_id", "lang", "text").mapInArrow(_packed, "doc_id long, lang string, bits binary")
    rows = sorted((r.doc_id, r.lang, bytes(r.bits)) for r in packed.collect())
    each = max(1, most_rows // max(1, len({r[1] for r in rows})))
    seen: dict[str, int] = {}
    few = []
    for _, lang, bits in rows:
        seen[lang] = seen.get(lang, 0) + 1
        if seen[lang] <= each:
            few.append((lang, bits))
    model = fit(few, landmarks, ridge)
    return docs.select("doc_id", "text").mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those not held out; see ``identify`` for nulls, empties and ties."""
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, learn_where=F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
