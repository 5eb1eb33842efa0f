"""Benchmark decontamination: a prefix-filtered set join with exact verification.

Every window of an item (``window`` words, or the whole item where it has fewer) is a record of word shingles. A pass
over the corpus counts the shingles of the items; ordered by that rarity, the containment asked for (all of a window)
makes the rarest shingle the whole necessary prefix. A second pass joins document shingles with those prefixes only,
drops candidates whose window would start before the text or end after it, and compares the words that are left
one by one. Items are taken in blocks of ``block_bytes``, and a block is what each task holds: the driver reads
item texts block by block, whatever the benchmark's size. Counts follow the block. With one block documents are not
shuffled; of further blocks only the hits are kept, by text, and joined to the documents once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, quoted, table
from .words import Tokens, inner, text_slices, windows

SHINGLE = 3


def _hashes(x: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    return windows(x.ids, n), inner(x.lengths, n)


class _Index:
    """The windows of one block of items: the block's words once, and where each different window starts in them.

    A window's shingles are those of the block that start inside it, so they are hashed once for all windows.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        x = Tokens([text.encode("utf-8", "surrogatepass") if text else None for _, text in items], fold=True)
        self.words = [w for i in range(len(items)) for w in x.words(i)]
        self.owners: list[set[str]] = []
        starts, sizes = [], []
        seen: dict[bytes, int] = {}
        for (item, _), first, m in zip(items, x.first.tolist(), x.lengths.tolist(), strict=False):
            n = min(window, m)
            for p in range(first, first + m - n + 1 if n else first):
                k = seen.setdefault(b" ".join(self.words[p : p + n]), len(starts))
                if k == len(starts):
                    starts.append(p)
                    sizes.append(n)
                    self.owners.append(set())
                if item is not None:
                    self.owners[k].add(item)
        self.start, self.size = np.array(starts, np.int64), np.array(sizes, np.int64)
        self._hash = {n: windows(x.ids, n) for n in {min(SHINGLE, n) for n in sizes}}
        self.known = {n: np.unique(self._shingles(n)[1]) for n in self._hash}

    def _shingles(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows cut into shingles of ``n`` words: the windows, and for each of their shingles hash and window."""
        of = np.flatnonzero(np.minimum(self.size, SHINGLE) == n)
        many = self.size[of] - n + 1
        row = np.repeat(np.arange(len(of)), many)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        return of, self._hash[n][self.start[of][row] + offset], row

    def prefixes(self, count: dict[tuple[int, int], int]) -> dict[int, tuple[np.ndarray, list[list[tuple[int, int]]]]]:
        """By shingle length: the sorted prefix shingles, and each one's (window, offset of the shingle)."""
        out = {}
        for n, known in self.known.items():
            of, h, row = self._shingles(n)
            found = np.array([count.get((n, int(v)), 0) for v in known.tolist()], np.int64)
            order = np.lexsort((h, found[np.searchsorted(known, h)], row))  # the rarest first; of equal ones the first in the window
            best = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
            offset = best - np.searchsorted(row, np.arange(len(of)))
            keys, which = np.unique(h[best], return_inverse=True)
            places: list[list[tuple[int, int]]] = [[] for _ in keys]
            for q, k, o in zip(which.tolist(), of.tolist(), offset.tolist(), strict=True):
                places[q].append((k, o))
            out[n] = keys, places
        return out


def _found(h: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(among, h), len(among) - 1)
    hit = np.flatnonzero(among[at] == h)
    return hit, at[hit]


def _count(known: dict[int, np.ndarray]) -> Callable:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {n: np.zeros(len(k), np.int64) for n, k in known.items()}
        for batch in batches:
            for _, texts in text_slices(batch):
                x = Tokens(texts, fold=True)
                for n, k in known.items():
                    h, ok = _hashes(x, n)
                    total[n] += np.bincount(_found(h[ok], k)[1], minlength=len(k))
        for n, k in known.items():
            some = total[n] > 0
            yield pa.RecordBatch.from_pydict({"n": pa.array([n] * int(some.sum()), pa.int64()), "shingle": pa.array(k[some].view(np.int64)), "found": pa.array(total[n][some])})

    return f


def _join(index: _Index, prefixes: dict, only_hits: bool = False) -> Callable:
    """``_n_words``, ``_hits`` and ``_items`` beside the columns; ``only_hits``: of hit texts alone, with their MD5 as ``_text_md5``."""
    words, start_of, size_of, owners_of = index.words, index.start.tolist(), index.size.tolist(), index.owners

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits: list[list[int]] = [[]] * batch.num_rows
            items: list[list[str]] = [[]] * batch.num_rows
            sizes = [0] * batch.num_rows
            for first, texts in text_slices(batch):
                x = Tokens(texts, fold=True)
                marked: dict[int, tuple[set[int], set[str]]] = {}
                for n, (keys, places) in prefixes.items():
                    h, ok = _hashes(x, n)
                    h[~ok] = 0
                    hit, which = _found(h, keys)
                    hit, which = hit[ok[hit]], which[ok[hit]]
                    texts_of = np.searchsorted(x.first, hit, "right") - 1
                    for p, q, t in zip(hit.tolist(), which.tolist(), texts_of.tolist(), strict=True):
                        for k, offset in places[q]:
                            w = words[start_of[k] : start_of[k] + size_of[k]]
                            start = p - offset
                            if start < x.first[t] or start + len(w) > x.first[t + 1]:  # length and position
                                continue
                            if x.buf[x.starts[start] : x.ends[start + len(w) - 1]].split() == w:
                                spot, owners = marked.setdefault(t, (set(), set()))
                                start -= int(x.first[t])
                                spot.update(range(start, start + len(w)))
                                owners |= owners_of[k]
                sizes[first : first + len(texts)] = x.lengths.tolist()
                for t, (spot, owners) in marked.items():
                    hits[first + t], items[first + t] = sorted(spot), sorted(owners)
            if only_hits:
                some = [t for t, h in enumerate(hits) if h]
                texts = [hashlib.md5(batch.column("text")[t].as_buffer(), usedforsecurity=False).digest() for t in some]
                yield pa.RecordBatch.from_pydict({"_text_md5": pa.array(texts, pa.binary()), "_hits": pa.array([hits[t] for t in some], pa.list_(pa.int64())), "_items": pa.array([items[t] for t in some], pa.list_(pa.string()))})
                continue
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=[*batch.schema.names, "_n_words", "_hits", "_items"])

    return f


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    held: list[tuple[str | None, str | None]] = []
    size = 0
    for row in items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        held.append(tuple(row))
        size += len(row[1] or "")
        if size >= block_bytes:
            yield held
            held, size = [], 0
    yield held


def contamination(docs: DataFrame, items: DataFrame, *, window: int = 10, block_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` (any columns, text among them) with three more: ``_n_words`` long, ``_hits`` (positions of the words
    inside an occurrence of an item's window, ascending, from 0) and ``_items`` (ids as strings, sorted).

    Words are folded (A-Z lower-cased; digits, letters and whatever is not ASCII). Null and empty texts have no words:
    a document like that is clean and an item like that matches nothing. Repeated items count once by id; an item
    without an id marks words but is not listed. An empty benchmark leaves every document clean.
    """
    bounded_batches(docs.sparkSession)
    plain = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in docs.schema.fields)
    texts, out, others = docs.select(F.col("text").cast("string").alias("text")), docs, []
    for number, block in enumerate(_blocks(items, block_bytes)):
        index = _Index(block, window)
        count: dict[tuple[int, int], int] = {}
        if index.known:
            found = texts.mapInArrow(_count(index.known), "n long, shingle long, found long").groupBy("n", "shingle").agg(F.sum("found").alias("found"))
            count = {(r.n, r.shingle % 2**64): r.found for r in found.toLocalIterator()}
        prefixes = index.prefixes(count)
        if number == 0:
            out = docs.mapInArrow(_join(index, prefixes), f"{plain}, _n_words: bigint, _hits: array<bigint>, _items: array<string>")
        elif index.known:
            others.append(texts.mapInArrow(_join(index, prefixes, only_hits=True), "_text_md5 binary, _hits array<bigint>, _items array<string>"))
    if not others:
        return out
    # equal texts have equal hits, so a group has one entry a block; documents are shuffled once for all further blocks
    union = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    more = reduce(DataFrame.unionByName, others).groupBy("_text_md5").agg(union("_hits").alias("_more_hits"), union("_items").alias("_more_items"))
    found = out.withColumn("_text_md5", F.unhex(F.md5(F.col("text").cast("binary")))).join(more, "_text_md5", "left")
    added = {c: F.when(F.col(m).isNull(), F.col(c)).otherwise(F.array_sort(F.array_union(c, m))) for c, m in (("_hits", "_more_hits"), ("_items", "_more_items"))}
    return found.withColumns(added).drop("_text_md5", "_more_hits", "_more_items")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the benchmark's windows mark in every document; see ``contamination`` for nulls, empties and repeats."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.size("_hits").cast("bigint").alias("n_hit"),
        F.size("_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (F.size("_hits") > 0).alias("contaminated"),
    )


NOTHING_SHA256 = hashlib.sha256(b"").hexdigest()

ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM bs),
ns AS (SELECT DISTINCT n FROM bw),
dn AS (SELECT doc_id, w, n FROM d, ns WHERE len(w) >= n),
ds AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM dn),
hit AS (SELECT ds.doc_id, ds.n, ds.i, bw.item FROM ds JOIN bw ON ds.n = bw.n AND array_to_string(list_slice(w, i, i + ds.n - 1), ' ') = bw.s),
spots AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, n)) AS k FROM hit) t GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) t GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN its USING (doc_id)
"""
