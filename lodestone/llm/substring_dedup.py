"""Substring dedup: a count-min prefilter over word windows, then exact grouping of what may repeat.

Documents are dealt once into chunks of about ``chunk_bytes`` of text. Every chunk sends a sparse count-min sketch
of its windows, cut by hash range; each range merges the sketches of all chunks (two rows of saturated counters) and
answers every chunk with the fingerprints whose estimate is two or more. Estimates never fall below true counts, so no
repeated window is lost. Chunks then send only those windows, with 128-bit identities, first reduced to the smallest
and largest document per window and chunk, so a passage in a third of all rows costs a range one entry a chunk. The
ranges reduce them exactly and answer with the smallest document of each. The number of chunks and ranges follows
the input; nothing is collected or broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, table
from .words import Tokens, inner, text_slices, windows

_EXACT = np.dtype([("h", "<u8"), ("g", "<u8"), ("least", "<i8"), ("most", "<i8")])
_MARK = np.dtype([("h", "<u8"), ("g", "<u8"), ("least", "<i8")])


def _coded(x: np.ndarray) -> bytes:
    """Sorted 32-bit values as Rice-coded gaps: the quotients in unary, then the ``k`` low bits of each."""
    gap, n = np.diff(x.astype(np.int64), prepend=0), len(x)
    k = max(0, int(x[-1] * 0.69 / n).bit_length() - 1)
    high = gap >> k
    unary = np.zeros(int(high.sum()) + n, np.uint8)
    unary[np.cumsum(high + 1) - 1] = 1
    low = np.unpackbits((gap & ((1 << k) - 1)).astype(">u4").view(np.uint8).reshape(n, 4), axis=1)[:, 32 - k :]
    return bytes([k]) + n.to_bytes(4, "little") + len(unary).to_bytes(4, "little") + np.packbits(unary).tobytes() + np.packbits(low).tobytes()


def _decoded(b: bytes) -> np.ndarray:
    k, n, m = b[0], int.from_bytes(b[1:5], "little"), int.from_bytes(b[5:9], "little")
    x = np.frombuffer(b, np.uint8)
    cut = 9 + -(-m // 8)
    high = np.diff(np.flatnonzero(np.unpackbits(x[9:cut], count=m)), prepend=-1) - 1
    low = np.zeros((n, 32), np.uint8)
    low[:, 32 - k :] = np.unpackbits(x[cut:], count=n * k).reshape(n, k)
    return np.cumsum(high << k | np.packbits(low, axis=1).view(">u4").ravel().astype(np.int64)).astype(np.uint32)


def _packed(x: np.ndarray, most: bool = True) -> bytes:
    """Column by column; documents take four bytes where all fit, and of ``most`` only whether it is more is kept.

    Without ``most`` the second hash keeps 32 bits: an answer's windows only have to be told apart within a chunk.
    """
    small = not len(x) or bool(x["least"].min() >= 0 and x["least"].max() < 2**32)
    parts = [x["h"].tobytes(), x["g"].astype("<u8" if most else "<u4").tobytes(), x["least"].astype("<u4" if small else "<i8").tobytes()]
    if most:
        parts.append(np.packbits(x["most"] > x["least"]).tobytes())
    return bytes([small]) + len(x).to_bytes(8, "little") + b"".join(parts)


def _unpacked(b: bytes, kind: np.dtype) -> np.ndarray:
    """``most`` comes back as ``least``, or one more where it was more."""
    small, n = b[0], int.from_bytes(b[1:9], "little")
    wide = 8 if "most" in kind.names else 4
    out, at, size = np.empty(n, kind), 9 + (8 + wide) * n, 4 if small else 8
    out["h"], out["g"] = np.frombuffer(b, "<u8", n, 9), np.frombuffer(b, f"<u{wide}", n, 9 + 8 * n)
    out["least"] = np.frombuffer(b, "<u4" if small else "<i8", n, at)
    if "most" in kind.names:
        out["most"] = out["least"] + np.unpackbits(np.frombuffer(b, np.uint8, -(-n // 8), at + size * n), count=n)
    return out


#: Counters of each row of a range's sketch, as a power of two; a range holds about chunk_bytes / 6 windows.
COUNTERS = 1 << 22


def _where(h: np.ndarray, ranges: int) -> np.ndarray:
    """Range of a window in the upper half of the result, its 32-bit fingerprint in the lower half."""
    return (h >> np.uint64(32)) % np.uint64(ranges) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))


def _by_range(key: np.ndarray, ranges: int) -> np.ndarray:
    return np.searchsorted(key >> np.uint64(32), np.arange(ranges + 1, dtype=np.uint64))


def _parts(data: pa.Table, window: int, both: bool):
    """For slices of a chunk: (first row, tokens, mask of windows in one text, hashes, second hashes)."""
    for first, texts in text_slices(data):
        x = Tokens(texts)
        yield first, x, inner(x.lengths, window), windows(x.ids, window), windows(x.ids, window, 1) if both else None


def _sketch(window: int, ranges: int) -> Callable:
    def f(data: pa.Table) -> pa.Table:
        keys = [_where(h[ok], ranges) for _, _, ok, h, _ in _parts(data, window, False)]
        key, n = np.unique(np.concatenate(keys) if keys else np.empty(0, np.uint64), return_counts=True)
        key = np.repeat(key, np.minimum(n, 2))
        cut = _by_range(key, ranges)
        low = key.astype(np.uint32)
        at = np.flatnonzero(np.diff(cut))
        chunk = data.column("chunk")[0].as_py()
        return pa.table({"chunk": pa.array([chunk] * len(at), pa.int64()), "shard": pa.array(at, pa.int64()), "cells": pa.array([_coded(low[cut[i] : cut[i + 1]]) for i in at], pa.binary())})

    return f


def _repeated(data: pa.Table) -> pa.Table:
    """Merge the sketches of one hash range; per chunk, the fingerprints estimated at two or more."""
    blobs = [_decoded(x) for x in data.column("cells").to_pylist()]
    rows = [lambda c: c & np.uint32(COUNTERS - 1), lambda c: (c * np.uint32(2654435761)) >> np.uint32(10)]
    keep = [np.ones(len(b), bool) for b in blobs]
    for row in rows:
        count = np.zeros(COUNTERS, np.uint8)
        for b in blobs:
            cell, n = np.unique(row(b), return_counts=True)
            count[cell] = np.minimum(count[cell] + n, 2)
        keep = [k & (count[row(b)] >= 2) for k, b in zip(keep, blobs, strict=True)]
    out = [b[k & np.concatenate([[True], b[1:] != b[:-1]])] for b, k in zip(blobs, keep, strict=True)]  # sorted: repeats stand together
    at = [i for i, x in enumerate(out) if len(x)]
    return pa.table({"chunk": data.column("chunk").take(pa.array(at, pa.int64())), "shard": data.column("shard").take(pa.array(at, pa.int64())), "cells": pa.array([_coded(out[i]) for i in at], pa.binary())})


def _doc_ids(data: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = data.column("doc_id")
    return ids.fill_null(0).to_numpy().astype(np.int64), ids.is_valid().to_numpy()


def _exact(window: int, ranges: int) -> Callable:
    def f(data: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        if data.num_rows and replies.num_rows:
            doc, real = _doc_ids(data)
            found = np.sort(np.concatenate([_decoded(b).astype(np.uint64) | np.uint64(s) << np.uint64(32) for s, b in zip(replies.column("shard").to_pylist(), replies.column("cells").to_pylist(), strict=True)]))
            for first, x, ok, h, g in _parts(data, window, True):
                rows = np.repeat(np.arange(len(x.lengths)), x.lengths)[: len(h)] + first
                ok &= real[rows]
                key = _where(h, ranges)
                ok &= found[np.minimum(np.searchsorted(found, key), len(found) - 1)] == key
                part = np.empty(int(ok.sum()), _EXACT)
                part["h"], part["g"], part["least"] = h[ok], g[ok], doc[rows[ok]]
                part["most"] = part["least"]
                out.append(_reduced(part))
        all_ = _reduced(np.concatenate(out)) if out else np.empty(0, _EXACT)
        shard = ((all_["h"] >> np.uint64(32)) % np.uint64(ranges)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        all_, cut = all_[order], np.searchsorted(shard[order], np.arange(ranges + 1))
        at = np.flatnonzero(np.diff(cut))
        chunk = data.column("chunk")[0].as_py() if data.num_rows else 0
        return pa.table({"chunk": pa.array([chunk] * len(at), pa.int64()), "shard": pa.array(at, pa.int64()), "seen": pa.array([_packed(all_[cut[i] : cut[i + 1]]) for i in at], pa.binary())})

    return f


def _reduced(x: np.ndarray) -> np.ndarray:
    """One entry per window, with the smallest and the largest document."""
    if not len(x):
        return x
    x = x[np.lexsort((x["least"], x["g"], x["h"]))]
    start = np.flatnonzero(np.concatenate([[True], (x["h"][1:] != x["h"][:-1]) | (x["g"][1:] != x["g"][:-1])]))
    y = x[start]
    y["most"] = np.maximum.reduceat(x["most"], start)
    return y


def _first_documents(data: pa.Table) -> pa.Table:
    """Of one hash range: per chunk, the windows that start in a smaller document than one of the chunk's."""
    blobs = [_unpacked(b, _EXACT) for b in data.column("seen").to_pylist()]
    whole = _reduced(np.concatenate(blobs))
    out = []
    for b in blobs:
        at = _find(whole, b["h"], b["g"])
        least = whole["least"][at]
        k = least < b["most"]
        y = np.empty(int(k.sum()), _MARK)
        y["h"], y["g"], y["least"] = b["h"][k], b["g"][k], least[k]
        out.append(_packed(y, False))
    return pa.table({"chunk": data.column("chunk"), "marks": pa.array(out, pa.binary())})


def _find(among: np.ndarray, h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Index of (h, g) in ``among``, sorted by both; -1 where absent."""
    at = np.searchsorted(among["h"], h)
    out = np.full(len(h), -1)
    open_ = np.flatnonzero(at < len(among))
    while len(open_):
        i = at[open_]
        same = among["h"][i] == h[open_]
        hit = same & (among["g"][i] == g[open_])
        out[open_[hit]] = i[hit]
        open_ = open_[same & ~hit]
        at[open_] += 1
        open_ = open_[at[open_] < len(among)]
    return out


def _cut(window: int) -> Callable:
    def f(data: pa.Table, replies: pa.Table) -> pa.Table:
        n_words, n_removed, kept = [], [], []
        marks = np.concatenate([_unpacked(b, _MARK) for b in replies.column("marks").to_pylist()]) if replies.num_rows else np.empty(0, _MARK)
        marks = marks[np.lexsort((marks["g"], marks["h"]))]
        doc, real = _doc_ids(data)
        for first, x, ok, h, g in _parts(data, window, True) if data.num_rows else ():
            gone = np.zeros(len(x.ids) + 1, np.int64)
            if len(marks) and len(h):
                at = np.flatnonzero(ok)
                found = _find(marks, h[at], g[at] & np.uint64(0xFFFFFFFF))
                at, found = at[found >= 0], found[found >= 0]
                rows = np.repeat(np.arange(len(x.lengths)), x.lengths)[at] + first
                at = at[real[rows] & (marks["least"][found] < doc[rows])]
                np.add.at(gone, at, 1)
                np.add.at(gone, at + window, -1)
            gone = np.cumsum(gone)[:-1] > 0
            before = np.concatenate([[0], np.cumsum(gone)])[x.first]
            n_words += x.lengths.tolist()
            n_removed += (lost := np.diff(before).tolist())
            for i, n in enumerate(lost):
                w = x.words(i)
                kept.append(b" ".join([v for v, r in zip(w, gone[x.first[i] : x.first[i + 1]].tolist(), strict=True) if not r] if n else w))
        return pa.table({"doc_id": data.column("doc_id").cast(pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})

    return f


def without_repeated_passages(docs: DataFrame, *, window: int = 13, chunk_bytes: int = 6 << 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for each row of ``docs`` (doc_id, text).

    A word goes if a window of ``window`` words over it also starts in a document with a smaller doc_id. Texts are
    judged on the input. Null and empty texts have no words and keep the empty text. Rows that repeat a doc_id don't
    remove each other's words; a null doc_id is neither smaller nor larger than any. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // chunk_bytes))
    chunks = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(n))).repartition(n, "chunk")
    by_chunk = chunks.groupBy("chunk")
    cells = by_chunk.applyInArrow(_sketch(window, n), "chunk long, shard long, cells binary")
    replies = cells.groupBy("shard").applyInArrow(_repeated, "chunk long, shard long, cells binary")
    seen = by_chunk.cogroup(replies.repartition(n, "chunk").groupBy("chunk")).applyInArrow(_exact(window, n), "chunk long, shard long, seen binary")
    marks = seen.groupBy("shard").applyInArrow(_first_documents, "chunk long, marks binary")
    bounded_batches(spark)
    return by_chunk.cogroup(marks.repartition(n, "chunk").groupBy("chunk")).applyInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept_text string")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is cut of every document, and what is kept; see ``without_repeated_passages`` for nulls, empties and repeats."""
    out = without_repeated_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS s FROM starts),
least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT win.doc_id, win.i FROM win JOIN least USING (s) WHERE least.m < win.doc_id) t, range(0, 13) r(k)),
gone AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ')
                   ELSE coalesce((SELECT string_agg(w[x], ' ' ORDER BY x) FROM range(1, len(w) + 1) q(x) WHERE NOT list_contains(ps, x)), '') END) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""
