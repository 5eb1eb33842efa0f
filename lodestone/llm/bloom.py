"""A filter of fixed size over 64-bit hashes; it only spares work, so its misses never change a result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import mix

BITS = 1 << 23  # 1 MB, whatever the number of members


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix(h.astype(np.uint64))
    return (h & np.uint64(BITS - 1)).astype(np.int64), (h >> np.uint64(32) & np.uint64(BITS - 1)).astype(np.int64)


class Bloom:
    """Eight bits a byte on the driver and on the way to tasks; opened where it is asked."""

    def __init__(self, packed: np.ndarray):
        self.packed, self._bits = packed, None

    def __reduce__(self):
        return Bloom, (self.packed,)

    def any(self) -> bool:
        return bool(self.packed.any())

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        if self._bits is None:
            self._bits = np.unpackbits(self.packed).view(bool)
        a, b = _places(h)
        return self._bits[a] & self._bits[b]

    def among(self, hashes: Column) -> Column:
        """Whether it may hold a long that isn't null. Only the hashes go to Python, not the rows they are of."""

        @F.arrow_udf("boolean")
        def f(h: pa.Array) -> pa.Array:
            return pa.array(self.may_hold(h.to_numpy(zero_copy_only=False).view(np.uint64)))

        return f(hashes)


def bloom_of(hashes: DataFrame) -> Bloom:
    """Of the only column, a long. Partitions make their bits; each piece of the filter is merged by one task."""
    column, piece = hashes.columns[0], BITS // 8

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS, bool)
        for batch in batches:
            h = batch.column(0).drop_null().to_numpy().view(np.uint64)
            for x in _places(h):
                bits[x] = True
        for i in range(8):
            x = bits[i * piece : (i + 1) * piece]
            if x.any():
                yield pa.RecordBatch.from_pydict({"piece": pa.array([i], pa.int64()), "bits": pa.array([np.packbits(x).tobytes()], pa.binary())})

    def merge(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for t in tables:
            for i, b in zip(t.column("piece").to_pylist(), t.column("bits").to_pylist(), strict=True):
                x = np.frombuffer(b, np.uint8)
                held[i] = held[i] | x if i in held else x
        for i, x in held.items():
            yield pa.RecordBatch.from_pydict({"piece": pa.array([i], pa.int64()), "bits": pa.array([x.tobytes()], pa.binary())})

    schema = "piece long, bits binary"
    packed = np.zeros(BITS // 8, np.uint8)
    merged = hashes.select(column).mapInArrow(part, schema).repartition(8, "piece").mapInArrow(merge, schema)
    for r in merged.collect():  # at most eight rows, 1 MB in all; one job, where an iterator would run one a partition
        packed[r.piece * piece // 8 : (r.piece + 1) * piece // 8] |= np.frombuffer(bytes(r.bits), np.uint8)
    return Bloom(packed)
