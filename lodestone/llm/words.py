"""Word splitting and window hashing shared by the operators on texts.

Everything here works on UTF-8 bytes and NumPy arrays, a bounded slice of rows at a time, so that the memory
of a Python worker follows ``SLICE_BYTES`` and the longest single text, never the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
#: Odd multipliers of the two polynomial window hashes (a window's identity is the pair of both, 128 bits).
MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def plain(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: bytes.split() separates at exactly these six characters."""
    return text.split() if text else []


def folded(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.translate(_FOLD).split() if text else []


class Tokens:
    """Words of several texts as arrays: byte ranges in ``buf``, 64-bit ids, words per text.

    An id is a polynomial over random values of the word's bytes, mixed; it is taken from prefix sums of the whole
    buffer, so no Python object is made for a word.
    """

    def __init__(self, texts: list[bytes | None], fold: bool = False):
        sizes = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
        self.raw = b" ".join([t or b"" for t in texts]) + b" "
        self.buf = self.raw.translate(_FOLD) if fold else self.raw
        b = np.frombuffer(self.buf, np.uint8)
        space = _SPACE[b]
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1))
        self.starts, self.ends = edge[::2], edge[1::2]
        self.base = np.concatenate([[0], np.cumsum(sizes + 1)])  # of each text in buf
        self.first = np.searchsorted(self.starts, self.base)  # word of each text
        self.lengths = np.diff(self.first)
        self.ids = _ids(b, self.starts, self.ends)

    def words(self, text: int) -> list[bytes]:
        return self.buf[self.base[text] : self.base[text + 1]].split()


def _ids(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _PIECE, "right")))
        at, to = int(starts[i]), int(ends[j - 1])
        up, down = _powers(to - at)
        sums = np.empty(to - at + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_VALUE[b[at:to]] * up[: to - at], out=sums[1:])
        s = starts[i:j] - at
        out[i:j] = mix((sums[ends[i:j] - at] - sums[s]) * down[s])
        i = j
    return out


def word_id(word: bytes) -> int:
    return int(Tokens([word]).ids[0])


_PIECE = 2 << 20
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_VALUE = np.random.Generator(np.random.PCG64(20)).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0xD1342543DE82EF95
_kept: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of _STEP and of its inverse modulo 2**64; those of a usual piece are kept."""
    if _kept and len(_kept[0]) >= n:
        return _kept
    m = max(n, _PIECE + 4096)
    made = []
    for x in (_STEP, pow(_STEP, -1, 2**64)):
        one = np.full(m, x, np.uint64)
        one[0] = 1
        made.append(np.cumprod(one))
    if m <= 2 * _PIECE:
        _kept[:] = made
    return made


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(ids: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hash of each n consecutive ids, by the start of the window; empty when there are fewer ids."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = ids[:m].copy()
    for k in range(1, n):
        h *= MULTIPLIERS[which]
        h += ids[k : k + m]
    return mix(h)


def inner(lengths: np.ndarray, n: int) -> np.ndarray:
    """Mask of the windows over concatenated texts that lie in one text."""
    total = int(lengths.sum())
    m = max(0, total - n + 1)
    ends = np.repeat(np.cumsum(lengths), lengths)[:m]
    return np.arange(m) + n <= ends


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string column's UTF-8 bytes, not decoded."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def slices(sizes: list[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows that hold about ``limit`` bytes each."""
    start = held = 0
    for i, s in enumerate(sizes):
        if held and held + s > limit:
            yield start, i
            start, held = i, 0
        held += s
    if start < len(sizes):
        yield start, len(sizes)


def text_slices(batch: pa.RecordBatch | pa.Table, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes | None]]]:
    """(first row, texts) for bounded slices of a batch."""
    texts = as_bytes(batch.column(batch.schema.get_field_index(column)))
    for a, b in slices([len(t) if t else 0 for t in texts], limit):
        yield a, texts[a:b]
