"""Vectorised word kernels over Arrow string batches.

A word is a run of bytes other than space and bytes 9 to 13, so words never
depend on how bytes group into characters.  Everything here works on a flat byte
buffer of several documents at once; memory is a fixed multiple of ``CHUNK_BYTES``
(or of the one document that is longer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _seeded(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUE = _seeded(0x5EED, 256)


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base = base
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, factor in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                steps = np.full(size, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up[:n], self.down[:n]

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums of values times powers, for :meth:`spans`."""
        up, _ = self.upto(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Position-independent hashes of values[start:end], all at once."""
        _, down = self.upto(len(prefix))
        return (prefix[end] - prefix[start]) * down[start]


BYTES, WORDS = Powers(0xD1342543DE82EF93), Powers(0xAF251AF3B0F025B7)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its n + 1 offsets; nulls are empty."""
    texts = texts.cast(pa.large_utf8())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``size`` bytes of text, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = flat(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


class Words:
    """Word boundaries of a flat buffer: byte start and end of each word, and
    ``ptr`` such that document i has the words ptr[i] to ptr[i + 1]."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        raw, self.offsets = flat(texts)
        self.raw = LOWER[raw] if lower else raw
        self.docs = len(self.offsets) - 1
        solid = ~SPACE[self.raw]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        full = self.offsets[:-1] < self.offsets[1:]
        begin, end = self.offsets[:-1][full], self.offsets[1:][full] - 1
        first[begin], last[end] = solid[begin], solid[end]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.ptr = np.searchsorted(self.start, self.offsets)
        self.counts = np.diff(self.ptr)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return mix(BYTES.spans(BYTES.prefix(BYTE_VALUE[self.raw]), self.start, self.end))

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """The words of each document joined by single spaces, as flat bytes, and
        where in these each word starts.  Each word is followed by one space."""
        length = self.end - self.start + 1
        at = np.zeros(len(length) + 1, np.int64)
        np.cumsum(length, out=at[1:])
        out = np.full(at[-1], 32, np.uint8)
        keep = ~SPACE[self.raw]
        body = np.ones(at[-1], bool)
        body[at[1:] - 1] = False
        out[body] = self.raw[keep]
        return out, at

    def strings(self) -> pa.Array:
        """The words as an Arrow array of binary values."""
        out, at = self.joined()
        offsets = np.empty(2 * len(self.start) + 1, np.int64)
        offsets[0::2] = at
        offsets[1::2] = at[1:] - 1
        pairs = pa.Array.from_buffers(pa.large_binary(), 2 * len(self.start), [None, pa.py_buffer(offsets), pa.py_buffer(out)])
        return pairs.take(pa.array(np.arange(0, 2 * len(self.start), 2)))


def per_doc(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sums of the values of each document."""
    total = np.zeros(len(values) + 1, np.result_type(values.dtype, np.int64))
    np.cumsum(values, out=total[1:])
    return total[ptr[1:]] - total[ptr[:-1]]


def lists(values: np.ndarray, ptr: np.ndarray, kind: pa.DataType) -> pa.Array:
    """One list for each document from flat values and pointers."""
    flat_values = pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, type=kind)
    return pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), flat_values)
