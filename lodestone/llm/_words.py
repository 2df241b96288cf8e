"""Words of many texts at once, as 64-bit hashes in numpy arrays.

Texts are joined into one byte buffer with a separator after each. All classes of separators in use
are ASCII bytes, and every byte of a longer UTF-8 sequence is a word byte, so bytes decide exactly.
A word's hash is a polynomial over random byte values modulo 2**64, made position-free by the inverse
power of its start, then mixed; equal words have equal hashes and unequal ones collide with 2**-64.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Inverse of BASE modulo 2**64.
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
PIECE = 1 << 18

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
UPPER = np.arange(ord("A"), ord("Z") + 1)
#: For text that is lowered by its byte values: A-Z stand for a-z.
NOT_ALNUM[UPPER] = False


def byte_values(lower: bool = False, digits_alike: bool = False) -> np.ndarray:
    values = np.random.default_rng(20240501).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    if lower:
        values[UPPER] = values[UPPER + 32]
    if digits_alike:
        values[0x30:0x3A] = values[0x30]
    return values


EXACT, LOWER, LOWER_DIGITS = byte_values(), byte_values(True), byte_values(True, True)


class _Powers:
    """Powers of BASE and of its inverse, grown as needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, base in (("up", BASE), ("down", BASE_INVERSE)):
                powers = np.full(n, base, np.uint64)
                powers[0] = 1
                setattr(cls, name, np.multiply.accumulate(powers))
        return cls.up, cls.down


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spans(buffer: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are no separators."""
    if not len(buffer):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    apart = separators[buffer]
    edges = np.flatnonzero(apart[1:] != apart[:-1]) + 1
    edges = np.concatenate([[0] if not apart[0] else [], edges, [len(buffer)] if not apart[-1] else []]).astype(np.int64)
    return edges[0::2], edges[1::2]


def span_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """One hash for each span; the spans ascend and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        first = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, first + PIECE, "right")))
        last = ends[j - 1]
        up, down = _Powers.to(max(PIECE, int(last - first)) + 1)
        sums = np.zeros(last - first + 1, np.uint64)
        np.cumsum(values[buffer[first:last]] * up[: last - first], out=sums[1:])
        s, e = starts[i:j] - first, ends[i:j] - first
        out[i:j] = mix((sums[e] - sums[s]) * down[s])
        i = j
    return out


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive hashes."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    if n <= 16:
        m = len(hashes) - n + 1
        out = hashes[:m].copy()
        for k in range(1, n):
            out *= BASE
            out += hashes[k : k + m]
        return mix(out)
    out = np.empty(len(hashes) - n + 1, np.uint64)
    for i in range(0, len(out), PIECE):
        part = hashes[i : i + PIECE + n - 1]
        up, down = _Powers.to(PIECE + n + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        m = len(part) - n + 1
        out[i : i + m] = mix((sums[n : n + m] - sums[:m]) * down[:m])
    return out


@dataclass
class Chunk:
    """Some consecutive rows of a batch with their texts in one buffer."""

    batch: pa.RecordBatch
    first: int
    #: Number of texts.
    n: int
    buffer: np.ndarray
    #: Where each text begins, and one past the last text's separator.
    offsets: np.ndarray

    @property
    def rows(self) -> pa.RecordBatch:
        return self.batch.slice(self.first, self.n)

    def column(self, name: str) -> pa.Array:
        return self.rows.column(self.batch.schema.get_field_index(name))

    def texts(self) -> Iterator[bytes]:
        """The bytes of each text, one at a time."""
        for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True):
            yield self.buffer[a : b - 1].tobytes()

    def words(self, separators: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, hashes of the words, and for each text the index of its first word (and the total)."""
        starts, ends = spans(self.buffer, separators)
        return starts, ends, span_hashes(self.buffer, starts, ends, values), np.searchsorted(starts, self.offsets)


def bounds_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of a string or binary column, without a copy of the bytes; a null is empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, np.int64 if wide else np.int32, column.offset + len(column) + 1)[column.offset :].astype(np.int64)
    starts, ends = edges[:-1], edges[1:].copy()
    if column.null_count:
        gone = column.is_null().to_numpy(zero_copy_only=False)
        ends[gone] = starts[gone]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), starts, ends


#: Bytes of text that are worked on at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20


def cut(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Rows in their order, in groups of about ``limit`` bytes of text; a null text counts as empty.

    A chunk is cut from the batch by offsets, so what is copied and worked on is one chunk, not the batch.
    """
    if not batch.num_rows:
        return
    data, starts, ends = bounds_of(batch.column(batch.schema.get_field_index(text)))
    reach = np.cumsum(ends - starts + 1)
    view, first = memoryview(data), 0
    while first < batch.num_rows:
        ahead = int(reach[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(reach, ahead + limit, "right")))
        buffer = b"\n".join([*(view[a:b] for a, b in zip(starts[first:last].tolist(), ends[first:last].tolist(), strict=True)), b""])
        yield Chunk(batch, first, last - first, np.frombuffer(buffer, np.uint8), np.r_[0, reach[first:last] - ahead])
        first = last


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The chunks of all batches of a partition."""
    for batch in batches:
        yield from cut(batch, text, limit)
    release()


def release() -> None:
    """Give freed memory back: a worker process lives on after its task and would keep its peak."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def sums_by(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i + 1]] for each i."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """True for each of n positions inside a window of that length at any of the starts."""
    edge = np.zeros(n + length + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge)[:n] > 0
