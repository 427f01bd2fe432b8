"""Numpy views of Arrow text batches.

Every Python operator of this subpackage reads text through these helpers: a
batch's UTF-8 buffer is viewed in place (no Python string per row), cut into
chunks of bounded bytes, and words are found and hashed with whole-array
operations. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20

_U = np.uint64
_PRIME = 0x9E3779B97F4A7C15 | 1

#: Bytes 9 to 13 and 32 separate words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: For matching: ASCII letters lower-cased, every other ASCII byte but digits a space.
ALNUM = np.full(256, 32, np.uint8)
ALNUM[48:58] = np.arange(48, 58)
ALNUM[97:123] = np.arange(97, 123)
ALNUM[65:91] = np.arange(97, 123)
ALNUM[128:] = np.arange(128, 256)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_PRIME, -1, 1 << 64)
    up, down = np.full(n, _U(_PRIME)), np.full(n, _U(inverse))
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)


_UP, _DOWN = _powers(1 << 12)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all input bits."""
    h = h ^ (h >> _U(31))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(29))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(32))


@dataclass
class Chunk:
    """Consecutive texts of a batch: their rows, bytes and where each starts in `data`."""

    first: int
    data: np.ndarray
    starts: np.ndarray  # n + 1 offsets into data

    def __len__(self) -> int:
        return len(self.starts) - 1


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column into chunks of whole texts of about `limit` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    n = len(column)
    if n == 0:
        return
    _, offsets, buffer = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32, n + 1, column.offset * (8 if large else 4)).astype(np.int64)
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield Chunk(row, data[at[row] : at[end]], at[row : end + 1] - at[row])
        row = end


@dataclass
class Words:
    """Words of a chunk in order: byte range [start, end) and the text each belongs to."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray


def words(chunk: Chunk, data: np.ndarray | None = None, separators: np.ndarray = SPACE) -> Words:
    """Maximal runs of non-separator bytes that do not cross a text's end."""
    data = chunk.data if data is None else data
    n = len(data)
    if n == 0:
        e = np.zeros(0, np.int64)
        return Words(e, e, e)
    sep = separators[data]
    first = ~sep
    first[1:] &= sep[:-1]
    inner = chunk.starts[1:-1]
    inner = inner[inner < n]
    cut = np.zeros(n + 1, bool)
    cut[inner] = True
    first |= cut[:n] & ~sep
    last = ~sep
    last[:-1] &= sep[1:] | cut[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(start, end, np.searchsorted(chunk.starts, start, "right") - 1)


class SpanHasher:
    """64-bit hashes of byte ranges; equal bytes give equal hashes in every process.

    A polynomial over a table of random odd numbers, in pieces of 2,048 bytes so
    that the powers stay a fixed table; whole-array work only.
    """

    SIZE = 2048

    def __init__(self, data: np.ndarray) -> None:
        pos = np.arange(len(data)) & (self.SIZE - 1)
        self.total = np.zeros(len(data) + 1, _U)
        np.cumsum(_TABLE[data] * _UP[pos], out=self.total[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size, total = self.SIZE, self.total
        if len(start) == 0:
            return np.zeros(0, _U)
        out = (total[end] - total[start]) * _DOWN[start & (size - 1)]
        apart = (np.maximum(end, start + 1) - 1) // size != start // size
        for i in np.flatnonzero(apart):  # ranges over a piece's edge: few
            h, p = 0, int(start[i])
            while p < end[i]:
                q = min(int(end[i]), (p // size + 1) * size)
                part = (int(total[q]) - int(total[p])) * int(_DOWN[p % size])
                h += part * pow(_PRIME, p - int(start[i]), 1 << 64)
                p = q
            out[i] = _U(h & ((1 << 64) - 1))
        return mix(out + (end - start).astype(_U) * _U(0x9E3779B97F4A7C15))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return SpanHasher(data)(start, end)


def matching_bytes(chunk: Chunk) -> np.ndarray:
    """Bytes for tolerant matching: lower-case ASCII letters and digits, all
    other ASCII and the general-punctuation block as spaces."""
    data = ALNUM[chunk.data]
    if len(data) > 2:
        at = np.flatnonzero((chunk.data[:-2] == 0xE2) & (chunk.data[1:-1] == 0x80))
        for k in range(3):
            data[at + k] = 32
        at = np.flatnonzero((chunk.data[:-1] == 0xC2) & (chunk.data[1:] < 0xC0))
        for k in range(2):
            data[at + k] = 32
    return data


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
