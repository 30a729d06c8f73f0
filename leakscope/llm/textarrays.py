"""Numpy views of Arrow text columns: words, lines and their fingerprints.

An Arrow string column is one byte buffer plus offsets, so a whole slice of
documents is scanned by a handful of array operations instead of a Python loop
over words.  Everything here runs inside Spark tasks; a slice is about
``SLICE_BYTES`` of text, or one document where that is longer.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20

# Word separators of every contract: space and the bytes 9 to 13.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(9, 14)]] = True

# ASCII A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; equal in, equal out."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


class _PowerCache:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            up, down = _powers(_BASE, size), _powers(_INVERSE, size)
            if size > 4 * SLICE_BYTES:
                return up, down  # one very long document: not kept
            self.up, self.down = up, down
        return self.up, self.down


_CACHE = _PowerCache()


def running_sums(codes: np.ndarray) -> np.ndarray:
    """What ``range_hashes`` needs of the codes; made once for any number of ranges."""
    n = len(codes)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(codes * _CACHE.get(n + 1)[0][:n], out=sums[1:])
    return sums


def sequence_hashes(codes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit fingerprint of codes[start:stop] for many ranges in one pass over the codes."""
    return range_hashes(running_sums(codes), starts, stops)


def range_hashes(sums: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    found = (sums[stops] - sums[starts]) * _CACHE.get(len(sums))[1][starts]
    return mix(found + (stops - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def slices(batches: Iterable[pa.RecordBatch], column: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows of about ``limit`` bytes of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column end to end, and the offset of each text (null: empty)."""
    n = len(column)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    if not n or where is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(where, np.int64 if large else np.int32)[column.offset:column.offset + n + 1]
    if data is None or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
    return bytes_, offsets.astype(np.int64) - int(offsets[0])


def owners(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Index of the text that holds each byte position."""
    return np.searchsorted(offsets, positions, "right") - 1


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and stop of every word; words end with their text."""
    inside = ~SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][filled], offsets[1:][filled] - 1
    begins[first], ends[last] = inside[first], inside[last]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and text index of every line; a text of n newlines has n + 1 lines."""
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    texts = np.concatenate([np.arange(len(offsets) - 1), owners(offsets, breaks)])
    order = np.lexsort((starts, texts))
    starts, texts = starts[order], texts[order]
    stops = np.empty_like(starts)
    stops[:-1] = starts[1:] - 1
    if len(stops):
        ends = np.flatnonzero(np.append(texts[1:] != texts[:-1], True))
        stops[ends] = offsets[1:][texts[ends]]
    return starts, stops, texts


def per_text(values: np.ndarray, texts: np.ndarray, n: int) -> np.ndarray:
    """Sum of values by text."""
    return np.bincount(texts, weights=values, minlength=n).astype(np.int64)


def lengths_in_characters(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Code points in each byte range."""
    heads = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    return heads[stops] - heads[starts]


def list_array(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """A list column whose i-th list takes the next counts[i] values."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned fingerprints as Spark's long."""
    return values.view(np.int64)


_PACKED = struct.Struct("<QqQB")
_ZSTD = pa.Codec("zstd", compression_level=1)


def pack_ints(values: np.ndarray, ascending: bool = False) -> bytes:
    """Integers as compressed bytes: offsets from the smallest, or steps where they ascend,
    in as few bytes as the largest needs, bytes of one rank together."""
    if not len(values):
        return b""
    low = int(values[0] if ascending else values.min())
    steps = (np.diff(values, prepend=values[:1]) if ascending else values - values.dtype.type(low)).astype(np.uint64)
    width = max(1, -(-int(steps.max()).bit_length() // 8))
    planes = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return _PACKED.pack(len(values), low, len(planes), width) + _ZSTD.compress(planes, asbytes=True)


def unpack_ints(packed: bytes, ascending: bool = False) -> np.ndarray:
    if not packed:
        return np.zeros(0, dtype=np.int64)
    n, low, size, width = _PACKED.unpack_from(packed)
    planes = np.frombuffer(_ZSTD.decompress(packed[_PACKED.size:], size), np.uint8).reshape(width, n)
    steps = np.zeros((n, 8), dtype=np.uint8)
    steps[:, :width] = planes.T
    steps = steps.view("<u8").ravel().astype(np.int64)
    return (np.cumsum(steps) if ascending else steps) + low


def pack_bytes(data: bytes) -> bytes:
    return struct.pack("<Q", len(data)) + _ZSTD.compress(data, asbytes=True) if data else b""


def unpack_bytes(packed: bytes) -> bytes:
    return _ZSTD.decompress(packed[8:], struct.unpack_from("<Q", packed)[0], asbytes=True) if packed else b""


def long_column(df: DataFrame, name: str) -> Column:
    """The column as long; as it is where it already is one, so that equal scans stay equal."""
    return F.col(name) if dict(df.dtypes)[name] == "bigint" else F.col(name).cast("long").alias(name)
