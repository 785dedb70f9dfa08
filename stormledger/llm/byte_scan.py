"""The bytes of a batch of texts as numpy arrays: classes of bytes, prefix sums, words and their hashes.

A string column's Arrow buffer holds all texts of a batch end to end. White space, capitals and symbols are single bytes in
UTF-8, so a table of 256 entries gives the class of every byte and prefix sums count a class in any text, line or word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .perfect_hash import mixed

#: Bytes and rows of texts that are scanned at once; a longer text is scanned alone.
PIECE_BYTES, PIECE_ROWS = 2_000_000, 8192
#: Words of more bytes are hashed and compared one by one.
LONG_WORD = 64
#: The low k bytes of eight.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def byte_class(characters: str) -> np.ndarray:
    """A table of 256 booleans: the bytes that are one of these ASCII characters."""
    table = np.zeros(256, bool)
    table[list(characters.encode("ascii"))] = True
    return table


WHITE = byte_class(" \t\n\v\f\r")


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds at most PIECE_BYTES of texts and PIECE_ROWS rows, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(pc.fill_null(batch.column(column), "")).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = min(max(at + 1, int(np.searchsorted(ends, before + PIECE_BYTES, "right"))), at + PIECE_ROWS)
            yield batch.slice(at, to - at)
            at = to


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and bounds: text i is bytes[bounds[i]:bounds[i + 1]]. Null is the empty text."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, values = column.buffers()
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def running(x: np.ndarray) -> np.ndarray:
    """Prefix sums: ``out[j] - out[i]`` is the sum of ``x[i:j]``."""
    out = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=out[1:])
    return out


def within(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of ``x`` in each text."""
    sums = running(x)
    return sums[bounds[1:]] - sums[bounds[:-1]]


def characters(data: np.ndarray) -> np.ndarray:
    """Whether a code point begins at each byte."""
    return (data & 0xC0) != 0x80


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and text of each maximal run of bytes that aren't white space, in order; no word crosses texts."""
    inside = ~WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one integer; zeros follow the last byte."""
    padded = np.append(data, np.zeros(8, np.uint8))
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice of the bytes."""
    lanes, length = _lanes(data), ends - starts
    out = mixed(length.astype(np.uint64), 1)
    active, at = np.flatnonzero(length <= LONG_WORD), 0
    while len(active):
        left = length[active] - at
        out[active] = mixed(out[active] ^ (lanes[starts[active] + at] & _LOW[np.minimum(left, 8)]), 2)
        active, at = active[left > 8], at + 8
    one, view = xxhash.xxh3_64_intdigest, memoryview(data)
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        out[i] = one(view[starts[i] : ends[i]])
    return out


def equal_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether slice ``i[k]`` has the same bytes as slice ``j[k]``."""
    lanes, length = _lanes(data), ends - starts
    same = length[i] == length[j]
    active, at = np.flatnonzero(same & (length[i] <= LONG_WORD)), 0
    while len(active):
        left = length[i[active]] - at
        differ = (lanes[starts[i[active]] + at] ^ lanes[starts[j[active]] + at]) & _LOW[np.minimum(left, 8)] != 0
        same[active[differ]] = False
        active, at = active[~differ & (left > 8)], at + 8
    view = memoryview(data)
    for k in np.flatnonzero(same & (length[i] > LONG_WORD)).tolist():
        same[k] = view[starts[i[k]] : ends[i[k]]] == view[starts[j[k]] : ends[j[k]]]
    return same
