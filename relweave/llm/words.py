"""Words of whole texts as numpy arrays, for the operators that look at every word.

A word is a run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z became a-z: ASCII digits and
letters, and every character beyond ASCII.  On UTF-8 bytes that is a property of single bytes, so a
batch of texts is cut into words and hashed without a Python loop.  Two different words have the same
64-bit hash with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Text handled at once; temporary arrays take about 40 times as much memory.
CHUNK_BYTES = 2 << 20

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
IS_LETTER = ((LOWER >= 97) & (LOWER <= 122)) | (_BYTES >= 128)
IS_WORD = ((LOWER >= 48) & (LOWER <= 57)) | ((LOWER >= 97) & (LOWER <= 122)) | (_BYTES >= 128)

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = (x ^ (x >> _SHIFT)) * _MIX
    x = (x ^ (x >> _SHIFT)) * _MIX
    return x ^ (x >> _SHIFT)


def powers(count: int) -> np.ndarray:
    """0, 1, 2.. powers of the step, modulo 2**64."""
    out = np.full(max(count, 1), _STEP, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Texts(NamedTuple):
    """UTF-8 bytes of several texts, one after the other."""

    data: np.ndarray
    offsets: np.ndarray  # where each text starts, and the end


class Words(NamedTuple):
    """Every word of several texts in order."""

    start: np.ndarray  # first byte
    end: np.ndarray  # byte after the last
    text: np.ndarray  # number of the text
    code: np.ndarray  # 64-bit hash
    first: np.ndarray  # for each text its first word, and the end


def texts_of(column: pa.Array) -> Texts:
    """The bytes of a string column; a null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(raw[offsets[0] : offsets[-1]], offsets - offsets[0])


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about ``limit`` bytes of text each; one text is never cut."""
    sizes = np.diff(texts_of(batch.column(column)).offsets)
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and held + size > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield batch.slice(begin)


def words_of(texts: Texts, kind: np.ndarray = IS_WORD) -> Words:
    """The runs of bytes of a kind, in lower case."""
    data, offsets = texts
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = kind[data]
    opens = inside[1:-1] & ~inside[:-2]
    closes = inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    opens[edges] = inside[1:-1][edges]
    closes[edges - 1] = inside[1:-1][edges - 1]
    start = np.flatnonzero(opens)
    end = np.flatnonzero(closes) + 1
    first = np.searchsorted(start, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(start, end, text, _codes(data, start, end), first)


def _codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    length = end - start
    begin = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(begin, length)
    letters = LOWER[data[np.repeat(start, length) + place]].astype(np.uint64) + np.uint64(1)
    letters *= powers(int(length.max()))[place]
    return mix(np.add.reduceat(letters, begin) + length.astype(np.uint64))


def running_sums(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of bytes times powers of the step, and the inverse powers."""
    power = powers(len(flat) + 1)
    sums = np.zeros(len(flat) + 1, dtype=np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64, out=sums[1:])
    inverse = np.full(len(flat) + 1, pow(int(_STEP), -1, 1 << 64), dtype=np.uint64)
    inverse[0] = 1
    return sums, np.cumprod(inverse, dtype=np.uint64)


def span_codes(flat: np.ndarray, start: np.ndarray, end: np.ndarray, prepared=None) -> np.ndarray:
    """64-bit hashes of stretches of bytes, by their contents only."""
    sums, inverse = prepared or running_sums(flat)
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
