"""Text columns as numpy arrays: bytes, words and shingles of whole texts.

The functions here work on one Arrow batch inside a task. A null text counts as
an empty one. Batches are cut so that a task holds a few megabytes of text at a
time; a single longer text is a piece of its own and is never shortened.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_ODD = 0x5851F42D4C957F2D
_INVERSE = pow(_ODD, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def column_of(batch: pa.RecordBatch, name: str):
    """The first column of that name: later columns with a clashing name are ignored."""
    return batch.column(batch.schema.names.index(name))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each text begins; one entry more than texts."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def pieces(
    batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about that many bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, starts = utf8(column_of(batch, column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(starts, starts[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


_POWERS: dict[int, np.ndarray] = {_ODD: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, at least, of an odd number and of its inverse; kept for later calls."""
    for base, row in _POWERS.items():
        if len(row) < n:
            row = np.full(n + n // 8, base, np.uint64)
            row[0] = 1
            _POWERS[base] = np.multiply.accumulate(row)
    return _POWERS[_ODD], _POWERS[_INVERSE]


_LETTERS = mixed(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    letters = _LETTERS[_FOLD] if fold else _LETTERS
    np.cumsum(letters[data] * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _GOLDEN)


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each run of non-space bytes, and how many words each text has.

    Space is 0x20 and 0x09 to 0x0D; a word ends with its text.
    """
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    begins = inside[1:-1] & ~inside[:-2]
    stops = inside[1:-1] & ~inside[2:]
    first = starts[:-1][starts[:-1] < starts[1:]]
    begins[first] = inside[1:-1][first]
    last = starts[1:][starts[:-1] < starts[1:]] - 1
    stops[last] = inside[1:-1][last]
    at = np.flatnonzero(begins)
    return at, np.flatnonzero(stops) + 1, np.diff(np.searchsorted(at, starts))


def word_hashes(data: np.ndarray, starts: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word (A-Z as a-z), and how many words each text has."""
    at, to, counts = words(data, starts)
    return span_hashes(data, at, to, fold), counts


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `width` words in a row, text by text, and how many each text has.

    A text with fewer words has its whole sequence as one shingle; one without
    words has none.
    """
    edges = np.concatenate(([0], np.cumsum(counts)))
    many = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    to = np.concatenate(([0], np.cumsum(many)))
    text = np.repeat(np.arange(len(counts)), many)
    at = edges[text] + np.arange(to[-1]) - to[text]
    out = np.full(to[-1], width, np.uint64)
    padded = np.concatenate((hashes, np.zeros(width, np.uint64)))
    for i in range(width):
        there = i < counts[text]
        out = mixed(out * _GOLDEN + np.where(there, padded[at + i], np.uint64(i)))
    return out, many


def distinct(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text in ascending order, and how many each text has."""
    text = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    return values[fresh], np.bincount(text[fresh], minlength=len(counts)).astype(np.int64)


def binaries(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive runs of an array as one binary value each."""
    ends = np.concatenate(([0], np.cumsum(counts * data.itemsize))).astype(np.int64)
    raw = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]
    )
    return raw.cast(pa.binary())
