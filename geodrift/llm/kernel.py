"""Vectorised text kernels shared by the Arrow-backed operators of this package.

A batch of texts is handled as one byte buffer plus document offsets, so that
word bounds, word hashes and shingles come from a few numpy passes and no code
runs once per word.  Hashes are 64-bit polynomials over a random byte table;
the odd base has an inverse modulo 2**64, so the hash of any byte range comes
from two prefix sums.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of text handled at once (one longer document still goes whole).
SLICE_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64, kept for later calls."""
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        factors = np.full(size, base & (2**64 - 1), np.uint64)
        factors[0] = 1
        have = np.multiply.accumulate(factors)
        if size <= 4 * SLICE_BYTES:
            _powers[str(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    offsets = offsets.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Document ranges of at most ``most`` bytes, or of one document."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1, lo + rows, n)
        hi = max(hi, lo + 1)
        yield lo, hi
        lo = hi


def release() -> None:
    """Gives freed memory back to the system, as workers stay for later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Prefix:
    """Prefix sums over a byte buffer, giving the hash of any byte range."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * _power(_BASE, len(data)), out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        inverse = _power(_INVERSE, len(self.sums))
        return mix((self.sums[ends] - self.sums[starts]) * inverse[starts])


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the first word of each document (n+1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[:-1]
    before[cuts[cuts < len(data)]] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    lasts = offsets[1:] - 1
    after[lasts[lasts >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the ``width``-word windows that start at each word but the last few."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    n = len(hashes) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n]
    return mix(out)


def with_columns(
    docs: DataFrame,
    inputs: list[str],
    fields: list[T.StructField],
    make: Callable[[], Callable[..., dict[str, object]]],
) -> DataFrame:
    """``docs`` plus columns computed in Python from the ``inputs`` columns.

    ``make`` is called once per task and returns the function that turns Arrow
    arrays into one sequence per new column.  A column of ``docs`` that has the
    name of a new one is replaced.  No shuffle; memory is bounded by a slice of
    ``SLICE_BYTES`` and one Arrow batch.
    """
    names = {f.name for f in fields}
    kept = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c not in names or c in inputs])
    passed = [f for f in kept.schema.fields if f.name not in names]
    kinds = {f.name: f.dataType for f in fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        work = make()
        types = {k: to_arrow_type(v) for k, v in kinds.items()}
        for batch in batches:
            sizes = np.zeros(batch.num_rows + 1, np.int64)
            for name in inputs:
                column = batch.column(batch.schema.get_field_index(name))
                if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
                    sizes += buffers(column)[1]
            for lo, hi in slices(sizes):
                part = batch.slice(lo, hi - lo)
                made = work(*[part.column(part.schema.get_field_index(name)) for name in inputs])
                arrays = [part.column(part.schema.get_field_index(f.name)) for f in passed]
                for f in fields:
                    value = made[f.name]
                    arrays.append(value if isinstance(value, pa.Array) else pa.array(value, types[f.name]))
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in passed] + [f.name for f in fields])
        release()

    return kept.mapInArrow(run, T.StructType(passed + fields))
