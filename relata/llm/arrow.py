"""Arrow batches in, Arrow batches out, in blocks of bounded size; and words of texts as numpy arrays."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that are worked on at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20

_ALL = np.arange(256)
#: A-Z to lower case.
LOWER = np.where((_ALL >= 65) & (_ALL <= 90), _ALL + 32, _ALL).astype(np.uint8)
#: Bytes of the words [^\x20\x09-\x0D]+ and, after LOWER, [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
SPACED = ~((_ALL == 32) | ((_ALL >= 9) & (_ALL <= 13)))
LETTERS = ((_ALL >= 48) & (_ALL <= 57)) | ((_ALL >= 97) & (_ALL <= 122)) | (_ALL >= 128)

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
_BYTE_CODE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finishing mix of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(1 << bits, _R), np.full(1 << bits, _R_INV)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**k and R**-k mod 2**64 for k < n; kept for blocks of usual size."""
    bits = max(20, int(n).bit_length())
    up, down = _powers(bits) if bits <= 22 else _powers.__wrapped__(bits)
    return up[:n], down[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of code(data[k]) * R**k for i <= k < j."""
    up, _ = powers(len(data))
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(_BYTE_CODE[data] * up, out=out[1:])
    return out


def slices_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end], whatever its place."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    """Words of a block of texts: first and last byte + 1, hash, and the index of each text's first word (one more at the end)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its texts; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about `limit` bytes together."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def find_words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, hashes: bool = True) -> Words:
    """Words of texts (data, offsets), A-Z lower-cased for the hash."""
    low = LOWER[data]
    inside = kind[low]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = inside[edges]
    edges = edges[edges > 0] - 1
    ends[edges] = inside[edges]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashed = slices_hash(prefix_sums(low), start, end) if hashes else np.zeros(0, np.uint64)
    return Words(start, end, hashed, np.searchsorted(start, offsets))


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of blocks of a column."""
    data, offsets = text_bytes(column)
    for lo, hi in row_blocks(offsets, limit):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def strings(column: pa.Array, rows: int = 256) -> Iterator[str]:
    """Texts of a column as strings, few at a time; null is empty."""
    for at in range(0, len(column), rows):
        yield from pc.fill_null(column.slice(at, rows), "").to_pylist()


@cache
def _trim() -> Callable[[int], int]:
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, done: Callable[[], None] | None = None) -> DataFrame:  # noqa: ANN001
    """df.mapInArrow(run), after which a worker gives its free memory back: workers outlive their tasks. done() comes before."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        if done:
            done()
        pa.default_memory_pool().release_unused()
        _trim()(0)

    return df.mapInArrow(whole, schema)


def add_columns(df: DataFrame, make: Callable[[pa.RecordBatch], dict[str, pa.Array]], ddl: str, keep: list[str] | None = None, done: Callable[[], None] | None = None) -> DataFrame:
    """df (or its columns `keep`) with the columns `ddl` that make() gives for a batch; they replace others of their name.

    done() is called at a task's end.
    """
    spark = df.sparkSession
    new = spark.createDataFrame([], ddl).schema
    old = [f for f in df.schema.fields if f.name not in new.names and (keep is None or f.name in keep)]
    schema = type(new)(old + new.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = make(batch)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f.name)) for f in old] + [made[f.name] for f in new.fields], names=schema.names)

    return map_arrow(df, run, schema, done)
