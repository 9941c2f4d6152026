"""Whole texts as byte arrays: helpers that the operators share.

Every operator that runs Python works on Arrow batches, cut into slices of bounded size
(a single longer text is a slice of its own), so memory follows the longest text and not
the size of a partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

#: Bytes of text that are worked on at once.
SLICE_BYTES = 1 << 20

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

SPACES = np.ones(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of `[^\x20\x09-\x0D]`: UTF-8 continues words with bytes of 0x80 and above.
NON_SPACE = SPACES
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after A-Z are lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows from, to, their bytes, and offsets into those bytes."""
    if not len(column):
        return
    data, offsets = utf8(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def map_texts(
    docs: DataFrame,
    make: Callable[[], Callable[[np.ndarray, np.ndarray], dict[str, list | np.ndarray]]],
    added: T.StructType,
    keep: list[str],
    text: str = "text",
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """Add columns that depend on each row's text alone; no shuffle.

    ``make()`` runs once in a task and returns a function from (bytes, offsets) to the
    added columns. ``keep`` names the columns that stay; an added column replaces one of
    the same name.
    """
    keep = [c for c in keep if c not in added.names]
    schema = T.StructType([docs.schema[c] for c in keep] + added.fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)

    def run(batches):
        work = make()
        for batch in batches:
            names = batch.schema.names
            for i, j, data, offsets in slices(batch.column(names.index(text)), limit):
                made = work(data, offsets)
                arrays = [batch.column(names.index(c)).slice(i, j - i) for c in keep]
                arrays = [a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, out)]
                arrays += [pa.array(made[f.name], f.type) for f in list(out)[len(keep) :]]
                yield pa.RecordBatch.from_arrays(arrays, schema=out)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of each."""
    size = 1 << max(10, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        found = []
        for base in (_BASE, _INVERSE):
            table = np.full(size, base, U64)
            table[0] = 1
            found.append(np.multiply.accumulate(table))
        _powers[size] = found[0], found[1]
    return _powers[size]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i] standing for data[i:j], up to a power of the base."""
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(len(data) + 1)[0][: len(data)], out=total[1:])
    return total


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; they depend on the bytes alone."""
    total = prefix_hash(data)
    return mix((total[ends] - total[starts]) * powers(len(data) + 1)[1][starts] + (ends - starts).astype(U64))


def word_spans(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray):
    """Starts and ends of the words of all texts, and the first word of each text."""
    inside = letters[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    starts[first] = inside[first]
    ends[last] = inside[last]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offsets)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` consecutive word hashes, for every start that has so many."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = words[:n].copy()
    for k in range(1, size):
        h = h * U64(0xD6E8FEB86659FD93) + words[k : k + n]
    return mix(h + U64(size))
