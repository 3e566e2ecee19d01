"""Text helpers that run inside tasks, on Arrow columns.

A word is a run of characters other than space and the ASCII controls 9 to 13.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``max_bytes`` of text, so that what a
    task holds does not depend on the batch size.  One row is never cut."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < n:
        base = total[start - 1] if start else 0
        end = max(int(np.searchsorted(total, base + max_bytes, side="right")), start + 1)
        yield batch.slice(start, end - start)
        start = end
    _give_back()


def _give_back() -> None:
    """Return freed memory to the system: a worker lives on into other stages, and two
    of them share an executor's memory with its JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def strings(column: pa.Array) -> pa.Array:
    """Nulls as empty texts."""
    return pc.fill_null(column, "")


def as_list(values: pa.Array) -> list:
    """The values as Python objects; for strings far faster than ``to_pylist``."""
    return values.to_numpy(zero_copy_only=False).tolist()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in order, and for text i the range
    ``offsets[i]:offsets[i + 1]`` of its words."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0)
    keep = full.to_numpy(zero_copy_only=False)
    if not keep.all():
        before = np.concatenate(([0], np.cumsum(keep)))
        offsets = before[offsets]
        flat = flat.filter(full)
    return flat, offsets


def joined_words(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All words of all texts, one space between: the bytes, each word's start and
    end in them, and the texts' word offsets."""
    words, offsets = split_words(texts)
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths + 1) - 1
    buffer = " ".join(as_list(words)).encode()
    return buffer, ends - lengths, ends, offsets


def expand_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of the ranges ``start, start + 1, ...`` one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum()), dtype=np.int64) + np.repeat(starts - before, lengths)
