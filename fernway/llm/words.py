"""Words of many texts at once as Arrow arrays, without a Python object for each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute


def translated(column: pa.Array, table: bytes) -> pa.Array:
    """The texts with each byte replaced by what ``table`` has for it; nulls are empty texts. Bytes need not be UTF-8."""
    column = pa.compute.fill_null(column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column, "")
    first = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    held = bytes(memoryview(data)[first[0] : first[-1]]) if data is not None and len(first) else b""
    return pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(first - first[0] if len(first) else np.zeros(1, dtype=np.int64)), pa.py_buffer(held.translate(table)))


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of the texts, one text after another, and the number of words before each text and after the last."""
    split = pa.compute.ascii_split_whitespace(pa.compute.fill_null(column.cast(pa.large_string()), ""))
    words, before = split.flatten(), np.concatenate(([0], np.cumsum(pa.compute.list_value_length(split).to_numpy(zero_copy_only=False)))).astype(np.int64)
    there = pa.compute.greater(pa.compute.binary_length(words), 0)
    kept = np.concatenate(([0], np.cumsum(there.to_numpy(zero_copy_only=False)))).astype(np.int64)
    return words.filter(there), kept[before]


def joined(words: pa.Array, first: np.ndarray) -> pa.Array:
    """Texts of the words, with a space between them; ``first`` as :func:`words_of` gives it."""
    lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), words)
    return pa.compute.binary_join(lists, pa.scalar(" ", words.type)).cast(pa.string())


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def word_counts(column: pa.Array) -> np.ndarray:
    """The number of words ``[^\\x20\\x09-\\x0D]+`` of each text; none where it is null."""
    column = pa.compute.fill_null(column.cast(pa.large_string()), "")
    first = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    counts, some = np.zeros(len(column), dtype=np.int64), np.flatnonzero(np.diff(first) > 0)
    if len(some):
        blank = _BLANK[np.frombuffer(column.buffers()[2], dtype=np.uint8)[first[0] : first[-1]]]
        begins = ~blank
        begins[1:] &= blank[:-1]
        at = first[some] - first[0]
        begins[at] = ~blank[at]
        counts[some] = np.add.reduceat(begins, at, dtype=np.int64)
    return counts
