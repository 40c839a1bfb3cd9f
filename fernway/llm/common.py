"""Small helpers that the corpus operators share: byte tables and batching."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes(range(0x61, 0x7B))

#: A-Z to a-z, every other byte as it is; ``bytes.split()`` then yields the words ``[^\x20\x09-\x0D]+``.
LOWER_TABLE = bytes.maketrans(_UPPER, _LOWER)

#: As above, and every ASCII byte that is neither digit nor letter becomes a space, so that ``split()`` yields the
#: words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``. Bytes of multi-byte characters stay.
ALNUM_TABLE = bytes(
    LOWER_TABLE[b] if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)
)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose values in ``column`` hold about ``most_bytes``; at least one row each."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def longest_first(batch: pa.RecordBatch, column: str) -> pa.RecordBatch:
    """The rows by the length of ``column``, longest first, so that slices hold values of like lengths."""
    return batch.take(pa.compute.sort_indices(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), sort_keys=[("", "descending")]))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with as many underscores after it as it takes, so that it is none of the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(column: str, modulus: int) -> F.Column:
    """crc32 of the value as text, modulo ``modulus``; null where the value is null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def fenced(column: F.Column) -> F.Column:
    """The column as it is, but never moved or repeated by the optimizer.

    Filters are pushed through projections by putting their expressions in, which would evaluate an array again for each element
    of a lambda that looks at it. Spark does not do so with what it takes for non-deterministic.
    """
    return F.when(F.spark_partition_id() >= 0, column)
