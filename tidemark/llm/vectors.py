"""Vector columns: which vectors take part, and how batches of them become matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for a vector that is not null, not empty, not all zero and whose components are all finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def matrix(vectors: pa.Array) -> np.ndarray:
    """The vectors of one length as a matrix of doubles."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)


def runs(stream: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(values, rows) for each stretch of equal values in the first ``keys`` (long)
    columns of each batch; a run that goes over batches comes in parts."""
    for batch in stream:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)], axis=1)
        cuts = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            yield tuple(values[s].tolist()), batch.slice(s, e - s)


def by_group(stream: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """One table for each run of equal values in the first ``keys`` (long)
    columns of a stream that is sorted by them. Holds one run and one batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for key, part in runs(stream, keys):
        if held and key != last:
            yield pa.Table.from_batches(held)
            held = []
        held.append(part)
        last = key
    if held:
        yield pa.Table.from_batches(held)
