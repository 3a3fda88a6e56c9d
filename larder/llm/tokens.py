"""Vectorised words of Arrow text columns: lower-cased A-Z, split at SPACE_CLASS."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batch: pa.RecordBatch, column: int, max_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice's text has about max_bytes, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    start = 0
    while start < batch.num_rows:
        limit = (ends[start - 1] if start else 0) + max_bytes
        stop = max(start + 1, int(np.searchsorted(ends, limit, side="right")))
        yield batch.take(pa.array(np.arange(start, stop)))
        start = stop


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of texts in order, and how many each text has; null has none.

    Slices are copied first: ascii_lower of this Arrow release misreads an array whose
    offset is not 0.
    """
    if texts.offset:
        texts = texts.take(pa.array(np.arange(len(texts))))
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string())))
    flat = pc.list_flatten(lists)
    owner = pc.list_parent_indices(lists)
    full = pc.not_equal(pc.binary_length(flat), 0)
    flat, owner = flat.filter(full), owner.filter(full)
    counts = np.bincount(owner.to_numpy(zero_copy_only=False).astype(np.int64), minlength=len(texts))
    return flat, counts


def coded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of words and the distinct words, in order of first occurrence."""
    d = flat.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary
