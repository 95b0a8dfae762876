"""Columns of numbers shipped through a Spark shuffle as one binary row per (batch, bucket).

A mapper cuts its numbers by bucket; groupBy("bucket").applyInArrow sees one bucket's rows, whose columns join up again.
The number of buckets follows the input, so a bucket stays of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Input bytes for each bucket.
BUCKET_BYTES = 6 << 20


def bucket_count(n_bytes: int, per_bucket: int = BUCKET_BYTES) -> int:
    return max(1, -(-n_bytes // per_bucket))


def cut(bucket: np.ndarray, columns: list[np.ndarray]) -> list[tuple]:
    """(bucket, column bytes...) for each bucket that occurs; rows keep their order within a bucket."""
    if not len(bucket):
        return []
    order = np.argsort(bucket, kind="stable")
    sorted_bucket = bucket[order]
    at = np.concatenate(([0], np.nonzero(np.diff(sorted_bucket))[0] + 1, [len(bucket)]))
    columns = [c[order] for c in columns]
    return [(int(sorted_bucket[a]), *(c[a:b].tobytes() for c in columns)) for a, b in zip(at[:-1], at[1:])]


def joined(rows: pa.Table, name: str, dtype: str) -> np.ndarray:
    """The numbers of all rows of a column, from Arrow's buffers, without a Python object for each row. Missing rows have none."""
    parts = []
    for chunk in rows.column(name).chunks:
        chunk = chunk.drop_null()
        if len(chunk):
            _, offsets, data = chunk.buffers()
            at = np.frombuffer(offsets, "<i8" if pa.types.is_large_binary(chunk.type) else "<i4")
            parts.append(np.frombuffer(data or b"", "u1")[at[chunk.offset] : at[chunk.offset + len(chunk)]].view(dtype))
    return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.zeros(0, dtype)])


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys begins, and its length."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.concatenate(([0], np.nonzero(sorted_keys[1:] != sorted_keys[:-1])[0] + 1))
    return start, np.diff(np.concatenate((start, [len(sorted_keys)])))
