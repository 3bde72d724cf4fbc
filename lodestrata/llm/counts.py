"""Hashed counts of character and byte sequences, and in how many rows each occurs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ending

_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def hashed_counts(codes: np.ndarray, orders: range, buckets: int, reserved: int = 0) -> np.ndarray:
    """How often each bucket's sequences of `orders` neighbours occur in codes (uint32); the last `reserved` stay free."""
    out = np.zeros(buckets, np.int64)
    room = np.uint32(buckets - reserved)
    total = None
    for k in range(1, max(orders) + 1):
        if len(codes) < k:
            break
        own = codes * _MIX[k - 1]
        total = own if total is None else total[:-1] + own[k - 1 :]
        if k in orders:
            h = total ^ total >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            out += np.bincount((h >> np.uint32(8)) % room, minlength=buckets)
    return out


def rows_with(docs: DataFrame, counts, buckets: int) -> tuple[int, np.ndarray]:
    """Rows of docs (one column, text), and for each bucket those in which counts(text) has it; every row counts."""
    def run(batches):
        n, seen = 0, np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch.column(0):
                seen += counts(x.as_py()) > 0
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([[n, *seen.tolist()]], pa.list_(pa.int64()))], ["c"])

    sums = docs.mapInArrow(ending(run), "c array<bigint>").select(F.posexplode("c").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets + 1, np.int64)
    for r in sums:  # as many as buckets
        out[r["i"]] = r["n"]
    return int(out[0]), out[1:]


def inverse_frequency(n: int, seen: np.ndarray) -> np.ndarray:
    return np.log((n + 1) / (seen + 1)).astype(np.float32) + np.float32(1e-3)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of unit length, for one row or several; rows without counts stay zero."""
    x = np.log1p(counts.astype(np.float32)) * idf
    size = np.sqrt((x * x).sum(axis=-1, keepdims=True))
    return np.divide(x, size, out=x, where=size > 0)
