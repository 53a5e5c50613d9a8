"""Dealing large groups to several tasks so that any two of their rows still meet.

A group over its limit has k chunks. A row of chunk s goes to the blocks (s, t) and (t, s), so to k blocks in all, and rows
of chunks s and t meet in the block of both. The work within one group grows with the square of its size over the limit's;
nothing is dropped.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_HEAVY = 100_000  # groups that are dealt in blocks, at most; limits grow to keep to it


def heavy(weights: DataFrame, limit: int, scale: int = 1) -> dict[int, int]:
    """Chunks of the keys of ``weights(key, weight)`` over the limit, MOST_HEAVY keys at most; weights count ``scale`` fold.

    A block holds two chunks, so a chunk is half the limit."""
    total = (weights.agg(F.sum("weight")).first()[0] or 0) * scale
    limit = max(limit, total // MOST_HEAVY)
    by = weights.groupBy("key").agg((F.sum("weight") * scale).alias("weight")).filter(F.col("weight") > limit).collect()
    return {r["key"]: -(-2 * r["weight"] // limit) for r in by}


def blocks(key: np.ndarray, row: np.ndarray, chunks: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(index, block): the blocks of each row, 0 for those of other keys. ``row`` numbers the rows."""
    if not chunks or not (big := np.isin(key, np.fromiter(chunks, np.int64, len(chunks)))).any():
        return np.arange(len(key)), np.zeros(len(key), np.int64)
    at, out = [np.flatnonzero(~big)], [np.zeros(int((~big).sum()), np.int64)]
    for r in np.flatnonzero(big).tolist():
        k = chunks[int(key[r])]
        own = xxhash.xxh64_intdigest(int(row[r]).to_bytes(8, "little", signed=True), 7) % k
        other = np.arange(k)
        at.append(np.full(k, r))
        out.append(np.minimum(own, other) * k + np.maximum(own, other))
    return np.concatenate(at), np.concatenate(out)
