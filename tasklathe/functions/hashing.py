"""The partitioner's hash of the log's producers (murmur2, 32 bits), vectorised over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Constants of the published hash function and the seed producers use.
MULTIPLIER = 0x5BD1E995
ROTATE = 24
SEED = 0x9747B28C


def murmur2(keys: list[bytes]) -> np.ndarray:
    """Signed 32-bit hashes. Keys of one length are hashed side by side."""
    out = np.zeros(len(keys), np.uint32)
    by_len: dict[int, list[int]] = {}
    for i, k in enumerate(keys):
        by_len.setdefault(len(k), []).append(i)
    m = np.uint64(MULTIPLIER)
    low = np.uint64(0xFFFFFFFF)
    for n, at in by_len.items():
        data = np.frombuffer(b"".join(keys[i] for i in at), np.uint8).reshape(len(at), n).astype(np.uint64)
        h = np.full(len(at), (SEED ^ n) & 0xFFFFFFFF, np.uint64)
        for a in range(0, n - n % 4, 4):
            k = data[:, a] | data[:, a + 1] << np.uint64(8) | data[:, a + 2] << np.uint64(16) | data[:, a + 3] << np.uint64(24)
            k = k * m & low
            k ^= k >> np.uint64(ROTATE)
            k = k * m & low
            h = (h * m & low) ^ k
        tail = n - n % 4
        if n % 4:
            for j in range(n % 4 - 1, -1, -1):
                h ^= data[:, tail + j] << np.uint64(8 * j)
            h = h * m & low
        h ^= h >> np.uint64(13)
        h = h * m & low
        h ^= h >> np.uint64(15)
        out[at] = h.astype(np.uint32)
    return out.view(np.int32)


def murmur2_column(key: Column) -> Column:
    """murmur2 of a binary column; null for null."""

    @F.pandas_udf("int")
    def run(s: pd.Series) -> pd.Series:
        ok = s.notna().to_numpy()
        out = pd.array([pd.NA] * len(s), "Int32")
        if ok.any():
            out[ok] = murmur2([bytes(b) for b in s[ok]])
        return pd.Series(out)

    return run(key)
