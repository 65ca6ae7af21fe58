"""What the vector operators share: which vectors count, and bounded samples of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(embedding: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(embedding, lambda x: x != 0)
    return F.coalesce(embedding.isNotNull() & ~bad & some, F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def usual_length(df: DataFrame) -> int:
    """The most frequent number of components; 0 for an empty table."""
    row = df.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return row["d"] if row else 0


def sample(df: DataFrame, dims: int, most: int) -> np.ndarray:
    """At most about ``most`` rows with ``dims`` components, chosen by a hash of the vector, scaled to length 1."""
    own = df.where(F.size("embedding") == dims)
    n = own.count()
    hashed = F.pmod(F.xxhash64("embedding"), F.lit(2**31))
    rows = own.where(hashed < int(2**31 * min(1.0, most / max(1, n)))).orderBy(hashed).select("embedding").limit(2 * most).collect()
    return unit(np.array([r[0] for r in rows], float)) if rows else np.zeros((0, dims))
