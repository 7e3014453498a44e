"""What the vector operators share: valid vectors, classes of equal ones, bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, all components finite."""
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")),
    )
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def same_key(vector: Column) -> list[Column]:
    """128 bits that tell vectors apart."""
    return [
        F.xxhash64(F.lit("a"), vector).alias("_k1"),
        F.xxhash64(F.lit("b"), vector).alias("_k2"),
    ]


def sample_vectors(classes: DataFrame, vector: str, rows: int):
    """A matrix of at most ``rows`` unit vectors, chosen by hash: alike on each run, at any size."""
    import numpy as np

    some = classes.select(F.xxhash64(F.lit("sample"), "_k1", "_k2").alias("h"), vector)
    some = [r[1] for r in some.orderBy("h", vector).limit(rows).collect()]
    return unit(np.array(some, dtype=np.float64)) if some else np.zeros((0, 1))


def matrix(column):
    """A pandas column of equally long arrays as a double matrix."""
    import numpy as np

    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def unit(x):
    import numpy as np

    # scaling first keeps squares of very large or very small components finite
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
