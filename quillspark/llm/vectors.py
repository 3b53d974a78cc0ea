"""Vectors as rows of whole numbers: what the two operators on embeddings share."""

import numpy as np
from pyspark.sql import functions as F


def finite(vector):
    """Whether a vector is there and all its components are finite numbers."""
    inside = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(inside, F.lit(False))


def floors(vector, scale, most):
    """floor(scale * x) of each component. Beyond `most` exact 64-bit distances would overflow: that is an error, not a wrong result."""
    whole = F.transform(vector, lambda x: F.floor(x * F.lit(float(scale))))
    beyond = F.raise_error(F.lit(f"a component times {scale} is beyond {most}")).cast("array<bigint>")
    return F.when(F.exists(vector, lambda x: F.abs(x) * float(scale) > most), beyond).otherwise(whole)


def matrix(column):
    """An Arrow column of lists of one length as rows of a matrix."""
    if not len(column):
        return np.zeros((0, 0), np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def floor_means(rows, sums, old):
    """`old` entries, replaced by floor(sum / count) where `rows` (at, n, *) has a count; each `sums` of a row is a list."""
    new = old.copy()
    for row in rows:
        new[row["at"]] = np.array(row[sums], np.int64) // row["n"]
    return new
