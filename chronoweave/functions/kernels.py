"""Feature kernels over square grey images given as arrays: numpy where a transform is needed, columns elsewhere."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dct_matrix(n: int) -> np.ndarray:
    """The orthonormal cosine transform of length ``n``."""
    k, i = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    m = np.sqrt(2 / n) * np.cos(np.pi * k * (2 * i + 1) / (2 * n))
    m[0] /= np.sqrt(2)
    return m


def dct_hash(side: int, low: int = 6):
    """A hash of the ``low`` x ``low`` lowest frequencies: bit i is whether coefficient i reaches their median."""
    transform = dct_matrix(side)

    @F.pandas_udf("bigint")
    def run(images: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(v, float).reshape(side, side) for v in images]) if len(images) else np.empty((0, side, side))
        spectrum = (transform @ x @ transform.T)[:, :low, :low].reshape(len(x), -1).round(9)
        bits = spectrum >= np.median(spectrum, axis=1, keepdims=True)
        return pd.Series((bits * (1 << np.arange(low * low, dtype=np.int64))).sum(axis=1))

    return run


def mean_hash(image: Column, bits: int = 60) -> Column:
    """Bit i: whether pixel i reaches the mean."""
    total = F.aggregate(image, F.lit(0.0), lambda s, x: s + x.cast("double"))
    mean = total / F.size(image)
    one = F.lit(1).cast("long")
    marks = F.slice(F.transform(image, lambda x, i: F.when(x.cast("double") >= mean, F.call_function("shiftleft", one, i)).otherwise(F.lit(0).cast("long"))), 1, bits)
    return F.aggregate(marks, F.lit(0).cast("long"), lambda s, x: s + x)


def quality(image: Column, side: int) -> Column:
    """0.42 spread + 0.38 edges + 0.20 (1 - dark share), each within [0, 1], for values around zero."""
    n = F.size(image)
    mean = F.aggregate(image, F.lit(0.0), lambda s, x: s + x.cast("double")) / n
    spread = F.sqrt(F.aggregate(image, F.lit(0.0), lambda s, x: s + (x.cast("double") - mean) * (x.cast("double") - mean)) / n)
    steps = F.zip_with(F.slice(image, 1, side * side - 1), F.slice(image, 2, side * side - 1), lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    edges = F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / (n - 1)
    dark = F.size(F.filter(image, lambda x: x < -0.2)) / n
    cap = lambda x: F.least(F.lit(1.0), x)
    return 0.42 * cap(spread) + 0.38 * cap(edges) + 0.20 * (1 - dark)
