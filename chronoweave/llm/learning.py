"""Bounded samples, hashed features and solvers that the classifiers share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import materialize, mix64


def bounded_sample(rows: DataFrame, by: str | None, bound: int, key: str = "doc_id") -> DataFrame:
    """About ``bound`` of the distinct (key, by) of ``rows``, the same number of each value of ``by`` where there are enough, chosen by a hash of ``key``.

    Each value has one row at least, so with more values than ``bound`` the sample is as large as their number. One
    small aggregation gives the share of each value; the choice itself is a filter. Null keys are left out. Without
    ``by``, all rows are of one kind.
    """
    part = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    if by is None:
        n = rows.where(F.col(key).isNotNull()).count()
        return rows.where(F.col(key).isNotNull() & (part < bound / max(n, 1))).select(key).distinct()
    keyed = rows.where(F.col(key).isNotNull()).select(key, by, part.alias("part"))
    counts = materialize(keyed.groupBy(F.col(by).alias("value")).agg(F.count("*").alias("n"), F.min("part").alias("least")), "shares")
    values = counts.count()
    share = max(1.0, bound / max(values, 1)) / F.col("n")
    chosen = keyed.join(counts, F.col(by).eqNullSafe(F.col("value"))).where((F.col("part") < share) | (F.col("part") == F.col("least")))
    return chosen.select(key, by).distinct()


def list_views(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Each row of a list column as a view of Arrow's memory."""
    out = []
    for chunk in column.chunks:
        values, offsets = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        out += [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return out


def byte_ngrams(words: list[bytes], sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the byte n-grams of each word, with marks for its two ends, and the index of the word each is from."""
    marked = b"".join(b"\x01" + w + b"\x02" for w in words)
    raw = np.frombuffer(marked, np.uint8).astype(np.uint64)
    length = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), length)
    left = np.repeat(np.cumsum(length), length) - np.arange(len(raw))  # bytes to the word's end
    hashes, owners = [], []
    for n in sizes:
        if len(raw) < n:
            continue
        h = np.full(len(raw) - n + 1, n, np.uint64)
        for i in range(n):
            h = h * np.uint64(257) + raw[i : len(raw) - n + 1 + i]
        ok = left[: len(h)] >= n
        hashes.append(mix64(h[ok] * np.uint64(0x9E3779B97F4A7C15)))
        owners.append(owner[: len(h)][ok])
    return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), np.concatenate(owners) if owners else np.empty(0, np.int64)


def ftrl(features: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, weight: np.ndarray, buckets: int, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.5, l2: float = 1.0, seed: int = 1) -> np.ndarray:
    """Logistic regression by follow-the-regularised-leader steps over sparse rows (places, values); targets may be probabilities. The last weight is the intercept."""
    z, n = np.zeros(buckets + 1), np.zeros(buckets + 1)
    order = np.random.Generator(np.random.PCG64(seed))

    def weights(at):
        w = np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))
        return w

    rows = [(np.append(i, np.int32(buckets)).astype(np.int32), np.append(v, np.float32(1)).astype(np.float32)) for i, v in features]
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            at, v = rows[r]
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ v, -30, 30)))
            g = weight[r] * (p - target[r]) * v
            new = n[at] + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(n[at])) / alpha * w
            n[at] = new
    return weights(np.arange(buckets + 1))


class WordRows:
    """A row of numbers for each word, from ``compute`` over a list of new words; rows of up to ``limit`` words are kept."""

    #: New words that are worked out at a time, so that a batch of long texts needs little memory.
    PART = 4_096

    def __init__(self, compute, limit: int = 200_000):
        self.one, self.limit, self.at = compute, limit, {}
        self.rows: np.ndarray | None = None

    def compute(self, words: list[bytes]) -> np.ndarray:
        return np.concatenate([self.one(words[i : i + self.PART]) for i in range(0, len(words), self.PART)])

    def look(self, texts: list[list[bytes]]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The rows, and for each text the places of its words in them. New words of all the texts are worked out together."""
        at = self.at
        new = list({w for words in texts for w in words if w not in at})
        if self.rows is None:
            like = self.compute(new or [b""])
            self.rows = np.zeros((self.limit, like.shape[1]), like.dtype)
        kept, rest = new[: self.limit - len(at)], new[self.limit - len(at) :]
        if kept:
            self.rows[len(at) : len(at) + len(kept)] = self.compute(kept)
            at.update(zip(kept, range(len(at), len(at) + len(kept)), strict=True))
        if not rest:
            return self.rows, [np.fromiter(map(at.__getitem__, words), np.int64, len(words)) for words in texts]
        more = dict(zip(rest, range(self.limit, self.limit + len(rest)), strict=True))
        find = lambda w: at[w] if w in at else more[w]
        return np.concatenate([self.rows, self.compute(rest)]), [np.fromiter(map(find, words), np.int64, len(words)) for words in texts]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
