"""Best-fit packing by length patterns and non-negative least squares."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm.bpe import IdCache
from chronoweave.llm.common import materialize, small_batches

#: Steps of the least-squares fit.
STEPS = 400


@lru_cache(maxsize=4)
def patterns(size: int) -> np.ndarray:
    """All sets of up to three lengths that fill ``size`` exactly, as rows of three lengths (0: none)."""
    out = [np.array([[size, 0, 0]])]
    if size > 1:
        low = np.arange(1, size // 2 + 1)
        out.append(np.stack([size - low, low, 0 * low], axis=1))
    if size > 2:
        b, c = np.meshgrid(np.arange(1, size), np.arange(1, size), indexing="ij")
        a = size - b - c
        ok = (a >= b) & (b >= c)
        out.append(np.stack([a[ok], b[ok], c[ok]], axis=1))
    return np.concatenate(out).astype(np.int64)


def fit_patterns(histogram: np.ndarray, size: int, steps: int = STEPS, over: float = 10.0) -> np.ndarray:
    """Repeat counts x >= 0 of ``patterns(size)`` that fit ``histogram`` best: weighted least squares by accelerated projected gradient.

    A length that is left over weighs as its share of ``size``, as short pieces are easily placed later; one that is
    used too often weighs ``over`` times that. The matrix is never built: its products are gathers and bin counts.
    """
    p, h = patterns(size), histogram.astype(float)
    weight = np.arange(size + 1) / size
    h[0] = 0

    def forward(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(p[:, i], weights=x, minlength=size + 1) for i in range(3))
        out[0] = 0
        return out

    bound = np.ones(len(p))
    for _ in range(12):  # the largest eigenvalue, by power steps
        bound = forward(bound)[p].sum(axis=1)
        bound /= np.linalg.norm(bound)
    step = 1 / (1.05 * over * np.linalg.norm(forward(bound)[p].sum(axis=1)))
    x = y = np.zeros(len(p))
    t = 1.0
    for _ in range(steps):
        off = forward(y) - h
        grad = off * np.where(off > 0, over * weight, weight)
        new = np.maximum(y - step * grad[p].sum(axis=1), 0)
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / s * (new - x), new, s
    return x


def best_fit(left: np.ndarray, size: int) -> dict[tuple[int, ...], int]:
    """Best-fit decreasing over counts of lengths: each length goes to the fullest sequences that still take it."""
    open_: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    for length in range(size, 0, -1):
        n = int(left[length])
        while n:
            room = next((r for r in range(length, size) if open_.get(r)), size)
            fits = room // length
            if room == size:
                filled, have = (), n // fits + 1
            else:
                filled, have = next(iter(open_[room].items()))
            full = min(have, n // fits)
            last = n - full * fits if full < have and n - full * fits < fits else 0
            for k, count in ((fits, full), (last, 1 if last else 0)):
                if count:
                    if room != size:
                        open_[room][filled] -= count
                    open_[room - k * length][(*filled, *[length] * k)] += count
                    n -= k * count
            if room != size and not open_[room][filled]:
                del open_[room][filled]
    return {f: n for by in open_.values() for f, n in by.items() if n}


def rounded(x: np.ndarray, histogram: np.ndarray, size: int) -> tuple[dict[tuple[int, ...], int], np.ndarray]:
    """The fitted counts rounded down, largest first and never beyond what is there; and the histogram of what remains."""
    left, out, p = histogram.astype(np.int64).copy(), {}, patterns(size)
    want = np.floor(x).astype(np.int64)
    for i in np.argsort(-x, kind="stable")[: int((want > 0).sum())]:
        key = tuple(int(v) for v in p[i] if v)
        need = {v: key.count(v) for v in key}
        n = min([int(want[i]), *(int(left[v]) // k for v, k in need.items())])
        if n > 0:
            out[key] = n
            for v, k in need.items():
                left[v] -= k * n
    return out, left


def plan(histogram: np.ndarray, size: int, shares: tuple[float, ...] = (1.0, 0.5, 0.2, 0.05)) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often to use each, together using each length of ``histogram`` (index: length) exactly as often as it occurs.

    Fitted counts are rounded down and what remains is packed by best fit. A length of outstanding frequency may have
    too few partners; then a fit that is used in full wastes short pieces, so that share of it is used that gives the
    fewest sequences.
    """
    if not histogram[1:].any():
        return []
    x, best = fit_patterns(histogram, size), None
    for share in shares:
        out, left = rounded(share * x, histogram, size)
        for key, n in best_fit(left, size).items():
            key = tuple(sorted(key, reverse=True))
            out[key] = out.get(key, 0) + n
        if best is None or sum(out.values()) < sum(best.values()):
            best = out
    return sorted(best.items(), reverse=True)


def slots(planned: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """For each run of places: length, first rank of that length, first sequence, offset in the sequence; by length and rank."""
    rows, taken, first = [], defaultdict(int), 0
    for pattern, n in planned:
        offset = 0
        for length in pattern:
            rows.append((length, taken[length], first, offset))
            taken[length] += n
            offset += length
        first += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, rank) of each piece; rank: place among the part's pieces of that length.

    A document's ids end with ``end_id``. More than ``size`` ids are cut so that all pieces but the first are full.
    """
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, ranks, end = IdCache(tokenizer_path), TaskContext.get().partitionId(), np.zeros(size + 1, dtype=np.int64), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = memoryview(ids_of(text or "") + end)
                n = len(ids) // 4
                start, piece = 0, 0
                while start < n:
                    length = (n - start) % size or size
                    rows.append((piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, ranks[length]))
                    at.append(i)
                    ranks[length] += 1
                    start, piece = start + length, piece + 1
            if rows:
                columns = np.array(rows, dtype=np.int64).T
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(columns[0].astype(np.int32)), *map(pa.array, columns[1:])], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part bigint, rank bigint")


def best_fit_packing(docs: DataFrame, tokenizer_path: str, end_id: int = 2, size: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece of each row of ``docs``.

    Only the histogram of lengths, ``size`` numbers, reaches the driver, and only the plan over lengths, whose size
    depends on ``size`` alone, goes back. Each piece finds its place from its rank among the pieces of its length: its
    rank in its part plus the number in earlier parts, which is a small table joined on (part, length); so no length,
    however frequent, meets in one task.

    Null text counts as empty and gives one piece with ``end_id`` alone. Ids, null or repeated, pass through; each row
    is a document. Other columns, whatever their names, are not read. An empty table gives no rows.
    """
    pieces = materialize(tokenize_pieces(docs, tokenizer_path, end_id, size, id_col, text_col), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = np.zeros(size + 1, dtype=np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    places = slots(plan(histogram, size))
    span = int(histogram.max(initial=0)) + 1
    keys = places[:, 0] * span + places[:, 1]
    earlier = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("earlier"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.searchsorted(keys, length * span + rank, side="right") - 1
            sequence = places[at, 2] + rank - places[at, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(places[at, 3])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(earlier, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("earlier")).alias("rank"))
    kind = docs.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
