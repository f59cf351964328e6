"""Search from coarse to fine: cheap scores over all frames of a source, exact ones for the best of them.

Queries and frames of a source meet in pairs of blocks, cut on both time axes, so a source with most of the rows is
many tasks, and each task is array arithmetic of bounded size. A task keeps the best of its own pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from chronoweave.functions.scoring import audit_calibration
from chronoweave.operators.folds import nms

#: Weights of the coarse score: two parts of the hash, the dense part, the even spread of signs. Fixed values.
COARSE = {"high": 0.20, "low": 0.28, "dense": 0.49, "edge": 0.03}
#: Elements of a vector that the dense part looks at; bits of the hash's two parts.
DENSE, HIGH_BITS, LOW_BITS = 16, 32, 28
#: Seconds between kept hits; exact and pair score in a hit; below which pair score a hit is damped, by how much. Fixed values.
APART, EXACT_SHARE, LEAST_PAIR, DAMPED = 0.35, 0.25, 0.45, 0.62
#: Queries and frames of a cell that are scored at once.
AT_ONCE = (256, 2_048)
#: The key of a pair that may not meet, below those of all scores.
NEVER = np.iinfo(np.int64).min


def coarse_scores(q_hash: np.ndarray, q_vectors: np.ndarray, f_hash: np.ndarray, f_vectors: np.ndarray) -> np.ndarray:
    """Approximate similarity of all queries (rows) and frames (columns)."""
    unit = lambda v: v[:, :DENSE] / np.maximum(np.sqrt(np.square(v[:, :DENSE]).sum(axis=1, keepdims=True)), 1e-12)
    off = q_hash[:, None] ^ f_hash[None, :]
    high, low = np.bitwise_count(off >> LOW_BITS), np.bitwise_count(off & ((1 << LOW_BITS) - 1))
    dense = np.clip(unit(q_vectors) @ unit(f_vectors).T, 0, 1)
    edge = 1 - np.abs(np.bitwise_count(q_hash)[:, None].astype(int) - np.bitwise_count(f_hash)[None, :].astype(int)) / (HIGH_BITS + LOW_BITS)
    return np.round(COARSE["high"] * (1 - high / HIGH_BITS) + COARSE["low"] * (1 - low / LOW_BITS) + COARSE["dense"] * dense + COARSE["edge"] * edge, 9)


def cosine_scores(q_hash: np.ndarray, q_vectors: np.ndarray, f_hash: np.ndarray, f_vectors: np.ndarray) -> np.ndarray:
    """Inner products, for vectors of length one."""
    return np.round(q_vectors @ f_vectors.T, 9)


def _keys(score: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of scores as SQL sorts them, NaN being the greatest; masked scores get ``NEVER``."""
    value = np.ma.getdata(score) + 0.0  # -0.0 is 0.0
    value[np.isnan(value)] = np.nan
    bits = value.view(np.int64)
    keys = bits ^ ((bits >> 63) & np.iinfo(np.int64).max)
    if np.ma.is_masked(score):
        keys[score.mask] = NEVER
    return keys


def _best_of_rows(score: np.ndarray, n: int, floor: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's ``n`` best, the earlier column of equals first, none below ``floor``, none that is masked."""
    key = _keys(score)
    lowest = NEVER + 1 if floor is None else _keys(np.array([floor]))[0]
    least = np.full(len(key), lowest) if key.shape[1] <= n else np.maximum(np.partition(key, -n, axis=1)[:, -n], lowest)
    row, place = np.nonzero(key >= least[:, None])
    order = np.lexsort((place, -key[row, place], row))
    row, place = row[order], place[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < n], place[rank < n]


def _best_of_cell(score: Callable[[slice, slice], np.ndarray], rows: int, columns: int, n: int, floor: float | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, score) of each row's ``n`` best, some rows at a time; no more than ``AT_ONCE`` pairs are held, besides the best of those seen."""
    for top in range(0, rows, AT_ONCE[0]):
        some = slice(top, min(top + AT_ONCE[0], rows))
        best = tuple(np.empty(0, k) for k in (int, int, float))
        for left in range(0, columns, AT_ONCE[1]):
            part = score(some, slice(left, min(left + AT_ONCE[1], columns)))
            row, place = _best_of_rows(part, n, floor)
            row, place, value = (np.concatenate(x) for x in zip(best, (row, place + left, np.ma.getdata(part)[row, place]), strict=True))
            order = np.lexsort((place, -_keys(value), row))
            row, place, value = row[order], place[order], value[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < n
            best = row[kept], place[kept], value[kept]
        yield best[0] + top, best[1], best[2]


def _first_others(own: np.ndarray | None, times: np.ndarray, n: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the first ``n`` places of each row, passing by those whose time is the row's ``own``; ``times`` rise."""
    at, until = (np.searchsorted(times, own, side) for side in ("left", "right")) if own is not None else (np.zeros(rows, int),) * 2
    place = np.arange(n) + (np.arange(n) >= at[:, None]) * (until - at)[:, None]
    row, k = np.nonzero(place < len(times))
    return row, place[row, k]


def coarse_hits(queries: DataFrame, frames: DataFrame, source: str, n: int, scores: Callable = coarse_scores, floor: float | None = None, block: float = 600.0, others: bool = False, missing: bool = False) -> DataFrame:
    """(source, query, time, coarse): the ``n`` best frames of each query's source by ``scores``, equal ones by time, none below ``floor``.

    ``queries``: source, query, q_time, hash, vector; ``frames``: source, time, hash, vector; vectors are doubles of one
    length. ``block``: seconds of either side that one task takes; it sees each frame block of a source once for each
    query block. ``others``: queries and times are ids of one kind, and a frame of the query's own id is no hit of it.
    ``missing``: pairs of which one has no vector count too; their score is null and ranks last. Otherwise such rows are
    left out.
    """
    kinds = {k: d.schema[k].dataType for d, k in ((queries, source), (queries, "query"), (frames, "time"))}
    schema = ", ".join(f"{k} {v.simpleString()}" for k, v in kinds.items()) + ", coarse double"
    usable = "hash is not null" if missing else "vector is not null and hash is not null"
    q = queries.withColumn("q_block", F.floor(F.col("q_time") / block)).where(usable)
    f = frames.withColumn("f_block", F.floor(F.col("time") / block)).where(usable)
    q_blocks, f_blocks = q.select(source, "q_block").distinct(), f.select(source, "f_block").distinct()
    # Names of their own on either side: both may come from one table.
    own = lambda df, side: df.select(*[F.col(x).alias(f"{side}__{x}") for x in df.columns])
    q, f = own(q.join(f_blocks, source), "q"), own(f.join(q_blocks, source), "f")

    def vectors(column: pa.ChunkedArray) -> np.ndarray:
        flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
        return flat.reshape(len(column), -1)

    def split(rows: pa.Table, vector: str) -> tuple[pa.Table, pa.Table]:
        """Rows with a vector, and those without."""
        if not rows.column(vector).null_count:
            return rows, rows.slice(0, 0)
        return rows.filter(pc.is_valid(rows.column(vector))), rows.filter(pc.is_null(rows.column(vector)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []

        def keep(asked: pa.Table, names: pa.ChunkedArray, row: np.ndarray, place: np.ndarray, value: np.ndarray | pa.Array) -> None:
            pick = asked.take(pa.array(row))
            parts.append(pa.table({source: pick.column(f"q__{source}"), "query": pick.column("q__query"), "time": names.take(pa.array(place)), "coarse": value}))

        ids = lambda column: column.to_numpy() if others else None
        right = right.sort_by("f__time")
        times = right.select(["f__time"])
        (left, blank), (right, bare) = split(left, "q__vector"), split(right, "f__vector")
        asked, names = left.select([f"q__{source}", "q__query"]), right.column("f__time")
        if left.num_rows and right.num_rows:
            f_hash, f_vectors, f_ids = right.column("f__hash").to_numpy(), vectors(right.column("f__vector")), ids(names)
            q_hash, q_vectors, q_ids = left.column("q__hash").to_numpy(), vectors(left.column("q__vector")), ids(asked.column("q__query"))
            left = right = None

            def score(q: slice, f: slice) -> np.ndarray:
                value = scores(q_hash[q], q_vectors[q], f_hash[f], f_vectors[f])
                self = others and q_ids[q, None] == f_ids[None, f]
                return np.ma.array(value, mask=self) if np.any(self) else value

            for row, place, value in _best_of_cell(score, len(q_hash), len(f_hash), n, floor):
                keep(asked, names, row, place, value)
        for some, seen in ((asked, bare), (blank, times)) if missing else ():
            if some.num_rows and seen.num_rows:
                row, place = _first_others(ids(some.column("q__query")), seen.column("f__time").to_numpy(), n, some.num_rows)
                keep(some, seen.column("f__time"), row, place, pa.nulls(len(row), pa.float64()))
        if not parts:
            return pa.table({**{k: pa.array([], to_arrow_type(v)) for k, v in kinds.items()}, "coarse": pa.array([], pa.float64())})
        return pa.concat_tables(parts)

    found = q.groupBy(f"q__{source}", "q__q_block", "q__f_block").cogroup(f.groupBy(f"f__{source}", "f__q_block", "f__f_block")).applyInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy(source, "query").orderBy(F.desc_nulls_last("coarse"), "time"))
    return found.withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")


def frame_hits(queries: DataFrame, frames: DataFrame, source: str, exact: Column, pair: Column, limit: int = 24, floor: float = 0.58) -> DataFrame:
    """(source, query, rank, time, score): the ``limit`` best frames of each query, none within ``APART`` seconds of a better one.

    The best by coarse score, four times ``limit`` and 48 at least, are scored by ``exact`` and ``pair``, columns of
    vector (the query's) and frame; a pair score of 0 says nothing.
    """
    hits = coarse_hits(queries, frames, source, max(4 * limit, 48), floor=floor)
    j = hits.join(queries.select(source, "query", "vector"), [source, "query"]).join(frames.select(source, "time", F.col("vector").alias("frame")), [source, "time"])
    j = j.withColumn("e", exact).withColumn("p", pair)
    both = (F.col("e") * EXACT_SHARE + F.col("p") * (1 - EXACT_SHARE)) * F.when(F.col("p") < LEAST_PAIR, F.lit(DAMPED)).otherwise(F.lit(1.0))
    j = j.select(source, "query", "time", F.round(F.when(F.col("p") > 0, both).otherwise(F.col("e")), 9).alias("score"), (-F.col("time")).alias("later_first"))
    return nms(j, [source, "query"], "score", "time", "later_first", APART).where(F.col("rank") <= limit).select(source, "query", "rank", "time", "score")


def verified_sources(queries: DataFrame, frames: DataFrame, source: str, pixel: Column, top_k: int = 32, verify_k: int = 8, radius: float = 1.0, step: float = 0.25) -> DataFrame:
    """(source, query, time, score): the best place of each query on a grid around its most similar frames.

    The ``verify_k`` best of the ``top_k`` nearest frames are looked at every ``step`` seconds within ``radius``; a place
    of the grid has the similarity of the best frame that led there and the ``pixel`` score (of vector and frame) of the
    frame that stands there, calibrated together. Places without a frame don't count; ties go to the later place.
    """
    near = coarse_hits(queries, frames, source, min(top_k, verify_k), cosine_scores)
    steps = [round(-radius + i * step, 9) for i in range(int(2 * radius / step + 1e-6) + 1)]
    grid = near.withColumn("at", F.explode(F.array(*map(F.lit, steps)))).withColumn("time", F.round(F.greatest(F.lit(0.0), F.col("time") + F.col("at")), 3))
    grid = grid.groupBy(source, "query", "time").agg(F.max("coarse").alias("similarity"))
    seen = grid.join(frames.select(source, F.round("time", 3).alias("time"), F.col("vector").alias("frame")), [source, "time"]).join(queries.select(source, "query", "vector"), [source, "query"])
    scored = seen.select(source, "query", "time", F.round(audit_calibration(F.col("similarity"), pixel), 9).alias("score"))
    best = scored.groupBy(source, "query").agg(F.max(F.struct("score", "time")).alias("b"))
    return best.select(source, "query", "b.time", "b.score")
