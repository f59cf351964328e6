"""Recurrences over one group's ordered rows: grouped Arrow functions with numpy inside.

A group is one project or one query sequence; groups are spread over the cluster and each is worked out in one task.
Inside a group, rows of a table or anti-diagonals are one array operation each. Where groups are many and short, a block
of whole groups is one array operation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, StructType

#: Rows of a block of whole groups, and array elements that are worked on at once.
BLOCK_ROWS, BLOCK_CELLS = 16_384, 262_144


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers of a column's values, null being one of them."""
    return pa.chunked_array(column.chunks or [pa.array([], column.type)]).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def _starts(*codes: np.ndarray) -> np.ndarray:
    """Places at which any of the codes changes."""
    change = np.ones(len(codes[0]), bool)
    change[1:] = np.any([x[1:] != x[:-1] for x in codes], axis=0)
    return np.flatnonzero(change)


def _members(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of runs that begin at ``first`` and have ``size`` members, run by run."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _in_blocks(df: DataFrame, key: str, order: list[Column], run: Callable[[pa.Table], dict], schema: str) -> DataFrame:
    """What ``run`` makes of tables of whole keys, sorted by key and ``order``: ``BLOCK_ROWS`` rows or so, more only for one key that has more."""
    out = StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def made(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        columns = run(pa.Table.from_batches(batches))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.ChunkedArray) else columns[f.name].combine_chunks().cast(f.type) for f in arrow], schema=arrow)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= BLOCK_ROWS:
                table = pa.Table.from_batches(held).combine_chunks()
                last = int(_starts(_codes(table.column(key)))[-1])
                if last:
                    yield made(table.slice(0, last).to_batches())
                held = table.slice(last).to_batches()
                # A key that goes on is looked at again once it has doubled, so its rows are joined a few times only.
                rows = len(table) - last if last else -len(table)
        if held:
            yield made(held)

    return df.repartition(key).sortWithinPartitions(F.col(key), *order).mapInArrow(blocks, out)


def _ranked_chain(v: np.ndarray, c: np.ndarray, first: np.ndarray, more: np.ndarray, limits: np.ndarray, values: np.ndarray) -> tuple[list[int], float]:
    """The best chain over rows in order: ``first`` is a row's sum as the first of a chain, ``more`` what it adds to one.

    A row may follow those whose value is among the ``limits`` least of ``values``. A binary indexed tree over the ranks
    of values holds the best sum of each prefix and its earliest row, so a row costs the logarithm of their number.
    """
    size, rank = len(values), np.searchsorted(values, v) + 1
    tree = [(-np.inf, 0)] * (size + 1)  # (sum, minus the row): the greatest is the best sum, the earliest row of equals
    best, back = np.array(first, dtype=float), np.full(len(v), -1)
    for i, (reach, own) in enumerate(zip(limits.tolist(), rank.tolist(), strict=True)):
        found, k = (-np.inf, 0), reach
        while k > 0:
            found = max(found, tree[k])
            k &= k - 1
        if found[0] + more[i] > best[i]:
            best[i], back[i] = found[0] + more[i], -found[1]
        entry, k = (float(best[i]), -i), own
        while k <= size:
            tree[k] = max(tree[k], entry)
            k += k & -k
    chain = [int(best.argmax())]
    while back[chain[-1]] >= 0:
        chain.append(int(back[chain[-1]]))
    return chain[::-1], float(best.max())


def _best_chain(df: DataFrame, key: str, order: str, value: str, confidence: str, row_id: str, first: Callable, gain: Callable, limits: Callable, least: int) -> DataFrame:
    """The chain of rows with the highest sum: ``first(c)`` for its first row, ``gain(c)`` for each further one, which follows values among the ``limits(values, v)`` least. Ties go to the earlier row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, row_id], kind="stable")
        v, c = pdf[value].to_numpy(float), pdf[confidence].to_numpy(float)
        values = np.unique(v)
        chain, score = _ranked_chain(v, c, first(c), gain(c), limits(values, v), values)
        chain = chain if len(chain) >= least else []
        return pdf.iloc[chain][[key, row_id, order, value]].assign(score=round(score, 6))

    kinds = dict(df.dtypes)
    return df.groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {row_id} {kinds[row_id]}, {order} {kinds[order]}, {value} {kinds[value]}, score double")


def increasing_subset(df: DataFrame, key: str, order: str, value: str, confidence: str, row_id: str) -> DataFrame:
    """The heaviest strictly increasing run of ``value``: each further row scores 1 + 0.1 * its confidence, the first scores 1."""
    return _best_chain(df, key, order, value, confidence, row_id, np.ones_like, lambda c: 1 + 0.1 * c, lambda values, v: np.searchsorted(values, v, side="left"), 1)


@F.pandas_udf(ArrayType(BooleanType()))
def in_increasing_subset(values: pd.Series, confidences: pd.Series) -> pd.Series:
    """As ``increasing_subset``, of a key's values and confidences as arrays in order: whether each belongs to the run. Null values belong to none."""

    def run(v: np.ndarray, c: np.ndarray) -> np.ndarray:
        v, c = np.asarray(v, float), np.asarray(c, float)
        kept, at = np.zeros(len(v), bool), np.flatnonzero(~np.isnan(v))
        if len(at):
            values = np.unique(v[at])
            chain, _ = _ranked_chain(v[at], c[at], np.ones(len(at)), 1 + 0.1 * c[at], np.searchsorted(values, v[at], side="left"), values)
            kept[at[chain]] = True
        return kept

    return pd.Series([run(v, c) for v, c in zip(values, confidences)])


def anchor_chain(df: DataFrame, key: str, order: str, value: str, confidence: str, row_id: str, slack: float = 5.0, least: int = 3) -> DataFrame:
    """The chain of most confidence in which no value falls more than ``slack`` below the one before; shorter chains than ``least`` are dropped."""
    return _best_chain(df, key, order, value, confidence, row_id, lambda c: c, lambda c: c, lambda values, v: np.searchsorted(values - slack, v, side="right"), least)


#: Costs and limits of one matched row after another: fixed values. Pairs are (for any order, for a kept order).
COSTS = {"back": 1.2, "again": 0.55, "stall": 0.2, "jump": 0.15}
BACK_SECONDS, BACK_CAP, DRIFT_SECONDS, DRIFT_CAP = 45.0, 2.0, (120.0, 50.0), (0.8, 1.5)
PACE, PACE_CAP, MOVING, GAP_CAP, NEXT_BONUS, NONE_COST = (0.38, (2.6, 1.8)), 1.2, 0.75, 0.45, 0.08, 0.05


def edges(before: np.ndarray, after: np.ndarray, free_order: bool = True) -> np.ndarray:
    """How well each row of ``after`` follows each of ``before``: arrays (..., n, 4) and (..., m, 4) give (..., m, n).

    Rows hold narration start and end, source start and end; a row of NaN stands for no match. What counts against a
    pair: going back in the source, showing the same source twice, drifting from the narration's clock, and, where the
    narration moves on, a pace out of range and gaps of different lengths. Source that goes on behind the last one
    counts for it.
    """
    n_from, n_to, s_from, s_to = (before[..., None, :, k] for k in range(4))
    told, told_end, shown, shown_end = (after[..., :, None, k] for k in range(4))
    way = 0 if free_order else 1
    over = lambda x: np.maximum(x, 0)
    with np.errstate(invalid="ignore"):
        step, source_step = told - n_from, shown - s_from
        twice = over(np.minimum(s_to, shown_end) - np.maximum(s_from, shown))
        pace = source_step / np.maximum(step, 0.25)
        slow, fast = PACE[0], PACE[1][way]
        gaps = np.abs(over(shown - s_to) - over(told - n_to))
        against = [
            COSTS["back"] * (source_step < 0) * (1 + np.minimum(-source_step / BACK_SECONDS, BACK_CAP)),
            COSTS["again"] * (twice > 0) * (1 + twice / np.maximum(shown_end - shown, 1)),
            np.minimum(np.abs(source_step - step) / DRIFT_SECONDS[way], DRIFT_CAP[way]),
            (step > MOVING) * COSTS["stall"] * np.minimum(PACE_CAP * over(1 - pace / slow), PACE_CAP),
            (step > MOVING) * COSTS["jump"] * np.minimum(PACE_CAP * over(pace / fast - 1), PACE_CAP),
            (step > MOVING) * np.minimum(gaps / np.maximum(1.8 * step, 8), GAP_CAP),
        ]
        score = NEXT_BONUS * (shown >= s_to) - sum(against)
    return np.where(np.isnan(shown), -NONE_COST, np.where(np.isnan(s_from), 0.0, score))


def viterbi(df: DataFrame, key: str, segment: str, free_order: bool = True) -> DataFrame:
    """The best choice of a candidate, or none, for each segment of a key.

    Rows: key, segment (its order), cand (its order in the segment; null for none), n_start, n_end, s_start, s_end, node (score).
    Ties go to the earlier candidate; the choice of none comes last. All edges of some keys of a block are one array,
    padded to their largest numbers of segments and candidates; the running maximum goes segment by segment, over all
    keys that have one.
    """

    def run(rows: pa.Table) -> dict:
        keys, segments = _codes(rows.column(key)), _codes(rows.column(segment))
        numbers = np.stack([rows.column(x).to_numpy() for x in ("node", "n_start", "n_end", "s_start", "s_end")], axis=1).astype(float)
        first, step_first = _starts(keys), _starts(keys, segments)
        step_size = np.diff(step_first, append=len(keys))
        # Of each key: its rows, its first step of all steps, its number of steps, its most candidates.
        size, begins = np.diff(first, append=len(keys)), np.searchsorted(step_first, first)
        steps, widths = np.diff(begins, append=len(step_first)), np.maximum.reduceat(step_size, begins)
        place = np.arange(len(keys)) - np.repeat(step_first, step_size)
        step = np.repeat(np.arange(len(step_first)), step_size) - np.repeat(begins, size)
        order, picked, totals = np.argsort(-steps, kind="stable"), [], []
        at = 0
        while at < len(order):
            until, wide = at, 0
            while until < len(order) and (until == at or (until + 1 - at) * steps[order[at]] * max(wide, widths[order[until]]) ** 2 <= BLOCK_CELLS):
                wide = max(wide, int(widths[order[until]]))
                until += 1
            some, at = order[at:until], until
            own = _members(first[some], size[some])
            chosen, best = _best_path(np.repeat(np.arange(len(some)), size[some]), step[own], place[own], numbers[own], steps[some], wide, free_order)
            picked.append(own[chosen])
            totals.append(np.repeat([round(x, 6) for x in best.tolist()], steps[some]))
        picked = np.concatenate(picked)
        kept = rows.take(pa.array(picked))
        return {key: kept.column(key), segment: kept.column(segment), "cand": kept.column("cand"), "total": np.concatenate(totals)}

    kinds = dict(df.dtypes)
    order = [F.col(segment), F.col("cand").asc_nulls_last()]
    return _in_blocks(df, key, order, run, f"{key} {kinds[key]}, {segment} {kinds[segment]}, cand bigint, total double")


def _best_path(key: np.ndarray, step: np.ndarray, place: np.ndarray, numbers: np.ndarray, lengths: np.ndarray, width: int, free_order: bool) -> tuple[np.ndarray, np.ndarray]:
    """The rows on each key's best path, key by key, and the paths' scores. Keys are numbered by falling ``lengths``; ``numbers``: node, n_start, n_end, s_start, s_end."""
    n, steps = len(lengths), int(lengths[0])
    node, where = np.full((n, steps, width), -np.inf), np.full((n, steps, width, 4), np.nan)
    node[key, step, place], where[key, step, place] = numbers[:, 0], numbers[:, 1:]
    where[np.isnan(where[..., 2])] = np.nan
    follow, score, back = edges(where[:, :-1], where[:, 1:], free_order), node[:, 0].copy(), np.zeros((n, steps, width), int)
    live = [int((lengths > t).sum()) for t in range(steps)]
    for t in range(1, steps):
        m = live[t]
        total = score[:m, None, :] + follow[:m, t - 1]
        back[:m, t] = total.argmax(axis=2)
        score[:m] = np.take_along_axis(total, back[:m, t][:, :, None], axis=2)[:, :, 0] + node[:m, t]
    chosen = np.zeros((n, steps), int)
    chosen[np.arange(n), lengths - 1] = score.argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        m = live[t]
        chosen[:m, t - 1] = back[np.arange(m), t, chosen[:m, t]]
    return np.flatnonzero(place == chosen[key, step]), score.max(axis=1)


def _diagonals(n: int, m: int):
    """Cells (i, j) of each anti-diagonal of a table, from 1 on both sides."""
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        yield i, d - i


def local_alignment(queries: DataFrame, rows: DataFrame, key: str, place: str, value: str, close: int = 5, near: int = 10, scores: tuple = (5.0, 2.0, -3.0), gaps: tuple = (-10.0, -0.5)) -> DataFrame:
    """Local alignment of two sequences of 60-bit hashes for each key: best score, length, extents and confidence.

    Pairs within ``close`` bits match, within ``near`` are similar; a gap opens at ``gaps[0]`` and grows by ``gaps[1]``.
    A gap on either side may follow the other. Keys of one side alone give no row.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = [key, "score", "pairs", "q_from", "q_to", "r_from", "r_to", "confidence"]
        if left.empty or right.empty:
            return pd.DataFrame(columns=columns)
        left, right = left.sort_values("q_place", kind="stable"), right.sort_values("r_place", kind="stable")
        distance = np.bitwise_count(left["q_value"].to_numpy(np.int64)[:, None] ^ right["r_value"].to_numpy(np.int64)[None, :]).astype(int)
        sub = np.select([distance <= close, distance <= near], scores[:2], scores[2])
        n, m = sub.shape
        # Best scores of what ends in a pair, in a gap of the query, in a gap of the rows.
        best, across, down = np.zeros((n + 1, m + 1)), np.full((n + 1, m + 1), -np.inf), np.full((n + 1, m + 1), -np.inf)
        came = np.zeros((n + 1, m + 1), np.int8)
        for i, j in _diagonals(n, m):
            across[i, j] = np.maximum(best[i, j - 1] + gaps[0], across[i, j - 1] + gaps[1])
            down[i, j] = np.maximum(best[i - 1, j] + gaps[0], down[i - 1, j] + gaps[1])
            ways = np.stack([np.zeros(len(i)), best[i - 1, j - 1] + sub[i - 1, j - 1], across[i, j], down[i, j]])
            best[i, j] = ways.max(axis=0)
            came[i, j] = ways.argmax(axis=0)
        i, j = (int(k) for k in np.unravel_index(int(best.argmax()), best.shape))
        top, pairs = float(best[i, j]), []
        while came[i, j]:
            move = came[i, j]
            if move == 1:
                pairs.append((i - 1, j - 1))
            i, j = i - (move != 2), j - (move != 3)
        if not pairs:
            return pd.DataFrame(columns=columns)
        mean = np.mean([distance[p] for p in pairs])
        confidence = np.clip(0.3 * len(pairs) / n + 0.4 * max(0.0, 1 - mean / 20) + 0.3 * top / (5 * n), 0, 1)
        q, r = left["q_place"].to_numpy(), right["r_place"].to_numpy()
        return pd.DataFrame([[left["q_key"].iloc[0], top, len(pairs), q[pairs[-1][0]], q[pairs[0][0]], r[pairs[-1][1]], r[pairs[0][1]], round(float(confidence), 6)]], columns=columns)

    kind, at = dict(queries.dtypes)[key], dict(queries.dtypes)[place]
    # Names of their own on either side: both may come from one table.
    left = queries.select(F.col(key).alias("q_key"), F.col(place).alias("q_place"), F.col(value).alias("q_value"))
    right = rows.select(F.col(key).alias("r_key"), F.col(place).alias("r_place"), F.col(value).alias("r_value"))
    return left.groupBy("q_key").cogroup(right.groupBy("r_key")).applyInPandas(run, f"{key} {kind}, score double, pairs bigint, q_from {at}, q_to {at}, r_from {at}, r_to {at}, confidence double")


def warp_speed(df: DataFrame, key: str, query: str, source: str, window: int = 10) -> DataFrame:
    """Speed of source against query time by dynamic time warping of the two series: median local slope, clipped to [0.8, 1.2], confidence, and whether it changed."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, s = np.sort(pdf[query].dropna().to_numpy(float)), np.sort(pdf[source].dropna().to_numpy(float))
        if len(q) < 2 or len(s) < 2:
            return pd.DataFrame({key: [pdf[key].iloc[0]], "speed": [1.0], "confidence": [0.0], "changed": [False]})
        x, y = (q - q[0]) / max(q[-1] - q[0], 1e-9), (s - s[0]) / max(s[-1] - s[0], 1e-9)
        cost, n, m = np.abs(x[:, None] - y[None, :]), len(x), len(y)
        band = max(window, abs(n - m))
        d = np.full((n, m), np.inf)
        d[:, 0], d[0, :] = np.cumsum(cost[:, 0]), np.cumsum(cost[0, :])
        for i, j in _diagonals(n - 1, m - 1):
            i, j = i[(j >= i - band) & (j < i + band)], j[(j >= i - band) & (j < i + band)]
            d[i, j] = cost[i, j] + np.minimum(np.minimum(d[i - 1, j], d[i, j - 1]), d[i - 1, j - 1])
        i, j, first = n - 1, m - 1, {}
        while i > 0 or j > 0:
            first[i] = j  # walking back, so the least stays
            moves = [(d[i - 1, j - 1], i - 1, j - 1)] if i and j else []
            moves += [(d[i - 1, j], i - 1, j)] if i else []
            moves += [(d[i, j - 1], i, j - 1)] if j else []
            _, i, j = min(moves, key=lambda z: z[0])
        at = sorted(first)
        dq, ds = np.diff(q[at]), np.diff(s[[first[i] for i in at]])
        local = (ds / np.maximum(dq, 1e-9))[dq > 0]
        speed = float(np.clip(np.median(local), 0.8, 1.2)) if len(local) else 1.0
        confidence = float(np.exp(-np.std(np.clip(local, 0, 10)))) if len(local) else 0.0
        return pd.DataFrame({key: [pdf[key].iloc[0]], "speed": [round(speed, 6)], "confidence": [round(confidence, 6)], "changed": [abs(speed - 1) > 0.05]})

    return df.groupBy(key).applyInPandas(run, f"{key} {dict(df.dtypes)[key]}, speed double, confidence double, changed boolean")


#: Limits of a line through anchors: fixed values. Tolerance is a share of the group's duration between two bounds.
LINE_APART, LINE_SPEEDS, LINE_TOLERANCE, SPEED_COST, LINE_LEAST = 0.65, (0.55, 1.85), (0.16, 0.45, 1.8), 0.30, {1: 0.75, 2: 0.75, 3: 1.4}


def fit_line(df: DataFrame, key: str, x: str, y: str, weight: str, row_id: str, duration: str, source_end: str) -> DataFrame:
    """The line y = speed * x + intercept with the best weighted inliers among all of a group's anchors.

    Lines through one anchor have speed one; those through two have any speed in ``LINE_SPEEDS``, if the anchors are
    ``LINE_APART`` or more apart. Each is scored against all anchors: an anchor within the tolerance counts its
    weight, less its share of the tolerance; of equal lines, the one through the heavier anchors is taken. The intercept
    then is the weighted median over the inliers, moved so that the group's ``duration`` fits the source, which ends at
    ``source_end`` (0: unknown). A fit of one anchor may have one inlier, others need two; all need the least score.
    Rows without a finite x, y, weight and duration are no anchors.

    All lines of all groups with as many anchors are one array; of groups beyond ``BLOCK_CELLS`` pairs of line and anchor,
    sums along each anchor's lines leave the few that can be best.
    """

    def run(rows: pa.Table) -> dict:
        first = _starts(_codes(rows.column(key)))
        size = np.diff(first, append=rows.num_rows)
        numbers = [rows.column(k).to_numpy().astype(float) for k in (x, y, weight, duration, source_end)]
        found, lines = [], []
        for n in np.unique(size):
            same = first[size == n]
            most = max(1, BLOCK_CELLS // int(n) ** 3)
            for at in range(0, len(same), most):
                some = same[at : at + most]
                a, b, w, length, end = (v[some[:, None] + np.arange(n)] for v in numbers)
                fits, line = _fitted(a, b, w, length[:, 0], end[:, 0])
                found.append(some[fits])
                lines.append(line)
        speed, intercept, inliers, score = np.concatenate(lines, axis=1)
        exact = lambda v: [round(k, 6) for k in v.tolist()]
        return {key: rows.column(key).take(pa.array(np.concatenate(found))), "speed": exact(speed), "intercept": exact(intercept), "inliers": inliers.astype(int), "score": exact(score)}

    finite = lambda k: F.abs(F.col(k).cast("double")) < float("inf")
    anchors = df.where(finite(x) & finite(y) & finite(weight) & finite(duration)).select(*dict.fromkeys([key, row_id, x, y, weight, duration, source_end]))
    return _in_blocks(anchors, key, [F.col(weight).desc(), F.col(row_id)], run, f"{key} {dict(df.dtypes)[key]}, speed double, intercept double, inliers bigint, score double")


def _line_scores(a: np.ndarray, b: np.ndarray, w: np.ndarray, tolerance: np.ndarray, speed: np.ndarray, through: np.ndarray) -> np.ndarray:
    """Scores of each group's lines (groups, lines) against its anchors (groups, n); ``tolerance``: (groups, 1, 1)."""
    off = np.abs(through[:, :, None] + speed[:, :, None] * a[:, None, :] - b[:, None, :])
    return ((off <= tolerance) * w[:, None, :] * (1 - off / tolerance)).sum(axis=2) - SPEED_COST * np.abs(speed - 1)


def _slopes(a: np.ndarray, b: np.ndarray, i: np.ndarray | int, j: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
    """Speeds through the anchors ``i`` and ``j``, one where they give no line, and whether they give one."""
    with np.errstate(invalid="ignore", divide="ignore"):
        slope = (b[..., j] - b[..., i]) / (a[..., j] - a[..., i])
        ok = (np.abs(a[..., j] - a[..., i]) >= LINE_APART) & (slope >= LINE_SPEEDS[0]) & (slope <= LINE_SPEEDS[1])
    return np.where(ok, slope, 1.0), ok


def _best_lines(a: np.ndarray, b: np.ndarray, w: np.ndarray, tolerance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Speed, intercept and score of each group's first best line: those through one anchor first, then those through two."""
    groups, n = a.shape
    i, j = np.triu_indices(n, 1)
    slope, ok = _slopes(a, b, i, j)
    speed = np.concatenate([np.ones((groups, n)), slope], axis=1)
    through = np.concatenate([b - a, b[:, i] - slope * a[:, i]], axis=1)
    score = np.where(np.concatenate([np.ones((groups, n), bool), ok], axis=1), _line_scores(a, b, w, tolerance, speed, through), -np.inf)
    own, best = np.arange(groups), np.argmax(np.round(score, 12), axis=1)
    return speed[own, best], through[own, best], score[own, best]


def _tents(rise: np.ndarray, run: np.ndarray, w: np.ndarray, tolerance: float, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of w * max(0, 1 - abs(run * t - rise) / tolerance) at each t of ``at``, and how far off it can be by rounding.

    Each term rises from one bend to the next and falls to the third, so running sums over all bends in order give the sum anywhere.
    """
    level = run == 0
    still = (w[level] * np.maximum(0, 1 - np.abs(rise[level]) / tolerance)).sum()
    rise, run, w = rise[~level] * np.sign(run[~level]), np.abs(run[~level]), w[~level] / tolerance
    with np.errstate(over="ignore"):
        bends = np.concatenate([(rise - tolerance) / run, rise / run, (rise + tolerance) / run])
    order = np.argsort(bends, kind="stable")
    slope = np.cumsum(np.concatenate([[0.0], np.concatenate([w * run, -2 * w * run, w * run])[order]]))
    base = np.cumsum(np.concatenate([[0.0], np.concatenate([w * (rise - tolerance), -2 * w * rise, w * (rise + tolerance)])[order]]))
    k = np.searchsorted(bends[order], at, side="right")
    terms = 4 * (np.abs(w) * (np.abs(rise) + tolerance)).sum() + 4 * (np.abs(w) * run).sum() * np.abs(at) + abs(still)
    return slope[k] * at - base[k] + still, (3 * len(w) + 8) * np.finfo(float).eps * terms


def _best_line_of_many(a: np.ndarray, b: np.ndarray, w: np.ndarray, tolerance: float) -> tuple[float, float, float]:
    """As ``_best_lines``, of one group with many anchors: all its lines in the square of their number, no more than a few rows of them at once.

    Lines that can be best, for all that rounding does to the running sums, are scored one by one; of an anchor's lines
    that agree to twelve digits of speed only the first is.
    """
    n, drift, least, kept = len(a), b - a, -np.inf, []
    for i in range(-1, n - 1):
        if i < 0:
            # Lines of speed one, by intercept.
            speed, through, known = np.ones(n), drift, np.arange(n)
            score, off = _tents(drift, np.ones(n), w, tolerance, drift)
        else:
            slope, ok = _slopes(a, b, i, slice(i + 1, None))
            _, known = np.unique(np.where(ok, np.round(slope, 12), np.nan), return_index=True)
            known = np.sort(known[ok[known]])
            speed, through = slope[known], b[i] - slope[known] * a[i]
            score, off = _tents(drift - drift[i], a - a[i], w, tolerance, speed - 1)
            score = score - SPEED_COST * np.abs(speed - 1)
        least = max(least, (score - off).max(initial=-np.inf))
        near = score + off >= least - 1e-9
        kept.append(np.stack([speed[near], through[near], (score + off)[near]]))
    speed, through, most = np.concatenate(kept, axis=1)
    speed, through = speed[most >= least - 1e-9], through[most >= least - 1e-9]
    some = max(1, BLOCK_CELLS // n)
    one = (a[None], b[None], w[None], np.full((1, 1, 1), tolerance))
    score = np.concatenate([_line_scores(*one, speed[None, k : k + some], through[None, k : k + some])[0] for k in range(0, len(speed), some)])
    best = int(np.argmax(np.round(score, 12)))
    return speed[best], through[best], score[best]


def _fitted(a: np.ndarray, b: np.ndarray, w: np.ndarray, length: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which groups (rows, of as many anchors each) have a line, and its speed, intercept, inliers and score."""
    n = a.shape[1]
    tolerance = np.clip(LINE_TOLERANCE[0] * length, *LINE_TOLERANCE[1:])[:, None, None]
    if n**3 <= BLOCK_CELLS:
        speed, through, score = _best_lines(a, b, w, tolerance)
    else:
        speed, through, score = np.array([_best_line_of_many(*some) for some in zip(a, b, w, tolerance[:, 0, 0], strict=True)]).T
    inliers = np.abs(through[:, None] + speed[:, None] * a - b) <= tolerance[:, :, 0]
    fits = ~((inliers.sum(axis=1) < min(n, 2)) | (score < LINE_LEAST[min(n, 3)]))
    inliers, speed, score = inliers[fits], speed[fits], score[fits]
    offsets = np.where(inliers, b[fits] - speed[:, None] * a[fits], np.inf)
    order = np.argsort(offsets, axis=1, kind="stable")
    reach = np.cumsum(np.take_along_axis(np.where(inliers, w[fits], 0.0), order, axis=1), axis=1)
    middle = np.minimum((reach < reach[:, -1:] / 2).sum(axis=1), n - 1)
    intercept = np.take_along_axis(offsets, np.take_along_axis(order, middle[:, None], axis=1), axis=1)[:, 0]
    held = np.maximum(0.0, np.minimum(intercept, end[fits] - speed * length[fits]))
    return fits, np.stack([speed, np.where(end[fits] > 0, held, intercept), inliers.sum(axis=1), score])
