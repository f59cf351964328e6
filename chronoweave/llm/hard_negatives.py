"""Hard negatives of anchors by segment summaries: means and deviations bound inner products before exact scores are made."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm.common import bounded_batches, materialize

#: Segments of a vector at each level of the hierarchy; a level's segments halve those of the one before it or cut them finer.
LEVELS = (1, 4, 16)
#: Share of pairs beyond which a level looks at all pairs of a tile at once instead of the surviving pairs one by one.
DENSE = 0.05
#: Anchors of one block (two passes over the rows each) in bytes of their vectors; rows and anchors of one tile.
ANCHOR_BYTES, TILE, ANCHOR_TILE = 16 << 20, 2048, 512


def prepared(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label", scale: int = 256) -> DataFrame:
    """(vec_id, label, vector): components become floor(scale * x); rows with a null id, label or vector, or a null or non-finite component, go."""
    x = F.col(vector_col)
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    kept = rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & good)
    vector = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    out = kept.select(F.col(id_col).cast("long").alias("vec_id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), vector.alias("vector"))
    return out.where("label is not null")


class Summaries:
    """Vectors of one length with, at each level, the segments' means (times the root of their length) and deviations from them.

    For two vectors x and y, the inner product of a segment is length * mean(x) * mean(y) plus the inner product of what
    is left of both, which is at most deviation(x) * deviation(y) and at least its negative.
    """

    def __init__(self, vectors: np.ndarray):
        self.exact = vectors
        self.real = vectors.astype(np.float64)
        self.means, self.deviations = [], []
        for n in (n for n in LEVELS if n < max(2, vectors.shape[1])):
            edges = np.linspace(0, vectors.shape[1], min(n, vectors.shape[1]) + 1).astype(int)
            lengths = np.diff(edges)
            sums = np.add.reduceat(self.real, edges[:-1], axis=1)
            left = np.square(self.real - np.repeat(sums / lengths, lengths, axis=1))
            self.means.append(sums / np.sqrt(lengths))
            self.deviations.append(np.sqrt(np.add.reduceat(left, edges[:-1], axis=1)))
        self.norms = np.sqrt(np.square(self.real).sum(axis=1))
        #: Whether sums of products with another such block are whole numbers in doubles.
        self.largest = float(np.abs(self.real).max(initial=0.0))

    def scores(self, other: Summaries, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Exact inner products of the pairs (at, to)."""
        return np.einsum("ij,ij->i", self.exact[at], other.exact[to])

    def all_scores(self, other: Summaries) -> np.ndarray | None:
        """Exact inner products of all pairs, where doubles hold them."""
        if self.largest * other.largest * self.exact.shape[1] < 2**52:
            return (self.real @ other.real.T).astype(np.int64)
        return None


def surviving(anchors: Summaries, rows: Summaries, open_pairs: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, exact score) of those ``open_pairs`` (a mask, anchors by rows) that the bounds don't rule out.

    ``least`` and ``most``: the scores that an anchor still has use for. Level by level the segments get finer; a pair
    whose upper bound is below the least or whose lower bound is above the most is not looked at again.
    """
    slack = 1 + 1e-9 * anchors.norms[:, None] * rows.norms[None, :].max(initial=0)  # rounding of the bounds
    least, most = least[:, None] - slack, most[:, None] + slack
    at = to = None
    for level in range(len(anchors.means)):
        if at is None:
            centre = anchors.means[level] @ rows.means[level].T
            reach = anchors.deviations[level] @ rows.deviations[level].T
            open_pairs = open_pairs & (centre + reach >= least) & (centre - reach <= most)
            if np.count_nonzero(open_pairs) < DENSE * open_pairs.size:
                at, to = np.nonzero(open_pairs)
        else:
            centre = np.einsum("ij,ij->i", anchors.means[level][at], rows.means[level][to])
            reach = np.einsum("ij,ij->i", anchors.deviations[level][at], rows.deviations[level][to])
            keep = (centre + reach >= least[at, 0]) & (centre - reach <= most[at, 0])
            at, to = at[keep], to[keep]
    if at is None:
        scores = anchors.all_scores(rows)
        at, to = np.nonzero(open_pairs if scores is None else open_pairs & (scores >= least) & (scores <= most))
        return at, to, anchors.scores(rows, at, to) if scores is None else scores[at, to]
    return at, to, anchors.scores(rows, at, to)


def _tiles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors) in tiles of at most ``TILE`` rows; shorter vectors end in zeros, longer ones are cut where the anchors end."""
    held: list[pa.RecordBatch] = []

    def tile() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        lists = table.column(2).combine_chunks()
        sizes, values = lists.value_lengths().to_numpy(), lists.values.slice(lists.offsets[0].as_py(), lists.offsets[-1].as_py() - lists.offsets[0].as_py()).to_numpy()
        vectors = np.zeros((len(sizes), width), np.int64)
        place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        row = np.repeat(np.arange(len(sizes)), sizes)
        inside = place < width
        vectors[row[inside], place[inside]] = values[inside]
        return table.column(0).to_numpy(), table.column(1).to_numpy(), vectors

    for batch in batches:
        for start in range(0, batch.num_rows, TILE):
            held.append(batch.slice(start, TILE))
            if sum(b.num_rows for b in held) >= TILE:
                yield tile()
                held = []
    if held:
        yield tile()


class _Kept:
    """The ``n`` best (key, score, id) of each key so far: by falling score, then rising id."""

    def __init__(self, n: int):
        self.n = n
        self.key = self.score = self.ids = np.empty(0, np.int64)

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys that now have all ``n``, and the least score of each."""
        if len(key):
            key, score, ids = (np.concatenate(x) for x in ((self.key, key), (self.score, score), (self.ids, ids)))
            order = np.lexsort((ids, -score, key))
            starts = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
            rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
            order = order[rank < self.n]
            self.key, self.score, self.ids = key[order], score[order], ids[order]
        last = np.arange(self.n - 1, len(self.key))
        last = last[self.key[last] == self.key[last - self.n + 1]]
        return self.key[last], self.score[last]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.key), pa.array(self.score), pa.array(self.ids)], ["key", "score", "vec_id"])


FOUND = "key bigint, score bigint, vec_id bigint"


def _anchor_tiles(vectors: np.ndarray) -> list[tuple[slice, Summaries]]:
    cuts = [slice(i, min(i + ANCHOR_TILE, len(vectors))) for i in range(0, len(vectors), ANCHOR_TILE)]
    return [(c, Summaries(vectors[c])) for c in cuts]


def _positives(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, n: int):
    """The ``n`` best rows of each anchor's label in one partition; keys are places of anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, kept = _anchor_tiles(vectors), _Kept(n)
        least, most = np.full(len(ids), -np.inf), np.full(len(ids), np.inf)
        for row_ids, row_labels, row_vectors in _tiles(batches, vectors.shape[1]):
            rows = Summaries(row_vectors)
            for cut, anchors in tiles:
                mask = (labels[cut, None] == row_labels[None, :]) & (ids[cut, None] != row_ids[None, :])
                at, to, scores = surviving(anchors, rows, mask, least[cut], most[cut])
                full, lowest = kept.add(at + cut.start, scores, row_ids[to])
                least[full] = lowest
        yield kept.batch()

    return run


def _negatives(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, windows: np.ndarray, n: int):
    """The ``n`` best rows of other labels within each window (anchor, least, most) in one partition; keys are places of windows, which come by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, kept = _anchor_tiles(vectors), _Kept(n)
        anchor, floor, ceiling = windows[:, 0], windows[:, 1].copy(), windows[:, 2]
        first = np.searchsorted(anchor, np.arange(len(ids) + 1))
        most = np.full(len(ids), -np.inf)
        np.maximum.at(most, anchor, ceiling)
        for row_ids, row_labels, row_vectors in _tiles(batches, vectors.shape[1]):
            rows = Summaries(row_vectors)
            least = np.full(len(ids), np.inf)  # where an anchor has no window, nothing is between least and most
            np.minimum.at(least, anchor, floor)
            for cut, anchors in tiles:
                at, to, scores = surviving(anchors, rows, labels[cut, None] != row_labels[None, :], least[cut], most[cut])
                at = at + cut.start
                for k in range(int(np.diff(first[cut.start : cut.stop + 1]).max(initial=0))):
                    window = np.minimum(first[at] + k, len(anchor) - 1)
                    fits = (first[at] + k < first[at + 1]) & (scores >= floor[window]) & (scores <= ceiling[window])
                    full, lowest = kept.add(window[fits], scores[fits], row_ids[to[fits]])
                    floor[full] = lowest
        yield kept.batch()

    return run


def _anchor_blocks(anchors: DataFrame, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors) of the anchors in blocks of at most ``size`` bytes of vectors: all that is broadcast at a time."""
    held: list = []
    width = 1

    def block() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vectors = np.zeros((len(held), width), np.int64)
        for i, r in enumerate(held):
            vectors[i, : len(r["vector"])] = r["vector"]
        return np.array([r["vec_id"] for r in held]), np.array([r["label"] for r in held]), vectors

    for row in anchors.toLocalIterator():
        wider = max(width, len(row["vector"]))
        if held and 8 * wider * (len(held) + 1) > size:
            yield block()
            held, wider = [], max(1, len(row["vector"]))
        width = wider
        held.append(row)
    if held:
        yield block()


def hard_negatives(rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, block_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the ``prepared`` rows that ``is_anchor`` marks.

    Scores are inner products of whole numbers; higher ones come first, equal ones by id. An anchor's positives are its
    first ``n_positives`` other rows of the same label; for each, the first ``n_negatives`` rows of other labels with a
    score of ``low`` to ``high`` per cent of the positive's, counted by ``rank``. Fewer where there are fewer: a positive
    of negative score has none.

    All rows are searched. Each task keeps, for each anchor, the best of its own rows, and rules pairs out by the bounds
    of segment summaries, coarse ones first, once it has found enough; what is left is scored exactly. Anchors are
    broadcast in blocks of ``block_bytes``; each block is two passes over the rows, one for positives, one for negatives.

    Rows that share an anchor's id are not its positives; repeated rows count as rows, so a repeated anchor's rows come
    once for its id. Of vectors of different lengths the shorter counts as ending in zeros. Products must fit 64 bits.
    No anchors, or an empty table, give no rows.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TILE))
    empty = out = spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")

    def best(run, n: int) -> DataFrame:
        by_key = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
        return rows.mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(by_key)).where(F.col("rank") <= n)

    for ids, labels, vectors in _anchor_blocks(rows.where(is_anchor).dropDuplicates(["vec_id", "label", "vector"]), block_bytes):
        found = sorted((r["key"], r["rank"], r["vec_id"], r["score"]) for r in best(_positives(ids, labels, vectors, n_positives), n_positives).collect())
        if not found:
            continue
        windows = np.array([(anchor, -(-low * score // 100), high * score // 100) for anchor, _, _, score in found])
        names = spark.createDataFrame([(i, int(ids[anchor]), positive, score) for i, (anchor, _, positive, score) in enumerate(found)], "key bigint, anchor_id bigint, positive_id bigint, positive_score bigint")
        got = best(_negatives(ids, labels, vectors, windows, n_negatives), n_negatives).join(F.broadcast(names), "key")
        part = got.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = materialize(part, "negatives") if out is empty else out.unionByName(materialize(part, "negatives"))
    return out
