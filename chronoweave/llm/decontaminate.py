"""Benchmark decontamination by size-partitioned MinHash containment search."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from chronoweave.llm.common import hash_words, shingle_hashes, small_batches

#: Hash functions of a signature, and items in one broadcast block.
WIDTH, BLOCK = 64, 20_000

_RNG = np.random.Generator(np.random.PCG64(20240505))
_MULTIPLY = (_RNG.integers(0, 2**32, WIDTH, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _RNG.integers(0, 2**32, WIDTH, dtype=np.uint64).astype(np.uint32)


def _values(shingles: np.ndarray) -> np.ndarray:
    """The hash of each shingle (columns) under each function (rows)."""
    return (shingles >> np.uint64(32)).astype(np.uint32)[None, :] * _MULTIPLY[:, None] + _ADD[:, None]


@dataclass
class SizeClass:
    """Items of between ``size / 2`` and ``size`` shingles: (hash function, least hash) of each as one sorted number, and whose it is."""

    size: int
    keys: np.ndarray
    owner: np.ndarray


_FUNCTION = np.arange(WIDTH, dtype=np.uint64)[:, None] << np.uint64(32)


class Items:
    """A block of test items, of bounded number, as signatures by size class and as full shingle sets."""

    def __init__(self, ids: list[int], texts: list[bytes | None]):
        words = [hash_words(t) for t in texts]
        keep = [i for i, w in enumerate(words) if len(w)]
        self.ids = [ids[i] for i in keep]
        self.short = [len(words[i]) < 5 for i in keep]
        self.sets = [np.unique(shingle_hashes(words[i])) for i in keep]
        by_class: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            by_class.setdefault(1 << int(len(s) - 1).bit_length(), []).append(i)
        self.classes, wanted = [], []
        for size, own in sorted(by_class.items()):
            keys = np.stack([_values(self.sets[i]).min(axis=1) for i in own], axis=1) | _FUNCTION
            wanted += [self.sets[i][_values(self.sets[i]).argmin(axis=1)] for i in own]
            order = np.argsort(keys, axis=None, kind="stable")
            self.classes.append(SizeClass(size, keys.ravel()[order], np.tile(np.array(own), WIDTH)[order]))
        # Shingles that are least in some item: a window without any of them has no signature value in common with an item.
        self.least_shingles = np.unique(np.concatenate(wanted)) if wanted else np.empty(0, np.uint64)
        bits = max(16, int(len(self.least_shingles) * 16).bit_length())
        self.shift = np.uint64(64 - bits)
        self.filter = np.zeros(1 << bits, dtype=bool)
        self.filter[(self.least_shingles >> self.shift).astype(np.int64)] = True

    def candidates(self, shingles: np.ndarray) -> np.ndarray:
        """Items one of whose least hashes is also least in a window of the document, in their size class.

        Windows of 2 * size shingles start at each multiple of size, so any run of ``size`` shingles lies in one.
        """
        if not len(self.least_shingles):
            return np.empty(0, np.int64)
        place = np.flatnonzero(self.filter[(shingles >> self.shift).astype(np.int64)])
        at = np.searchsorted(self.least_shingles, shingles[place])
        place = place[self.least_shingles[np.minimum(at, len(self.least_shingles) - 1)] == shingles[place]]
        found = []
        for c in self.classes if len(place) else ():
            starts = np.unique(np.concatenate([place // c.size, place // c.size - 1]))
            starts = starts[(starts >= 0) & ((starts == 0) | (starts * c.size < len(shingles)))]
            for i in range(0, len(starts), 256):
                windows = np.stack([_values(shingles[s * c.size : (s + 2) * c.size]).min(axis=1) for s in starts[i : i + 256]], axis=1) | _FUNCTION
                lo, hi = np.searchsorted(c.keys, windows.ravel(), "left"), np.searchsorted(c.keys, windows.ravel(), "right")
                for x, y in {(int(lo[j]), int(hi[j])) for j in np.flatnonzero(hi > lo)}:
                    found.append(c.owner[x:y])
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)

    def contained(self, text: bytes | None, percent: int) -> list[tuple[int, int, int]]:
        """(item id, its shingles, how many of them the text holds) for each item of which the text holds enough: candidates, verified on full sets."""
        words = hash_words(text)
        shingles = shingle_hashes(words)
        near = self.candidates(shingles) if len(shingles) else ()
        if not len(near):
            return []
        full, out = np.unique(shingles), []
        for i in near:
            both = len(np.intersect1d(full, self.sets[i], assume_unique=True))
            if 100 * both >= percent * len(self.sets[i]) and not (self.short[i] and len(words) >= 5):
                out.append((self.ids[i], len(self.sets[i]), both))
        return out


def _search(items: Items, percent: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(at, *hit) for at, text in enumerate(batch.column(1).to_pylist()) for hit in items.contained(text, percent)]
            if rows:
                at, *rest = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(rest, (id_type, pa.int64(), pa.int64()), strict=True))], ["doc_id", "item_id", "item_shingles", "shared_shingles"])

    return run


def _without(items: Items, percent: int, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [not items.contained(t.encode() if isinstance(t, str) else t, percent) for t in batch.column(text_at).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block: int) -> Iterator[Items]:
    """The items in blocks of at most ``block`` rows, so that whatever is broadcast has a bound; each block is a pass over the documents."""
    rows = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("binary").alias("text")).where("item_id is not null").distinct()
    buffer: list = []
    for row in rows.toLocalIterator():
        buffer.append(row)
        if len(buffer) == block:
            yield Items([r["item_id"] for r in buffer], [r["text"] for r in buffer])
            buffer = []
    if buffer:
        yield Items([r["item_id"] for r in buffer], [r["text"] for r in buffer])


def contamination(docs: DataFrame, benchmark: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared_shingles) for each document that holds ``percent`` of an item's five-word shingles.

    Words are A-Z lower-cased runs without white space. Items are partitioned by size into classes of powers of two.
    For each class a document is seen as overlapping windows of twice the class size, so that a short item inside a long
    document meets a set of its own size. Window and item share a MinHash value with a chance of at least 0.19 for each
    of 64 hash functions if the document holds the item in one place, so all but 1e-6 of the pairs become candidates.
    Each candidate is verified on the full shingle sets of the document and the item. Signatures of the windows are made
    only where a window holds a shingle that is least in some item, without which no value could be shared.

    Documents are read in place: nothing but the found pairs leaves a task, and no join or shuffle is needed.

    An item of fewer than five words is its whole sequence as one shingle and is found only in documents that are that
    sequence. Null or blank texts, in either table, and items without an id are in no pair. Null document ids pass
    through. Item ids may be of any type. An item whose shingles are spread over a long document, in no window enough of
    them, may be missed. A repeated document row repeats its pairs; a repeated item counts once. Other columns, whatever their names,
    are not read. Empty tables give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = benchmark.schema[item_id_col].dataType
    schema = f"doc_id {kind}, item_id {item_kind.simpleString()}, item_shingles bigint, shared_shingles bigint"
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    out = None
    for items in item_blocks(benchmark, item_id_col, item_text_col, block):
        pairs = read.mapInArrow(_search(items, percent, to_arrow_type(item_kind)), schema)
        out = pairs if out is None else out.unionByName(pairs)
    return out if out is not None else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, percent: int = 80, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``contamination`` finds no item in. Rows are judged one by one, so ids may be null or repeated."""
    small_batches(docs.sparkSession)
    for items in item_blocks(benchmark, item_id_col, item_text_col, block):
        docs = docs.mapInArrow(_without(items, percent, docs.columns.index(text_col)), docs.schema)
    return docs
