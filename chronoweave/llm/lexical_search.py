"""Ranked lexical search: documents grouped by which of an item's terms they hold, groups of the highest possible score first."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from chronoweave.llm.common import bounded_batches, materialize

#: Text of one block of items in bytes (two passes over the documents each): a bound for what is broadcast.
BLOCK_BYTES = 4 << 20
#: Documents and postings that a worker ranks at a time, terms in one mask, documents in the first exact look.
DOCS, POSTINGS, MASK, FIRST = 1 << 15, 1 << 22, 48, 512
#: Bytes of a text that are split at a time, about.
PART = 1 << 20
#: ASCII letters and digits and everything beyond ASCII form terms, A-Z lower-cased; the rest separates.
_TERM_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size (but for one huge term)."""
    for start, stop in _parts(plain := text.translate(_TERM_BYTES)):
        yield plain[start:stop].split()


def _parts(plain: bytes) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(plain):
        stop = plain.find(b" ", start + PART)
        stop = len(plain) if stop < 0 else stop
        yield start, stop
        start = stop


def _postings(vocabulary: dict[bytes, int], id_type: pa.DataType):
    """(doc_id, n, terms, counts) for each document with a term: its number of terms, and which of the vocabulary it holds how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for batch in batches:
            rows, totals, terms, counts = [], [], [], []
            for at, text in enumerate(batch.column(1)):
                n, held = 0, Counter()
                for words in terms_of(text.as_py() or b""):
                    n += len(words)
                    held.update(map(get, words))
                if n:
                    held.pop(None, None)
                    rows.append(at)
                    totals.append(n)
                    terms.append(list(held.keys()))
                    counts.append(list(held.values()))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(totals, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "counts"])

    return run


class Block:
    """Some documents, by rising id, with their postings by term."""

    def __init__(self, batches: list[pa.RecordBatch], n_docs: int, n_terms: int, vocabulary: int):
        table = pa.Table.from_batches(batches).combine_chunks()
        table = table.take(pc.sort_indices(table, sort_keys=[(table.column_names[0], "ascending")], null_placement="at_end")).combine_chunks()
        self.ids, self.size = table.column(0), table.num_rows
        n, lists, counts = table.column(1).to_numpy(), table.column(2).combine_chunks(), table.column(3).combine_chunks()
        terms, tf = lists.flatten().to_numpy(), counts.flatten().to_numpy()
        doc = np.repeat(np.arange(self.size, dtype=np.int32), lists.value_lengths().to_numpy())
        norm = 100 - 25 + 25 * n * n_docs // n_terms
        impact = 1_000_000_000 * tf // (1000 * tf + 12 * norm[doc])
        order = np.argsort(terms, kind="stable")
        self.doc, self.impact = doc[order], impact[order]
        self.first = np.searchsorted(terms[order], np.arange(vocabulary + 1))

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) of a term, documents rising."""
        cut = slice(self.first[term], self.first[term + 1])
        return self.doc[cut], self.impact[cut]

    def masks(self, terms: list[int], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(group of each document, highest possible score of each group); a group is the documents that hold the same of ``terms``.

        The bitmaps of up to ``MASK`` terms, read across, give each document's mask as one integer; more terms split the
        groups further. No document of a group scores above the sum of its terms' greatest impacts here.
        """
        group, bound = np.zeros(self.size, np.int64), np.zeros(1, np.int64)
        for start in range(0, len(terms), MASK):
            some = terms[start : start + MASK]
            bitmaps, most = np.zeros((64, self.size), bool), np.zeros(64, np.int64)
            for i, t in enumerate(some):
                docs, impact = self.postings(t)
                bitmaps[i, docs] = True
                most[i] = weights[start + i] * impact.max(initial=0)
            mask = np.ascontiguousarray(np.packbits(bitmaps, axis=0, bitorder="little").T).view("<u8").ravel()
            distinct, where = np.unique(mask, return_inverse=True)
            held = np.unpackbits(distinct.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            pairs, group = np.unique(group * len(distinct) + where, return_inverse=True)
            bound = bound[pairs // len(distinct)] + (held.astype(np.int64) @ most)[pairs % len(distinct)]
        return group, bound

    def scores(self, docs: np.ndarray, terms: list[int], weights: np.ndarray) -> np.ndarray:
        place, out = np.full(self.size, -1), np.zeros(len(docs), np.int64)
        place[docs] = np.arange(len(docs))
        for t, w in zip(terms, weights, strict=True):
            holders, impact = self.postings(t)
            at = place[holders]
            out[at[at >= 0]] += w * impact[at >= 0]
        return out

    def best(self, terms: list[int], weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, documents scored) of the ``k`` best of a score above 0 and of ``least`` or more.

        Groups go by falling bound, more and more of them at a time, until no group left can reach the k-th score.
        """
        present = [i for i, t in enumerate(terms) if weights[i] > 0 and self.first[t] < self.first[t + 1]]
        terms, weights = [terms[i] for i in present], weights[present]
        docs = scores = np.empty(0, np.int64)
        if not terms:
            return docs, scores, 0
        group, bound = self.masks(terms, weights)
        by_group = np.argsort(-bound[group], kind="stable")
        ceiling = bound[group[by_group]]
        least, start, size, seen = max(least, 1), 0, FIRST, 0
        while start < self.size and ceiling[start] >= least:
            stop = np.searchsorted(-ceiling, -ceiling[min(start + size, self.size) - 1], "right")  # whole groups
            stop = min(stop, int(np.searchsorted(-ceiling, -least, "right")))
            more = by_group[start:stop]
            seen += len(more)
            docs, scores = np.concatenate([docs, more]), np.concatenate([scores, self.scores(more, terms, weights)])
            order = np.lexsort((docs, -scores))[:k]
            order = order[scores[order] >= least]
            docs, scores = docs[order], scores[order]
            if len(docs) == k:
                least = max(least, int(scores[-1]))
            start, size = stop, size * 4
        return docs, scores, seen


def _ranked(items: list[tuple[list[int], np.ndarray]], k: int, n_docs: int, n_terms: int, vocabulary: int, id_type: pa.DataType):
    """The ``k`` best documents of a partition for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list] = [[] for _ in items]

        def rank(held: list[pa.RecordBatch]) -> None:
            block = Block(held, n_docs, n_terms, vocabulary)
            for at, (terms, weights) in enumerate(items):
                docs, scores, _ = block.best(terms, weights, k, -kept[at][-1][0] if len(kept[at]) == k else 1)
                if len(docs):
                    new = [(-s, i is None, i) for s, i in zip(scores.tolist(), block.ids.take(pa.array(docs)).to_pylist(), strict=True)]
                    kept[at] = sorted(kept[at] + new, key=lambda r: r if r[2] is not None else r[:2])[:k]

        held, docs, postings = [], 0, 0
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                size = pc.sum(pc.list_value_length(part.column(2))).as_py() or 0
                if held and (docs + part.num_rows > DOCS or postings + size > POSTINGS):
                    rank(held)
                    held, docs, postings = [], 0, 0
                held.append(part)
                docs, postings = docs + part.num_rows, postings + size
        if held:
            rank(held)
        rows = [(at, i, -minus) for at, found in enumerate(kept) for minus, _, i in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), id_type, pa.int64()))], ["item", "doc_id", "score"])

    return run


def _item_blocks(items: DataFrame, id_col: str, text_col: str, size: int) -> Iterator[list[tuple[object, list[str]]]]:
    """(id, terms with repeats) of items, in blocks of at most ``size`` bytes of terms, or of one item."""
    lowered = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = items.select(F.col(id_col).alias("item_id"), F.filter(F.split(lowered, _SEPARATORS), lambda t: t != "").alias("terms")).where("size(terms) > 0").distinct()
    held, taken = [], 0
    for row in rows.toLocalIterator():
        more = sum(map(len, row["terms"]))
        if held and taken + more > size:
            yield held
            held, taken = [], 0
        held.append((row["item_id"], row["terms"]))
        taken += more
    if held:
        yield held


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of the highest score above 0 for each item, equal scores by rising id.

    A term is a run of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. With N documents that hold a
    term and L terms in all, a term held by df of them weighs floor(1000 ln((2N + 2) / (2 df + 1))); a document of n
    terms has m = 75 + 25 n N div L and scores, for each of the item's terms, repeats included, its weight times
    10^9 tf div (1000 tf + 12 m), in 64-bit integers.

    One pass finds which of the items' terms each document holds; a second one ranks blocks of documents: an item's
    documents are grouped by the mask of its terms that they hold, masks go by their highest possible score, and what
    can't reach the best so far isn't scored. A task returns ``k`` rows an item at most. Items come in blocks of
    ``block_bytes``, which is all that is broadcast.

    Null or blank texts have no terms, match nothing and don't count in N. Document ids, null (last among equals) or
    repeated, are those of rows. An item that is repeated whole counts once; one id with several texts ranks each.
    Long texts are read whole, in parts. Other columns, whatever their names, are not read. Without documents or items
    there are no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind, item_kind = docs.schema[id_col].dataType, items.schema[item_id_col].dataType
    schema = f"item_id {item_kind.simpleString()}, rank int, doc_id {kind.simpleString()}, score bigint"
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    out = None
    for block in _item_blocks(items, item_id_col, item_text_col, block_bytes):
        vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for _, terms in block for t in terms))}
        names = {t.encode(): i for t, i in vocabulary.items()}
        postings = materialize(read.mapInArrow(_postings(names, to_arrow_type(kind)), f"doc_id {kind.simpleString()}, n bigint, terms array<int>, counts array<bigint>"), "postings")
        n_docs, n_terms = postings.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        df = dict(postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
        weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(vocabulary))]
        wanted = []
        for _, terms in block:
            repeats = Counter(vocabulary[t] for t in terms)
            wanted.append((list(repeats), np.array([weight[t] * n for t, n in repeats.items()], np.int64)))
        found = postings.mapInArrow(_ranked(wanted, k, n_docs, n_terms, len(vocabulary), to_arrow_type(kind)), f"item int, doc_id {kind.simpleString()}, score bigint")
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= k)
        ids = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"item int, item_id {item_kind.simpleString()}")
        part = ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)
