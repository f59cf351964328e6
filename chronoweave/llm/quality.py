"""Quality classifier: hashed word n-grams and logistic regression by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import mix64, small_batches
from chronoweave.llm.learning import WordRows, bounded_sample, ftrl, list_views, sigmoid

#: log2 of the hash buckets, and labelled rows to learn from.
BITS, SAMPLE = 18, 6_000

_CLASS = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))


def shape(word: bytes) -> bytes:
    """Runs of capitals, other letters and digits as one A, a or 0; the rest as it is, at most 8 bytes in all."""
    word = word.translate(_CLASS)
    for sign in (b"a", b"A", b"0"):
        while sign + sign in word:
            word = word.replace(4 * sign, sign).replace(2 * sign, sign)
    return word[:8]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Two hashes of each word: of its lower-case form and of its shape."""
    both = [x for w in words for x in (xxhash.xxh3_64_intdigest(w.lower()), xxhash.xxh3_64_intdigest(shape(w), seed=1))]
    return np.fromiter(both, np.uint64, len(both)).reshape(-1, 2)


def features(both: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of the hashed word n-grams of a whole text, from the two hashes of each of its words.

    The n-grams are words, pairs of words, and up to three successive shapes, where a word equal to the one before it
    has a shape of its own. Values are the logarithm of one plus the count, scaled to length one.
    """
    n, word, form = len(both), both[:, 0], both[:, 1].copy()
    form[np.flatnonzero(word[1:] == word[:-1]) + 1] = np.uint64(77)
    step = np.uint64(0x9E3779B97F4A7C15)
    grams = [word, word[:-1] * step + word[1:], form * step, (form[:-1] * step + form[1:]) * step, ((form[:-2] * step + form[1:-1]) * step + form[2:]) * step]
    hashed = [mix64(g + np.uint64(i)) for i, g in enumerate(grams) if len(g)]
    hashed.append(mix64(np.array([1000 + min(n, 1), 2000 + n.bit_length()], np.uint64)))
    places, counts = np.unique((np.concatenate(hashed) >> np.uint64(64 - bits)).astype(np.int32), return_counts=True)
    values = np.log1p(counts)
    return places, values / np.sqrt(values @ values)


def feature_rows(texts: list[str | None], words: WordRows, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    rows, places = words.look([(t or "").encode().split() for t in texts])
    for at in places:
        yield features(rows[at], bits)


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, bits: int = BITS) -> np.ndarray:
    """Weights, the intercept last, from at most about ``sample`` labelled rows among those that ``learn`` (over the id) marks."""
    small_batches(docs.sparkSession)
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & learn).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = bounded_sample(marked, "label", sample)
    texts = docs.where(learn).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordRows(word_hashes)
        for batch in batches:
            found = list(feature_rows(batch.column(1).to_pylist(), words, bits))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([p.astype(np.int32) for p, _ in found], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32()))], ["doc_id", "label", "at", "value"])

    # A bounded sample: no text but its own moves. Of rows that repeat an id, one is learned from.
    joined = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
    kind = docs.schema[id_col].dataType.simpleString()
    got = joined.mapInArrow(rows, f"doc_id {kind}, label int, at array<int>, value array<float>").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    label = got["label"].to_numpy().astype(float) if got.num_rows else np.empty(0)
    pairs = list(zip(list_views(got["at"]), list_views(got["value"]), strict=True))
    # The sample holds the labels in equal number; weights give them back their shares, so that scores are probabilities.
    share = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    total, have = sum(share.values()), {k: max(1, int((label == k).sum())) for k in share}
    weight = np.array([share[int(y)] / total / have[int(y)] * len(label) for y in label])
    return ftrl(pairs, label, weight, 1 << bits, epochs=8, alpha=1.0, l1=0.05, l2=0.1)


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted), a row for each row of ``docs``: the probability of quality, and whether it reaches ``threshold``.

    A score is a sparse dot product with broadcast weights of fixed size. Null text is scored as empty. Ids, null or
    repeated, pass through. Other columns, whatever their names, are not read. Texts are read whole. An empty table gives
    no rows. Without any label to learn from, all scores are one half.
    """
    small_batches(docs.sparkSession)
    kind, bits, small = docs.schema[id_col].dataType.simpleString(), int(len(weights) - 1).bit_length() - 1, weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordRows(word_hashes)
        for batch in batches:
            out = [float(sigmoid(float(small[at] @ value) + float(small[-1]))) for at, value in feature_rows(batch.column(1).to_pylist(), words, bits)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
