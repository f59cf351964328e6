"""Language identification by averaged hashed subword embeddings and a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import small_batches, unused_name
from chronoweave.llm.learning import WordRows, bounded_sample, byte_ngrams, list_views

#: Hash buckets of subwords, length of an embedding, sizes of the subwords in bytes, and labelled rows to learn from.
BUCKETS, DIMENSION, SIZES, SAMPLE = 1 << 16, 16, (2, 3, 4, 5), 2_000
#: Share of right answers on validation rows that the rejection threshold may give up.
GIVE_UP = 0.001
UNKNOWN = "und"


@dataclass
class LanguageModel:
    """``table``: each subword bucket's part in each language's logit; ``temperature`` and ``threshold`` are calibrated."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


def _subwords(text: str) -> np.ndarray:
    hashes, _ = byte_ngrams(text.lower().encode().split(), SIZES)
    return (hashes >> np.uint64(64 - 16)).astype(np.int32)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, n = [], []
        for text in batch.column(1).to_pylist():
            places, counts = np.unique(_subwords(text), return_counts=True)
            at.append(places.astype(np.int32)), n.append(counts.astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))], ["lang", "check", "at", "n"])


def fit(bags: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, languages: list[str], check: np.ndarray, epochs: int = 5, rate: float = 0.5, seed: int = 7) -> LanguageModel:
    """Stochastic gradient descent on rows outside ``check``; temperature and threshold from those inside."""
    rng = np.random.Generator(np.random.PCG64(seed))
    e = rng.normal(0, 0.1, (BUCKETS, DIMENSION))
    w, b = rng.normal(0, 0.1, (DIMENSION, len(languages))), np.zeros(len(languages))
    learn = np.flatnonzero(~check) if (~check).any() else np.arange(len(bags))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for r in rng.permutation(learn):
            at, n = bags[r]
            if not len(at):
                continue
            share = n / n.sum()
            mean = share @ e[at]
            logit = mean @ w + b
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[target[r]] -= 1
            back = w @ p
            w -= step * np.outer(mean, p)
            b -= step * 0.1 * p
            e[at] -= step * 20 * share[:, None] * back[None, :]
    table = (e @ w).astype(np.float32)
    rows = [r for r in (np.flatnonzero(check) if check.any() else learn) if len(bags[r][0])]
    temperature, threshold = 1.0, 0.0
    if rows and len(languages) > 1:
        logits = np.array([(bags[r][1] / bags[r][1].sum()) @ table[bags[r][0]] + b for r in rows])

        def probability(t: float) -> np.ndarray:
            x = np.exp((logits - logits.max(axis=1, keepdims=True)) / t)
            return x / x.sum(axis=1, keepdims=True)

        loss = {t: -np.log(np.maximum(probability(t)[np.arange(len(rows)), target[rows]], 1e-12)).mean() for t in np.geomspace(0.2, 5, 25)}
        temperature = float(min(loss, key=loss.get))
        p = probability(temperature)
        right = p.argmax(axis=1) == target[rows]
        if right.any():
            # No more than half of what a right answer of the least allowed rank scores, and never above an even chance.
            threshold = float(min(0.5, 0.5 * np.quantile(p.max(axis=1)[right], GIVE_UP) + 0.5 / len(languages)))
    return LanguageModel(languages, table, b.astype(np.float32), temperature, threshold)


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> LanguageModel:
    """A model from at most about ``sample`` rows with a language among those that ``learn`` marks, equally many of each language and one at least; a fifth of them calibrates.

    Of rows that repeat id and language, one is learned from. Null ids are not.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    keys = F.broadcast(bounded_sample(rows.select("doc_id", "lang"), "lang", sample))  # bounded: no text but those of the sample moves
    chosen = rows.join(keys, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    chosen = chosen.select("lang", "text", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("check"))
    found = chosen.mapInArrow(_bags, "lang string, check boolean, at array<int>, n array<int>").toArrow()
    languages = sorted(set(found["lang"].to_pylist()))
    number = {lang: i for i, lang in enumerate(languages)}
    bags, lang, check = list(zip(list_views(found["at"]), list_views(found["n"]), strict=True)), found["lang"].to_pylist(), found["check"].to_pylist()
    order = sorted(range(len(bags)), key=lambda i: (lang[i], bags[i][0][:20].tolist(), int(bags[i][1].sum())))  # the same model in whatever order rows come
    return fit([bags[i] for i in order], np.array([number[lang[i]] for i in order], dtype=np.int64), languages, np.array([check[i] for i in order], dtype=bool))


def _word_parts(model: LanguageModel):
    """For words: the sum of their subwords' parts in each logit, and the number of subwords."""

    def compute(words: list[bytes]) -> np.ndarray:
        hashes, owner = byte_ngrams(words, SIZES)
        parts = model.table[(hashes >> np.uint64(64 - 16)).astype(np.int64)]
        out = [np.bincount(owner, weights=parts[:, k], minlength=len(words)) for k in range(parts.shape[1])]
        return np.stack([*out, np.bincount(owner, minlength=len(words))], axis=1).astype(np.float32)

    return compute


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected behind its columns; equally named columns of ``docs`` are replaced.

    The score is the calibrated probability of the predicted language. Text that is null or has no letter is ``und``
    with score 0 and rejected; so is, if no language was learned, any text. Other texts are rejected below the model's
    threshold, but keep their best language in lang_pred. Texts are read whole. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    docs = docs.select(*names, F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False)).alias(unused_name(docs, "letter")))
    at = names.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordRows(_word_parts(model))
        for batch in batches:
            texts, letter = batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()
            can = [i for i, ok in enumerate(letter) if ok and model.languages]
            lang, score, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
            rows, places = words.look([texts[i].lower().encode().split() for i in can])
            for i, place in zip(can, places, strict=True):
                total = rows[place].sum(axis=0, dtype=np.float64)
                logit = (total[:-1] / max(total[-1], 1) + model.bias) / model.temperature
                p = np.exp(logit - logit.max())
                p /= p.sum()
                best = int(p.argmax())
                lang[i], score[i], rejected[i] = model.languages[best], float(p[best]), bool(p[best] < model.threshold)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*names, "lang_pred", "score", "rejected"])

    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean")
