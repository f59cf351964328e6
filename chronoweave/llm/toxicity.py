"""Toxicity by weak supervision: a generative label model over many voters, and a linear classifier on its posterior labels."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import small_batches
from chronoweave.llm.learning import bounded_sample, ftrl, list_views, sigmoid

#: log2 of the hash buckets, labelled rows to learn from, unlabelled ones beside them, word-start voters, and folds.
BITS, SAMPLE, UNLABELLED, STARTS, FOLDS = 20, 4_000, 1_000, 200, 4

#: Lexicon voters: each list is one voter.
LEXICONS = {
    "stupidity_en": "idiot moron stupid dumb imbecile fool dimwit",
    "contempt_en": "loser clown jerk creep pathetic",
    "worthlessness_en": "trash scum worthless scumbag garbage crap",
    "disgust_en": "disgusting vile filthy repulsive gross",
    "profanity_en": "damn hell shit fuck bastard bitch asshole bullshit",
    "threats_en": "kill die hurt destroy hang shoot burn",
    "hate_en": "hate despise vermin subhuman filth parasite",
    "insults_de": "idiot dummkopf trottel arschloch abschaum versager dreck blöd ekelhaft scheiße",
    "insults_fr": "idiot imbécile crétin connard salope merde débile minable ordure raclure",
    "insults_es": "idiota imbécil estúpido basura mierda cabrón inútil asqueroso escoria payaso",
}
#: Pattern voters: each is one voter.
PATTERNS = {
    "addressed": r"\b(you|your|u r|du bist|tu es|eres)\b[^.!?\n]{0,40}\b(idiot|moron|loser|trash|scum|clown|stupid|pathetic)",
    "named": r"\b(the|a|an|of|that|this)\s+(idiot|moron|loser|trash|scum|clown)\b",
    "telling_off": r"\b(shut up|go to hell|get lost|drop dead|kill yourself|screw you)\b",
    "masked": r"\b[a-z]+\*{2,}[a-z]*\b|\b[a-z]+[@$][a-z]+\b",
    "shouting": r"(?:\b[A-Z]{3,}\b[\s!,.]*){5,}",
    "exclaiming": r"!{3,}",
}
_LEXICON = [frozenset(w.encode() for w in words.split()) for words in LEXICONS.values()]
_PATTERN = [re.compile(p, re.IGNORECASE if name not in ("shouting",) else 0) for name, p in PATTERNS.items()]
_EDGES = b".,;:!?\"'()[]{}<>*#$%&|_-"


#: Bytes of the word starts that are counted over a text's words, and how many words are several.
LENGTHS, SEVERAL = (5, 6, 7), (2, 3)


def _bucket(key: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(key, seed=seed) >> (64 - BITS)


def word_features(word: bytes) -> tuple[tuple[int, ...], tuple[tuple[int, ...], ...]]:
    """Buckets of a word without punctuation at its ends: the word, its first four, five and six bytes, and each lexicon that lists it.

    Behind them, for each longer start, its buckets for texts where it begins several words.
    """
    if not word:
        return (), ()
    found = {_bucket(word[:n], n) for n in (4, 5, 6, 99) if n == 99 or len(word) > n}
    listed = {_bucket(str(i).encode(), 1000) for i, lexicon in enumerate(_LEXICON) if word in lexicon}
    return tuple(found | listed), tuple(tuple(_bucket(word[:n], 2000 + k) for k in SEVERAL) for n in LENGTHS if len(word) >= n)


class _Cached(dict):
    def __init__(self, compute, limit: int = 200_000):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        value = self.compute(word)
        if len(self) < self.limit:
            self[word] = value
        return value


def bare_words(text: str | None) -> set[bytes]:
    """The distinct words of a text, lower-cased, without punctuation at their ends."""
    return {w.strip(_EDGES) for w in set((text or "").lower().encode().split())}


def presence(words: set[bytes], cache: _Cached) -> set[int]:
    """The distinct buckets of a text's words."""
    found: set[int] = set()
    starts: Counter = Counter()
    for one, several in map(cache.__getitem__, words):
        found.update(one)
        starts.update(several)
    for buckets, n in starts.items():
        found.update(b for b, least in zip(buckets, SEVERAL, strict=True) if b >= 0 and n >= least)
    return found


def fixed_votes(text: str, words: set[bytes]) -> list[int]:
    """1 for each lexicon and pattern voter that calls the text toxic, else 0: it abstains. Two more ask for several listed words."""
    listed = [len(words & lexicon) for lexicon in _LEXICON]
    return [int(n > 0) for n in listed] + [int(sum(listed) > 1), int(sum(listed) > 3)] + [int(bool(p.search(text))) for p in _PATTERN]


@dataclass
class LabelModel:
    """Votes given the class, each voter depending on one other at most.

    ``rate[y, j]``: how often voter j votes in class y. ``parent[j]``: the voter it moves together with, or -1.
    ``given[y, v, j]``: how often it votes in class y where its parent's vote is v.
    """

    prior: float
    rate: np.ndarray
    parent: np.ndarray
    given: np.ndarray

    def logit(self, votes: np.ndarray) -> np.ndarray:
        """Log odds of toxic for rows of votes."""
        has, at = self.parent >= 0, np.where(self.parent >= 0, self.parent, 0)
        out = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for y, sign in ((1, 1), (0, -1)):
            p = np.where(has, np.where(votes[:, at] > 0, self.given[y, 1], self.given[y, 0]), self.rate[y])
            out += sign * (votes * np.log(p) + (1 - votes) * np.log(1 - p)).sum(axis=1)
        return out

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(votes))


def _tree(information: np.ndarray, least: float) -> np.ndarray:
    """Parents in the spanning forest of most mutual information, without edges below ``least``."""
    n = len(information)
    parent, best, to, inside = np.full(n, -1), np.full(n, -np.inf), np.full(n, -1), np.zeros(n, bool)
    for _ in range(n):
        j = int(np.where(inside, -np.inf, best).argmax()) if (~inside & (best > -np.inf)).any() else int(np.flatnonzero(~inside)[0])
        parent[j], inside[j] = (to[j] if best[j] >= least else -1), True
        closer = ~inside & (information[j] > best)
        best[closer], to[closer] = information[j][closer], j
    return parent


def fit_label_model(votes: np.ndarray, weight: np.ndarray, known: np.ndarray, gold: np.ndarray, known_weight: np.ndarray, rounds: int = 8) -> LabelModel:
    """Expectation maximisation over accuracies and correlations of voters.

    ``votes``: rows whose class the model infers; no label of theirs is seen. ``known``: votes on other rows, whose
    labels ``gold`` give the voters' first accuracies and stay in the counts. In turn: rates of votes and of pairs of
    votes in either class, the tree of the pairs that tell most about each other given the class, and posteriors.
    """
    prior = float(np.clip((known_weight * gold).sum() / max(known_weight.sum(), 1e-9), 0.005, 0.5))
    x = np.concatenate([known, votes])
    model, q = None, None
    for _ in range(rounds):
        rows, m = (known, known_weight) if q is None else (x, np.concatenate([known_weight, weight]))
        share = gold if q is None else np.concatenate([gold, q])
        mass = np.stack([m * (1 - share), m * share])
        base = (m @ rows + 0.5) / (m.sum() + 1)
        rate, joint, information = [], [], np.zeros((x.shape[1], x.shape[1]))
        for y in (0, 1):
            n = mass[y].sum()
            r = ((mass[y] @ rows + 1 + 2 * base) / (n + 4)).clip(1e-4, 1 - 1e-4)
            both = (rows.T @ (mass[y][:, None] * rows) + 2 * np.outer(r, r)) / (n + 2)
            both = np.clip(both, np.maximum(1e-7, r[:, None] + r[None, :] - 1 + 1e-7), np.minimum(r[:, None], r[None, :]) - 1e-7)
            cells = ((both, r[:, None] * r[None, :]), (r[:, None] - both, r[:, None] * (1 - r[None, :])), (r[None, :] - both, (1 - r[:, None]) * r[None, :]), (1 - r[:, None] - r[None, :] + both, (1 - r[:, None]) * (1 - r[None, :])))
            information += n / mass.sum() * sum(np.maximum(p, 1e-9) * np.log(np.maximum(p, 1e-9) / e) for p, e in cells)
            rate.append(r), joint.append(both)
        np.fill_diagonal(information, -np.inf)
        rate = np.stack(rate)
        parent = _tree(information, 10 / (2 * max(len(rows), 1)))
        at = np.where(parent >= 0, parent, 0)
        own = np.arange(len(parent))
        given = np.stack([np.stack([(rate[y] - joint[y][own, at]) / (1 - rate[y][at]), joint[y][own, at] / rate[y][at]]) for y in (0, 1)]).clip(1e-4, 1 - 1e-4)
        model = LabelModel(prior, rate, parent, given)
        q = model.posterior(votes)
    return model


def word_starts(rows: list[np.ndarray], gold: np.ndarray, limit: int = STARTS) -> np.ndarray:
    """Voters beside the fixed ones: words and word starts that are far more frequent among toxic labels than among others, by the lower end of the ratio."""
    size = 1 << BITS
    counts = [np.bincount(np.concatenate([np.empty(0, np.int32), *(rows[i] for i in np.flatnonzero(gold == y))]).astype(np.int64), minlength=size) for y in (0, 1)]
    n = [max(1, int((gold == y).sum())) for y in (0, 1)]
    lift = (counts[1] / n[1] - np.sqrt(counts[1] + 1) / n[1]) / (counts[0] / n[0] + 1 / n[0])
    lift[counts[1] < max(4, 0.01 * n[1])] = 0
    best = np.argsort(-lift, kind="stable")[:limit]
    return np.sort(best[lift[best] > 4])


def label_rows(rows: list[np.ndarray], fixed: np.ndarray, gold: np.ndarray, fold: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """P(toxic) of each row, where gold is 1, 0, or -1 for no label.

    Cross-fitted: the voters and the model that label a fold come from the labels of the other folds, so no row's own
    label is part of its posterior. Unlabelled rows get the mean over the folds.
    """
    known, free = gold >= 0, np.flatnonzero(gold < 0)
    q, loose = np.zeros(len(gold)), np.zeros(len(free))
    folds = [f for f in range(FOLDS) if (known & (fold == f)).any()] or [0]
    for f in folds:
        own, others = np.flatnonzero(known & (fold == f)), np.flatnonzero(known & (fold != f))
        others = others if len(others) else own
        starts = word_starts([rows[i] for i in others], gold[others])
        votes = np.concatenate([fixed, np.stack([np.isin(starts, r) for r in rows]).astype(float)], axis=1)
        infer = np.concatenate([own, free])
        model = fit_label_model(votes[infer], weight[infer], votes[others], gold[others].astype(float), weight[others])
        logit = model.logit(votes[infer])
        q[own] = sigmoid(logit[: len(own)])
        loose += logit[len(own) :] / len(folds)
    q[free] = sigmoid(loose)
    return q


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, unlabelled: int = UNLABELLED) -> dict[int, float]:
    """Weights of buckets other than 0, and under -1 the intercept, from about ``sample`` labelled rows at most and ``unlabelled`` others among those that ``learn`` (over the id) marks."""
    small_batches(docs.sparkSession)
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & learn).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = bounded_sample(marked, "label", sample)
    ids = docs.where(learn).select(F.col(id_col).alias("doc_id"))
    others = bounded_sample(ids.join(marked, "doc_id", "left_anti"), None, unlabelled).withColumn("label", F.lit(-1))
    texts = docs.where(learn).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Cached(word_features)
        for batch in batches:
            at, votes = [], []
            for text in batch.column(1).to_pylist():
                words = bare_words(text)
                at.append(np.array(sorted(presence(words, cache)), np.int32)), votes.append(np.array(fixed_votes(text or "", words), np.int8))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(at, pa.list_(pa.int32())), pa.array(votes, pa.list_(pa.int8()))], ["doc_id", "label", "fold", "at", "votes"])

    kind = docs.schema[id_col].dataType.simpleString()
    # A bounded sample: no text but its own moves. Of rows that repeat an id, one is learned from.
    joined = texts.join(F.broadcast(chosen.unionByName(others)), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    joined = joined.select("doc_id", "text", "label", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(FOLDS)).cast("int").alias("fold"))
    got = joined.mapInArrow(describe, f"doc_id {kind}, label int, fold int, at array<int>, votes array<tinyint>").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    gold, rows = got["label"].to_numpy(), list_views(got["at"])
    if not (gold >= 0).any():
        return {-1: 0.0}
    share = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    have = {y: max(1, int((gold == y).sum())) for y in (-1, 0, 1)}
    total = sum(share.values())
    # The sample holds the labels in equal number; weights give them back their shares.
    weight = np.array([1.0 if y < 0 else share[int(y)] / total / have[int(y)] * (have[0] + have[1]) for y in gold])
    q = label_rows(rows, np.stack(list_views(got["votes"])).astype(float), gold, got["fold"].to_numpy(), weight)
    w = ftrl([(r.astype(np.int64), np.ones(len(r))) for r in rows], q, weight, 1 << BITS, epochs=10, alpha=2.0, l1=5.0, l2=0.1)
    return {int(i): float(w[i]) for i in np.flatnonzero(w[:-1])} | {-1: float(w[-1])}


def score(docs: DataFrame, weights: dict[int, float], id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted), a row for each row of ``docs``: the probability of toxicity, and whether it reaches ``threshold``.

    The weights are those of at most 2^20 buckets. Null text is scored as empty: the intercept alone. Ids, null or
    repeated, pass through. Other columns, whatever their names, are not read. Texts are read whole. An empty table gives
    no rows. Without any label to learn from, all scores are one half.
    """
    small_batches(docs.sparkSession)
    kind, intercept = docs.schema[id_col].dataType.simpleString(), weights[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def weighted(word: bytes) -> tuple:
            one, several = word_features(word)
            kept = (tuple(b if b in weights else -1 for b in buckets) for buckets in several)
            return tuple(b for b in one if b in weights), tuple(k for k in kept if max(k) >= 0)

        cache = _Cached(weighted)
        for batch in batches:
            out = [float(sigmoid(intercept + sum(weights[b] for b in sorted(presence(bare_words(t), cache))))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
