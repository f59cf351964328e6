import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import langid, quality, toxicity
from chronoweave.llm.common import doc_bucket
from chronoweave.llm.learning import WordRows, bounded_sample, ftrl
from chronoweave.llm.toxicity import LabelModel, fit_label_model, label_rows, word_starts


@pytest.fixture(scope="module")
def labelled(spark):
    rng, docs, labels = random.Random(8), [], []
    for i in range(600):
        lang = ("en", "de")[i % 2]
        words = [rng.choice(("the", "of", "and", "thing", "other") if lang == "en" else ("der", "und", "nicht", "schöne", "über")) + rng.choice("abcdefgh") for _ in range(40)]
        toxic, good = i % 5 == 0, i % 7 != 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(("idiot", "moron")) if lang == "en" else "lowei" + rng.choice("abcd")
        if not good:
            words = [w + "%%%" for w in words]
        docs.append((i, " ".join(words), lang, "s"))
        if i % 3:
            labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), {i: (int(i % 7 != 0), int(i % 5 == 0)) for i in range(600)}


def test_toxicity_on_held_out_rows(labelled):
    docs, labels, truth = labelled
    got = toxicity.score(docs, toxicity.train(docs, labels, doc_bucket("doc_id", 5) != 0)).where(doc_bucket("doc_id", 5) == 0).collect()
    assert np.mean([r["predicted"] == truth[r["doc_id"]][1] for r in got]) > 0.95


def test_quality_on_held_out_rows(labelled):
    docs, labels, truth = labelled
    got = quality.score(docs, quality.train(docs, labels, doc_bucket("doc_id", 5) != 0)).where(doc_bucket("doc_id", 5) == 0).collect()
    assert np.mean([r["predicted"] == truth[r["doc_id"]][0] for r in got]) > 0.95


def test_language_on_held_out_rows(labelled):
    docs, _, _ = labelled
    model = langid.train(docs, doc_bucket("doc_id", 4) != 2)
    got = langid.identify(docs, model).where(doc_bucket("doc_id", 4) == 2).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.98
    assert not any(r["rejected"] for r in got)


def test_classifiers_on_nasty_rows(labelled, nasty, empty):
    docs, labels, _ = labelled
    w = toxicity.train(docs, labels, doc_bucket("doc_id", 5) != 0)
    q = quality.train(docs, labels, doc_bucket("doc_id", 5) != 0)
    m = langid.train(docs, doc_bucket("doc_id", 4) != 2)
    for out in (toxicity.score(nasty, w), quality.score(nasty, q), langid.identify(nasty, m)):
        rows = out.collect()
        assert len(rows) == nasty.count() and all(0 <= r["score"] <= 1 for r in rows)
    for out in (toxicity.score(empty, w), quality.score(empty, q), langid.identify(empty, m)):
        assert out.count() == 0
    und = {r["doc_id"] for r in langid.identify(nasty, m).where("lang_pred = 'und'").collect()}
    assert und == {4, 5, 6, 10, None}


def test_nothing_to_learn_from(labelled, empty):
    docs, labels, _ = labelled
    learn = doc_bucket("doc_id", 5) != 0
    assert {r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels.limit(0), learn, unlabelled=0)).collect()} == {0.5}
    assert quality.score(docs, quality.train(docs, labels.limit(0), learn)).select("score").distinct().collect()[0][0] == 0.5
    assert langid.identify(docs, langid.train(empty, doc_bucket("doc_id", 4) != 2)).where("lang_pred <> 'und'").count() == 0


def drawn(n: int, seed: int):
    rng = np.random.default_rng(seed)
    y = rng.random(n) < 0.2
    rates = np.array([[0.02, 0.9], [0.05, 0.6], [0.01, 0.5], [0.2, 0.25]])
    votes = np.stack([rng.random(n) < np.where(y, b, a) for a, b in rates], axis=1).astype(float)
    return y, np.concatenate([votes, votes[:, 1:2], votes[:, 1:2]], axis=1)  # two voters that repeat another


def test_label_model_finds_accuracies_and_correlations():
    y, votes = drawn(4_000, 0)
    known_y, known = drawn(400, 1)
    model = fit_label_model(votes, np.ones(4_000), known, known_y.astype(float), np.ones(400))
    q = model.posterior(votes)
    assert abs(model.rate[1, 0] - 0.9) < 0.1 and abs(model.rate[0, 0] - 0.02) < 0.03
    # The three that move together form a chain, so that what the first says counts once.
    assert sum(model.parent[j] in (1, 4, 5) for j in (1, 4, 5)) == 2
    assert np.mean((q > 0.5) == y) > 0.93
    one, all_three = np.zeros((1, 6)), np.zeros((1, 6))
    one[0, 1] = all_three[0, [1, 4, 5]] = 1
    alone = fit_label_model(votes[:, :4], np.ones(4_000), known[:, :4], known_y.astype(float), np.ones(400))
    assert abs(model.logit(all_three)[0] - alone.logit(one[:, :4])[0]) < 1.0


def test_logit_equals_the_product_of_conditional_rates():
    rng = np.random.default_rng(3)
    model = LabelModel(0.3, rng.uniform(0.1, 0.9, (2, 4)), np.array([-1, 0, 1, -1]), rng.uniform(0.1, 0.9, (2, 2, 4)))
    votes = rng.integers(0, 2, (16, 4)).astype(float)
    for v, got in zip(votes, model.posterior(votes), strict=True):
        p = [0.7, 0.3]
        for y in (0, 1):
            for j in range(4):
                rate = model.rate[y, j] if model.parent[j] < 0 else model.given[y, int(v[model.parent[j]]), j]
                p[y] *= rate if v[j] else 1 - rate
        assert abs(got - p[1] / sum(p)) < 1e-9


def test_no_row_sees_its_own_label():
    """Turning one row's label round leaves its posterior as it was."""
    rng = np.random.default_rng(4)
    n = 200
    gold = (rng.random(n) < 0.3).astype(int)
    rows = [np.sort(rng.choice(50, 8, replace=False)).astype(np.int32) for _ in range(n)]
    rows = [np.unique(np.append(r, 60 + int(rng.integers(4)))).astype(np.int32) if g and rng.random() < 0.8 else r for r, g in zip(rows, gold, strict=True)]
    fixed, fold = (rng.random((n, 3)) < np.where(gold[:, None] == 1, 0.6, 0.05)).astype(float), rng.integers(0, 4, n)
    before = label_rows(rows, fixed, gold, fold, np.ones(n))
    turned = gold.copy()
    turned[5] = 1 - gold[5]
    after = label_rows(rows, fixed, turned, fold, np.ones(n))
    assert after[5] == pytest.approx(before[5], abs=1e-12)
    assert np.mean((before > 0.5) == gold) > 0.85


def test_word_starts_match_a_plain_count():
    rng = np.random.default_rng(5)
    gold = rng.integers(0, 2, 300)
    rows = [np.unique(rng.integers(0, 40, 6) + (100 if g and rng.random() < 0.5 else 0)).astype(np.int32) for g in gold]
    n = [int((gold == y).sum()) for y in (0, 1)]
    want = []
    for b in range(200):
        c = [sum(b in r for r, g in zip(rows, gold, strict=True) if g == y) for y in (0, 1)]
        lift = (c[1] / n[1] - (c[1] + 1) ** 0.5 / n[1]) / (c[0] / n[0] + 1 / n[0])
        if c[1] >= max(4, 0.01 * n[1]) and lift > 4:
            want.append(b)
    assert word_starts(rows, gold).tolist() == want and want


def test_score_equals_the_sum_of_weights(labelled):
    docs, labels, _ = labelled
    weights = toxicity.train(docs, labels, doc_bucket("doc_id", 5) != 0)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, weights).collect()}
    for r in docs.limit(50).collect():
        found, starts = set(), {}
        for w in toxicity.bare_words(r["text"]):
            one, several = toxicity.word_features(w)
            found |= set(one)
            for k in several:
                starts[k] = starts.get(k, 0) + 1
        found |= {b for k, n in starts.items() for b, least in zip(k, toxicity.SEVERAL, strict=True) if n >= least}
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-(weights[-1] + sum(weights.get(b, 0.0) for b in found)))), abs=1e-9)


def test_ftrl_steps_equal_the_textbook():
    """The published per-coordinate update, one coordinate and one row at a time."""
    rng = np.random.default_rng(6)
    rows = [(np.sort(rng.choice(12, 3, replace=False)), rng.normal(size=3)) for _ in range(20)]
    target, weight = rng.random(20), rng.uniform(0.5, 2, 20)
    alpha, beta, l1, l2 = 0.3, 1.0, 0.2, 0.5
    got = ftrl(rows, target, weight, 12, epochs=2, alpha=alpha, beta=beta, l1=l1, l2=l2, seed=1)
    z, n, order = [0.0] * 13, [0.0] * 13, np.random.Generator(np.random.PCG64(1))

    def w(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(2):
        for r in order.permutation(20):
            at, v = [*rows[r][0], 12], [*rows[r][1].astype(np.float32), 1.0]
            p = 1 / (1 + np.exp(-sum(w(i) * x for i, x in zip(at, v, strict=True))))
            for i, wi, x in [(i, w(i), x) for i, x in zip(at, v, strict=True)]:
                g = weight[r] * (p - target[r]) * x
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha
                z[i] += g - sigma * wi
                n[i] += g * g
    assert np.allclose(got, [w(i) for i in range(13)], atol=1e-6)


def test_quality_scores_equal_plain_products(labelled):
    """Features of a text as a plain count of hashed grams would have them: scores don't depend on batches or caches."""
    docs, labels, _ = labelled
    weights = quality.train(docs, labels, doc_bucket("doc_id", 5) != 0)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, weights).collect()}
    for r in docs.limit(20).collect():
        at, value = next(quality.feature_rows([r["text"]], WordRows(quality.word_hashes, limit=3)))
        assert abs(np.sqrt((value**2).sum()) - 1) < 1e-9 and len(set(at.tolist())) == len(at)
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-(sum(weights[i] * v for i, v in zip(at, value, strict=True)) + weights[-1]))), abs=1e-4)


def test_language_scores_equal_plain_averages(labelled):
    """The mean of a text's subword parts and a softmax, one subword at a time."""
    docs, _, _ = labelled
    model = langid.train(docs, doc_bucket("doc_id", 4) != 2)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, model).collect()}
    for r in docs.limit(20).collect():
        parts = [model.table[b].astype(float) for b in langid._subwords(r["text"])]
        logit = (sum(parts) / len(parts) + model.bias) / model.temperature
        p = np.exp(logit) / np.exp(logit).sum()
        assert got[r["doc_id"]][0] == model.languages[int(p.argmax())] and got[r["doc_id"]][1] == pytest.approx(p.max(), abs=1e-4)


def test_every_language_is_learned(spark):
    """Seventy languages, some of one row: none is left out of the model."""
    rng = random.Random(1)
    rows = [(100 * k + i, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{rng.choice('xyz')}" for _ in range(20)), f"l{k:02}") for k in range(70) for i in range(1 if k > 60 else 12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(docs, F.lit(True), sample=300)
    assert len(model.languages) == 70


def test_a_repeated_id_is_learned_from_once(spark):
    rows = [(1, f"text {i}", "en") for i in range(500)] + [(2, "das ist", "de")]
    keys = bounded_sample(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), "lang", 10)
    assert sorted(map(tuple, keys.collect())) == [(1, "en"), (2, "de")]
