"""Fits against their definition: gradients, known weights, weights by gain, rounds of boosting."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankwright.operators import evaluate, gain, quality, train
from rankwright.operators.skew import find_hot_groups, no_hot_groups
from rankwright.plans.catalog import _labelled_features
from rankwright.sources import tables

NONE = no_hot_groups(["ranker_id"])


@pytest.fixture(scope="module")
def features(spark):
    return _labelled_features(spark, "/root/testdata/sf0.01").cache()


@pytest.fixture(scope="module")
def small(spark):
    """Sessions of 1 to 12 offers, some with no or several chosen ones, ties and a missing value."""
    rng = random.Random(11)
    rows = []
    for session in range(80):
        for i in range(rng.randrange(1, 13)):
            x, y = rng.randrange(6) / 2, rng.gauss(0, 1)
            label = int(rng.random() < 1 / (1 + math.exp(2 - x)))
            rows.append((f"{session}-{i}", session, label, x, None if rng.random() < 0.05 else y))
    rows.append(("lost", None, 1, 1.0, 1.0))
    return spark.createDataFrame(rows, "Id string, ranker_id long, selected long, x double, y double").cache()


def _hash(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def _pairs(rows, meetings=1):
    """(best, other) as ``make_pairs`` defines them."""
    sessions = {}
    for r in rows:
        if r.ranker_id is not None:
            sessions.setdefault(r.ranker_id, []).append(r)
    for offers in sessions.values():
        chosen = sorted((r for r in offers if r.selected), key=lambda r: r.Id)
        for other in offers:
            if not other.selected:
                for step in range(len(chosen) if meetings is None else min(meetings, len(chosen))):
                    yield chosen[(_hash(other.Id) + step) % len(chosen)], other


@pytest.mark.parametrize("meetings", [1, 2, None])
def test_pairs_of_several_chosen(small, meetings):
    made = train.make_pairs(small, hot=NONE, meetings=meetings)
    expected = sorted((a.Id, b.Id) for a, b in _pairs(small.collect(), meetings))
    assert sorted((r.best_id, r.other_id) for r in made.collect()) == expected


def _gradient(rows, model, spreads, regularisation, weigh=lambda a, b: 1.0):
    """Of the mean logistic loss of the pairs, plus the penalty, by the scaled weights."""
    names = list(spreads)
    scaled = np.array([model.weights[c] * spreads[c] for c in names])
    total, weight = np.zeros(len(names)), 0.0
    for best, other in _pairs(rows):
        d = np.array([((best[c] or 0) - (other[c] or 0)) / spreads[c] for c in names])
        g = weigh(best, other)
        total -= g * d / (1 + np.exp(d @ scaled))
        weight += g
    return total / weight + regularisation * scaled


def test_gradient_is_zero_at_the_fitted_weights(small):
    model = train.train_ranker(small, ["x", "y"], hot=NONE, regularisation=0.01, iterations=200)
    spreads = train.feature_spreads(small, ["x", "y"])
    assert np.abs(_gradient(small.collect(), model, spreads, 0.01)).max() < 1e-4
    away = train.LinearRanker({c: w * 1.5 for c, w in model.weights.items()})
    assert np.abs(_gradient(small.collect(), away, spreads, 0.01)).max() > 1e-2


def test_known_best_weight(spark):
    """A difference of one that wins three times of four has the weight ln 3."""
    rows = []
    for s in range(200):
        better = 1.0 if s % 4 else 0.0
        rows += [(f"{s}a", s, 1, better), (f"{s}b", s, 0, 1.0 - better)]
    df = spark.createDataFrame(rows, "Id string, ranker_id long, selected long, x double")
    model = train.train_ranker(df, ["x"], hot=NONE, regularisation=0.0)
    assert model.weights["x"] == pytest.approx(math.log(3), abs=1e-3)
    sparse = train.train_ranker(df, ["x"], hot=NONE, regularisation=10.0, mixing=1.0)
    assert sparse.weights["x"] == 0.0


def _gains(rows, k):
    """Weight of each pair by its change in NDCG@k, from scores by ``x``."""
    by, result = {}, {}
    for r in rows:
        if r.ranker_id is not None:
            by.setdefault(r.ranker_id, []).append(r)
    place, ideal = {}, {}
    for session, offers in by.items():
        for i, r in enumerate(sorted(offers, key=lambda r: (-r.x, r.Id)), 1):
            place[r.Id] = 1 / np.log2(i + 1) if i <= k else 0.0
        ideal[session] = sum(1 / np.log2(i + 1) for i in range(1, min(k, sum(r.selected for r in offers)) + 1))
    for best, other in _pairs(rows):
        result[best.Id, other.Id] = abs(place[best.Id] - place[other.Id]) / ideal[best.ranker_id]
    return result


@pytest.mark.parametrize("k", [1, 4])
def test_weights_of_a_round(small, k):
    scored = small.withColumn("score", F.col("x"))
    pairs = gain.weighed_pairs(scored, ["y"], k, hot=NONE)
    assert "best_y" in pairs.columns and "best__rank" not in pairs.columns
    found = {(r.best_id, r.other_id): r.gain for r in pairs.collect()}
    assert found == pytest.approx(_gains(small.collect(), k))
    model = train.fit_pairs(pairs, {"y": 1.0}, 0.01, 200, F.col("gain"))
    weigh = lambda best, other: found[best.Id, other.Id]
    assert np.abs(_gradient(small.collect(), model, {"y": 1.0}, 0.01, weigh)).max() < 1e-4


def test_rounds_by_gain(small):
    model, history = gain.train_by_gain(small, ["x", "y"], hot=NONE, rounds=2, tune_share=0.3)
    assert [r.number for r in history] == [0, 1, 2]
    assert max(r.tune_ndcg for r in history) == next(r for r in history if r.model is model).tune_ndcg
    rows = train.score(small.filter(gain.in_tuning("ranker_id", 0.3)), history[1].model)
    assert evaluate.ndcg_at_k(rows, score="score", hot=NONE).first().ndcg == pytest.approx(history[1].tune_ndcg)
    whole, _ = gain.train_by_gain(small, ["x"], hot=NONE, rounds=0, tune_share=0.0)
    plain = train.train_ranker(small, ["x"], hot=NONE)
    assert whole.weights == pytest.approx(plain.weights, rel=1e-6)


def test_gain_holds_on_other_sessions(features):
    learned = features.filter(F.col("part") == "train")
    valid = features.filter(F.col("part") == "valid")
    model, history = gain.train_by_gain(learned, hot=NONE)
    plain = train.train_ranker(learned, hot=NONE)

    def ndcg(m):
        return evaluate.ndcg_at_k(train.score(valid, m), score="score", hot=NONE).first().ndcg

    assert ndcg(model) >= ndcg(plain) - 1e-9
    assert history[0].tune_ndcg <= max(r.tune_ndcg for r in history)


def test_training_beats_the_untrained_order(features):
    valid = features.filter(F.col("part") == "valid")
    model = train.train_ranker(features.filter(F.col("part") == "train"), hot=NONE)
    trained = evaluate.hit_summary(train.score(valid, model), score="score", hot=NONE).collect()
    order = -F.conv(F.substring(F.md5("Id"), 1, 8), 16, 10).cast("double")
    untrained = evaluate.hit_summary(valid.withColumn("score", order), score="score", hot=NONE).collect()
    rates = [{r.k: r.hitrate for r in rows} for rows in (trained, untrained)]
    assert sum(rates[0].values()) > sum(rates[1].values())


def test_rounds_of_boosting(features):
    valid, learned = (features.filter(F.col("part") == p) for p in ("valid", "train"))
    model = train.train_pointwise(learned, rounds=4, depth=3)
    rows = {(r["round"], r.part): r for r in quality.boosting_rounds(features, model).collect()}
    assert set(rows) == {(n, p) for n in (1, 2, 3, 4) for p in ("train", "valid")}
    assembled = model.stages[0].transform(valid.withColumn("selected", F.col("selected").cast("double")))
    losses = model.stages[1].evaluateEachIteration(assembled)
    assert [rows[n, "valid"].error for n in (1, 2, 3, 4)] == pytest.approx(losses, rel=1e-6)
    last = evaluate.ndcg_at_k(train.score(valid, model), score="score", hot=NONE).first().ndcg
    assert rows[4, "valid"].ndcg == pytest.approx(last, abs=5e-3)  # equal chances of different margins tie
    assert rows[4, "train"].sessions == learned.select("ranker_id").distinct().count()


def test_rounds_of_boosting_move_an_offer_once(small, monkeypatch):
    """Offers become rows per round behind the exchange on the session, and not if sessions are oversized."""
    rows = small.withColumn("part", F.when(F.col("ranker_id") % 3 == 0, "valid").otherwise("train"))
    model = train.train_pointwise(rows, ["x"], rounds=3, depth=2, feature_share=1.0)
    measured = quality.boosting_rounds(rows, model)
    above, *below = measured._jdf.queryExecution().executedPlan().toString().split("Generate")
    assert below
    assert above.count("Exchange hashpartitioning") == 1  # the means by round and part
    found = []
    monkeypatch.setattr(quality, "find_hot_groups", lambda df, keys: found.append(find_hot_groups(df, keys, 5)) or found[0])
    apart = quality.boosting_rounds(rows, model).collect()
    assert found[0]
    together = measured.orderBy("round", "part").collect()
    assert len(together) == len(apart) == 6
    for one, other in zip(together, sorted(apart)):
        assert one[:2] == other[:2]
        assert one[2:] == pytest.approx(other[2:])


def test_validation_stops_boosting(spark):
    """A label that the feature tells nothing about: more rounds only fit the rows learned from."""
    rng = random.Random(5)
    rows = [(str(i), i // 5, rng.randrange(2), rng.random(), i % 3 == 0) for i in range(1500)]
    df = spark.createDataFrame(rows, "Id string, ranker_id long, selected long, x double, held boolean")
    stopped = train.train_pointwise(df, ["x"], rounds=15, validation="held", feature_share=1.0)
    assert len(stopped.stages[1].trees) < 15
    assert len(train.train_pointwise(df, ["x"], rounds=15, feature_share=1.0).stages[1].trees) == 15
