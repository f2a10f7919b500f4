"""Training moves an offer at most once, and not at all where the features lie by session."""

import pytest
from pyspark.sql import functions as F

from rankwright.operators import gain, quality, train
from rankwright.operators.skew import find_hot_groups, no_hot_groups
from rankwright.plans.catalog import _labelled_features
from rankwright.sources import tables

NONE = no_hot_groups(["ranker_id"])
PAIRS = ["ranker_id", "other_id", "other_x", "other_y", "best_id", "best_x", "best_y"]


@pytest.fixture(scope="module")
def rows(spark):
    """Sessions with none to four chosen offers, ids that are null or come twice, a label that is missing."""
    made = []
    for s in range(40):
        for i in range(s % 9 + 1):
            made.append((f"{s}-{i}", s, int(i < s % 5), float(i * s % 7), None if i == 2 else float(i)))
    made += [("3-0", 3, 1, 9.0, 9.0), (None, 3, 0, 1.0, 1.0), (None, 7, 1, 2.0, 2.0)]
    made += [("lost", None, 1, 1.0, 1.0), ("unknown", 8, None, 1.0, 1.0), ("9-9", 9, 0, 1.0, 1.0), ("9-9", 9, 0, 1.0, 1.0)]
    return spark.createDataFrame(made, "Id string, ranker_id long, selected long, x double, y double").cache()


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("meetings", [1, 2, None])
def test_pairs_move_an_offer_once(rows, meetings):
    made = train.make_pairs(rows, ["x", "y"], hot=NONE, meetings=meetings)
    assert made.columns == PAIRS
    assert _exchanges(made) == 1
    hot = find_hot_groups(rows, ["ranker_id"], 4)
    assert hot
    apart = train.make_pairs(rows, ["x", "y"], hot=hot, meetings=meetings)
    # which of two chosen offers of one id comes first is open
    known = [c for c in PAIRS if not c.startswith("best_") or c == "best_id"]
    assert sorted(map(str, made.select(known).collect())) == sorted(map(str, apart.select(known).collect()))


def test_permuted_offers_move_once(rows):
    model = train.LinearRanker({"x": 1.0, "y": -0.5})
    found = quality.permutation_importance(rows, model, ["x", "y"], hot=NONE)
    above, *below = found._jdf.queryExecution().executedPlan().toString().split("Generate")
    assert below
    assert above.count("Exchange hashpartitioning") == 1  # the means by feature


@pytest.fixture(scope="module")
def stored(spark):
    return _labelled_features(spark, "/root/testdata/sf0.001", by_session=True)


def test_features_by_session_are_the_features(spark, stored):
    plain = _labelled_features(spark, "/root/testdata/sf0.001")
    assert stored.schema == plain.schema
    assert stored.exceptAll(plain).isEmpty() and plain.exceptAll(stored).isEmpty()
    assert len(stored.inputFiles()) <= tables.parts_for(spark, "/root/testdata/sf0.001")


def test_pairs_of_stored_features_stay_in_place(stored):
    learned = stored.filter(F.col("part") == "train")
    assert _exchanges(train.make_pairs(learned, ["price_rank"], hot=NONE)) == 0
    scored = train.score(learned, train.LinearRanker({"price_rank": -1.0}))
    assert _exchanges(gain.weighed_pairs(scored, ["price_rank"], hot=NONE)) == 0


def test_stored_rows_are_not_written_again(stored, monkeypatch):
    learned = stored.filter(F.col("part") == "train")
    first = gain.train_by_gain(learned, ["price_rank", "log_price"], hot=NONE, rounds=1)[1]
    monkeypatch.setattr(gain, "write_table", None)
    second = gain.train_by_gain(learned, ["price_rank", "log_price"], hot=NONE, rounds=1, stored=True)[1]
    for one, other in zip(first, second):
        assert one.model.weights == pytest.approx(other.model.weights, rel=1e-6)
        assert (one.fit_ndcg, one.tune_ndcg) == pytest.approx((other.fit_ndcg, other.tune_ndcg))


def test_tasks_rank_few_margins(spark):
    """Twenty million margins are dealt so that a task holds half a million of them."""
    assert quality._parts_for(spark.range(1_000_000), 20) >= 40
