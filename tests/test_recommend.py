"""Requests to responses: the two-flight payload, batch against stream, models."""

import json

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from rankwright.operators import encode, evaluate, train
from rankwright.operators.skew import no_hot_groups
from rankwright.operators.ranking import rank_requests
from rankwright.plans.catalog import _labelled_features, fixed_score, tidy
from rankwright.plans.features import build_features, fit_artifacts, load_artifacts, load_fitted_files, save_artifacts
from rankwright.plans.recommend import recommend
from rankwright.schema import CARRIER_COLUMNS
from rankwright.sources import readers, tables
from rankwright.sources.readers import read_requests, request_offers
from rankwright.streaming.requests import read_request_stream, recommend_stream

# Two offers made up for these tests: one dear, direct and short, one cheap with three segments.
OURS = {
    "ranker_id": 41,
    "flights": [
        {
            "Id": "a",
            "totalPrice": 700.5,
            "taxes": 70.5,
            "legs0_duration": "01:40:00",
            "legs0_segments0_duration": "01:40:00",
            "searchRoute": "AAABBB",
        },
        {
            "Id": "b",
            "totalPrice": 120.0,
            "legs0_duration": "1.02:00:00",
            "legs0_segments0_duration": "02:00:00",
            "legs0_segments1_duration": "03:00:00",
            "searchRoute": "AAABBB",
        },
    ],
}


@pytest.fixture(scope="module")
def artifacts(spark, folder):
    return fit_artifacts(tables.offers(spark, folder))


def write_lines(path, *requests):
    path.mkdir(exist_ok=True)
    (path / "requests.json").write_text("\n".join(json.dumps(r) for r in requests))
    return str(path)


def test_features_of_a_request(spark, artifacts, tmp_path):
    requests = read_requests(spark, write_lines(tmp_path / "in", OURS))
    built = build_features(
        request_offers(requests), artifacts, "request_id", hot=no_hot_groups(["request_id"])
    )
    a, b = built.orderBy("Id").collect()
    assert (a.total_duration, b.total_duration) == (100, 1560)
    assert (a.is_cheapest, b.is_cheapest) == (0, 1)
    assert (a.price_rank, b.price_rank) == (2.0, 1.0)
    assert (a.n_segments_leg0, b.n_segments_leg0) == (1, 2)
    for row in (a, b):
        assert row.group_size == 2 and row.is_one_way == 1


def test_one_response_for_each_request(spark, artifacts, tmp_path):
    """Requests with one id are not compared with each other, as a retried request would be."""
    named = {**OURS, "request_id": "same"}
    requests = read_requests(spark, write_lines(tmp_path / "in", named, named, OURS))
    response = recommend(requests, artifacts, F.col("group_size") - F.col("totalPrice"), [])
    response = response.collect()
    assert sorted(r.request_id == "same" for r in response) == [False, True, True]
    for r in response:
        assert [(f.Id, f.score) for f in r.ranked_flights] == [("b", -118.0), ("a", -698.5)]


def test_rejected_requests(spark, artifacts, tmp_path):
    path = write_lines(
        tmp_path / "in",
        OURS,
        {"ranker_id": 5, "flights": []},
        {"ranker_id": 6},
        {"ranker_id": 7, "flights": [{"Id": "x", "totalPrice": "much"}]},
    )
    with open(f"{path}/requests.json", "a") as lines:
        lines.write('\n\n{"ranker_id": 8, "fli')
    rejected = readers.rejected_requests(spark, path).collect()
    assert sorted(r.reason for r in rejected) == ["empty", "empty", "unreadable", "unreadable"]
    requests = read_requests(spark, path)
    assert recommend(requests, artifacts, -F.col("totalPrice"), []).count() == 1


def test_only_needed_categories_are_coded(spark, artifacts, tmp_path):
    requests = read_requests(spark, write_lines(tmp_path / "in", OURS))
    model = train.LinearRanker({"price_rank": 1.0, "group_size": 0.5})
    plan = recommend(requests, artifacts, model)._jdf.queryExecution().analyzed().toString()
    assert "_code_" not in plan


def test_fitted_files(spark, tmp_path):
    folder = tmp_path / "fitted"
    folder.mkdir()
    for leg, name in enumerate(CARRIER_COLUMNS):
        rows = spark.createDataFrame([("X", 0.25)], f"{name} string, carrier{leg}_pop double")
        rows.write.parquet(f"{folder}/carrier{leg}_pop.parquet")
    routes = spark.createDataFrame([("AB_BA", 3)], "round_trip_route string, rt_route_count long")
    routes.write.parquet(f"{folder}/round_trip_freq.parquet")
    mapping = {"nationality": {"36": 7}, "sex": {"0": 0, "1": 1}}
    (folder / "cat_mappings.json").write_text(json.dumps(mapping))
    fitted = load_fitted_files(spark, str(folder))
    frame = spark.createDataFrame([("i", 36, 1), ("j", 37, 2)], "Id string, nationality long, sex long")
    coded = encode.apply_codes(frame, fitted.codes, ["nationality", "sex"], fitted.dictionaries)
    assert sorted(map(tuple, coded.collect())) == [("i", 7, 1), ("j", -1, -1)]


def test_stream_agrees_with_batch(spark, folder, artifacts, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    tables.requests(spark, folder).repartition(3).write.json(path)
    stream = read_request_stream(spark, path, files_per_trigger=1)
    recommend_stream(
        stream, artifacts, fixed_score(), out, str(tmp_path / "progress")
    ).awaitTermination()
    batch = recommend(read_requests(spark, path), artifacts, fixed_score())
    streamed = spark.read.schema(batch.schema).json(out)
    assert len(list((tmp_path / "out").iterdir())) == 3

    def responses(frame):
        return {r.request_id: [(f.Id, f.score) for f in r.ranked_flights] for r in frame.collect()}

    assert responses(streamed) == responses(batch)


def test_artifacts_round_trip(spark, artifacts, tmp_path):
    save_artifacts(artifacts, str(tmp_path / "saved"))
    loaded = load_artifacts(spark, str(tmp_path / "saved"))
    assert loaded.codes.exceptAll(artifacts.codes).count() == 0
    assert loaded.routes.exceptAll(artifacts.routes).count() == 0
    assert loaded.dictionaries == artifacts.dictionaries
    assert loaded.small_carriers == {0: True, 1: True} and loaded.small_routes


@pytest.fixture(scope="module")
def features(spark, folder):
    return _labelled_features(spark, folder)


def test_scoring_features_agree_with_training_features(spark, folder, artifacts):
    names = ["Id", *train.RANKER_FEATURES]
    offers = tables.offers(spark, folder)
    # The standard deviation's last digits depend on the order of the rows.
    asked = offers.withColumn("request_id", F.substring_index("Id", "-", 1))
    trained = tidy(build_features(asked, artifacts, "request_id"), *names, digits=9)
    one_each = tables.requests(spark, folder)
    served = build_features(
        request_offers(one_each), artifacts, "request_id", hot=no_hot_groups(["request_id"])
    )
    served = tidy(served, *names, digits=9)
    assert trained.count() == served.count()
    assert trained.exceptAll(served).count() == 0


def test_linear_ranker_learns(spark, features, tmp_path):
    """The label is re-made to follow price, so that there is something to learn."""
    cheapest = features.withColumn("selected", (F.col("price_rank") == 1).cast("long"))
    model = train.train_ranker(cheapest.filter("part = 'train'"))
    scored = train.score(cheapest.filter("part = 'valid'"), model)
    learned = evaluate.hitrate_at_k(scored, score="score").first()[0]
    fixed = evaluate.hitrate_at_k(scored).first()[0]
    assert learned > 0.9 > fixed
    model.save(spark, str(tmp_path / "ranker"))
    again = train.LinearRanker.load(spark, str(tmp_path / "ranker"))
    assert again.weights == model.weights
    top = train.feature_importance(spark, model).first()
    assert top.importance == max(abs(w) for w in model.weights.values())


def test_trees_learn_and_reload(spark, features, artifacts, folder, tmp_path):
    cheapest = features.withColumn("selected", F.col("is_cheapest").cast("long"))
    model = train.train_pointwise(cheapest, ["price_pct_rank", "is_cheapest", "l0_seg"], depth=2, rounds=2, feature_share=1.0)
    scored = train.score(cheapest, model)
    assert evaluate.hitrate_at_k(scored, score="score", k=1).first()[0] == 1.0
    importance = train.feature_importance(spark, model).collect()
    assert importance[0].feature in ("is_cheapest", "price_pct_rank")
    model.save(str(tmp_path / "trees"))
    again = PipelineModel.load(str(tmp_path / "trees"))
    ranked = recommend(tables.requests(spark, folder), artifacts, again)
    assert ranked.select(F.sum(F.size("ranked_flights"))).first()[0] == features.count()


def test_a_long_request_is_answered_as_one(spark, artifacts, tmp_path):
    """Thousands of offers are compared with one another and come back in one row."""
    flights = [{"Id": f"f{i:05d}", "totalPrice": 100.0 + (i * 7919) % 4000} for i in range(4000)]
    requests = read_requests(spark, write_lines(tmp_path / "in", {"ranker_id": 5, "flights": flights}))
    answers = recommend(requests, artifacts, -F.col("price_rank") - F.col("group_size") * 1e-6).collect()
    assert len(answers) == 1
    expected = [f["Id"] for f in sorted(flights, key=lambda f: f["totalPrice"])]
    assert [e.Id for e in answers[0].ranked_flights] == expected
    assert answers[0].ranked_flights[0].score == pytest.approx(-1 - 4000e-6)


def test_first_offers_of_a_request(spark):
    rows = [(str(r), r, f"{i:03d}", float(i * 37 % 50) if i % 9 else None) for r in range(3) for i in range(r * 60)]
    df = spark.createDataFrame(rows, "request_id string, ranker_id long, Id string, score double")
    whole = {r.request_id: r.ranked_flights for r in rank_requests(df, hot=no_hot_groups(["request_id"])).collect()}
    for first in (1, 7, 1000):
        cut = rank_requests(df, hot=no_hot_groups(["request_id"]), first=first)
        assert {r.request_id: r.ranked_flights for r in cut.collect()} == {k: v[:first] for k, v in whole.items()}
    pruned = rank_requests(df, hot=no_hot_groups(["request_id"]), first=7)
    assert "WindowGroupLimit" in pruned._jdf.queryExecution().executedPlan().toString()
