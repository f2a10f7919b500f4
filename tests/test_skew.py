"""Oversized groups must give what the plain windows give, with no group in one task."""

import random

import pytest
from compare import rows_of
from pyspark.sql import Window
from pyspark.sql import functions as F

from rankwright.operators import encode, evaluate, groups, lookups, ranking, split, train
from rankwright.operators import columns as cols
from rankwright.operators import skew

PER_TASK = 40


@pytest.fixture(scope="module")
def rows(spark):
    """600 offers: a third in one session, with heavy price ties and nulls there."""
    rng = random.Random(7)
    made = []
    for i in range(600):
        # the crowded sessions are one with an id and the one without
        session = 1 if i % 3 == 0 else None if i % 5 == 0 else rng.randrange(2, 40)
        price = None if rng.random() < 0.1 else float(rng.choice([10, 10, 10, rng.randrange(100)]))
        chosen = int(i % 97 == 0)
        score = None if rng.random() < 0.05 else float(rng.randrange(12))
        carrier = None if rng.random() < 0.4 else rng.choice(["SU", "SU", "S7", "XX", "YY"])
        made.append(
            (f"o{i:04d}", session, price, rng.randrange(5), int(rng.random() < 0.5),
             rng.randrange(300), chosen, score, carrier, rng.randrange(50))
        )
    schema = (
        "Id string, ranker_id long, totalPrice double, l0_seg int, is_direct_leg0 int,"
        " total_duration long, selected long, pred_score double, carrier string, day long"
    )
    return spark.createDataFrame(made, schema).repartition(5).cache()


@pytest.fixture(scope="module")
def hot(rows):
    found = skew.find_hot_groups(rows, ["ranker_id"], PER_TASK)
    assert found and found.slices > 2
    return found


def same(left, right):
    assert set(left.columns) == set(right.columns)
    columns = sorted(left.columns)
    a = rows_of(columns, left.select(columns).collect())
    b = rows_of(columns, right.select(columns).collect())
    assert a == b


NONE = skew.no_hot_groups(["ranker_id"])


def test_hot_groups_are_few_and_exact(rows, hot):
    counted = {r.ranker_id: r["count"] for r in rows.groupBy("ranker_id").count().collect()}
    wanted = {k: n for k, n in counted.items() if n > PER_TASK}
    assert {r.ranker_id: r._hot_rows for r in hot.table.collect()} == wanted
    assert not skew.find_hot_groups(rows, ["ranker_id"], 1000)


def test_hot_limit_grows_with_the_input(rows, monkeypatch):
    monkeypatch.setattr(skew, "MAX_HOT_GROUPS", 4)
    found = skew.find_hot_groups(rows, ["ranker_id"], 1)
    assert found.rows_per_task == 150
    assert found.table.count() == 1


def test_group_stats(rows, hot):
    stats = {"low": F.min("totalPrice"), "n": F.count("Id"), "sd": F.stddev_samp("totalPrice")}
    same(
        skew.with_group_stats(rows, ["ranker_id"], stats, hot).withColumn("sd", F.round("sd", 6)),
        skew.with_group_stats(rows, ["ranker_id"], stats, NONE).withColumn("sd", F.round("sd", 6)),
    )


@pytest.mark.parametrize("weight", [None, "day"])
def test_running_total(rows, hot, weight):
    order = [F.col("pred_score").desc_nulls_last(), F.col("Id")]
    amount = None if weight is None else F.col(weight)
    same(
        skew.running_total(rows, ["ranker_id"], order, "before", amount, hot),
        skew.running_total(rows, ["ranker_id"], order, "before", amount, NONE),
    )


def test_running_total_over_the_whole_table(rows):
    sliced = skew.running_total(rows, [], [F.col("Id")], "before", rows_per_task=50)
    places = [(r.Id, r.before) for r in sliced.select("Id", "before").collect()]
    assert sorted(places) == [(f"o{i:04d}", i) for i in range(600)]


@pytest.mark.parametrize("small", [True, False])
def test_lookup_join(spark, rows, small):
    table = spark.createDataFrame([("SU", 0.5), ("S7", 0.25), ("ZZ", 1.0)], "carrier string, p double")
    joined = skew.lookup_join(rows, table, ["carrier"], small, rows_per_task=30)
    same(joined, rows.join(table, ["carrier"], "left"))


def test_group_features(rows, hot):
    names = ["Id", *groups.GROUP_FEATURES]
    made = groups.group_features(rows, hot=hot).select(*names)
    plain = groups.group_features(rows, hot=NONE).select(*names)
    same(made, plain)
    assert made.filter(F.col("price_rank") % 1 != 0).count() > 0


def test_average_rank_against_brute_force(rows, hot):
    made = {r.Id: r for r in groups.group_features(rows, hot=hot).collect()}
    prices = {}
    for r in made.values():
        prices.setdefault(r.ranker_id, []).append(r.totalPrice)
    for r in made.values():
        known = [p for p in prices[r.ranker_id] if p is not None]
        if r.totalPrice is None:
            assert r.price_rank is None
            continue
        below = sum(p < r.totalPrice for p in known)
        ties = sum(p == r.totalPrice for p in known)
        assert r.price_rank == below + (ties + 1) / 2
        assert r.price_pct_rank == pytest.approx(r.price_rank / len(known))


def test_ranking(rows, hot):
    same(ranking.rank_in_group(rows, hot=hot), ranking.rank_in_group(rows, hot=NONE))
    same(
        ranking.top_k_per_group(rows, 150, hot=hot),
        ranking.rank_in_group(rows, hot=NONE).filter("rank <= 150"),
    )
    same(
        ranking.top_k_per_group(rows, 3),
        ranking.rank_in_group(rows, hot=NONE).filter("rank <= 3"),
    )


def test_top_k_is_cut_before_the_shuffle(rows):
    plan = ranking.top_k_per_group(rows, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_session_measures(rows, hot):
    same(evaluate.session_outcomes(rows, hot=hot), evaluate.session_outcomes(rows, hot=NONE))
    same(evaluate.ndcg_at_k(rows, hot=hot), evaluate.ndcg_at_k(rows, hot=NONE))
    same(cols.keep_large_groups(rows, hot=hot), cols.keep_large_groups(rows, hot=NONE))
    same(
        lookups.with_direct_cheapest(rows, hot=hot), lookups.with_direct_cheapest(rows, hot=NONE)
    )


def test_best_rank_is_that_of_the_ranking(rows, hot):
    best = (
        ranking.rank_in_group(rows, hot=NONE)
        .filter("selected = 1")
        .groupBy("ranker_id")
        .agg(F.min("rank").cast("long").alias("best_rank"))
    )
    found = evaluate.session_outcomes(rows, hot=hot).filter("chosen > 0")
    same(found.select("ranker_id", "best_rank"), best)


def test_pairs_cover_every_other_offer_once(rows, hot):
    pairs = train.make_pairs(rows, ["totalPrice"], hot=hot)
    same(pairs, train.make_pairs(rows, ["totalPrice"], hot=NONE))
    chosen = {}
    for r in rows.filter("selected = 1").collect():
        chosen.setdefault(r.ranker_id, set()).add(r.Id)
    assert max(len(ids) for ids in chosen.values()) > 1
    others = [r.Id for r in rows.filter("selected = 0 AND ranker_id IS NOT NULL").collect() if r.ranker_id in chosen]
    made = pairs.collect()
    assert sorted(r.other_id for r in made) == sorted(others)
    assert all(r.best_id in chosen[r.ranker_id] for r in made)


def test_pages_hold_every_offer(rows, hot):
    requests = rows.withColumn("request_id", F.col("ranker_id").cast("string"))
    one = ranking.rank_requests(requests, "pred_score", hot=skew.no_hot_groups(["request_id"]))
    paged = ranking.rank_requests(
        requests, "pred_score", page_rows=7, hot=skew.no_hot_groups(["request_id"])
    )
    assert "page" not in one.columns
    whole = {r.request_id: [f.Id for f in r.ranked_flights] for r in one.collect()}
    parts = {}
    for r in sorted(paged.collect(), key=lambda r: (str(r.request_id), r.page)):
        assert len(r.ranked_flights) <= 7
        parts.setdefault(r.request_id, []).extend(f.Id for f in r.ranked_flights)
    assert parts == whole


def test_codes_in_slices(rows):
    named = rows.select("Id", "carrier", "total_duration", "totalPrice")
    features = ["Id", "carrier", "total_duration", "totalPrice"]
    sliced = encode.fit_codes(named, features, rows_per_task=20)
    same(sliced, encode.fit_codes(named, features))
    durations = sorted({r.total_duration for r in rows.collect()})
    wanted = {str(v): i for i, v in enumerate(durations)}
    found = sliced.filter("feature = 'total_duration'").collect()
    assert {r.value: r.code for r in found} == wanted


def test_time_cut_in_slices(rows):
    plain = split.session_time_cut(rows, "day", 0.9)
    assert split.session_time_cut(rows, "day", 0.9, rows_per_task=3) == plain
    times = sorted(
        r.t for r in rows.groupBy("ranker_id").agg(F.min("day").alias("t")).collect()
    )
    assert plain == next(t for i, t in enumerate(times, 1) if i >= 0.9 * len(times))


def test_no_session_straddles_the_split(rows, hot):
    parts = split.time_split(rows, "day", 0.7, hot=hot)
    same(parts, split.time_split(rows, "day", 0.7, hot=NONE))
    assert parts.groupBy("ranker_id").agg(F.countDistinct("part").alias("n")).filter("n > 1").count() == 0
    assert {r.part for r in parts.select("part").distinct().collect()} == {"train", "valid"}


def test_one_exchange_serves_all_session_features(rows):
    made = groups.group_features(rows, hot=NONE)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(ranker_id") == 1


def test_window_over_many_partitions_agrees(rows):
    ordered = Window.partitionBy("ranker_id").orderBy(*ranking.score_order())
    plain = rows.withColumn("rank", F.row_number().over(ordered))
    same(ranking.rank_in_group(rows), plain)


def test_broadcast_budget_is_shared(spark, monkeypatch):
    rows = [("a", "x", 7), ("b", "yy", 0), ("b", "zz", 1), ("c", "w" * 50, 0)]
    codes = spark.createDataFrame(rows, "feature string, value string, code int")
    monkeypatch.setattr(encode, "BROADCAST_TOTAL_BYTES", 60)
    sizes = encode.measure_codes(codes)
    assert {name: size.small for name, size in sizes.items()} == {"a": True, "b": True, "c": False}
    assert sizes["a"].only == ("x", 7) and sizes["b"].only is None


def test_offers_bucketed_by_session_need_no_exchange(spark, rows, tmp_path):
    spark.sql("DROP TABLE IF EXISTS bucketed_offers")
    rows.write.bucketBy(4, "ranker_id").option("path", str(tmp_path / "b")).saveAsTable(
        "bucketed_offers"
    )
    stored = spark.table("bucketed_offers")
    made = groups.group_features(stored, hot=NONE)
    assert "hashpartitioning" not in made._jdf.queryExecution().executedPlan().toString()
    names = ["Id", "price_rank", "group_size"]
    same(made.select(*names), groups.group_features(rows, hot=NONE).select(*names))
    spark.sql("DROP TABLE bucketed_offers")


def test_large_dictionaries_give_the_same_codes(rows):
    given = rows.select("Id", "carrier", "total_duration")
    features = ["carrier", "total_duration"]
    codes = encode.fit_codes(given.filter("Id < 'o0300'"), features)
    large = {c: encode.Dictionary(False) for c in features}
    same(
        encode.apply_codes(given, codes, features, large, rows_per_task=30),
        encode.apply_codes(given, codes, features),
    )


def test_group_features_with_ranks_too_large_to_broadcast(rows, hot, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    names = ["Id", *groups.GROUP_FEATURES]
    made = groups.group_features(rows, hot=hot).select(*names)
    same(made, groups.group_features(rows, hot=NONE).select(*names))


def test_group_size_may_come_first(rows, hot):
    names = ["Id", *groups.GROUP_FEATURES]
    plain = groups.group_features(rows, hot=NONE).select(*names)
    for known in (hot, NONE):
        sized = groups.with_offer_count(rows, hot=known)
        same(groups.group_features(sized, hot=known).select(*names), plain)


def test_large_dictionaries_search_hot_values_once(rows, monkeypatch):
    features = ["carrier", "l0_seg", "day"]
    codes = encode.fit_codes(rows, features)
    plain = encode.apply_codes(rows, codes, features)
    searched = []

    def counted(df, keys, rows_per_task):
        searched.append(sorted(keys))
        assert "Join" not in df._jdf.queryExecution().analyzed().toString()
        return skew.find_hot_keys(df, keys, rows_per_task)

    monkeypatch.setattr(encode, "find_hot_keys", counted)
    large = {c: encode.Dictionary(False) for c in features}
    spread = encode.apply_codes(rows, codes, features, large, rows_per_task=PER_TASK)
    same(spread, plain)
    assert searched == [[f"_value_{c}" for c in sorted(features)]]
