"""Hand-made rows for ties, nulls, one-row sessions, unreadable texts and unseen categories."""

import datetime
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankwright.functions import columns as C
from rankwright.operators import columns as cols
from rankwright.operators import encode, evaluate, groups, ranking, rows
from rankwright.operators.skew import no_hot_groups
from rankwright.schema import CATEGORIES, LATE_SEGMENT_COLUMNS, OFFER_SCHEMA

NONE = no_hot_groups(["ranker_id"])


def values(spark, kind, column, *inputs):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in frame.orderBy("i").select(column(F.col("v"))).collect()]


def test_minutes(spark):
    texts = [None, "", "junk", "02:30:00", "1.02:30:00", "0.15:45:00", "5:30", "3.", ":20:"]
    found = values(spark, "string", C.minutes_of, *texts)
    assert found == [0, 0, 0, 150, 1590, 945, 300, 4320, 20]


def test_minutes_beyond_a_long_count_nothing(spark):
    assert values(spark, "string", C.minutes_of, "99999999999999999999.01:05:00") == [65]


def test_times(spark):
    found = values(
        spark, "string", lambda c: C.weekday_of(C.to_moment(c)), "2025-01-05T10:00:00", "unknown"
    )
    assert found == [7, None]
    assert values(spark, "string", lambda c: C.hour_of(C.to_moment(c)), "2025-01-05T23:59:00") == [23]


def test_small_functions(spark):
    assert values(spark, "string", C.count_slashes, "a/b/c", "", None) == [2, 0, None]
    assert values(spark, "string", C.clock_part, "0.02:30:00", "02:30:00", "3.") == [
        "02:30:00", "02:30:00", "3.",
    ]
    assert values(spark, "string", lambda c: C.one_of(c, ["a"]), "a", "b", None) == [1, 0, None]
    assert values(spark, "double", lambda c: C.ratio(F.lit(1.0), c), 0.0, 2.0) == [None, 0.5]
    assert values(spark, "double", C.log_plus_one, 0.0, -1.0) == [0.0, None]
    assert values(spark, "string", C.to_whole, "12", "x", None) == [12, None, None]
    assert values(spark, "string", lambda c: C.join_text(c, F.lit("_")), "a", None) == ["a_", None]


def offers(spark, *given):
    names = sorted({k for g in given for k in g})
    fields = [f for f in OFFER_SCHEMA.fields if f.name in names]
    data = [tuple(g.get(f.name) for f in fields) for g in given]
    return cols.align_schema(spark.createDataFrame(data, T.StructType(fields)))


def test_align_schema_adds_typed_nulls(spark):
    aligned = offers(spark, {"Id": "a", "totalPrice": 1.0})
    assert aligned.schema.names == OFFER_SCHEMA.names
    assert [f.dataType for f in aligned.schema.fields] == [f.dataType for f in OFFER_SCHEMA.fields]
    flags = spark.createDataFrame([("a", True)], "Id string, isVip boolean")
    assert cols.align_schema(flags).select("isVip").first()[0] == 1.0


def test_price_ratio_without_a_divisor(spark):
    made = rows.row_features(offers(spark, {"Id": "a", "totalPrice": 5.0, "taxes": -1.0}))
    assert made.select("price_per_tax").first()[0] is None


def test_segments_are_counted_on_the_raw_text(spark):
    made = rows.row_features(
        offers(
            spark,
            {"Id": "a", "legs0_duration": "02:00:00", "legs0_segments0_duration": "02:00:00"},
            {
                "Id": "b",
                "legs0_segments0_duration": "01:00:00",
                "legs0_segments2_duration": "01:00:00",
                "legs1_duration": "03:00:00",
                "legs1_segments0_duration": "03:00:00",
                "legs1_segments0_departureFrom_airport_iata": "LED",
            },
        )
    )
    names = ["n_segments_leg0", "n_segments_leg1", "is_direct_leg0", "is_direct_leg1", "is_one_way"]
    found = {r.Id: tuple(r[n] for n in names) for r in made.select("Id", *names).collect()}
    assert found == {"a": (1, 0, 1, 0, 1), "b": (2, 1, 0, 1, 0)}


def test_times_default_when_unreadable(spark):
    made = rows.row_features(
        offers(
            spark,
            {"Id": "a", "legs0_departureAt": "soon"},
            {"Id": "b", "legs0_departureAt": "2025-01-05T08:15:00"},
        )
    )
    names = [f"legs0_departureAt_{p}" for p in ("hour", "weekday", "business_time")]
    found = {r.Id: tuple(r[n] for n in names) for r in made.select("Id", *names).collect()}
    assert found == {"a": (12, 0, 0), "b": (8, 7, 1)}


def _session(spark, *prices):
    return groups.group_features(
        rows.row_features(
            offers(
                spark,
                *[{"Id": f"o{i}", "ranker_id": 1, "totalPrice": p} for i, p in enumerate(prices)],
            )
        ),
        hot=NONE,
    )


def test_average_ranks(spark):
    made = _session(spark, 10.0, 10.0, 30.0, None).orderBy("Id").collect()
    assert [r.price_rank for r in made] == [1.5, 1.5, 3.0, None]
    assert [r.price_pct_rank for r in made] == [0.5, 0.5, 1.0, None]
    assert [r.group_size for r in made] == [4] * 4
    assert [r.is_cheapest for r in made] == [1, 1, 0, None]


def test_one_row_session(spark):
    made = _session(spark, 10.0)
    assert made.select("price_from_median").first()[0] is None
    filled = cols.fill_by_type(made)
    assert filled.select("price_from_median").first()[0] == 0.0


def test_fill_by_type(spark):
    given = spark.createDataFrame(
        [(None, None, None, float("nan"))], "n int, s string, b boolean, d double"
    )
    filled = cols.fill_by_type(given).first()
    assert (filled.n, filled.s, filled.b) == (0, "missing", None)
    assert math.isnan(filled.d)


def test_feature_selection(spark):
    names = cols.feature_names(offers(spark, {"Id": "a"}))
    assert not set(names) & (set(LATE_SEGMENT_COLUMNS) | {"Id", "ranker_id", "frequentFlyer"})
    assert set(CATEGORIES) <= set(names)
    with pytest.raises(ValueError, match="carrier9_pop"):
        cols.validate_features(offers(spark, {"Id": "a"}), ["totalPrice", "carrier9_pop"])


def test_codes_of_unseen_and_missing_values(spark):
    fit = spark.createDataFrame([("b", 10), ("a", 9), ("missing", 100)], "s string, n int")
    codes = encode.fit_codes(fit, ["s", "n"])
    found = {(r.feature, r.value): r.code for r in codes.collect()}
    assert found == {
        ("s", "a"): 0, ("s", "b"): 1, ("s", "missing"): 2,
        ("n", "9"): 0, ("n", "10"): 1, ("n", "100"): 2,
    }
    given = spark.createDataFrame(
        [("1", "a", 100), ("2", "zz", 11), ("3", None, None)], "Id string, s string, n int"
    )
    coded = encode.apply_codes(cols.fill_by_type(given), codes, ["s", "n"]).orderBy("Id")
    assert [(r.s, r.n) for r in coded.collect()] == [(0, 2), (-1, -1), (2, -1)]


def scored(spark, sizes, chosen):
    """Sessions of given sizes, scores falling with the id, chosen offer at a given place."""
    data = [
        (f"{s}-{i:03d}", s, float(size - i), int(chosen.get(s) == i + 1))
        for s, size in sizes.items()
        for i in range(size)
    ]
    return spark.createDataFrame(data, "Id string, ranker_id int, pred_score double, selected int")


def test_hitrate_counts_large_sessions_and_misses(spark):
    frame = scored(spark, {1: 10, 2: 11, 3: 12, 4: 13}, {1: 1, 2: 3, 3: 4})
    assert evaluate.hitrate_at_k(frame, hot=NONE).first()[0] == pytest.approx(1 / 3)
    curve = {r.k: r.hitrate for r in evaluate.hitrate_curve(frame, hot=NONE).collect()}
    assert curve[3] == pytest.approx(1 / 3) and curve[4] == pytest.approx(2 / 3)
    assert [curve[k] for k in sorted(curve)] == sorted(curve.values())
    summary = {r.k: r.hitrate for r in evaluate.hit_summary(frame, hot=NONE).collect()}
    assert summary == {k: curve[k] for k in (1, 3, 5, 10)}


def test_ndcg(spark):
    frame = scored(spark, {1: 5, 2: 5, 3: 5}, {1: 2, 2: 4})
    wanted = (1 / math.log2(3) + 0 + 1) / 3
    assert evaluate.ndcg_at_k(frame, hot=NONE).first()[0] == pytest.approx(wanted)


def test_equal_session_sizes_share_a_bin(spark):
    frame = scored(spark, {s: 12 for s in range(4)}, {0: 1})
    made = evaluate.hitrate_by_size_bin(frame, hot=NONE).collect()
    assert [(r.hitrate, r.n_groups) for r in made] == [(0.25, 4)]
    assert made[0].bin_center == pytest.approx(12)


def test_few_sessions_make_no_bin(spark):
    frame = scored(spark, {1: 11, 2: 30, 3: 30, 4: 30}, {})
    made = evaluate.hitrate_by_size_bin(frame, hot=NONE).collect()
    assert [(r.bin_idx, r.n_groups) for r in made] == [(50, 3)]


def test_ties_and_missing_scores(spark):
    data = [("b", 1, 5.0), ("a", 1, 5.0), ("c", 1, None), ("d", 1, float("nan")), ("e", 1, 9.0)]
    frame = spark.createDataFrame(data, "Id string, ranker_id int, pred_score double")
    ranked = ranking.rank_in_group(frame, hot=NONE).orderBy("rank").collect()
    assert [(r.Id, r["rank"]) for r in ranked] == [("e", 1), ("a", 2), ("b", 3), ("c", 4), ("d", 5)]


def test_display(spark):
    data = [("a", 1, 1, 2.0, "MOWLED", "0.02:30:00", 1234567.5, 0.12345, "SU"),
            ("b", 1, 2, 3.0, "MOWLED", "02:30:00", 85000.0, 0.1, "S7")]
    schema = (
        "Id string, ranker_id int, rank int, legs0_segments0_cabinClass double, searchRoute string,"
        " legs0_duration string, totalPrice double, score double,"
        " legs0_segments0_marketingCarrier_code string"
    )
    shown = ranking.present_ranked(spark.createDataFrame(data, schema)).orderBy("position").collect()
    first, second = shown
    assert (first.is_best_choice, first.cabin, first.price) == (1, "Premium", "1,234,567.5")
    assert (first.origin, first.destination, first.duration) == ("MOW", "LED", "02:30:00")
    assert (first.score, second.cabin, second.price) == (0.123, "Economy", "85,000")


def test_time_zone_of_the_session_does_not_matter(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        found = values(spark, "string", C.to_moment, "2025-03-30T02:30:00")
        assert found == [datetime.datetime(2025, 3, 30, 2, 30)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
