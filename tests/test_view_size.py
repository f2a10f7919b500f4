"""What the order view and the jobs on it move, and requests of whole sessions."""

import datetime
import glob
import math
import statistics

import pytest
from pyspark.sql import functions as F

from rankwright.operators import evaluate, groups, split
from rankwright.operators.encode import value_stats
from rankwright.operators.columns import align_schema
from rankwright.operators.rows import route_key, row_features
from rankwright.operators.skew import no_hot_groups
from rankwright.plans.catalog import _labelled_features, _request_file
from rankwright.plans.features import ROUTE, fit_counts
from rankwright.schema import CATEGORIES
from rankwright.sources import readers, tables, writers

_COMPARED = ["Id", "ranker_id", "totalPrice", "total_duration", "l0_seg", "is_direct_leg0"]

DAY = datetime.datetime(1995, 3, 1)


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """One customer with 400 orders of three lines in a year, one of them a repeated line."""
    folder = str(tmp_path_factory.mktemp("shop"))
    lines = [
        (o, 1, 1, n, 1.0 * n, 10.0 * o + n, 0.01 * n, 0.02, "N" if n % 2 else "R", "O", DAY)
        for o in range(400)
        for n in (1, 2, 2)
    ]
    made = {
        "lineitem": lines,
        "orders": [(o, 7, "F", 1.0, DAY, "1-URGENT") for o in range(400)],
        "customer": [(7, "c", 3, 1.0, "MACHINERY")],
        "part": [(1, "p", "b", "ECONOMY", 6, 1.0)],
        "supplier": [(1, "s", 4, 1.0)],
    }
    for name, rows in made.items():
        frame = spark.createDataFrame(rows, tables.TABLE_SCHEMAS[name])
        frame.write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_a_session_is_one_request(spark, shop):
    """All offers of a session, 1200 from 400 orders, are compared with each other."""
    (request,) = tables.session_requests(spark, shop).collect()
    assert request.request_id == "71995" and len(request.flights) == 1200
    assert tables.requests(spark, shop).count() == 400


def test_request_files_are_compressed(spark, shop):
    path = _request_file(tables.session_requests(spark, shop))
    assert glob.glob(f"{path}/*.json.gz") and not glob.glob(f"{path}/*.json")
    assert readers.request_offers(readers.read_requests(spark, path)).count() == 1200


def test_line_items_move_before_they_are_wide(spark, shop):
    for view in (tables.offers(spark, shop), tables.session_requests(spark, shop)):
        plan = view._jdf.queryExecution().optimizedPlan().toString()
        moved = plan[plan.index("RepartitionByExpression") :]
        assert "legs0_duration" not in moved and "concat" not in moved


def test_offers_that_lie_by_session_are_stored_as_they_are(spark, shop, tmp_path):
    view = tables.offers(spark, shop, parts=3)
    writers.write_offers_by_session(view, "lie_by_session", str(tmp_path / "t"), 3, placed=True)
    stored = readers.read_offers_by_session(spark, "lie_by_session")
    assert stored.count() == 1200
    assert "Exchange" not in stored.groupBy("ranker_id").count()._jdf.queryExecution().executedPlan().toString()
    spark.sql("DROP TABLE lie_by_session")


def test_absent_categories_are_counted_once(spark, shop):
    view = tables.offers(spark, shop)
    counts = fit_counts(view)
    rows = align_schema(view).withColumn(ROUTE, route_key())
    plain = value_stats(rows, [*CATEGORIES, ROUTE], "selected")
    assert sorted(map(str, counts.collect())) == sorted(map(str, plain.select(counts.columns).collect()))
    size = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    entries = [f._jdf.queryExecution().analyzed().toString().count("named_struct(feature") for f in (counts, plain)]
    spark.conf.set("spark.sql.debug.maxToStringFields", size)
    assert 0 < entries[0] < entries[1] == len(CATEGORIES) + 1


def test_resampling_hash_is_worked_out_once(spark):
    steps = evaluate.poisson_steps()
    edges = [math.ceil(s * 2**32) for s in steps if math.ceil(s * 2**32) < 2**32]
    numbers = sorted({0, 2**32 - 1, *edges, *(e - 1 for e in edges), *(e + 1 for e in edges if e + 1 < 2**32)})
    drawn = spark.createDataFrame([(n, f"{n:08x}") for n in numbers], "n long, d string")
    for r in drawn.select("n", evaluate._times(F.col("d")).alias("t")).collect():
        assert r.t == sum(r.n / 4294967296.0 >= s for s in steps)
    rows = [(s, f"{s}-{i}", float(i), int(i == s % 13)) for s in range(30) for i in range(13)]
    df = spark.createDataFrame(rows, "ranker_id long, Id string, pred_score double, selected long")
    plan = evaluate.hitrate_bounds(df, rounds=5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1


def test_features_are_split_once(spark, shop, monkeypatch):
    """The cut that the lookups are fitted behind is the one that marks the parts."""
    cuts, real = [], split.session_time_cut
    monkeypatch.setattr(split, "session_time_cut", lambda *a, **k: cuts.append(real(*a, **k)) or cuts[-1])
    features = _labelled_features(spark, shop)
    assert cuts == [DAY]
    assert features.filter("part = 'train'").count() == 1200


def test_a_session_is_sorted_once_by_duration_and_once_by_price(spark, shop):
    view = row_features(align_schema(tables.offers(spark, shop)))
    made = groups.group_features(view.select(*_COMPARED), hot=no_hot_groups(["ranker_id"]))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ASC NULLS LAST], false") == 2
    rows = made.collect()
    for name, value in (("price_rank", "totalPrice"), ("duration_rank", "total_duration")):
        known = [r[value] for r in rows]
        for r in rows[::100]:
            assert r[name] == sum(k < r[value] for k in known) + (known.count(r[value]) + 1) / 2
    middle = statistics.median(r.totalPrice for r in rows)
    spread = statistics.stdev(r.totalPrice for r in rows)
    for r in rows[::100]:
        assert r.price_from_median == pytest.approx((r.totalPrice - middle) / (spread + 1))
