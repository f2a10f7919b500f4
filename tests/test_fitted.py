"""Counts that add up, codes that stay, saves that break off, requests sent again."""

import json

import pytest
from pyspark.sql import functions as F

from rankwright.operators import encode
from rankwright.plans import features
from rankwright.plans.features import (
    artifacts_from_counts,
    fit_artifacts,
    fit_counts,
    load_artifacts,
    load_counts,
    merge_counts,
    save_artifacts,
    save_counts,
)
from rankwright.schema import CARRIER_COLUMNS
from rankwright.sources import tables
from rankwright.streaming.requests import read_request_stream, recommend_stream


@pytest.fixture(scope="module")
def view(spark, folder):
    return tables.offers(spark, folder).cache()


def _contents(artifacts):
    lookups = [*artifacts.carriers.values(), artifacts.routes, artifacts.codes.select("feature", "value", "code")]
    return [sorted(map(tuple, t.collect()), key=repr) for t in lookups]


def test_counts_of_days_add_up(spark, view, tmp_path):
    whole = fit_artifacts(view)
    parts = [view.filter(F.pmod(F.hash("Id"), F.lit(4)) == n) for n in range(4)]
    merged = merge_counts(*[fit_counts(p) for p in parts[:2]])
    folder = str(tmp_path / "counts")
    save_counts(merged, folder, "first")
    save_counts(fit_counts(parts[2]), folder, "second")
    save_counts(fit_counts(parts[3]), folder, "third")
    save_counts(fit_counts(parts[3]), folder, "third")  # again: replaced, not added
    assert _contents(artifacts_from_counts(load_counts(spark, folder))) == _contents(whole)
    some = fit_artifacts(parts[2].unionByName(parts[3]))
    assert _contents(artifacts_from_counts(load_counts(spark, folder, ["second", "third"]))) == _contents(some)
    with pytest.raises(ValueError):
        save_counts(merged, folder, "a/b")


def test_counts_of_nothing(spark, view):
    counts = merge_counts(fit_counts(view.limit(0)), fit_counts(view.withColumn("selected", F.lit(None).cast("long"))))
    unlabelled = artifacts_from_counts(counts)
    assert unlabelled.carriers[0].filter("carrier0_pop IS NOT NULL").count() == 0
    assert unlabelled.routes.count() == fit_artifacts(view).routes.count()


def _stats(spark, *values):
    rows = [(f, None if v is None else str(v), v if isinstance(v, int) else None, None) for f, v in values]
    return spark.createDataFrame(rows, "feature string, value string, whole long, real double")


def test_known_codes_stay(spark):
    first = encode.codes_from_stats(_stats(spark, ("n", 2), ("n", 10), ("t", "b"), ("t", None)))
    later = _stats(spark, ("n", 1), ("n", 10), ("n", 9), ("t", "a"), ("t", "c"), ("t", None), ("u", "z"))
    for rows_per_task in (1000, 1):
        both = encode.extend_codes(first, later, rows_per_task)
        found = {(r.feature, r.value): r.code for r in both.collect()}
        assert found == {
            ("n", "2"): 0, ("n", "10"): 1, ("n", "1"): 2, ("n", "9"): 3,
            ("t", "b"): 0, ("t", "a"): 1, ("t", "c"): 2, ("u", "z"): 0,
        }
    again = encode.extend_codes(both, later)
    assert {(r.feature, r.value): r.code for r in again.collect()} == found and again.count() == len(found)
    kept = spark.createDataFrame([("t", "gone", 41)], "feature string, value string, code int")
    row = encode.extend_codes(kept, _stats(spark, ("t", "new"))).filter("value = 'new'").first()
    assert row.code == 42


def test_a_broken_save_leaves_the_last_one(spark, view, tmp_path):
    folder = str(tmp_path / "artifacts")
    with pytest.raises(FileNotFoundError):
        load_artifacts(spark, folder)
    old, new = fit_artifacts(view.filter("selected = 1")), fit_artifacts(view)
    name = save_artifacts(old, folder)
    failing = new.codes.withColumn("code", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        save_artifacts(features.Artifacts(new.carriers, new.routes, failing), folder)
    assert _contents(load_artifacts(spark, folder)) == _contents(old)
    save_artifacts(new, folder)
    assert _contents(load_artifacts(spark, folder)) == _contents(new)
    assert _contents(load_artifacts(spark, folder, name)) == _contents(old)
    with pytest.raises(FileNotFoundError):
        load_artifacts(spark, folder, "000002-unknown")
    assert set(load_artifacts(spark, folder).carriers[0].columns) == {CARRIER_COLUMNS[0], "carrier0_pop"}


def test_a_request_sent_again_is_answered_once(spark, view, tmp_path):
    artifacts = fit_artifacts(view)
    given, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    given.mkdir()

    def send(name, *ids):
        requests = [{"request_id": i, "ranker_id": 1, "flights": [{"Id": "a", "totalPrice": 1.0}]} for i in ids]
        (given / name).write_text("\n".join(json.dumps({k: v for k, v in r.items() if v}) for r in requests))

    def run(**options):
        stream = read_request_stream(spark, str(given))
        query = recommend_stream(stream, artifacts, F.lit(0.0), out, progress, once_within="1 hour", **options)
        query.awaitTermination()
        return sorted(r.request_id for r in spark.read.json(out).collect())

    send("1.json", "x", "y", "y", None)
    first = run()
    assert [i for i in first if not i.startswith("made-")] == ["x", "y"] and len(first) == 3
    send("2.json", "y", "z", None)  # in a later batch, after a restart
    second = run()
    assert [i for i in second if not i.startswith("made-")] == ["x", "y", "z"] and len(second) == 5
    send("3.json", "x", "x")
    assert run() == second
