"""Resampling towards a target: checksums, odd rows, runs of words, the draw."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankwright.llm import resample
from rankwright.llm.resample import ResampleSpec

SCHEMA = "doc_id long, text string, bucket string, n string, score string, rank string, _eligible string, _id string"


def _table(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 6) for r in rows], SCHEMA)


def _words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def _features(text, run):
    words = _words(text)
    return [" ".join(words[i : i + n]).encode() for n in range(1, run + 1) for i in range(len(words) - n + 1)]


def _expected(docs, target, spec):
    counts = []
    for texts in ([t for _, t in docs], target):
        n = [0] * spec.buckets
        for text in texts:
            for f in _features(text, spec.run):
                n[zlib.crc32(f) % spec.buckets] += 1
        counts.append(n)
    s, t = counts
    all_s, all_t = sum(s) + spec.buckets, sum(t) + spec.buckets
    gains = [math.floor(1000 * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s, t)]
    rows = []
    for doc, text in docs:
        found = _features(text, spec.run)
        weight = sum(gains[zlib.crc32(f) % spec.buckets] for f in found)
        key = f"{spec.seed}:{'' if doc is None else doc}"
        h = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc, len(_words(text)), len(found), weight, weight + noise])
    fit = sorted((r for r in rows if r[1] >= spec.least_words), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    for place, r in enumerate(fit):
        r.append(place + 1 if place < spec.percent * len(fit) // 100 else None)
    return sorted((tuple(r if len(r) == 6 else [*r, None]) for r in rows), key=repr)


ODD = [
    (1, "One two THREE four é x1-y2 one"), (2, None), (3, ""), (4, " \t--"), (None, "one two three"), (5, "a" * 5000 + " one"),
    (6, "one two " * 40_000), (7, "one two three four"), (7, "one two three four"), (8, "ONE TWO three four"), (9, "ünï 中文 one"),
]


@pytest.mark.parametrize("run", [1, 3])
def test_against_plain_version(spark, run):
    spec = ResampleSpec(buckets=97, run=run, least_words=2, percent=50)
    target = ["one two three", None, "", "zwei ONE"]
    bench = spark.createDataFrame([(t, "x") for t in target], "text string, bucket string")
    found = resample.resample(_table(spark, ODD).repartition(3), bench, spec).collect()
    assert sorted((tuple(r) for r in found), key=repr) == _expected(ODD, target, spec)


def test_empty_tables(spark):
    docs, nothing = _table(spark, ODD), _table(spark, [])
    assert resample.resample(nothing, docs).count() == 0
    spec = ResampleSpec(buckets=97, least_words=2, percent=50)
    found = resample.resample(docs, nothing.select("text"), spec).collect()
    assert sorted((tuple(r) for r in found), key=repr) == _expected(ODD, [], spec)


def test_crcs_of_all_lengths():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 20_000, dtype=np.uint8)
    starts = rng.integers(0, 10_000, 600)
    ends = starts + rng.choice([0, 1, 3, 7, 8, 9, 40, 511, 512, 513, 4000], 600)
    expected = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]
    assert resample.range_crcs(data, starts, ends).tolist() == expected


def test_ranks_over_many_ranges(spark):
    spec = ResampleSpec(least_words=1, percent=30)
    scored = spark.range(5000).select(
        F.col("id").alias("doc_id"), (F.col("id") % 7).alias("n_words"), (F.col("id") % 3).alias("score")
    )
    rows = [r for r in resample.draw(scored, spec).collect() if r.rank]
    rows.sort(key=lambda r: r.rank)
    fit = sorted((-(i % 3), i) for i in range(5000) if i % 7)
    assert [(-r.score, r.doc_id) for r in rows] == fit[: 30 * len(fit) // 100]
    assert [r.rank for r in rows] == list(range(1, len(rows) + 1))
