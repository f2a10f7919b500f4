"""Importance resampling towards a target, on hashed word features.

Features are runs of words, put into buckets by the CRC-32 of their bytes. A bucket's gain is the
smoothed log-ratio of its share in the target and in the documents; a document's weight is the sum
of the gains of its features. The highest weights plus Gumbel noise, fixed by the document's id,
are a sample without replacement in proportion to the exponential of the weights.

CRCs are worked out for many features at once: distinct features of one length are the rows of a
matrix of bytes, all CRCs advance by one column at a time, and buckets go back to the places of
their features.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankwright.llm.runs import ALNUM, Runs, split_runs
from rankwright.llm.words import slices
from rankwright.session import write_table


@dataclass(frozen=True)
class ResampleSpec:
    """Features are runs of 1 to ``run`` words; ``percent`` of the long enough documents are drawn."""

    buckets: int = 10_000
    run: int = 1
    seed: str = "2024"
    least_words: int = 20
    percent: int = 10


def _crc_table() -> np.ndarray:
    """CRC-32 of each byte, by the reflected polynomial 0xEDB88320 (fixed value)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (table & np.uint32(1)))
    return table


_TABLE = _crc_table()
_LONGEST = 512  # features above are too few to share columns; the same CRC, one at a time


def crc_matrix(matrix: np.ndarray) -> np.ndarray:
    """CRC-32 of each row of a matrix of bytes, column by column."""
    crc = np.full(len(matrix), 0xFFFFFFFF, dtype=np.uint32)
    for column in np.ascontiguousarray(matrix.T):
        crc = _TABLE[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
    return ~crc


def range_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each ``data[start:end]``."""
    out = np.empty(len(starts), dtype=np.uint32)
    sizes = ends - starts
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for same in np.split(order, cuts):
        if not len(same):
            continue
        size = int(sizes[same[0]])
        if size > _LONGEST:
            for i in same:
                out[i] = zlib.crc32(data[starts[i] : ends[i]])
            continue
        matrix = data[starts[same][:, None] + np.arange(size)]
        if size <= 8:  # as numbers, which sort faster
            wide = np.zeros((len(same), 8), dtype=np.uint8)
            wide[:, :size] = matrix
            keys = wide.view(np.uint64).ravel()
        else:
            keys = matrix.view(f"V{size}").ravel()
        _, place, back = np.unique(keys, return_index=True, return_inverse=True)
        out[same] = crc_matrix(matrix[place])[back]
    return out


def feature_buckets(words: Runs, run: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket and the row of every feature: all runs of 1 to ``run`` words of one text."""
    rows = words.rows()
    starts, ends, of = [], [], []
    for n in range(1, run + 1):
        left = np.arange(max(0, words.count - n + 1))
        left = left[rows[left] == rows[left + n - 1]]
        starts.append(words.starts[left])
        ends.append(words.ends[left + n - 1])
        of.append(rows[left])
    crcs = range_crcs(words.data, np.concatenate(starts), np.concatenate(ends))
    return (crcs % np.uint32(buckets)).astype(np.int64), np.concatenate(of)


def _count(spec: ResampleSpec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(spec.buckets, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                found, _ = feature_buckets(split_runs(part.column("text"), ALNUM), spec.run, spec.buckets)
                total += np.bincount(found, minlength=spec.buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, spec: ResampleSpec = ResampleSpec()) -> DataFrame:
    """``bucket, n``: features per bucket over all rows of ``texts`` (column ``text``).

    A task sends one row per bucket at most. Null and empty texts have no features.
    """
    texts = texts.select(F.col("text").cast("string").alias("text"))
    counted = texts.mapInArrow(_count(spec), "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, spec: ResampleSpec = ResampleSpec()) -> DataFrame:
    """``bucket, gain`` for every bucket: 1000 times the log-ratio of target and documents, floored."""
    rows = docs.sparkSession.range(spec.buckets).withColumnRenamed("id", "bucket")
    for table, name in ((docs, "s"), (target, "t")):
        rows = rows.join(F.broadcast(bucket_counts(table, spec).withColumnRenamed("n", name)), "bucket", "left")
    rows = rows.select("bucket", *[F.coalesce(F.col(n), F.lit(0)).cast("double").alias(n) for n in "st"])
    everything = Window.partitionBy()  # spec.buckets rows
    s, t = (F.sum(n).over(everything) + F.lit(float(spec.buckets)) for n in "st")
    ratio = (F.col("t") + 1) * s / ((F.col("s") + 1) * t)
    return rows.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def _weigh(gains: np.ndarray, spec: ResampleSpec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = split_runs(part.column("text"), ALNUM)
                found, rows = feature_buckets(words, spec.run, spec.buckets)
                # sums stay far below 2 ** 53, so doubles add them exactly
                weights = np.bincount(rows, gains[found].astype(float), minlength=part.num_rows).astype(np.int64)
                features = np.bincount(rows, minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array(a, pa.int64()) for a in (np.diff(words.first), features, weights)]],
                    ["doc_id", "n_words", "n_features", "weight"],
                )

    return run


def score_documents(docs: DataFrame, gains: DataFrame, spec: ResampleSpec = ResampleSpec()) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` for each row of ``docs``.

    ``gains`` has ``spec.buckets`` rows, which bounds what goes to the driver and the tasks.
    """
    table = np.zeros(spec.buckets, dtype=np.int64)
    for r in gains.collect():
        table[r.bucket] = r.gain
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = docs.mapInArrow(_weigh(table, spec), "doc_id long, n_words long, n_features long, weight long")
    key = F.concat(F.lit(f"{spec.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / F.lit(4294967296.0))))
    return rows.withColumn("score", F.col("weight") + noise)


def draw(scored: DataFrame, spec: ResampleSpec = ResampleSpec()) -> DataFrame:
    """Add ``rank``: 1, 2, 3... for the drawn documents by score, ties to smaller ``doc_id``; else null.

    Rows are split by ranges of the order, numbered within each range and shifted by the rows of the
    ranges before, so no task sees them all. Equal rows take neighbouring ranks. The bounds of the
    ranges are sampled first, so the scores are written once, not worked out twice.
    """
    scored = write_table(scored, "scored")
    eligible = F.col("n_words") >= spec.least_words
    order = [F.col("_eligible").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # the id counts rows within a partition: its high bits are the partition, its low ones the place
    placed = write_table(
        scored.withColumn("_eligible", eligible)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id()),
        "placed",
    ).withColumn("_slice", F.shiftright("_id", 33))
    sizes = placed.filter("_eligible").groupBy("_slice").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # one row per shuffle partition
    starts = sizes.select(
        "_slice",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
        F.floor(F.sum("_size").over(Window.partitionBy()) * spec.percent / 100).alias("_drawn"),
    )
    place = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(F.broadcast(starts), "_slice", "left").select(
        *scored.columns, F.when(F.col("_eligible") & (place <= F.col("_drawn")), place).alias("rank")
    )


def resample(docs: DataFrame, target: DataFrame, spec: ResampleSpec = ResampleSpec()) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` for each row of ``docs``.

    Needs ``doc_id`` and ``text`` in ``docs`` and ``text`` in ``target``; other columns are ignored.
    Null and empty texts have no features, weight 0, and are not drawn unless ``least_words`` is 0.
    Repeated rows are rows of their own. A null ``doc_id`` counts as an empty text in the noise and
    ranks last among ties. With an empty target the gains only favour rare features; an empty table
    gives no rows.
    """
    gains = bucket_gains(docs, target, spec)
    return draw(score_documents(docs, gains, spec), spec)
