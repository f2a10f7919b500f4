"""Toxic passages by maximum-scoring segments, and the toxicity of documents.

A word's weight is its log-odds between toxic and clean documents, with an informative Dirichlet
prior; words and word beginnings without significant odds cost a little. All maximal segments of
the weights (Ruzzo and Tompa) are found in one scan of a text: the passages. The scores that such
segments reach by chance in clean text follow an extreme-value law, whose two parameters are taken
from the clean documents; a document's evidence is the sum of its passages' normalised scores
(Karlin and Altschul), which a logistic curve turns into a score from 0 to 1.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwright.session import write_table

_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class ToxicitySpec:
    """``labelled`` bounds the documents that are learned from, ``features`` the model's size."""

    labelled: int = 200_000
    features: int = 20_000
    beginnings: tuple[int, ...] = (4, 5, 6)
    prior: float = 0.05  # weight of the background counts in the Dirichlet prior
    least_z: float = 3.0
    least_share: float = 0.7  # of the weight that a word seen in toxic documents only gets
    density: float = 0.05  # share of toxic words in a toxic passage
    held: int = 300_000  # counts or weights a task keeps at once


@dataclass(frozen=True)
class ToxicityModel:
    spec: ToxicitySpec = ToxicitySpec()
    weights: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0  # lambda of the extreme-value law
    log_k: float = 0.0  # logarithm of its K
    shift: float = -30.0
    slope: float = 0.0


def in_training(doc_id: str | Column = "doc_id") -> Column:
    """Whether labels of this document may be learned from: crc32(doc_id as text) mod 5 is not 0."""
    value = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary")) % 5 != 0


def _features(word: str, sizes: Sequence[int]) -> Iterator[str]:
    yield word
    for n in sizes:
        if len(word) > n:
            yield f"{word[:n]}*"


def _count(spec: ToxicitySpec):
    def drain(counts: list[Counter]) -> pa.RecordBatch:
        names = list(counts[0].keys() | counts[1].keys())
        columns = [pa.array(names, pa.string())] + [pa.array([c[n] for n in names], pa.int64()) for c in counts]
        return pa.RecordBatch.from_arrays(columns, ["feature", "clean", "toxic"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter(), Counter()]
        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic")):
                words = set(_LETTERS.findall((text.as_py() or "").lower()))
                counts[toxic.as_py()].update({f for w in words for f in _features(w, spec.beginnings)})
                if len(counts[0]) + len(counts[1]) > spec.held:
                    yield drain(counts)
                    counts = [Counter(), Counter()]
        yield drain(counts)

    return run


class _Weights(dict):
    """Word to weight, worked out at first sight."""

    def __init__(self, model: ToxicityModel) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) > self.model.spec.held:
            self.clear()
        known = self.model.weights
        value = max((known.get(f, 0.0) for f in _features(word, self.model.spec.beginnings)), default=0.0)
        self[word] = value
        return value


def maximal_segments(hits: Sequence[tuple[int, float]], cost: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments as (first word, last word, score), in linear time.

    ``hits`` are the words of positive weight by place; every other word costs ``cost``.
    """
    found: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum after
    outer: list[int] = []  # for each: the nearest earlier one with a smaller sum before
    total, at = 0.0, 0
    for place, weight in hits:
        before = total - cost * (place - at)
        total, at = before + weight, place + 1
        first, low, top = place, before, total
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = outer[j]
            if j < 0 or found[j][3] >= top:
                break
            first, low = found[j][0], found[j][2]
            del found[j:], outer[j:]
        found.append((first, place, low, top))
        outer.append(j)
    return [(first, last, top - low) for first, last, low, top in found]


def _segments(text: str, weights: _Weights) -> tuple[int, list[tuple[int, int, float]]]:
    words = _LETTERS.findall(text.lower())
    hits = [(i, v) for i, v in enumerate(map(weights.__getitem__, words)) if v]
    cost = -math.log1p(-weights.model.spec.density)
    return len(words), maximal_segments(hits, cost) if hits else []


def evidence(words: int, scores: Sequence[float], model: ToxicityModel) -> float:
    """Sum of the normalised scores of the passages that chance doesn't explain."""
    least = model.log_k + math.log(max(words, 1))
    return sum(max(0.0, model.rate * s - least) for s in scores)


def _scan(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _Weights(model)
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            counts, passages, sums, scores = [], [], [], []
            for text in batch.column("text"):
                n, found = _segments(text.as_py() or "", weights)
                value = evidence(n, [s for _, _, s in found], model)
                counts.append(n)
                passages.append([{"first": a, "last": b, "score": s} for a, b, s in found])
                sums.append(value)
                scores.append(1 / (1 + math.exp(-max(-700.0, model.shift + model.slope * math.log1p(value)))))
            rest = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(counts, pa.int64()), pa.array(passages, kind), pa.array(sums, pa.float64()), pa.array(scores, pa.float64())],
                [*names, "n_words", "passages", "evidence", "score"],
            )

    return run


def _clean(model: ToxicityModel):
    """The rows whose score is below one half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _Weights(model)
        for batch in batches:
            keep = []
            for text in batch.column("text"):
                n, found = _segments(text.as_py() or "", weights)
                value = evidence(n, [s for _, _, s in found], model)
                keep.append(model.shift + model.slope * math.log1p(value) < 0)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


_SCANNED = "n_words long, passages array<struct<first: long, last: long, score: double>>, evidence double, score double"


def fit_toxicity(docs: DataFrame, labels: DataFrame, spec: ToxicitySpec = ToxicitySpec()) -> ToxicityModel:
    """Learn from ``labels (doc_id, toxic)`` of the training part, on the texts of ``docs``.

    At most ``spec.labelled`` documents are used, chosen by a hash of doc_id, so that the labels
    can be broadcast and what is learned from is bounded. Rows without doc_id or toxic are left
    out; of contradicting labels the toxic one holds. Without labels, or with labels of one kind
    only, the model gives every text the same score: the share of toxic labels, or 0.
    """
    labels = (
        labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(in_training())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(spec.labelled)
    )
    labels = write_table(labels, "labels")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(labels), "doc_id").select("text", "toxic")
    sizes = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    share = min(max(toxic / (clean + toxic), 1e-9), 1 - 1e-9) if clean + toxic else 1e-9
    if not clean or not toxic:
        return ToxicityModel(spec, shift=math.log(share / (1 - share)))

    counted = texts.mapInArrow(_count(spec), "feature string, clean long, toxic long")
    counted = counted.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    prior = F.lit(spec.prior) * (F.col("clean") + F.col("toxic"))
    n = {"toxic": toxic, "clean": clean}
    most = max(1.0, math.log((1 + spec.prior) / spec.prior * clean / toxic))
    odds = {k: F.log((F.col(k) + prior) / (F.lit(n[k] * (1 + spec.prior) + 1.0) - F.col(k) + prior)) for k in n}
    chosen = (
        counted.withColumn("weight", odds["toxic"] - odds["clean"])
        .withColumn("z", F.col("weight") / F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior)))
        .filter((F.col("z") >= spec.least_z) & (F.col("weight") >= spec.least_share * most))
        .orderBy(F.desc("z"), "feature").limit(spec.features)
    )
    model = ToxicityModel(spec, {r["feature"]: r["weight"] for r in chosen.select("feature", "weight").collect()})

    scanned = write_table(texts.mapInArrow(_scan(model), f"toxic int, {_SCANNED}"), "scanned")
    chance = scanned.filter("toxic = 0").select(
        F.sum("n_words").alias("words"),
        F.sum(F.size("passages")).alias("segments"),
        F.sum(F.expr("aggregate(passages, 0D, (t, p) -> t + p.score)")).alias("score"),
    ).first()
    # two passages in the expected proportion stand for what theory says of the law: rate 1
    rate = ((chance["segments"] or 0) + 2) / ((chance["score"] or 0.0) + 2)
    log_k = math.log(((chance["segments"] or 0) + 0.5) / max(chance["words"] or 1, 1))
    model = ToxicityModel(spec, model.weights, rate, log_k)

    least = F.lit(log_k) + F.log(F.greatest("n_words", F.lit(1)))
    value = F.aggregate("passages", F.lit(0.0), lambda t, p: t + F.greatest(F.lit(0.0), F.lit(rate) * p["score"] - least))
    bins = scanned.groupBy(F.round(F.log1p(value) * 50).alias("bin"), "toxic").count().collect()
    shift, slope = _logistic([(r["bin"] / 50, r["toxic"], r["count"]) for r in bins])
    return ToxicityModel(spec, model.weights, rate, log_k, shift, slope)


def _logistic(points: Sequence[tuple[float, int, int]], ridge: float = 0.01) -> tuple[float, float]:
    """Logistic curve of one variable through binned counts, by Newton steps."""
    positive = sum(n for _, y, n in points if y)
    total = sum(n for _, _, n in points)
    shift, slope = math.log((positive + 0.5) / (total - positive + 0.5)), 0.0
    for _ in range(100):
        g0, g1, h00, h01, h11 = -ridge * shift, -ridge * slope, ridge, 0.0, ridge
        for x, y, n in points:
            p = 1 / (1 + math.exp(-max(-700.0, min(700.0, shift + slope * x))))
            g0, g1 = g0 + n * (y - p), g1 + n * (y - p) * x
            w = n * p * (1 - p)
            h00, h01, h11 = h00 + w, h01 + w * x, h11 + w * x * x
        det = h00 * h11 - h01 * h01
        a, b = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        size = max(1.0, abs(a) / 2, abs(b) / 2)
        shift, slope = shift + a / size, slope + b / size
        if abs(a) + abs(b) < 1e-9:
            break
    return shift, max(slope, 0.0)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score, passages, n_words, evidence`` for each row of ``docs``.

    Needs ``doc_id`` and ``text``; other columns are ignored. Null and empty texts have no words,
    no passage, and the score of a text without evidence. An empty table gives no rows.
    ``passages`` has the first and last word (counted in runs of letters) and score of each.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = texts.mapInArrow(_scan(model), f"doc_id long, {_SCANNED}")
    return out.select("doc_id", "score", "passages", "n_words", "evidence")


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below one half."""
    return docs.mapInArrow(_clean(model), docs.schema)
