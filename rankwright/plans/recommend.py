"""From ranking requests to ranked responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwright.operators.columns import drop_empty_requests, numeric_matrix, validate_features
from rankwright.operators.ranking import rank_requests
from rankwright.operators.skew import no_hot_groups
from rankwright.operators.train import LinearRanker, score
from rankwright.plans.features import Artifacts, build_features, encode_features
from rankwright.schema import CATEGORIES
from rankwright.sources.readers import read_requests, rejected_requests, request_offers

_ROW = "_request_row"

# A row is one request by its own key; with the id before it, rows that lie by request id stay there.
_REQUEST = ["request_id", _ROW]


def score_requests(
    requests: DataFrame,
    artifacts: Artifacts,
    model: LinearRanker | PipelineModel | Column,
    features: Sequence[str] | None = None,
) -> DataFrame:
    """``request_id, ranker_id, Id, score`` of every offer in the requests.

    Offers are compared within their request, as session ids and request ids may repeat between
    requests. A request arrives as one row, so its offers fit a task by construction and no search
    for oversized groups is needed. Only categories among ``features`` are coded; with a score
    expression and no ``features`` all are.
    """
    return _scored(requests, artifacts, model, features).drop(_ROW)


def _scored(
    requests: DataFrame,
    artifacts: Artifacts,
    model: LinearRanker | PipelineModel | Column,
    features: Sequence[str] | None,
) -> DataFrame:
    """Scores with the key of the request's row, which tells apart requests with one id."""
    keyed = drop_empty_requests(requests).withColumn(_ROW, F.monotonically_increasing_id())
    offers = request_offers(keyed, _ROW)
    built = build_features(offers, artifacts, _REQUEST, hot=no_hot_groups(_REQUEST))
    if features is None and isinstance(model, LinearRanker):
        features = list(model.weights)
    elif features is None and isinstance(model, PipelineModel):
        features = model.stages[0].getInputCols()
    needed = CATEGORIES if features is None else [c for c in CATEGORIES if c in set(features)]
    coded = encode_features(built, artifacts, needed)
    if isinstance(model, Column):
        scored = coded.withColumn("score", model)
    else:
        keep = [_ROW, "request_id", "ranker_id", "Id"]
        scored = score(numeric_matrix(validate_features(coded, features), features, keep=keep), model)
    return scored.select(_ROW, "request_id", "ranker_id", "Id", F.col("score").cast("double"))


def recommend(
    requests: DataFrame,
    artifacts: Artifacts,
    model: LinearRanker | PipelineModel | Column,
    features: Sequence[str] | None = None,
) -> DataFrame:
    """One ranked response per request; ``model`` may also be a plain score expression.

    A request comes as one row, and so does its response, whatever its length.
    """
    scored = _scored(requests, artifacts, model, features)
    ranked = rank_requests(
        scored, request=_ROW, hot=no_hot_groups(_REQUEST), carry=["request_id"], group=_REQUEST
    )
    return ranked.drop(_ROW)


def answer_all(
    spark: SparkSession,
    path: str,
    artifacts: Artifacts,
    model: LinearRanker | PipelineModel | Column,
    features: Sequence[str] | None = None,
) -> DataFrame:
    """An answer for every request line of ``path``: a ranked response, or the reason why there is none.

    ``request_id, ranker_id, ranked_flights, reason, text``; ``reason`` and ``text`` are those of
    ``rejected_requests`` and null for ranked responses, whose flights are never empty.
    """
    ranked = recommend(read_requests(spark, path), artifacts, model, features)
    nothing = F.array().cast(ranked.schema["ranked_flights"].dataType)
    text = F.lit(None).cast("string")
    answered = ranked.select("request_id", "ranker_id", "ranked_flights", text.alias("reason"), text.alias("text"))
    rejected = rejected_requests(spark, path)
    return answered.unionByName(rejected.withColumn("ranked_flights", nothing))
