"""Pairwise and pointwise ranking models on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankwright.operators.skew import (
    HotGroups,
    find_hot_groups,
    lookup_join,
    running_total,
    with_group_stats,
)

# The categorical codes are ordinal only, so a linear model is better off without them.
RANKER_FEATURES = (
    "price_per_tax",
    "tax_rate",
    "log_price",
    "total_duration",
    "duration_ratio",
    "is_one_way",
    "l0_seg",
    "n_ff_programs",
    "has_corporate_tariff",
    "has_access_tp",
    "baggage_total",
    "total_fees",
    "is_popular_route",
    "avg_cabin_class",
    "cabin_class_diff",
    "total_segments",
    "is_direct_leg0",
    "is_direct_leg1",
    "fee_rate",
    "is_major_carrier",
    "group_size_log",
    "price_rank",
    "duration_rank",
    "price_pct_rank",
    "is_cheapest",
    "price_from_median",
    "is_min_segments",
    "is_direct_cheapest",
    "carrier0_pop",
    "carrier1_pop",
    "carrier_pop_product",
    "round_trip_freq",
)


def _id_hash(row_id: str) -> Column:
    """A number fixed by the id, the same in every run and engine."""
    return F.conv(F.substring(F.md5(row_id), 1, 8), 16, 10).cast("long")


def _slots(row_id: str, meetings: int | None) -> Column:
    """The place, among the chosen offers of a session, of the one that an offer meets; an array if not 1."""
    first = F.pmod(_id_hash(row_id), F.col("_chosen"))
    if meetings == 1:
        return first
    met = F.col("_chosen") if meetings is None else F.least(F.lit(meetings), F.col("_chosen"))
    steps = F.sequence(F.lit(0).cast("long"), met.cast("long") - 1)
    return F.transform(steps, lambda step: F.pmod(first + step, F.col("_chosen")))


def _pairs_in_place(
    rows: DataFrame,
    features: Sequence[str],
    label: str,
    group: str,
    row_id: str,
    meetings: int | None,
) -> DataFrame:
    """The pairs by windows over the session: a chosen offer and those that meet it share a slot."""
    chosen = F.col(label) > 0
    session = Window.partitionBy(group).orderBy(row_id)
    whole = session.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = session.rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.select(
        "*",
        F.count_if(chosen).over(whole).alias("_chosen"),
        F.count_if(chosen).over(before).alias("_before"),
    ).filter(chosen | ((F.col(label) <= 0) & (F.col("_chosen") > 0)))
    own = F.col("_before")
    if meetings == 1:
        slot = F.when(chosen, own).otherwise(_slots(row_id, meetings))
    else:
        slot = F.explode(F.when(chosen, F.array(own)).otherwise(_slots(row_id, meetings)))
    placed = counted.withColumn("_slot", slot)
    best = F.when(
        chosen, F.struct(F.col(row_id).alias("best_id"), *[F.col(c).alias(f"best_{c}") for c in features])
    )
    met = F.first(best, ignorenulls=True).over(Window.partitionBy(group, "_slot"))
    return placed.withColumn("_best", met).filter(F.col(label) <= 0).select(
        group,
        F.col(row_id).alias("other_id"),
        *[F.col(c).alias(f"other_{c}") for c in features],
        "_best.*",
    )


def make_pairs(
    df: DataFrame,
    features: Sequence[str] = (),
    label: str = "selected",
    group: str = "ranker_id",
    row_id: str = "Id",
    hot: HotGroups | None = None,
    meetings: int | None = 1,
) -> DataFrame:
    """Each offer not chosen, next to a chosen offer of its session.

    With one chosen offer per session, as in search logs, these are all the pairs. With several,
    each other offer meets ``meetings`` of them, from the one its id's hash points to on, so there
    are at most ``meetings`` pairs for an offer; None means all of them, whose number grows with the
    product of chosen and other offers. ``features`` come along twice, prefixed ``best_`` and
    ``other_``. Offers without a session id were not shown together, and make no pairs.

    The offers move once, and not at all if they lie by session. Oversized sessions move twice.
    """
    hot = find_hot_groups(df, [group]) if hot is None else hot
    rows = df.select(group, row_id, label, *features).filter(F.col(group).isNotNull())
    if not hot:
        return _pairs_in_place(rows, features, label, group, row_id, meetings)
    chosen_rows = {"_chosen": F.count_if(F.col(label) > 0)}
    counted = with_group_stats(rows, [group], chosen_rows, hot, (row_id,))
    slots = _slots(row_id, meetings)
    others = counted.filter((F.col(label) <= 0) & (F.col("_chosen") > 0)).select(
        group,
        (slots if meetings == 1 else F.explode(slots)).alias("_slot"),
        F.col(row_id).alias("other_id"),
        *[F.col(c).alias(f"other_{c}") for c in features],
    )
    chosen = rows.filter(F.col(label) > 0).select(
        group,
        F.col(row_id).alias("best_id"),
        *[F.col(c).alias(f"best_{c}") for c in features],
    )
    numbered = running_total(chosen, [group], [F.col("best_id")], "_slot")
    pairs = lookup_join(others, numbered, [group, "_slot"], small=False, spread_by=("other_id",))
    return pairs.drop("_slot")


@dataclass(frozen=True)
class LinearRanker:
    """A pairwise model as weights; its score is a column expression, with no model transform."""

    weights: dict[str, float]

    def score_column(self) -> Column:
        terms = [
            F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.lit(w)
            for c, w in self.weights.items()
        ]
        return reduce(lambda a, b: a + b, terms)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(c, float(w)) for c, w in self.weights.items()]
        spark.createDataFrame(rows, "feature string, weight double").coalesce(1).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> LinearRanker:
        rows = spark.read.parquet(path).orderBy("feature").collect()
        return LinearRanker({r.feature: r.weight for r in rows})


def feature_spreads(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Standard deviations, without the features that have none to speak of."""
    seen = df.agg(*[F.stddev_samp(c).alias(c) for c in features]).first()
    return {c: float(seen[c]) for c in features if seen[c]}


def fit_pairs(
    pairs: DataFrame,
    spreads: dict[str, float],
    regularisation: float = 1e-4,
    iterations: int = 50,
    weight: Column | None = None,
    mixing: float = 0.0,
) -> LinearRanker:
    """Logistic regression on the scaled feature differences of (chosen, not chosen) pairs.

    Half of the pairs, picked by id hash, are turned round and labelled 0. For a model without
    intercept a pair and its mirror image cost the same, so this equals training on both.
    ``weight`` is what a pair counts (1 without). ``mixing`` is the share of the L1 penalty in
    ``regularisation``; the rest is L2.
    """
    turned = F.pmod(_id_hash("other_id"), F.lit(2)) == 0
    sign = F.when(turned, -1.0).otherwise(1.0)
    differences = pairs.select(
        F.when(turned, 0.0).otherwise(1.0).alias("label"),
        (F.lit(1.0) if weight is None else weight).alias("_weight"),
        *[
            (
                sign
                * (F.coalesce(f"best_{c}", F.lit(0)) - F.coalesce(f"other_{c}", F.lit(0)))
                / F.lit(spread)
            ).alias(c)
            for c, spread in spreads.items()
        ],
    )
    if weight is not None:
        differences = differences.filter(F.col("_weight") > 0)
    assembled = VectorAssembler(inputCols=list(spreads), outputCol="features").transform(differences)
    model = LogisticRegression(
        fitIntercept=False,
        standardization=False,
        regParam=regularisation,
        elasticNetParam=mixing,
        maxIter=iterations,
        weightCol="_weight",
    ).fit(assembled.select("label", "_weight", "features"))
    return LinearRanker({c: float(w) / spreads[c] for c, w in zip(spreads, model.coefficients)})


def train_ranker(
    df: DataFrame,
    features: Sequence[str] = RANKER_FEATURES,
    label: str = "selected",
    group: str = "ranker_id",
    row_id: str = "Id",
    hot: HotGroups | None = None,
    regularisation: float = 1e-4,
    iterations: int = 50,
    meetings: int | None = 1,
    mixing: float = 0.0,
) -> LinearRanker:
    """A pairwise model: ``fit_pairs`` on ``make_pairs``, every pair weighing the same.

    ``gain.train_by_gain`` goes on from here and weighs pairs by the NDCG they would change.
    """
    spreads = feature_spreads(df, features)
    pairs = make_pairs(df, list(spreads), label, group, row_id, hot, meetings)
    return fit_pairs(pairs, spreads, regularisation, iterations, mixing=mixing)


def train_pointwise(
    df: DataFrame,
    features: Sequence[str] = RANKER_FEATURES,
    label: str = "selected",
    depth: int = 5,
    rounds: int = 20,
    learning_rate: float = 0.1,
    min_rows: int = 2,
    row_share: float = 0.88,
    feature_share: float = 0.46,
    seed: int = 42,
    validation: str | None = None,
    tolerance: float = 0.01,
) -> PipelineModel:
    """Boosted trees on the 0/1 label alone; save and load it as any Spark ML model.

    Each tree sees ``row_share`` of the rows and each split ``feature_share`` of the features; these
    two and ``seed`` are settings of the reference trainer, fixed values.

    Rows for which the column ``validation`` is true are not learned from: boosting stops at the
    round after which their error no longer falls by ``tolerance``, and keeps the best round.
    ``quality.boosting_rounds`` shows the quality round by round.
    """
    assembler = VectorAssembler(
        inputCols=list(features), outputCol="features", handleInvalid="keep"
    )
    trees = GBTClassifier(
        labelCol=label,
        featuresCol="features",
        maxDepth=depth,
        maxIter=rounds,
        stepSize=learning_rate,
        minInstancesPerNode=min_rows,
        subsamplingRate=row_share,
        featureSubsetStrategy=str(feature_share),
        seed=seed,
    )
    kept = [label, "features"]
    if validation is not None:
        trees = trees.setValidationIndicatorCol(validation).setParams(validationTol=tolerance)
        kept.append(validation)
    held = [] if validation is None else [F.col(validation).cast("boolean").alias(validation)]
    prepared = assembler.transform(df.select(F.col(label).cast("double").alias(label), *held, *features))
    return PipelineModel(stages=[assembler, trees.fit(prepared.select(*kept))])


def score(df: DataFrame, model: LinearRanker | PipelineModel, out: str = "score") -> DataFrame:
    """Add the model's score to each row."""
    if isinstance(model, LinearRanker):
        return df.withColumn(out, model.score_column())
    added = ("features", "rawPrediction", "probability", "prediction")
    chance = vector_to_array("probability")[1]
    return model.transform(df).withColumn(out, chance).drop(*added)


def feature_importance(spark: SparkSession, model: LinearRanker | PipelineModel,
                       spreads: dict[str, float] | None = None) -> DataFrame:
    """``feature, importance``, highest first. One row per feature.

    Trees give their gain; a linear model the size of its weight, times the feature's standard
    deviation where ``spreads`` gives it.
    """
    if isinstance(model, LinearRanker):
        scale = spreads or {}
        rows = [(c, abs(w) * float(scale.get(c) or 1.0)) for c, w in model.weights.items()]
    else:
        assembler, trees = model.stages
        rows = [
            (c, float(g)) for c, g in zip(assembler.getInputCols(), trees.featureImportances.toArray())
        ]
    table = spark.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.col("importance").desc(), "feature")
