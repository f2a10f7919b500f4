"""A pairwise model whose pairs weigh what they would change in NDCG.

Each round ranks the sessions by the model of the round before. A pair of a chosen and another
offer then weighs the change in its session's NDCG if the two swapped places, so pairs near the top
count most and pairs far below it nothing. The weighted pairs are fitted anew, and the model of the
round that does best on sessions set aside is kept. Round 0 is the model with equal weights, so the
result is never worse than it there.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwright.operators.evaluate import ideal_dcg, session_ndcg
from rankwright.operators.ranking import rank_in_group
from rankwright.operators.skew import HotGroups, find_hot_groups, with_group_stats
from rankwright.operators.train import (
    RANKER_FEATURES,
    LinearRanker,
    feature_spreads,
    fit_pairs,
    make_pairs,
    score,
)
from rankwright.session import write_table


@dataclass(frozen=True)
class Round:
    """A model and its mean NDCG on the sessions learned from and on those set aside."""

    number: int
    model: LinearRanker
    fit_ndcg: float
    tune_ndcg: float | None


def in_tuning(group: str, share: float) -> Column:
    """Whether a session is set aside, by a hash of its id; rows without one are not."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit("tune:"), F.col(group).cast("string"))), 1, 8), 16, 10)
    return F.coalesce(drawn.cast("double") / 2**32 < share, F.lit(False))


def _discount(rank: str, k: int) -> Column:
    return F.when(F.col(rank) <= k, 1 / F.log2(F.col(rank) + 1.0)).otherwise(0.0)


def swap_gain(best: str, other: str, ideal: str, k: int) -> Column:
    """The change in NDCG@k if the chosen offer at rank ``best`` and the one at ``other`` swapped."""
    return F.try_divide(F.abs(_discount(best, k) - _discount(other, k)), F.col(ideal))


def weighed_pairs(
    scored: DataFrame,
    features: Sequence[str],
    k: int = 10,
    score: str = "score",
    label: str = "selected",
    group: str = "ranker_id",
    row_id: str = "Id",
    hot: HotGroups | None = None,
    meetings: int | None = 1,
) -> DataFrame:
    """``make_pairs`` with a ``gain``: the change in NDCG@k that swapping the two would make."""
    hot = find_hot_groups(scored, [group]) if hot is None else hot
    rows = scored.select(group, row_id, label, score, *features)
    chosen = {"_n_chosen": F.count_if(F.col(label) > 0)}
    counted = with_group_stats(rows, [group], chosen, hot, (row_id,))
    placed = rank_in_group(counted, score, group, row_id, "_rank", hot)
    ideal = placed.withColumn("_ideal", ideal_dcg(F.col("_n_chosen"), k))
    pairs = make_pairs(ideal, [*features, "_rank", "_ideal"], label, group, row_id, hot, meetings)
    gain = swap_gain("best__rank", "other__rank", "best__ideal", k)
    return pairs.withColumn("gain", gain).drop("best__rank", "other__rank", "best__ideal", "other__ideal")


def train_by_gain(
    df: DataFrame,
    features: Sequence[str] = RANKER_FEATURES,
    label: str = "selected",
    group: str = "ranker_id",
    row_id: str = "Id",
    hot: HotGroups | None = None,
    rounds: int = 3,
    k: int = 10,
    metric_k: int = 3,
    tune_share: float = 0.1,
    regularisation: float = 1e-4,
    iterations: int = 50,
    meetings: int | None = 1,
    mixing: float = 0.0,
    stored: bool = False,
) -> tuple[LinearRanker, list[Round]]:
    """The best model by NDCG@``metric_k`` on the sessions set aside, and all rounds.

    Weights are changes in NDCG@``k``. With a ``tune_share`` of 0 nothing is set aside and the
    rounds are compared on what they learned from. Only figures of a round come to the driver.
    Rows read from a table are ``stored`` and not written again; each round reads them anew.
    """
    hot = find_hot_groups(df, [group]) if hot is None else hot
    kept = df.select(group, row_id, label, *features).withColumn("_tune", in_tuning(group, tune_share))
    kept = kept if stored else write_table(kept, "learned")
    rows = kept.filter(~F.col("_tune"))
    spreads = feature_spreads(rows, features)
    fit = {"regularisation": regularisation, "iterations": iterations, "mixing": mixing}

    def measured(number: int, model: LinearRanker) -> Round:
        scored = score(kept, model).select(group, row_id, label, "score", "_tune")
        sessions = session_ndcg(
            scored, metric_k, "score", label, group, row_id, hot, {"_tune": F.first("_tune")}
        )
        seen = {r["_tune"]: r.ndcg for r in sessions.groupBy("_tune").agg(F.avg("ndcg").alias("ndcg")).collect()}
        return Round(number, model, seen.get(False), seen.get(True))

    pairs = make_pairs(rows, list(spreads), label, group, row_id, hot, meetings)
    history = [measured(0, fit_pairs(pairs, spreads, **fit))]
    for number in range(1, rounds + 1):
        scored = score(rows, history[-1].model)
        pairs = weighed_pairs(scored, list(spreads), k, "score", label, group, row_id, hot, meetings)
        history.append(measured(number, fit_pairs(pairs, spreads, weight=F.col("gain"), **fit)))
    best = max(history, key=lambda r: (r.fit_ndcg if r.tune_ndcg is None else r.tune_ndcg, -r.number))
    return best.model, history


def round_table(df: DataFrame, history: Sequence[Round]) -> DataFrame:
    """``round, fit_ndcg, tune_ndcg``, one row per round."""
    rows = [(r.number, r.fit_ndcg, r.tune_ndcg) for r in history]
    return df.sparkSession.createDataFrame(rows, "round int, fit_ndcg double, tune_ndcg double")
