"""Ranking quality: hit rates, their curves by session size, and NDCG.

Every measure is read from one table with a row per session (``session_outcomes``), computed in a
single pass with one exchange, however many values of k are asked for. Measures by session size
then work on a table with a row per distinct size. Since D distinct sizes need at least
D * (D + 1) / 2 offers, that table has at most the square root of twice the number of offers, so
ordering it in one task is safe: about 1.4 million rows for a trillion offers.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankwright.operators.ranking import rank_in_group
from rankwright.operators.skew import HotGroups, with_group_stats

LARGER_THAN = 10
CURVE_KS = tuple(range(1, 21))
SUMMARY_KS = (1, 3, 5, 10)
SIZE_BINS = 50
MIN_SESSIONS_PER_BIN = 3


def _place(score: str, row_id: str) -> Column:
    """A struct that sorts in ranking order: best score first, missing last, ties by id."""
    value = F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))
    return F.struct(value.isNull().alias("missing"), (-value).alias("down"), F.col(row_id).alias("id"))


def session_outcomes(
    df: DataFrame,
    score: str = "pred_score",
    label: str = "selected",
    group: str = "ranker_id",
    row_id: str = "Id",
    hot: HotGroups | None = None,
) -> DataFrame:
    """Per session: size, number of chosen offers, and rank of the best-placed chosen offer.

    That rank is one more than the number of offers ahead of it, so no session is sorted.
    """
    chosen = F.col(label) > 0
    rows = df.select(
        group, row_id, chosen.alias("_chosen"), _place(score, row_id).alias("_place")
    )
    best = {"_best": F.min(F.when(F.col("_chosen"), F.col("_place")))}
    return (
        with_group_stats(rows, [group], best, hot, (row_id,))
        .groupBy(group)
        .agg(
            F.count(F.lit(1)).alias("group_size"),
            F.count_if(F.col("_chosen")).alias("chosen"),
            F.count_if(F.col("_place") < F.col("_best")).alias("_ahead"),
        )
        .select(
            group,
            "group_size",
            "chosen",
            F.when(F.col("chosen") > 0, F.col("_ahead") + 1).alias("best_rank"),
        )
    )


def _hit(k: int) -> Column:
    """1.0 when a chosen offer is among the first ``k``; a session without one is a miss."""
    return F.coalesce((F.col("best_rank") <= k).cast("double"), F.lit(0.0))


def large_sessions(outcomes: DataFrame, larger_than: int = LARGER_THAN) -> DataFrame:
    return outcomes.filter(F.col("group_size") > larger_than)


def group_hit(outcomes: DataFrame, k: int = 3, group: str = "ranker_id") -> DataFrame:
    """Per session: its size, and whether the first ``k`` hold a chosen offer."""
    return outcomes.select(group, "group_size", _hit(k).cast("long").alias("hit"))


def mean_of_hits(hits: DataFrame) -> DataFrame:
    return hits.agg(F.avg("hit").alias("hitrate"))


def hitrate_at_k(df: DataFrame, k: int = 3, larger_than: int = LARGER_THAN, **columns) -> DataFrame:
    """Share of the sessions above ``larger_than`` offers with a chosen offer in the first k."""
    outcomes = large_sessions(session_outcomes(df, **columns), larger_than)
    return mean_of_hits(group_hit(outcomes, k, columns.get("group", "ranker_id")))


def _curve_rows(table: DataFrame, ks: Sequence[int], keep: Sequence[str] = ()) -> DataFrame:
    """Columns ``hit_<k>`` as rows ``(k, hitrate)``."""
    points = F.array(
        *[F.struct(F.lit(k).alias("k"), F.col(f"hit_{k}").alias("hitrate")) for k in ks]
    )
    return table.select(*keep, F.inline(points))


def hitrate_curve(
    df: DataFrame, ks: Sequence[int] = CURVE_KS, larger_than: int = LARGER_THAN, **columns
) -> DataFrame:
    """HitRate@k for every k, in one pass over the offers."""
    outcomes = large_sessions(session_outcomes(df, **columns), larger_than)
    return _curve_rows(outcomes.agg(*[F.avg(_hit(k)).alias(f"hit_{k}") for k in ks]), ks)


def poisson_steps(places: int = 12) -> list[float]:
    """Chances that a Poisson variable of mean 1 is at most 0, 1, 2..."""
    return [sum(math.exp(-1) / math.factorial(j) for j in range(i + 1)) for i in range(places)]


def _draw(seed: str, round_number: str, group: str) -> Column:
    key = F.concat_ws(":", F.lit(seed), F.col(round_number).cast("string"), F.coalesce(F.col(group).cast("string"), F.lit("")))
    return F.substring(F.md5(key), 1, 8)


def resampling_weight(seed: str, round_number: str, group: str) -> Column:
    """How often a session is drawn in a round: Poisson of mean 1, fixed by a hash of both."""
    return _times(_draw(seed, round_number, group))


def _times(drawn: Column) -> Column:
    """The Poisson variable for a number from 0 to 1, whose 32 binary places come as eight hex digits.

    Such texts of one length sort as their numbers do, so none is converted.
    """
    places = [math.ceil(step * 2**32) for step in poisson_steps()]
    reached = [(drawn >= f"{place:08x}").cast("long") for place in places if place < 2**32]
    return reduce(lambda a, b: a + b, reached)


def hitrate_bounds(
    df: DataFrame,
    ks: Sequence[int] = SUMMARY_KS,
    rounds: int = 200,
    share: float = 0.95,
    seed: str = "bootstrap",
    larger_than: int = LARGER_THAN,
    **columns,
) -> DataFrame:
    """``k, hitrate, low, high``: HitRate@k, and where ``share`` of its resampled values lie.

    A Poisson bootstrap over sessions: in each round every session counts as often as a hash of the
    round and its id says, so the bounds are the same in every run. All rounds and all k come from
    one pass over the outcomes, which sends a row per round and task.
    """
    group = columns.get("group", "ranker_id")
    outcomes = large_sessions(session_outcomes(df, **columns), larger_than)
    numbered = F.explode(F.sequence(F.lit(0), F.lit(rounds))).alias("_round")
    # The hash is a column of its own, so that it is worked out once for its twelve comparisons.
    drawn = outcomes.select(group, "best_rank", numbered).withColumn("_drawn", _draw(seed, "_round", group))
    # round 0 is the sample itself
    drawn = drawn.withColumn("_times", F.when(F.col("_round") == 0, 1).otherwise(_times(F.col("_drawn"))))
    hits = [F.sum(F.col("_times") * _hit(k)).alias(f"_hits_{k}") for k in ks]
    sums = drawn.groupBy("_round").agg(F.sum("_times").alias("_sessions"), *hits)
    rates = [F.try_divide(F.col(f"_hits_{k}"), F.col("_sessions")).alias(f"hit_{k}") for k in ks]
    each = _curve_rows(sums.select("_round", *rates), ks, ["_round"])
    resampled = F.when(F.col("_round") > 0, F.col("hitrate"))
    ends = ((1 - share) / 2, 1 - (1 - share) / 2)
    low, high = (_at_share(resampled, end) for end in ends)
    return each.groupBy("k").agg(
        F.max(F.when(F.col("_round") == 0, F.col("hitrate"))).alias("hitrate"),
        low.alias("low"),
        high.alias("high"),
    )


def _at_share(value: Column, share: float) -> Column:
    """The smallest of a group's values that at least ``share`` of them do not exceed."""
    ordered = F.array_sort(F.collect_list(value))
    place = F.greatest(F.ceil(F.round(F.lit(share) * F.size(ordered), 9)), F.lit(1)).cast("int")
    return F.try_element_at(ordered, place)


def hit_summary(df: DataFrame, ks: Sequence[int] = SUMMARY_KS, **columns) -> DataFrame:
    return hitrate_curve(df, ks, **columns)


def size_table(outcomes: DataFrame, ks: Sequence[int] = ()) -> DataFrame:
    """Sessions, and hits at each k, per session size."""
    return outcomes.groupBy("group_size").agg(
        F.count(F.lit(1)).alias("n_groups"), *[F.sum(_hit(k)).alias(f"hits_{k}") for k in ks]
    )


def size_bounds(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(
        F.min("group_size").alias("min_size"), F.max("group_size").alias("max_size")
    )


def session_sizes(df: DataFrame, group: str = "ranker_id", size: str = "group_size") -> DataFrame:
    """The distinct sessions of a frame that carries its session size on every row."""
    return df.select(group, size).distinct()


def _size_at(share: float) -> Column:
    """Smallest size that at least ``share`` of the sessions do not exceed, on a size table."""
    whole = Window.partitionBy()
    return F.min(
        F.when(F.col("_up_to") >= F.lit(share) * F.col("_all"), F.col("group_size"))
    ).over(whole)


def _with_quantiles(sizes: DataFrame, shares: dict[str, float]) -> DataFrame:
    up_to = F.sum("n_groups").over(Window.orderBy("group_size"))
    everything = F.sum("n_groups").over(Window.partitionBy())
    counted = sizes.select("*", up_to.alias("_up_to"), everything.alias("_all"))
    return counted.select(
        *sizes.columns, *[_size_at(share).alias(name) for name, share in shares.items()]
    )


def size_quantiles(outcomes: DataFrame) -> DataFrame:
    """Quartiles of the session sizes, each an actual size (``percentile_disc``)."""
    shares = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    return (
        _with_quantiles(size_table(outcomes), shares)
        .agg(*[F.max(name).alias(name) for name in shares])
    )


def hitrate_by_stratum(
    df: DataFrame, ks: Sequence[int] = CURVE_KS, larger_than: int = LARGER_THAN, **columns
) -> DataFrame:
    """Curves for all sessions and for small, medium and large ones, cut at the quartiles."""
    outcomes = large_sessions(session_outcomes(df, **columns), larger_than)
    sizes = _with_quantiles(size_table(outcomes, ks), {"q25": 0.25, "q75": 0.75})
    stratum = (
        F.when(F.col("group_size") <= F.col("q25"), "small")
        .when(F.col("group_size") <= F.col("q75"), "medium")
        .otherwise("large")
    )
    rates = (
        sizes.withColumn("stratum", F.explode(F.array(F.lit("all"), stratum)))
        .groupBy("stratum")
        .agg(*[(F.sum(f"hits_{k}") / F.sum("n_groups")).alias(f"hit_{k}") for k in ks])
    )
    return _curve_rows(rates, ks, ["stratum"])


def hitrate_by_size_bin(
    df: DataFrame,
    k: int = 3,
    bins: int = SIZE_BINS,
    min_sessions: int = MIN_SESSIONS_PER_BIN,
    larger_than: int = LARGER_THAN,
    **columns,
) -> DataFrame:
    """HitRate@k in log-scaled bins of the session size, sorted by bin centre.

    The largest size has a bin of its own past the last edge, centred like the last bin. With a
    single size all edges coincide, and all sessions are in that one.
    """
    outcomes = large_sessions(session_outcomes(df, **columns), larger_than)
    whole = Window.partitionBy()
    sizes = size_table(outcomes, [k]).select(
        "*",
        F.log10("group_size").alias("_log"),
        F.log10(F.min("group_size").over(whole)).alias("_low"),
        F.log10(F.max("group_size").over(whole)).alias("_high"),
    )
    bucket = F.width_bucket("_log", F.col("_low"), F.col("_high"), F.lit(bins)) - 1
    index = F.when(F.col("_low") == F.col("_high"), F.lit(bins).cast("long")).otherwise(bucket)
    width = (F.col("_high") - F.col("_low")) / bins
    edge = F.least("bin_idx", F.lit(bins - 1).cast("long"))

    def edge_size(step: int) -> Column:
        return F.pow(F.lit(10.0), F.col("_low") + (edge + step) * width)

    return (
        sizes.withColumn("bin_idx", index)
        .withColumn("bin_center", (edge_size(0) + edge_size(1)) / 2)
        .groupBy("bin_idx", "bin_center")
        .agg(
            (F.sum(f"hits_{k}") / F.sum("n_groups")).alias("hitrate"),
            F.sum("n_groups").alias("n_groups"),
        )
        .filter(F.col("n_groups") >= min_sessions)
        .orderBy("bin_center", "bin_idx")
    )


def ideal_dcg(chosen: Column, k: int) -> Column:
    """DCG@k of ``chosen`` 0/1 gains in the best order."""
    discounts = F.array(*[1 / F.log2(F.lit(place + 1.0)) for place in range(1, k + 1)])
    best_places = F.slice(discounts, 1, F.least(chosen, F.lit(k)).cast("int"))
    return F.aggregate(best_places, F.lit(0.0), lambda total, d: total + d)


def session_ndcg(
    df: DataFrame,
    k: int = 3,
    score: str = "pred_score",
    label: str = "selected",
    group: str | Sequence[str] = "ranker_id",
    row_id: str = "Id",
    hot: HotGroups | None = None,
    also: dict[str, Column] | None = None,
) -> DataFrame:
    """NDCG@k of each session for 0/1 labels, 1 without a chosen offer; ``also`` are more aggregates."""
    keys = [group] if isinstance(group, str) else list(group)
    ranked = rank_in_group(df, score, keys, row_id, "_rank", hot)
    gain = F.when((F.col("_rank") <= k) & (F.col(label) > 0), 1 / F.log2(F.col("_rank") + 1.0))
    per_session = ranked.groupBy(*keys).agg(
        F.coalesce(F.sum(gain), F.lit(0.0)).alias("_dcg"),
        F.count_if(F.col(label) > 0).alias("_chosen"),
        *[value.alias(name) for name, value in (also or {}).items()],
    )
    ideal = ideal_dcg(F.col("_chosen"), k)
    ndcg = F.when(F.col("_chosen") == 0, 1.0).otherwise(F.try_divide(F.col("_dcg"), ideal))
    return per_session.select(*keys, ndcg.alias("ndcg"), *(also or {}))


def ndcg_at_k(
    df: DataFrame,
    k: int = 3,
    score: str = "pred_score",
    label: str = "selected",
    group: str = "ranker_id",
    row_id: str = "Id",
    hot: HotGroups | None = None,
) -> DataFrame:
    """Mean NDCG@k for 0/1 labels over all sessions; one without a chosen offer counts as 1."""
    rows = df.select(group, row_id, score, label)
    return session_ndcg(rows, k, score, label, group, row_id, hot).agg(F.avg("ndcg").alias("ndcg"))
