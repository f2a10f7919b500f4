"""Features that compare an offer with the others of its session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankwright.functions import columns as C
from rankwright.operators.skew import (
    HotGroups,
    find_hot_groups,
    fits_broadcast,
    lookup_join,
    null_safe_join,
    running_total,
    split_hot,
    with_group_stats,
)
from rankwright.session import write_table

GROUP_FEATURES = [
    "group_size",
    "group_size_log",
    "price_rank",
    "duration_rank",
    "price_pct_rank",
    "is_cheapest",
    "price_from_median",
    "is_min_segments",
    "is_direct_cheapest",
]

_FIGURES = ["_prices", "_price_min", "_price_std", "_segments_min", "_direct_min"]


def average_rank(value: str, group: str) -> Column:
    """Rank with ties sharing their mean place; NULL for NULL, which takes no place.

    ``rank`` is the first place of a tie and the running count over peers its last.
    """
    ordered = Window.partitionBy(group).orderBy(F.col(value).asc_nulls_last())
    places = F.rank().over(ordered) + F.count(F.lit(1)).over(ordered)
    return F.when(F.col(value).isNotNull(), places / 2)


def with_offer_count(
    df: DataFrame, group: str = "ranker_id", row_id: str = "Id", hot: HotGroups | None = None
) -> DataFrame:
    """Only ``group_size``, the offers of a session that have an id.

    Asked for before the row features, it moves the exchange in front of them: the shuffle then
    carries the raw columns alone, and every later window finds the rows in place.
    """
    return with_group_stats(df, [group], {"group_size": F.count(row_id)}, hot, (row_id,))


def _session_figures(df: DataFrame, row_id: str, price: str) -> dict[str, Column]:
    direct_price = F.when(F.col("is_direct_leg0") == 1, F.col(price))
    sized = {} if "group_size" in df.columns else {"group_size": F.count(row_id)}
    return sized | {
        "_prices": F.count(price),
        "_price_min": F.min(price),
        "_price_std": F.stddev_samp(price),
        "_segments_min": F.min("l0_seg"),
        "_direct_min": F.min(direct_price),
    }


def group_features(
    df: DataFrame,
    group: str = "ranker_id",
    row_id: str = "Id",
    price: str = "totalPrice",
    duration: str = "total_duration",
    hot: HotGroups | None = None,
) -> DataFrame:
    """Add the session features; needs the row features.

    Ordinary sessions take one exchange and two sorts for all windows. The cheapest direct price
    is a window minimum too, which saves the aggregate and the join back. A ``group_size`` that
    is already there is kept.
    """
    hot = find_hot_groups(df, [group]) if hot is None else hot
    if not hot:
        return _compare(_by_window(df, group, row_id, price, duration), price)
    ordinary, crowded = split_hot(df, hot)
    figures = _by_window(ordinary, group, row_id, price, duration).unionByName(
        _by_aggregate(crowded, group, row_id, price, duration, hot.rows_per_task)
    )
    return _compare(figures, price)


def _by_window(df: DataFrame, group: str, row_id: str, price: str, duration: str) -> DataFrame:
    # The whole session as a frame of the price order, so that one window step covers both.
    whole = (
        Window.partitionBy(group)
        .orderBy(F.col(price).asc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    ordered = Window.partitionBy(group).orderBy(F.col(price).asc_nulls_last())
    figures = _session_figures(df, row_id, price)
    # Durations are ranked first: the price order then stands for all that follows, the median too.
    placed = df.withColumn("_duration_rank", average_rank(duration, group)).select(
        "*",
        *[f.over(whole).alias(name) for name, f in figures.items()],
        F.row_number().over(ordered).alias("_price_place"),
        average_rank(price, group).alias("price_rank"),
        F.col("_duration_rank").alias("duration_rank"),
    )
    # The median lies between two places of the price order. Unlike ``percentile``, which keeps a map
    # of a session's prices, this can spill.
    middle = [F.floor((F.col("_prices") + step) / 2) for step in (1, 2)]
    at_middle = [F.max(F.when(F.col("_price_place") == m, F.col(price))).over(whole) for m in middle]
    median = (at_middle[0] + at_middle[1]) / 2
    return placed.withColumn("_price_median", median).drop("_price_place", "_duration_rank")


def _ranked_values(df: DataFrame, group: str, value: str, rows_per_task: int) -> DataFrame:
    """Distinct values per session with their count and the number of rows below them."""
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(group, value)
        .agg(F.count(F.lit(1)).alias("_ties"))
    )
    return running_total(
        counted, [group], [F.col(value)], "_below", F.col("_ties"), rows_per_task=rows_per_task
    )


def _attach_place(
    df: DataFrame, narrow: DataFrame, ranks: DataFrame, value: str, group: str, row_id: str,
    rows_per_task: int,
) -> DataFrame:
    """Average rank of each row's value, looked up in the ranks of the distinct values."""
    place = F.col("_below") + (F.col("_ties") + 1) / 2
    places = ranks.select(group, value, place.alias("_place"))
    small = fits_broadcast(places)
    # A session without an id is a session too: inside a struct, NULL equals NULL.
    session = F.struct(F.col(group)).alias("_session")
    on = ["_session", value]
    hot = None if small else find_hot_groups(narrow.select(session, value), on, rows_per_task)
    places = places.select(session, value, "_place")
    return lookup_join(df.select("*", session), places, on, small, (row_id,), hot=hot).drop("_session")


def _by_aggregate(
    df: DataFrame, group: str, row_id: str, price: str, duration: str, rows_per_task: int
) -> DataFrame:
    """The same figures for hot sessions, with no window over a whole session.

    The few columns that are counted again and again are written once, so the wide rows behind
    them are read only for that and for the final lookups.
    """
    needed = [group, row_id, price, duration, "l0_seg", "is_direct_leg0"]
    narrow = write_table(df.select(*needed), "crowded")
    figures = narrow.groupBy(group).agg(
        *[f.alias(name) for name, f in _session_figures(df, row_id, price).items()]
    )
    prices = write_table(_ranked_values(narrow, group, price, rows_per_task), "prices")
    durations = write_table(_ranked_values(narrow, group, duration, rows_per_task), "durations")
    # The value at place p is the largest one with fewer than p rows below it.
    middle = [F.floor((F.col("_prices") + step) / 2) for step in (1, 2)]
    at_middle = [
        F.max(F.when(F.col("_below") < m, F.col(price))).alias(f"_m{i}")
        for i, m in enumerate(middle)
    ]
    medians = (
        null_safe_join(prices, figures.select(group, "_prices"), [group], "inner")
        .groupBy(group)
        .agg(*at_middle)
        .select(group, ((F.col("_m0") + F.col("_m1")) / 2).alias("_price_median"))
    )
    out = df
    for value, ranks, name in ((price, prices, "price_rank"), (duration, durations, "duration_rank")):
        out = _attach_place(out, narrow, ranks, value, group, row_id, rows_per_task)
        out = out.withColumnRenamed("_place", name)
    # One row per hot session: bounded, see the skew module.
    return null_safe_join(null_safe_join(out, figures, [group], "left"), medians, [group], "left")


def _compare(df: DataFrame, price: str) -> DataFrame:
    value = F.col(price)
    direct_cheapest = (F.col("is_direct_leg0") == 1) & (value == F.col("_direct_min"))
    return df.withColumns(
        {
            "group_size_log": C.log_plus_one(F.col("group_size")),
            "price_pct_rank": C.ratio(F.col("price_rank"), F.col("_prices")),
            "is_cheapest": C.flag(value == F.col("_price_min")),
            "price_from_median": C.ratio(
                value - F.col("_price_median"), F.col("_price_std") + 1
            ),
            "is_min_segments": C.flag(F.col("l0_seg") == F.col("_segments_min")),
            "is_direct_cheapest": C.or_zero(C.flag(direct_cheapest)),
        }
    ).drop(*_FIGURES, "_price_median")
