"""Aggregates over a training set, and the joins that bring them back to the offers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwright.operators.rows import route_key
from rankwright.operators.skew import HotGroups, lookup_join, with_group_stats
from rankwright.schema import CARRIER_COLUMNS


def carrier_popularity(train: DataFrame, leg: int, label: str = "selected") -> DataFrame:
    """Share of chosen offers per marketing carrier of one leg."""
    return train.groupBy(CARRIER_COLUMNS[leg]).agg(F.avg(label).alias(f"carrier{leg}_pop"))


def popularity_from_stats(stats: DataFrame) -> dict[int, DataFrame]:
    """The same of all legs, from one count of values with their labels."""
    share = F.col("chosen") / F.col("labelled")
    return {
        leg: stats.filter((F.col("feature") == name) & F.col("value").isNotNull()).select(
            F.col("value").alias(name), share.alias(f"carrier{leg}_pop")
        )
        for leg, name in enumerate(CARRIER_COLUMNS)
    }


def route_frequency(train: DataFrame) -> DataFrame:
    """Offers per round trip; one-way offers share the NULL route."""
    return (
        train.select(route_key().alias("round_trip_route"))
        .groupBy("round_trip_route")
        .agg(F.count(F.lit(1)).alias("rt_route_count"))
    )


def cheapest_direct(df: DataFrame, group: str = "ranker_id", price: str = "totalPrice") -> DataFrame:
    """Lowest price of the direct offers of each session that has any."""
    return (
        df.filter(F.col("is_direct_leg0") == 1)
        .groupBy(group)
        .agg(F.min(price).alias("min_direct"))
    )


def group_sizes(df: DataFrame, group: str = "ranker_id") -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("group_size"))


def with_group_size(
    df: DataFrame, group: str = "ranker_id", row_id: str = "Id", hot: HotGroups | None = None
) -> DataFrame:
    """Session size on every row, without an aggregate and a join back."""
    return with_group_stats(df, [group], {"group_size": F.count(F.lit(1))}, hot, (row_id,))


def attach_carrier_popularity(
    df: DataFrame,
    popularity: dict[int, DataFrame],
    small: dict[int, bool] | None = None,
    row_id: str = "Id",
    hot: dict[str, HotGroups] | None = None,
) -> DataFrame:
    """Popularity of both legs' carriers, 0.0 for an unknown or absent one, and their product."""
    for leg, table in popularity.items():
        known = None if small is None else small.get(leg)
        name = CARRIER_COLUMNS[leg]
        df = lookup_join(df, table, [name], known, (row_id,), hot=(hot or {}).get(name))
    pops = {f"carrier{leg}_pop": F.coalesce(f"carrier{leg}_pop", F.lit(0.0)) for leg in (0, 1)}
    return df.withColumns(pops).withColumn(
        "carrier_pop_product", F.col("carrier0_pop") * F.col("carrier1_pop")
    )


def attach_route_frequency(
    df: DataFrame,
    routes: DataFrame,
    small: bool | None = None,
    row_id: str = "Id",
    hot: HotGroups | None = None,
) -> DataFrame:
    """``rt_route_count`` as found, and ``round_trip_freq`` with 0 for an unknown route."""
    joined = lookup_join(df, routes, ["round_trip_route"], small, (row_id,), hot=hot)
    return joined.withColumn("round_trip_freq", F.coalesce("rt_route_count", F.lit(0)))


def with_direct_cheapest(
    df: DataFrame,
    group: str = "ranker_id",
    price: str = "totalPrice",
    row_id: str = "Id",
    hot: HotGroups | None = None,
) -> DataFrame:
    """Flag the direct offers at their session's lowest direct price."""
    direct_price = F.when(F.col("is_direct_leg0") == 1, F.col(price))
    priced = with_group_stats(df, [group], {"_min_direct": F.min(direct_price)}, hot, (row_id,))
    cheapest = (F.col("is_direct_leg0") == 1) & (F.col(price) == F.col("_min_direct"))
    return priced.withColumn(
        "is_direct_cheapest", F.coalesce(cheapest.cast("int"), F.lit(0))
    ).drop("_min_direct")


def attach_offers(
    ranked: DataFrame, offers: DataFrame, keys: tuple[str, str] = ("ranker_id", "Id")
) -> DataFrame:
    """Offer details back on ranked ids. Both keys together are unique, so no skew arises.

    An offer without a session id finds its details too.
    """
    group, row_id = keys
    named = {k: f"_right_{k}" for k in keys}
    right = offers.withColumnsRenamed(named)
    same = F.col(group).eqNullSafe(F.col(named[group])) & (F.col(row_id) == F.col(named[row_id]))
    return ranked.join(right, same, "left").drop(*named.values())
