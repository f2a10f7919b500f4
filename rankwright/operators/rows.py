"""Features computed from one offer alone, as named columns per family. No shuffle.

``row_features`` adds them in four projections, ordered by what they read: raw texts, minutes,
the families, and the flags that follow from those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwright.functions import columns as C
from rankwright.schema import (
    CARRIER_COLUMNS,
    CONVERTED_DURATIONS,
    LEGS,
    MAJOR_CARRIERS,
    POPULAR_ROUTES,
    ROUTE_COLUMNS,
    SEGMENTS,
    TIME_COLUMNS,
    segment_column,
)

RUSH_HOURS = ((6, 9), (17, 20))


def segment_counts() -> dict[str, Column]:
    """Segments per leg, from the raw duration texts.

    Counting must come before the texts are turned into minutes: an absent segment is NULL as
    text but 0 as minutes, and would then count as a segment.
    """
    return {
        f"n_segments_leg{leg}": C.count_present(
            [F.col(segment_column(leg, s, "duration")) for s in SEGMENTS]
        )
        for leg in LEGS
    }


def minutes() -> dict[str, Column]:
    """Duration texts replaced by whole minutes."""
    return {c: C.minutes_of(F.col(c)) for c in CONVERTED_DURATIONS}


def price_ratios() -> dict[str, Column]:
    price, taxes = F.col("totalPrice"), F.col("taxes")
    return {
        "price_per_tax": C.ratio(price, taxes + 1),
        "tax_rate": C.ratio(taxes, price + 1),
        "log_price": C.log_plus_one(price),
    }


def trip_shape() -> dict[str, Column]:
    """Total duration, duration ratio and the one-way flag; reads minutes."""
    out, back = C.or_zero(F.col("legs0_duration")), C.or_zero(F.col("legs1_duration"))
    no_return = (back == 0) | F.col(segment_column(1, 0, "departureFrom_airport_iata")).isNull()
    return {
        "total_duration": out + back,
        "duration_ratio": C.choose(back > 0, out / (back + 1), F.lit(1.0)),
        "is_one_way": C.flag(no_return),
    }


def carrier_counts() -> dict[str, Column]:
    """``l0_seg`` counts the named marketing carriers of both legs, despite its name."""
    carriers = [
        F.col(segment_column(leg, s, "marketingCarrier_code")) for leg in LEGS for s in SEGMENTS
    ]
    return {
        "l0_seg": C.count_present(carriers),
        "is_major_carrier": C.one_of(F.col(CARRIER_COLUMNS[0]), MAJOR_CARRIERS),
    }


def traveller_flags() -> dict[str, Column]:
    programs = F.coalesce("frequentFlyer", F.lit(""))
    n_programs = C.count_slashes(programs) + C.flag(programs != "")
    return {
        "n_ff_programs": n_programs,
        "has_corporate_tariff": C.present(F.col("corporateTariffCode")),
        "has_access_tp": C.flag(F.col("pricingInfo_isAccessTP") == 1),
        "is_popular_route": C.one_of(F.col("searchRoute"), POPULAR_ROUTES),
        "is_vip_freq": C.flag((F.col("isVip") == 1) | (n_programs > 0)),
    }


def baggage_and_fees() -> dict[str, Column]:
    baggage = C.total(
        [C.or_zero(F.col(segment_column(leg, 0, "baggageAllowance_quantity"))) for leg in LEGS]
    )
    fees = C.total([C.or_zero(F.col(f"miniRules{rule}_monetaryAmount")) for rule in (0, 1)])
    return {
        "baggage_total": baggage,
        "total_fees": fees,
        "has_baggage": C.flag(baggage > 0),
        "has_fees": C.flag(fees > 0),
        "fee_rate": C.ratio(fees, F.col("totalPrice") + 1),
    }


def cabins() -> dict[str, Column]:
    out, back = [F.col(segment_column(leg, 0, "cabinClass")) for leg in LEGS]
    return {
        "avg_cabin_class": C.mean_present([out, back]),
        "cabin_class_diff": C.or_zero(out) - C.or_zero(back),
    }


def direct_flags() -> dict[str, Column]:
    """Reads the segment counts and ``is_one_way``."""
    counts = [F.col(f"n_segments_leg{leg}") for leg in LEGS]
    direct0 = C.flag(counts[0] == 1)
    direct1 = C.choose(F.col("is_one_way") == 1, F.lit(0), C.flag(counts[1] == 1))
    return {
        "total_segments": C.total(counts),
        "is_direct_leg0": direct0,
        "is_direct_leg1": direct1,
        "both_direct": C.both(direct0, direct1),
    }


def _in_rush_hours(hour: Column) -> Column:
    (am0, am1), (pm0, pm1) = RUSH_HOURS
    return hour.between(am0, am1) | hour.between(pm0, pm1)


def times() -> dict[str, Column]:
    """Hour (12 when unknown), weekday (0 when unknown) and rush-hour flag of each time."""
    made = {}
    for name in TIME_COLUMNS:
        moment = C.to_moment(F.col(name))
        hour = F.coalesce(C.hour_of(moment), F.lit(12))
        made[f"{name}_hour"] = hour
        made[f"{name}_weekday"] = C.or_zero(C.weekday_of(moment))
        made[f"{name}_business_time"] = C.flag(_in_rush_hours(hour))
    return made


def route_key() -> Column:
    """``a_b__c_d`` of the four end airports; NULL when any is."""
    a, b, c, d = [F.col(name) for name in ROUTE_COLUMNS]
    return C.join_text(a, F.lit("_"), b, F.lit("__"), c, F.lit("_"), d)


def with_route(df: DataFrame) -> DataFrame:
    return df.withColumn("round_trip_route", route_key())


def row_features(df: DataFrame) -> DataFrame:
    """All per-offer features of an aligned frame."""
    families = (
        price_ratios()
        | trip_shape()
        | carrier_counts()
        | traveller_flags()
        | baggage_and_fees()
        | cabins()
        | times()
        | {"round_trip_route": route_key()}
    )
    return (
        df.withColumns(segment_counts())
        .withColumns(minutes())
        .withColumns(families)
        .withColumns(direct_flags())
    )
