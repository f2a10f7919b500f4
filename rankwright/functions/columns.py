"""Scalar building blocks shared by the feature expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def extract_first(text: Column, pattern: str) -> Column:
    """Capture group 1 of ``pattern``; NULL where it does not match."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def to_whole(text: Column) -> Column:
    """Text to a long; NULL where it is not a number."""
    return text.try_cast("long")


def contains(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def replace_leading(text: Column, pattern: str, replacement: str = "") -> Column:
    """Replace ``pattern`` where the text starts with it."""
    return F.regexp_replace(text, f"^(?:{pattern})", replacement)


def count_slashes(text: Column) -> Column:
    return F.regexp_count(text, F.lit("/"))


def join_text(*parts: Column) -> Column:
    """Concatenate; NULL when any part is NULL."""
    return F.concat(*parts)


def one_of(value: Column, allowed: list) -> Column:
    """Membership as 0/1; NULL stays NULL."""
    return value.isin(allowed).cast("int")


def present(value: Column) -> Column:
    return value.isNotNull().cast("int")


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def choose(condition: Column, then: Column, otherwise: Column) -> Column:
    return F.when(condition, then).otherwise(otherwise)


def log_plus_one(value: Column) -> Column:
    """Natural log of ``value + 1``; NULL at -1 and below."""
    return F.log1p(value)


def total(values: list[Column]) -> Column:
    """Horizontal sum."""
    return reduce(lambda a, b: a + b, values)


def mean_present(values: list[Column]) -> Column:
    """Horizontal mean over the values that are not NULL; NULL when none is."""
    return F.try_divide(total([or_zero(v) for v in values]), total([present(v) for v in values]))


def count_present(values: list[Column]) -> Column:
    return total([present(v) for v in values])


def to_moment(text: Column) -> Column:
    """Text to a timestamp without zone; NULL where it cannot be read.

    Hours and weekdays are those written in the text, whatever the session's time zone.
    """
    return text.try_cast("timestamp_ntz")


def hour_of(moment: Column) -> Column:
    return F.hour(moment)


def weekday_of(moment: Column) -> Column:
    """1 = Monday to 7 = Sunday."""
    return F.weekday(moment) + 1


def ratio(top: Column, bottom: Column) -> Column:
    """Division that gives NULL, not an error, for a zero divisor."""
    return F.try_divide(top, bottom)


def flag(condition: Column) -> Column:
    return condition.cast("int")


def both(left: Column, right: Column) -> Column:
    """And of two 0/1 columns."""
    return left.bitwiseAND(right)


def as_text(value: Column) -> Column:
    return value.cast("string")


def as_number(value: Column) -> Column:
    return value.cast("double")


def route_origin(route: Column) -> Column:
    return F.substring(route, 1, 3)


def route_destination(route: Column) -> Column:
    return F.substring(route, 4, 3)


def upper_code(code: Column) -> Column:
    return F.upper(code)


def clock_part(duration: Column) -> Column:
    """What follows the first dot, as in ``1.02:30:00``; the whole text where nothing does."""
    after_dot = F.get(F.split(duration, r"\."), F.lit(1))
    return F.coalesce(F.nullif(after_dot, F.lit("")), duration)


def minutes_of(duration: Column) -> Column:
    """``[D.]HH:MM:SS`` as whole minutes; parts that cannot be read, and NULL, count 0.

    The optional day prefix is matched, not removed, so each part needs a single regex pass.
    """
    def part(pattern: str) -> Column:
        # Only digits reach the cast: trying it on '' is many times slower than not matching.
        return or_zero(to_whole(extract_first(duration, pattern)))

    days, hours, minutes = part(r"^(\d+)\."), part(r"^(?:\d+\.)?(\d+):"), part(r":(\d+):")
    return days * 1440 + hours * 60 + minutes
