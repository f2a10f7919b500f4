"""Schema, projection and filter operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankwright.operators.skew import HotGroups, with_group_stats
from rankwright.schema import LATE_SEGMENT_COLUMNS, MISSING, NOT_FEATURES, OFFER_SCHEMA


def align_schema(df: DataFrame, schema: T.StructType = OFFER_SCHEMA) -> DataFrame:
    """Cast to the declared types, add each missing column as a typed NULL, keep extra columns."""
    present = set(df.columns)
    declared = [
        f"CAST({f.name if f.name in present else 'NULL'} AS {f.dataType.simpleString()}) AS {f.name}"
        for f in schema.fields
    ]
    names = set(schema.names)
    return df.selectExpr(*declared, *[f"`{c}`" for c in df.columns if c not in names])


def normalise_strings(df: DataFrame) -> DataFrame:
    """Bring every text type (such as ``varchar`` and ``char``) to plain string."""
    textual = (T.StringType, T.VarcharType, T.CharType)
    return df.select(
        *[
            F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, textual) else f.name
            for f in df.schema.fields
        ]
    )


def fill_by_type(df: DataFrame) -> DataFrame:
    """NULL numbers become 0 and NULL text ``missing``; other types stay as they are."""

    def filled(field: T.StructField) -> str:
        name = f"`{field.name}`"
        if isinstance(field.dataType, T.NumericType):
            return f"coalesce({name}, CAST(0 AS {field.dataType.simpleString()})) AS {name}"
        if isinstance(field.dataType, T.StringType):
            return f"coalesce({name}, '{MISSING}') AS {name}"
        return name

    return df.selectExpr(*[filled(f) for f in df.schema.fields])


def feature_names(df: DataFrame, exclude: Sequence[str] = NOT_FEATURES) -> list[str]:
    dropped = set(exclude) | set(LATE_SEGMENT_COLUMNS)
    return [c for c in df.columns if c not in dropped]


def select_features(
    df: DataFrame, exclude: Sequence[str] = NOT_FEATURES, keep: Sequence[str] = ()
) -> DataFrame:
    """All columns but the excluded and the third- and fourth-segment ones; ``keep`` stays."""
    names = feature_names(df, exclude)
    return df.select(*[k for k in keep if k not in names], *names)


def validate_features(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Raise, before any job runs, when an expected feature is missing."""
    absent = [c for c in expected if c not in df.columns]
    if absent:
        raise ValueError(f"missing feature columns: {absent}")
    return df


def numeric_matrix(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The features as numbers; one that is still text becomes the constant -1.0."""
    types = dict(df.dtypes)
    return df.select(
        *keep,
        *[F.lit(-1.0).alias(c) if types[c] == "string" else F.col(c) for c in features],
    )


def keep_large_groups(
    df: DataFrame,
    larger_than: int = 10,
    group: str = "ranker_id",
    row_id: str = "Id",
    hot: HotGroups | None = None,
) -> DataFrame:
    """Rows whose session has more than ``larger_than`` rows, with ``group_size`` added."""
    sized = with_group_stats(
        df, [group], {"group_size": F.count(F.lit(1))}, hot, spread_by=(row_id,)
    )
    return sized.filter(F.col("group_size") > larger_than)


def keep_direct(df: DataFrame) -> DataFrame:
    return df.filter(F.col("is_direct_leg0") == 1)


def label_strata(df: DataFrame, low: float, high: float, size: str = "group_size") -> DataFrame:
    """``small`` up to ``low``, ``medium`` up to ``high``, ``large`` above."""
    return df.withColumn(
        "stratum",
        F.when(F.col(size) <= low, "small").when(F.col(size) <= high, "medium").otherwise("large"),
    )


def filter_strata(
    df: DataFrame, stratum: str, low: float, high: float, size: str = "group_size"
) -> DataFrame:
    bounds = {
        "small": F.col(size) <= low,
        "medium": (F.col(size) > low) & (F.col(size) <= high),
        "large": F.col(size) > high,
    }
    return df.filter(bounds[stratum])


def drop_empty_requests(requests: DataFrame) -> DataFrame:
    """Requests with at least one flight (a NULL list counts as empty)."""
    return requests.filter(F.size("flights") > 0)
