"""The one feature job behind both training and scoring, and the tables it needs."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankwright.operators.columns import align_schema, fill_by_type
from rankwright.operators.encode import (
    Dictionary,
    apply_codes,
    codes_from_stats,
    extend_codes,
    fill_values,
    measure_codes,
    value_stats,
)
from rankwright.operators.groups import group_features, with_offer_count
from rankwright.operators.lookups import (
    attach_carrier_popularity,
    attach_route_frequency,
    popularity_from_stats,
)
from rankwright.operators.rows import route_key, row_features
from rankwright.operators.skew import HotGroups, find_hot_groups, find_hot_keys
from rankwright.schema import CARRIER_COLUMNS, CATEGORIES, OFFER_SCHEMA
from rankwright.session import write_table

ROUTE = "round_trip_route"


@dataclass(frozen=True)
class Artifacts:
    """Lookups fitted on a training set, with their measured sizes."""

    carriers: dict[int, DataFrame]
    routes: DataFrame
    codes: DataFrame
    small_carriers: dict[int, bool] | None = None  # None: not measured
    small_routes: bool | None = None
    dictionaries: dict[str, Dictionary] | None = None


def _measured(carriers: dict[int, DataFrame], routes: DataFrame, codes: DataFrame) -> Artifacts:
    """Measure all lookups in one job."""
    keys = codes.select("feature", "value", F.col("code").cast("int").alias("code"))
    for name, table in [*((f"carrier{leg}", t) for leg, t in carriers.items()), (ROUTE, routes)]:
        keys = keys.unionByName(
            table.select(
                F.lit(name).alias("feature"),
                F.col(table.columns[0]).alias("value"),
                F.lit(0).alias("code"),
            )
        )
    sizes = measure_codes(keys)
    # A lookup without rows has no size to report, and is small.
    small = {name: size.small for name, size in sizes.items()}
    return Artifacts(
        carriers,
        routes,
        codes,
        {leg: small.get(f"carrier{leg}", True) for leg in carriers},
        small.get(ROUTE, True),
        {c: size for c, size in sizes.items() if c in CATEGORIES},
    )


def numeric_categories(schema: T.StructType = OFFER_SCHEMA) -> list[str]:
    return [c for c in CATEGORIES if isinstance(schema[c].dataType, T.NumericType)]


COUNTS = "feature string, value string, whole bigint, real double, rows bigint, chosen bigint, labelled bigint"


def fit_counts(train: DataFrame, label: str = "selected") -> DataFrame:
    """All that ``fit_artifacts`` learns from offers: rows, chosen and labelled rows of every value.

    One scan of ``train``. Counts of several sets of offers add up, see ``merge_counts``. Categories
    that ``train`` lacks are NULL in all rows, and are counted as one.
    """
    rows = align_schema(train).withColumn(ROUTE, route_key())
    absent = [c for c in CATEGORIES if c not in train.columns]
    stats = value_stats(rows, [*(c for c in CATEGORIES if c not in absent), *absent[:1], ROUTE], label)
    if len(absent) < 2:
        return stats
    shared = F.when(F.col("feature") == absent[0], F.array(*map(F.lit, absent))).otherwise(F.array("feature"))
    return stats.withColumn("feature", F.explode(shared))


def merge_counts(counts: DataFrame, *more: DataFrame) -> DataFrame:
    """The counts of all sets of offers together, which may be saved, merged again and so on."""
    return (
        reduce(DataFrame.unionByName, more, counts)
        .groupBy("feature", "value", "whole", "real")
        .agg(*[F.sum(c).alias(c) for c in ("rows", "chosen", "labelled")])
    )


def save_counts(counts: DataFrame, folder: str, day: str) -> None:
    """Keep the counts of one day (or any other part); those of that day saved before are replaced."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", day):
        raise ValueError(f"{day!r} is no name for a day: letters, digits, '_', '.' and '-' only")
    counts.write.mode("overwrite").parquet(f"{folder}/day={day}")


def load_counts(spark: SparkSession, folder: str, days: Sequence[str] | None = None) -> DataFrame:
    """The saved counts of all days, or of those named, added up. No offers are read."""
    saved = spark.read.schema(f"{COUNTS}, day string").parquet(folder)
    chosen = saved if days is None else saved.filter(F.col("day").isin(list(days)))
    return merge_counts(chosen.drop("day"))


def artifacts_from_counts(counts: DataFrame, known: DataFrame | None = None) -> Artifacts:
    """Popularity, route counts and codes of counted offers.

    With ``known``, a dictionary fitted before, its values keep their codes and others get the next.
    """
    stats = write_table(counts, "values")
    found = F.col("value").isNotNull()
    carriers = popularity_from_stats(stats)
    routes = stats.filter((F.col("feature") == ROUTE) & found).select(
        F.col("value").alias(ROUTE), F.col("rows").alias("rt_route_count")
    )
    filled = fill_values(stats.filter(F.col("feature") != ROUTE), numeric_categories())
    codes = codes_from_stats(filled) if known is None else extend_codes(known, filled)
    return _measured(carriers, routes, write_table(codes, "codes"))


def fit_artifacts(train: DataFrame, label: str = "selected", known: DataFrame | None = None) -> Artifacts:
    """Carrier popularity, route frequency and category codes, from one scan of ``train``.

    All three are counts per value, so the rows are turned into values once and counted together;
    the count table is written, and everything else is read from it.
    """
    return artifacts_from_counts(fit_counts(train, label), known)


_MANIFEST = "number bigint, version string"


def _versions(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def _newest(spark: SparkSession, folder: str):
    """The last row of the manifest, None if nothing has been saved as a whole."""
    try:
        return _versions(spark, folder).orderBy(F.col("number").desc(), F.col("version").desc()).first()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def save_artifacts(artifacts: Artifacts, folder: str) -> str:
    """Add a version of the lookups to ``folder`` and return its name.

    The manifest names a version only when all its tables are written, and its one file appears as
    a whole. A save that breaks off leaves what was there in force; earlier versions stay readable.
    """
    spark = artifacts.codes.sparkSession
    last = _newest(spark, folder)
    number = 1 if last is None else last.number + 1
    version = f"{number:06d}-{uuid.uuid4().hex[:12]}"
    base = f"{folder}/{version}"
    for leg, table in artifacts.carriers.items():
        table.write.parquet(f"{base}/carrier{leg}_pop")
    artifacts.routes.write.parquet(f"{base}/round_trip_freq")
    artifacts.codes.write.partitionBy("feature").parquet(f"{base}/codes")
    row = spark.createDataFrame([(number, version)], _MANIFEST)
    row.coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return version


def load_artifacts(spark: SparkSession, folder: str, version: str | None = None) -> Artifacts:
    """Read the newest version of saved lookups, or the one named, and measure them again.

    Keys are read as text. Only versions of the manifest are read, so all tables are of one save.
    """
    if version is None:
        last = _newest(spark, folder)
        if last is None:
            raise FileNotFoundError(f"no artifacts have been saved as a whole in {folder}")
        version = last.version
    elif _newest(spark, folder) is None or not _versions(spark, folder).filter(F.col("version") == version).count():
        raise FileNotFoundError(f"{folder} has no whole version {version}")
    base = f"{folder}/{version}"
    carriers = {
        leg: spark.read.parquet(f"{base}/carrier{leg}_pop").withColumn(
            name, F.col(name).cast("string")
        )
        for leg, name in enumerate(CARRIER_COLUMNS)
    }
    routes = spark.read.parquet(f"{base}/round_trip_freq").withColumn(
        ROUTE, F.col(ROUTE).cast("string")
    )
    codes = (
        spark.read.schema("value string, code int, feature string")
        .parquet(f"{base}/codes")
        .select("feature", F.col("value").cast("string").alias("value"), "code")
    )
    return _measured(carriers, routes, codes)


def load_fitted_files(spark: SparkSession, folder: str) -> Artifacts:
    """Read lookups fitted elsewhere: one parquet file each, and a JSON dictionary of codes.

    The files are ``carrier0_pop.parquet``, ``carrier1_pop.parquet``, ``round_trip_freq.parquet``
    and ``cat_mappings.json``, an object of the form ``{feature: {value: code}}``. Codes are kept
    as they are.
    """
    carriers = {}
    for leg, name in enumerate(CARRIER_COLUMNS):
        table = spark.read.parquet(f"{folder}/carrier{leg}_pop.parquet")
        carriers[leg] = table.select(
            F.col(name).cast("string").alias(name),
            F.col(f"carrier{leg}_pop").cast("double").alias(f"carrier{leg}_pop"),
        ).filter(F.col(name).isNotNull())
    routes = spark.read.parquet(f"{folder}/round_trip_freq.parquet")
    count = next(c for c in routes.columns if c != ROUTE)
    routes = routes.select(
        F.col(ROUTE).cast("string").alias(ROUTE), F.col(count).cast("long").alias("rt_route_count")
    ).filter(F.col(ROUTE).isNotNull())
    text = spark.read.option("wholetext", True).text(f"{folder}/cat_mappings.json")
    parsed = F.from_json("value", "map<string, map<string, int>>")
    by_feature = text.select(F.explode(parsed).alias("feature", "values"))
    codes = by_feature.select("feature", F.explode("values").alias("value", "code"))
    return _measured(carriers, routes, write_table(codes, "codes"))


def build_features(
    df: DataFrame,
    artifacts: Artifacts,
    group: str = "ranker_id",
    row_id: str = "Id",
    hot: HotGroups | None = None,
) -> DataFrame:
    """Offers to filled feature rows: one exchange on the session, lookups by measured size.

    The session size comes first so that the exchange carries the raw columns only.
    """
    hot = find_hot_groups(df, [group]) if hot is None else hot
    aligned = align_schema(df)
    sized = with_offer_count(aligned, group, row_id, hot)
    compared = group_features(row_features(sized), group, row_id, hot=hot)
    # Hot values of lookups that are shuffled are counted on the input, before any join.
    small = artifacts.small_carriers or {}
    large = {CARRIER_COLUMNS[leg]: F.col(CARRIER_COLUMNS[leg]) for leg, s in small.items() if not s}
    if artifacts.small_routes is False:
        large[ROUTE] = route_key()
    busy = find_hot_keys(aligned, large)
    popular = attach_carrier_popularity(
        compared, artifacts.carriers, artifacts.small_carriers, row_id, busy
    )
    routed = attach_route_frequency(
        popular, artifacts.routes, artifacts.small_routes, row_id, busy.get(ROUTE)
    )
    return fill_by_type(routed.drop("rt_route_count", ROUTE))


def encode_features(
    features: DataFrame,
    artifacts: Artifacts,
    categories: Sequence[str] = CATEGORIES,
    row_id: str = "Id",
) -> DataFrame:
    return apply_codes(features, artifacts.codes, categories, artifacts.dictionaries, row_id)
