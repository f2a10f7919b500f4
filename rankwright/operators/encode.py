"""Category codes: fitted as dense ranks per feature, applied as lookups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankwright.operators.skew import (
    BROADCAST_BYTES,
    BROADCAST_ROWS,
    BROADCAST_TOTAL_BYTES,
    ROWS_PER_TASK,
    find_hot_keys,
    lookup_join,
    running_total,
)
from rankwright.schema import CATEGORIES, MISSING
from rankwright.session import write_table

UNSEEN = -1


def _entry(name: str, kind: T.DataType) -> str:
    """One value in long form: its text, and a number to sort by when the column is numeric."""
    whole = f"CAST(`{name}` AS bigint)" if isinstance(kind, T.IntegralType) else "CAST(NULL AS bigint)"
    real = f"CAST(`{name}` AS double)" if isinstance(kind, T.FractionalType) else "CAST(NULL AS double)"
    return (
        f"named_struct('feature', '{name}', 'value', CAST(`{name}` AS string),"
        f" 'whole', {whole}, 'real', {real})"
    )


def value_stats(df: DataFrame, features: Sequence[str], label: str | None = None) -> DataFrame:
    """Rows, chosen rows and rows with a label, of every value of every feature, NULL included.

    One scan for all features: each row is turned into its values, and values are counted in the
    map tasks before anything is shuffled.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    entries = ", ".join(_entry(c, kinds[c]) for c in features)
    chosen = "CAST(NULL AS bigint)" if label is None else label
    long = df.selectExpr(f"{chosen} AS _chosen", f"inline(array({entries}))")
    return long.groupBy("feature", "value", "whole", "real").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("_chosen").alias("chosen"),
        F.count("_chosen").alias("labelled"),
    )


def codes_from_stats(stats: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``feature, value, code``: dense rank from 0 within each feature, NULL left out.

    Numeric features follow their numbers, text its bytes. A feature with more values than one
    task should sort is numbered in range slices.
    """
    values = stats.filter(F.col("value").isNotNull()).select("feature", "value", "whole", "real")
    ordered = [F.col("whole"), F.col("real"), F.col("value")]
    coded = running_total(values, ["feature"], ordered, "code", rows_per_task=rows_per_task)
    return coded.select("feature", "value", F.col("code").cast("int").alias("code"))


def fit_codes(
    df: DataFrame, features: Sequence[str] = CATEGORIES, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Codes of the values found in ``df``; pass the training part, filled by type."""
    stats = write_table(value_stats(df, features), "values")
    return codes_from_stats(stats, rows_per_task)


def extend_codes(codes: DataFrame, stats: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``codes`` and, for the values of ``stats`` that it lacks, the next codes of their features.

    Known values keep their codes, whatever became of them since; a model fitted on them stays
    valid. New ones follow the largest code of the feature, in the order of ``codes_from_stats``,
    from 0 if the feature is new. Extending by the same values again changes nothing.
    """
    known = codes.select("feature", "value", F.col("code").cast("int").alias("code"))
    values = stats.filter(F.col("value").isNotNull()).select("feature", "value", "whole", "real")
    new = write_table(values.join(known, ["feature", "value"], "left_anti"), "new_values")
    ordered = [F.col("whole"), F.col("real"), F.col("value")]
    placed = running_total(new, ["feature"], ordered, "_before", rows_per_task=rows_per_task)
    # one row per feature
    taken = known.groupBy("feature").agg((F.max("code") + 1).alias("_taken"))
    code = (F.coalesce("_taken", F.lit(0)) + F.col("_before")).cast("int").alias("code")
    added = placed.join(F.broadcast(taken), "feature", "left").select("feature", "value", code)
    return known.unionByName(added)


def fill_values(stats: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """The value table as it would be had the nulls been filled by type before counting."""
    is_number = F.col("feature").isin(list(numeric))
    return (
        stats.select(
            "feature",
            F.coalesce("value", F.when(is_number, "0").otherwise(MISSING)).alias("value"),
            F.coalesce("whole", F.when(is_number, F.lit(0).cast("long"))).alias("whole"),
            "real",
            "rows",
        )
        .groupBy("feature", "value", "whole", "real")
        .agg(F.sum("rows").alias("rows"))
    )


#: Dictionaries of so many values are put into the expression itself, which spares a join.
TINY = 64


@dataclass(frozen=True)
class Dictionary:
    """What is known of one feature's codes: whether they fit a broadcast, an only entry, all of a few."""

    small: bool
    only: tuple[str, int] | None = None
    entries: tuple[tuple[str, int], ...] | None = None


def measure_codes(codes: DataFrame) -> dict[str, Dictionary]:
    """The size of each feature's dictionary. One row per feature comes back.

    The smallest are marked for broadcast first, until together they reach the bound on what an
    executor should hold for one job.
    """
    sizes = codes.groupBy("feature").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.octet_length("value") + 16).alias("bytes"),
        F.min(F.struct("value", "code")).alias("first"),
    )
    seen = sorted(sizes.collect(), key=lambda r: (r.bytes, r.feature))
    tiny = [r.feature for r in seen if 1 < r.rows <= TINY and r.bytes <= 64 * TINY]
    listed: dict[str, list[tuple[str, int]]] = {}
    if tiny:  # TINY rows for each of these features
        for r in codes.filter(F.col("feature").isin(tiny)).select("feature", "value", "code").collect():
            listed.setdefault(r.feature, []).append((r.value, r.code))
    measured, taken = {}, 0
    for r in seen:
        taken += r.bytes
        small = (
            r.rows <= BROADCAST_ROWS
            and r.bytes <= BROADCAST_BYTES
            and taken <= BROADCAST_TOTAL_BYTES
        )
        only = (r["first"].value, r["first"].code) if r.rows == 1 else None
        entries = tuple(sorted(listed[r.feature])) if r.feature in listed else None
        measured[r.feature] = Dictionary(small, only, entries)
    return measured


def apply_codes(
    df: DataFrame,
    codes: DataFrame,
    features: Sequence[str] = CATEGORIES,
    dictionaries: dict[str, Dictionary] | None = None,
    row_id: str = "Id",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Replace each category by its code; a value without one becomes -1.

    Features whose dictionary is measured small are looked up by broadcast, all in one stage; those
    of a few values are looked up in a constant. Hot values of the others are searched for once.
    """
    known = measure_codes(codes) if dictionaries is None else dictionaries
    joined = [c for c in features if c in known and known[c].only is None and known[c].entries is None]
    large = {f"_value_{c}": F.col(c) for c in joined if not known[c].small}
    hot = find_hot_keys(df, large, rows_per_task)
    keyed = df
    for name in joined:
        dictionary = codes.filter(F.col("feature") == name).select(
            F.col("value").alias(f"_value_{name}"), F.col("code").alias(f"_code_{name}")
        )
        text = F.col(name).cast("string")
        if known[name].small:
            same = text == F.col(f"_value_{name}")
            keyed = keyed.join(F.broadcast(dictionary), same, "left")
        else:
            keyed = lookup_join(
                keyed.withColumn(f"_value_{name}", text),
                dictionary,
                [f"_value_{name}"],
                small=False,
                spread_by=(row_id,),
                hot=hot[f"_value_{name}"],
            )

    def coded(name: str) -> Column:
        if name in joined:
            return F.coalesce(F.col(f"_code_{name}"), F.lit(UNSEEN))
        if name in known and known[name].entries is not None:
            pairs = F.create_map(*[F.lit(x) for entry in known[name].entries for x in entry])
            return F.coalesce(F.try_element_at(pairs, F.col(name).cast("string")), F.lit(UNSEEN))
        if name in known:
            value, code = known[name].only
            return F.when(F.col(name).cast("string") == F.lit(value), F.lit(code)).otherwise(F.lit(UNSEEN))
        return F.lit(UNSEEN)

    wanted = set(features)
    return keyed.select(*[coded(c).alias(c) if c in wanted else c for c in df.columns])
