"""Work per group that holds up when one group has a large share of all rows.

A window over a group puts that group in one task. That is the cheapest plan while groups are
small, so it is what every operator here uses for them. Groups above ``ROWS_PER_TASK`` are found
by one counting job over the key columns and take another, exact way:

* whole-group figures come from a partial-and-final aggregate, joined back by broadcast;
* ordered figures (ranks, running totals) come from a range split of the group's rows, whose
  pieces are counted apart and shifted by the rows of the pieces before them;
* lookups whose rows pile up on one key answer that key by broadcast and spread its rows.

How many such groups can exist is bounded: each has more than ``total / MAX_HOT_GROUPS`` rows, so
there are fewer than ``MAX_HOT_GROUPS`` of them, which is what makes broadcasting their figures
safe at any size of input.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankwright.session import write_table

ROWS_PER_TASK = 1_000_000
MAX_HOT_GROUPS = 100_000
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 * 1024 * 1024
BROADCAST_TOTAL_BYTES = 256 * 1024 * 1024

_HOT_ROWS = "_hot_rows"
_SALT = "_salt"
_SLICE = "_slice"


@dataclass(frozen=True)
class HotGroups:
    """The groups too large for one task; ``table`` is None when there are none."""

    keys: tuple[str, ...]
    rows_per_task: int
    table: DataFrame | None = None
    rows: int = 0

    def __bool__(self) -> bool:
        return self.table is not None

    @property
    def slices(self) -> int:
        return max(2, math.ceil(self.rows / self.rows_per_task))


def no_hot_groups(keys: Sequence[str]) -> HotGroups:
    """For callers that know a bound on the group size, such as one request per input row."""
    return HotGroups(tuple(keys), ROWS_PER_TASK)


def find_hot_groups(
    df: DataFrame, keys: Sequence[str], rows_per_task: int = ROWS_PER_TASK
) -> HotGroups:
    """Count rows per group (one job over the key columns) and keep the oversized groups."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(_HOT_ROWS))
    seen = counts.agg(F.max(_HOT_ROWS).alias("largest"), F.sum(_HOT_ROWS).alias("total")).first()
    if seen.largest is None:
        return HotGroups(tuple(keys), rows_per_task)
    limit = max(rows_per_task, math.ceil(seen.total / MAX_HOT_GROUPS))
    if seen.largest <= limit:
        return HotGroups(tuple(keys), limit)
    table = write_table(counts.filter(F.col(_HOT_ROWS) > limit), "hot")
    rows = table.agg(F.sum(_HOT_ROWS)).first()[0]
    return HotGroups(tuple(keys), limit, table, rows)


def find_hot_keys(
    df: DataFrame, keys: dict[str, Column], rows_per_task: int = ROWS_PER_TASK
) -> dict[str, HotGroups]:
    """Oversized values of several lookup keys, each named and given as an expression.

    All are counted in one pass over ``df``, before anything is joined to it, so a job with many
    large lookups searches once.
    """
    if not keys:
        return {}
    entries = F.array(
        *[F.struct(F.lit(n).alias("key"), c.cast("string").alias("value")) for n, c in keys.items()]
    )
    counts = (
        df.select(F.inline(entries)).groupBy("key", "value").agg(F.count(F.lit(1)).alias(_HOT_ROWS))
    )
    counts = write_table(counts, "counts")
    seen = counts.groupBy("key").agg(F.max(_HOT_ROWS).alias("largest"), F.sum(_HOT_ROWS).alias("total"))
    found = {}
    for r in seen.collect():  # one row per key
        limit = max(rows_per_task, math.ceil(r.total / MAX_HOT_GROUPS))
        if r.largest <= limit:
            found[r.key] = HotGroups((r.key,), limit)
            continue
        table = counts.filter((F.col("key") == r.key) & (F.col(_HOT_ROWS) > limit))
        table = table.select(F.col("value").alias(r.key), _HOT_ROWS)
        found[r.key] = HotGroups((r.key,), limit, table, table.agg(F.sum(_HOT_ROWS)).first()[0])
    return {n: found.get(n, HotGroups((n,), rows_per_task)) for n in keys}


def null_safe_join(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join a broadcast table on keys that may be NULL; the table's key columns are dropped."""
    renamed = small.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    )
    joined = df.join(F.broadcast(renamed), condition, how)
    return joined if how == "left_semi" else joined.drop(*[f"_right_{k}" for k in keys])


def _mark(df: DataFrame, hot: HotGroups) -> DataFrame:
    return null_safe_join(df, hot.table.select(*hot.keys, _HOT_ROWS), hot.keys, "left")


def split_hot(df: DataFrame, hot: HotGroups) -> tuple[DataFrame, DataFrame]:
    """Rows of ordinary groups, and rows of hot groups."""
    marked = _mark(df, hot)
    ordinary = marked.filter(F.col(_HOT_ROWS).isNull()).drop(_HOT_ROWS)
    return ordinary, null_safe_join(df, hot.table.select(*hot.keys), hot.keys, "left_semi")


def _spread(spread_by: Sequence[str], hot: HotGroups) -> Column:
    """0 for ordinary rows; rows of hot groups get one of several salts, fixed by their own id."""
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(hot.slices)) + 1
    return F.when(F.col(_HOT_ROWS).isNotNull(), salt).otherwise(F.lit(0))


def with_group_stats(
    df: DataFrame,
    keys: Sequence[str],
    stats: dict[str, Column],
    hot: HotGroups | None = None,
    spread_by: Sequence[str] = ("Id",),
) -> DataFrame:
    """Add whole-group aggregates (``min``, ``count``, ``stddev_samp``...) to every row.

    One exchange on ``keys``; later windows and aggregates on the same keys reuse it.
    """
    hot = find_hot_groups(df, keys) if hot is None else hot
    if not hot:
        window = Window.partitionBy(*keys)
        return df.select("*", *[stat.over(window).alias(name) for name, stat in stats.items()])
    exact = (
        null_safe_join(df, hot.table.select(*keys), keys, "left_semi")
        .groupBy(*keys)
        .agg(*[stat.alias(f"_exact_{name}") for name, stat in stats.items()])
    )
    marked = null_safe_join(_mark(df, hot), exact, keys, "left")
    window = Window.partitionBy(*keys, _SALT)
    is_hot = F.col(_HOT_ROWS).isNotNull()
    return marked.withColumn(_SALT, _spread(spread_by, hot)).select(
        *df.columns,
        *[
            F.when(is_hot, F.col(f"_exact_{name}")).otherwise(stat.over(window)).alias(name)
            for name, stat in stats.items()
        ],
    )


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    out: str,
    weight: Column | None = None,
    hot: HotGroups | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add the weight (default: the number) of the rows before each row in its group's order.

    ``order`` must leave no ties among rows of a group, so pre-aggregate equal values and pass
    their count as ``weight``. ``keys`` may be empty: then the whole table is one group.
    """
    if hot is None:
        hot = find_hot_groups(df, keys, rows_per_task)
    if not hot:
        return _running_window(df, keys, order, out, weight)
    if keys:
        ordinary, crowded = split_hot(df, hot)
        whole = _running_window(ordinary, keys, order, out, weight)
        return whole.unionByName(_running_slices(crowded, keys, order, out, weight, hot))
    return _running_slices(df, keys, order, out, weight, hot)


def _running_window(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str, weight: Column | None
) -> DataFrame:
    ordered = Window.partitionBy(*keys).orderBy(*order)
    if weight is None:
        return df.withColumn(out, (F.row_number().over(ordered) - 1).cast("long"))
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(weight).over(before), F.lit(0).cast("long")))


def _running_slices(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    out: str,
    weight: Column | None,
    hot: HotGroups,
) -> DataFrame:
    """Range-split the rows, count each piece, and shift each piece by those before it.

    The split is written down once, because its sampled bounds must be the same for counting the
    pieces and for numbering the rows inside them.
    """
    amount = F.lit(1).cast("long") if weight is None else weight
    pieces = write_table(
        df.repartitionByRange(hot.slices, *[F.col(k) for k in keys], *order).withColumn(
            _SLICE, F.spark_partition_id()
        ),
        "slices",
    )
    # At most one row per slice, plus one more for each group that starts inside a slice.
    sizes = pieces.groupBy(*keys, _SLICE).agg(F.sum(amount).alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *keys, _SLICE, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start")
    )
    numbered = _running_window(pieces, [*keys, _SLICE], order, out, weight)
    return (
        null_safe_join(numbered, starts, [*keys, _SLICE], "left")
        .withColumn(out, F.col(out) + F.col("_start"))
        .select(*df.columns, out)
    )


def fits_broadcast(table: DataFrame) -> bool:
    """Measure a table (rows, and bytes of its text) against the broadcast bounds."""
    text = [f.name for f in table.schema.fields if isinstance(f.dataType, T.StringType)]
    width = reduce(
        lambda a, b: a + b,
        [F.coalesce(F.octet_length(c), F.lit(0)) for c in text],
        F.lit(16 * len(table.columns)),
    )
    seen = table.agg(F.count(F.lit(1)).alias("rows"), F.sum(width).alias("bytes")).first()
    return seen.rows <= BROADCAST_ROWS and (seen.bytes or 0) <= BROADCAST_BYTES


def lookup_join(
    df: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    small: bool | None = None,
    spread_by: Sequence[str] = ("Id",),
    rows_per_task: int = ROWS_PER_TASK,
    hot: HotGroups | None = None,
) -> DataFrame:
    """Left join a table with one row per key.

    A table measured small is broadcast: no shuffle. A larger one is shuffled with the rows,
    except that keys on which rows pile up (NULL among them, which matches nothing) are answered
    by broadcast and their rows spread over salts.
    """
    small = fits_broadcast(lookup) if small is None else small
    if small:
        return df.join(F.broadcast(lookup), list(on), "left")
    hot = find_hot_groups(df, on, rows_per_task) if hot is None else hot
    if not hot:
        return df.join(lookup, list(on), "left")
    values = [c for c in lookup.columns if c not in on]
    answers = lookup.join(F.broadcast(hot.table.select(*on)), list(on), "left_semi").select(
        *on, *[F.col(v).alias(f"_hot_{v}") for v in values]
    )
    salted = _mark(df, hot).withColumn(_SALT, _spread(spread_by, hot))
    rest = salted.join(lookup.withColumn(_SALT, F.lit(0).cast("long")), [*on, _SALT], "left")
    is_hot = F.col(_HOT_ROWS).isNotNull()
    return rest.join(F.broadcast(answers), list(on), "left").select(
        *df.columns,
        *[F.when(is_hot, F.col(f"_hot_{v}")).otherwise(F.col(v)).alias(v) for v in values],
    )
