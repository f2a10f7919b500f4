"""Split by time, whole sessions on one side."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwright.operators.skew import (
    ROWS_PER_TASK,
    HotGroups,
    running_total,
    with_group_stats,
)
from rankwright.session import write_table


def session_time_cut(
    df: DataFrame,
    time: str = "requestDate",
    share: float = 0.9,
    group: str = "ranker_id",
    rows_per_task: int = ROWS_PER_TASK,
) -> datetime.datetime:
    """The session time that at least ``share`` of the sessions do not exceed (exact).

    A session's time is its earliest row. Sessions are counted per time first, so what is put in
    order is the distinct times, in range slices if there are many of them.
    """
    times = write_table(
        df.groupBy(group)
        .agg(F.min(time).alias("_time"))
        .filter(F.col("_time").isNotNull())
        .groupBy("_time")
        .agg(F.count(F.lit(1)).alias("_sessions")),
        "times",
    )
    total = times.agg(F.sum("_sessions")).first()[0]
    placed = running_total(
        times, [], [F.col("_time")], "_before", F.col("_sessions"), rows_per_task=rows_per_task
    )
    reached = F.col("_before") + F.col("_sessions") >= F.lit(share) * F.lit(total)
    return placed.filter(reached).agg(F.min("_time")).first()[0]


def time_split(
    df: DataFrame,
    time: str = "requestDate",
    share: float = 0.9,
    group: str = "ranker_id",
    row_id: str = "Id",
    hot: HotGroups | None = None,
) -> DataFrame:
    """Add ``part``: ``train`` for the sessions up to the cut, ``valid`` for those after it."""
    cut = session_time_cut(df, time, share, group)
    timed = with_group_stats(df, [group], {"_time": F.min(time)}, hot, (row_id,))
    part = F.when(F.col("_time") <= F.lit(cut), "train").otherwise("valid")
    return timed.withColumn("part", part).drop("_time")
