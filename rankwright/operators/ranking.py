"""Order, top-k and ranked output per session."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankwright.functions import columns as C
from rankwright.operators.skew import HotGroups, running_total

# Spark prunes a row_number() <= k filter inside each map task, so a session sends at most k rows
# per task to the shuffle. Beyond this k that is no longer small, and the full ranking is used.
PRUNED_K = 100


def score_order(score: str = "pred_score", row_id: str = "Id") -> list[Column]:
    """Best score first, ties by id; a missing or NaN score comes last."""
    value = F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))
    return [value.desc_nulls_last(), F.col(row_id).asc()]


def rank_in_group(
    df: DataFrame,
    score: str = "pred_score",
    group: str | Sequence[str] = "ranker_id",
    row_id: str = "Id",
    out: str = "rank",
    hot: HotGroups | None = None,
) -> DataFrame:
    """Places 1..n in each session, without ties."""
    keys = [group] if isinstance(group, str) else list(group)
    ranked = running_total(df, keys, score_order(score, row_id), out, hot=hot)
    return ranked.withColumn(out, (F.col(out) + 1).cast("int"))


def top_k_per_group(
    df: DataFrame,
    k: int,
    score: str = "pred_score",
    group: str = "ranker_id",
    row_id: str = "Id",
    hot: HotGroups | None = None,
) -> DataFrame:
    """The ``k`` best offers of each session, with their ``rank``."""
    if k > PRUNED_K:
        return rank_in_group(df, score, group, row_id, "rank", hot).filter(F.col("rank") <= k)
    ordered = Window.partitionBy(group).orderBy(*score_order(score, row_id))
    return df.withColumn("rank", F.row_number().over(ordered)).filter(F.col("rank") <= k)


def make_submission(
    df: DataFrame,
    score: str = "pred_score",
    group: str = "ranker_id",
    row_id: str = "Id",
    hot: HotGroups | None = None,
) -> DataFrame:
    """``Id, ranker_id, selected``, where ``selected`` holds the rank."""
    ranked = rank_in_group(df.select(row_id, group, score), score, group, row_id, "_rank", hot)
    return ranked.select(row_id, group, F.col("_rank").alias("selected"))


def rank_requests(
    df: DataFrame,
    score: str = "score",
    request: str = "request_id",
    session: str = "ranker_id",
    row_id: str = "Id",
    hot: HotGroups | None = None,
    page_rows: int | None = None,
    carry: Sequence[str] = (),
    first: int | None = None,
    group: str | list[str] | None = None,
) -> DataFrame:
    """One response per request: its offers as ``{Id, score}``, best first.

    A request is one row, whatever its length. With ``page_rows`` one beyond that goes on over
    further rows, numbered by ``page``, for requests that no row should hold; no offer is left out.
    ``carry`` are more columns of the request, ``group`` the columns to compare within, ``request``
    if not given.

    With ``first`` only so many offers of a request are kept. Those beyond it are dropped in the
    tasks that read them, so neither the shuffle nor an array holds more.
    """
    group = request if group is None else group
    rows = df.select(request, *carry, session, row_id, score)
    if first is None:
        ranked = rank_in_group(rows, score, group, row_id, "_rank", hot)
    else:
        ranked = top_k_per_group(rows, first, score, group, row_id, hot).withColumnRenamed("rank", "_rank")
    entry = F.struct(
        F.col("_rank"), F.col(row_id).alias("Id"), F.col(score).cast("double").alias("score")
    )
    pages = [] if page_rows is None else [((F.col("_rank") - 1) / page_rows).cast("int").alias("page")]
    return (
        ranked.groupBy(request, *carry, session, *pages)
        .agg(F.sort_array(F.collect_list(entry)).alias("_entries"))
        .select(
            request,
            *carry,
            session,
            *(["page"] if pages else []),
            F.transform("_entries", lambda e: F.struct(e["Id"], e["score"])).alias(
                "ranked_flights"
            ),
        )
    )


def most_important(importance: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` highest importances, sorted."""
    return importance.orderBy(F.col("importance").desc(), "feature").limit(n)


def present_ranked(
    df: DataFrame, rank: str = "rank", score: str = "score", request: str = "ranker_id"
) -> DataFrame:
    """The texts a result list shows for each ranked offer."""
    premium = F.col("legs0_segments0_cabinClass") == 2
    return df.select(
        request,
        "Id",
        F.col(rank).alias("position"),
        C.flag(F.col(rank) == 1).alias("is_best_choice"),
        F.col("legs0_segments0_marketingCarrier_code").alias("carrier"),
        C.route_origin(F.col("searchRoute")).alias("origin"),
        C.route_destination(F.col("searchRoute")).alias("destination"),
        F.when(premium, "Premium").otherwise("Economy").alias("cabin"),
        C.clock_part(F.col("legs0_duration")).alias("duration"),
        F.expr("format_number(totalPrice, '#,##0.###')").alias("price"),
        F.round(score, 3).alias("score"),
    )
