"""Search offers as a view over order tables: one offer per line item.

A session is a customer's orders of one year, its offers their line items. The columns are picked
so that ties, nulls, unreadable texts, one-row sessions and unknown carriers all occur.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwright.operators.skew import (
    HotGroups,
    find_hot_groups,
    with_group_stats,
)
from rankwright.schema import FLIGHT_SCHEMA, segment_column

TABLE_SCHEMAS = {
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int,"
    " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
    " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double,"
    " c_mktsegment string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int,"
    " p_retailprice double",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
}


#: Rows of the view that a task should hold; its rows are wide once their texts are made.
ROWS_PER_PART = 200_000

# What is kept of each table's columns, made before the joins so that these move little.
_KEPT = {
    "lineitem": ["*"],
    "orders": [
        "o_orderkey",
        "o_custkey",
        "o_orderdate",
        "o_orderpriority IN ('1-URGENT', '2-HIGH') AS o_urgent",
        "CASE o_orderstatus WHEN 'F' THEN 1D WHEN 'O' THEN 0D END AS o_access",
    ],
    "customer": [
        "c_custkey",
        "c_nationkey",
        "double(c_acctbal > 5000) AS c_vip",
        "CASE c_mktsegment WHEN 'FURNITURE' THEN '' WHEN 'MACHINERY' THEN 'SU'"
        " WHEN 'AUTOMOBILE' THEN 'SU/S7' WHEN 'HOUSEHOLD' THEN 'SU/S7/U6' END AS c_programs",
    ],
    "part": [
        "p_partkey",
        "p_size",
        "CASE p_type WHEN 'ECONOMY' THEN 1D WHEN 'SMALL' THEN NULL ELSE 2D END AS p_cabin",
        "CASE p_type WHEN 'ECONOMY' THEN 1D WHEN 'LARGE' THEN NULL ELSE 2D END AS p_cabin_back",
    ],
    "supplier": ["s_suppkey", "s_nationkey"],
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _place_code(key: str) -> str:
    return f"concat('N', lpad({key}, 2, '0'))"


def _duration(minutes: str) -> str:
    return (
        f"concat(if({minutes} >= 1440, concat({minutes} div 1440, '.'), ''),"
        f" lpad({minutes} % 1440 div 60, 2, '0'), ':', lpad({minutes} % 60, 2, '0'), ':00')"
    )


def _carrier(key: str) -> str:
    return f"get(array('SU', 'S7', 'U6', 'DP', 'UT'), int({key} % 6))"


def _at(hour: str) -> str:
    return (
        "if(l_linenumber = 6, 'unknown', concat(date_format(l_shipdate, 'yyyy-MM-dd'), 'T',"
        f" lpad(({hour}) % 24, 2, '0'), ':30:00'))"
    )


def _on_return(value: str) -> str:
    """A column of the second leg: NULL on one-way offers."""
    return f"if(l_returnflag <> 'N', {value}, NULL)"


def _offer_columns() -> dict[str, str]:
    out_trip = _duration("(p_size * 47 + l_linenumber * 13)")
    back_trip = _duration("(p_size * 41 + l_linenumber * 17)")
    customer, supplier = _place_code("c_nationkey"), _place_code("s_nationkey")
    return {
        "Id": "Id",
        "ranker_id": "ranker_id",
        "requestDate": "o_orderdate",
        "totalPrice": "l_extendedprice",
        "taxes": "if(l_linenumber <> 7, l_extendedprice * (l_tax + 0D), NULL)",
        "legs0_duration": out_trip,
        "legs1_duration": _on_return(back_trip),
        segment_column(0, 0, "duration"): out_trip,
        segment_column(1, 0, "duration"): _on_return(back_trip),
        segment_column(0, 1, "duration"): f"if(p_size % 3 = 0, {back_trip}, NULL)",
        segment_column(1, 1, "duration"): _on_return(f"if(p_size % 2 = 0, {out_trip}, NULL)"),
        segment_column(0, 0, "marketingCarrier_code"): _carrier("l_suppkey"),
        segment_column(1, 0, "marketingCarrier_code"): _on_return(_carrier("l_partkey")),
        segment_column(0, 0, "departureFrom_airport_iata"): customer,
        segment_column(0, 0, "arrivalTo_airport_iata"): supplier,
        segment_column(1, 0, "departureFrom_airport_iata"): _on_return(supplier),
        segment_column(1, 0, "arrivalTo_airport_iata"): _on_return(customer),
        "searchRoute": "CASE l_partkey % 8 WHEN 0 THEN 'MOWLED/LEDMOW' WHEN 1 THEN 'MOWLED'"
        f" WHEN 2 THEN NULL ELSE concat({customer}, {supplier}) END",
        "frequentFlyer": "c_programs",
        "corporateTariffCode": "if(o_urgent, string(l_suppkey % 10), NULL)",
        "pricingInfo_isAccessTP": "o_access",
        "isVip": "c_vip",
        segment_column(0, 0, "baggageAllowance_quantity"): "if(l_linenumber <> 5,"
        " double(l_linenumber % 3), NULL)",
        segment_column(1, 0, "baggageAllowance_quantity"): _on_return("double(l_linenumber % 2)"),
        segment_column(0, 0, "cabinClass"): "p_cabin",
        segment_column(1, 0, "cabinClass"): _on_return("p_cabin_back"),
        "miniRules0_monetaryAmount": "if(l_linestatus <> 'F',"
        " l_extendedprice * (l_discount + 0D), NULL)",
        "miniRules1_monetaryAmount": _on_return("l_quantity"),
        "legs0_departureAt": _at("p_size * 7 + l_linenumber"),
        "legs0_arrivalAt": _at("p_size * 7 + l_linenumber + 3"),
        "legs1_departureAt": _on_return(_at("p_size * 5 + l_linenumber")),
        "legs1_arrivalAt": _on_return(_at("p_size * 5 + l_linenumber + 3")),
        "nationality": "bigint(c_nationkey)",
        "companyID": "o_custkey % 50",
        "sex": "o_custkey % 2",
        "bySelf": "l_orderkey % 2",
        "pred_score": "l_quantity",
    }


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with the columns of the other tables that offers are made of.

    Joins without hints: Catalyst broadcasts a side by its file size, or shuffles both. Orders meet
    their customers before the line items do, so line items are shuffled twice at most.
    """

    def table(name: str) -> DataFrame:
        return read_table(spark, folder, name).selectExpr(*_KEPT[name])

    placed = table("orders").join(table("customer"), F.expr("o_custkey = c_custkey"))
    placed = placed.withColumn("ranker_id", F.expr("o_custkey * 10000 + year(o_orderdate)"))
    return (
        table("lineitem")
        .join(table("part"), F.expr("l_partkey = p_partkey"))
        .join(table("supplier"), F.expr("l_suppkey = s_suppkey"))
        .join(placed, F.expr("l_orderkey = o_orderkey"))
    )


_ID = (
    "concat_ws('-', string(l_orderkey), string(l_linenumber), string(l_partkey),"
    " string(l_suppkey), string(bigint(round(l_extendedprice * 100)))) AS Id"
)


def parts_for(spark: SparkSession, folder: str) -> int:
    """Partitions in which the wide rows of the view fit their tasks; only row counts are read."""
    rows = read_table(spark, folder, "lineitem").count()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / ROWS_PER_PART))


_session_profiles: dict[tuple[str, str], HotGroups] = {}


def session_profile(spark: SparkSession, folder: str) -> HotGroups:
    """The oversized sessions of a folder of tables, counted once per application."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _session_profiles:
        _session_profiles[key] = find_hot_groups(_lines(spark, folder), ["ranker_id"])
    return _session_profiles[key]


def _as_offers(lines: DataFrame, *keep: str) -> DataFrame:
    return lines.selectExpr(*[f"{made} AS {name}" for name, made in _offer_columns().items()], *keep)


def offers(
    spark: SparkSession, folder: str, labelled: bool = True, parts: int | None = None
) -> DataFrame:
    """The offer view; the chosen offer of a session has its highest discount, ties by ``Id``.

    With labels its rows lie by session: they move as line items, in ``parts`` partitions, and are
    made wide behind that exchange, which later windows over a session reuse. Rows of oversized
    sessions stay apart.
    """
    lines = _lines(spark, folder)
    if not labelled:
        return _as_offers(lines.selectExpr("*", _ID))
    hot = session_profile(spark, folder)
    if not hot:
        lines = lines.repartition(parts_for(spark, folder) if parts is None else parts, "ranker_id")
    lines = lines.selectExpr("*", _ID)
    first = {"_first": F.min(F.struct(-(F.col("l_discount") + F.lit(0.0)), F.col("Id")))}
    marked = with_group_stats(lines, ["ranker_id"], first, hot)
    marked = marked.withColumn("selected", (F.col("Id") == F.col("_first.Id")).cast("long"))
    return _as_offers(marked, "selected")


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """The offers packed into ranking requests: one request per order, with all its line items.

    An order is what was asked for at once, so nothing is cut, and a request has as many flights as
    its order has lines. The session ids sent along repeat between requests, as ids drawn at random
    would.
    """
    return _packed(spark, folder, "substring_index(string(l_orderkey), '-', 1)")


def session_requests(spark: SparkSession, folder: str) -> DataFrame:
    """The offers packed into ranking requests: one request per session, with all its offers.

    All offers of a session are compared with each other, however many they are. Offers without a
    session id are one request.
    """
    return _packed(spark, folder, "coalesce(string(ranker_id), 'none')")


def _packed(spark: SparkSession, folder: str, request: str) -> DataFrame:
    """Requests with the id given as SQL; line items move, and are made wide where they are packed."""
    lines = _lines(spark, folder).withColumn("request_id", F.expr(request))
    placed = lines.repartition(parts_for(spark, folder), "request_id").selectExpr("*", _ID)
    rows = _as_offers(placed, "request_id")
    flight_columns = [f.name for f in FLIGHT_SCHEMA.fields if f.name in rows.columns]
    return rows.groupBy("request_id", (F.col("ranker_id") % 1000).alias("ranker_id")).agg(
        F.collect_list(F.struct(*flight_columns)).alias("flights")
    )
