"""The offer view and the features as DuckDB SQL, to check the Spark jobs against.

Each constant or function is a piece of SQL; ``with_tables`` puts the needed pieces in front of a
select. The texts follow the definitions of the features, not the Spark code.
"""

from __future__ import annotations

from rankwright.schema import CATEGORIES, OFFER_SCHEMA

LEG0 = "legs0_segments0_"
LEG1 = "legs1_segments0_"


def _duration(minutes: str) -> str:
    return (
        f"(CASE WHEN {minutes} >= 1440 THEN ({minutes} // 1440)::VARCHAR || '.' ELSE '' END"
        f" || lpad((({minutes} % 1440) // 60)::VARCHAR, 2, '0') || ':'"
        f" || lpad(({minutes} % 60)::VARCHAR, 2, '0') || ':00')"
    )


def _carrier(key: str) -> str:
    return (
        f"(CASE {key} % 6 WHEN 0 THEN 'SU' WHEN 1 THEN 'S7' WHEN 2 THEN 'U6'"
        f" WHEN 3 THEN 'DP' WHEN 4 THEN 'UT' END)"
    )


def _place(key: str) -> str:
    return f"('N' || lpad({key}::VARCHAR, 2, '0'))"


def _at(hour: str) -> str:
    return (
        "(CASE WHEN l_linenumber = 6 THEN 'unknown' ELSE strftime(l_shipdate, '%Y-%m-%d') || 'T'"
        f" || lpad((({hour}) % 24)::VARCHAR, 2, '0') || ':30:00' END)"
    )


def _back(value: str) -> str:
    return f"(CASE WHEN l_returnflag <> 'N' THEN {value} END)"


_OUT = "(p_size * 47 + l_linenumber * 13)"
_RET = "(p_size * 41 + l_linenumber * 17)"
_FROM, _TO = _place("c_nationkey"), _place("s_nationkey")

BASE = f"""base AS (
  SELECT
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
              CAST(round(l_extendedprice * 100) AS BIGINT)) AS Id,
    o_custkey * 10000 + year(o_orderdate) AS ranker_id,
    o_orderdate AS requestDate,
    l_extendedprice AS totalPrice,
    CASE WHEN l_linenumber <> 7 THEN l_extendedprice * (l_tax + 0.0) END AS taxes,
    {_duration(_OUT)} AS legs0_duration,
    {_back(_duration(_RET))} AS legs1_duration,
    {_duration(_OUT)} AS {LEG0}duration,
    {_back(_duration(_RET))} AS {LEG1}duration,
    CASE WHEN p_size % 3 = 0 THEN {_duration(_RET)} END AS legs0_segments1_duration,
    {_back(f"CASE WHEN p_size % 2 = 0 THEN {_duration(_OUT)} END")} AS legs1_segments1_duration,
    {_carrier("l_suppkey")} AS {LEG0}marketingCarrier_code,
    {_back(_carrier("l_partkey"))} AS {LEG1}marketingCarrier_code,
    {_FROM} AS {LEG0}departureFrom_airport_iata,
    {_TO} AS {LEG0}arrivalTo_airport_iata,
    {_back(_TO)} AS {LEG1}departureFrom_airport_iata,
    {_back(_FROM)} AS {LEG1}arrivalTo_airport_iata,
    CASE l_partkey % 8 WHEN 0 THEN 'MOWLED/LEDMOW' WHEN 1 THEN 'MOWLED' WHEN 2 THEN NULL
      ELSE {_FROM} || {_TO} END AS searchRoute,
    CASE c_mktsegment WHEN 'FURNITURE' THEN '' WHEN 'MACHINERY' THEN 'SU'
      WHEN 'AUTOMOBILE' THEN 'SU/S7' WHEN 'HOUSEHOLD' THEN 'SU/S7/U6' END AS frequentFlyer,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH')
      THEN (l_suppkey % 10)::VARCHAR END AS corporateTariffCode,
    CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'O' THEN 0.0::DOUBLE END
      AS pricingInfo_isAccessTP,
    CASE WHEN c_acctbal > 5000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS isVip,
    CASE WHEN l_linenumber <> 5 THEN (l_linenumber % 3)::DOUBLE END
      AS {LEG0}baggageAllowance_quantity,
    {_back("(l_linenumber % 2)::DOUBLE")} AS {LEG1}baggageAllowance_quantity,
    (CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'SMALL' THEN NULL ELSE 2 END)::DOUBLE
      AS {LEG0}cabinClass,
    {_back("(CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN NULL ELSE 2 END)::DOUBLE")}
      AS {LEG1}cabinClass,
    CASE WHEN l_linestatus <> 'F' THEN l_extendedprice * (l_discount + 0.0) END
      AS miniRules0_monetaryAmount,
    {_back("l_quantity")} AS miniRules1_monetaryAmount,
    {_at("p_size * 7 + l_linenumber")} AS legs0_departureAt,
    {_at("p_size * 7 + l_linenumber + 3")} AS legs0_arrivalAt,
    {_back(_at("p_size * 5 + l_linenumber"))} AS legs1_departureAt,
    {_back(_at("p_size * 5 + l_linenumber + 3"))} AS legs1_arrivalAt,
    c_nationkey::BIGINT AS nationality,
    o_custkey % 50 AS companyID,
    o_custkey % 2 AS sex,
    l_orderkey % 2 AS bySelf,
    l_quantity AS pred_score,
    l_discount + 0.0 AS discount
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
)"""

OFFERS = """offers AS (
  SELECT * EXCLUDE (discount),
    CAST(row_number() OVER (PARTITION BY ranker_id ORDER BY discount DESC, Id) = 1 AS BIGINT)
      AS selected
  FROM base
)"""


def minutes(column: str) -> str:
    rest = f"regexp_replace({column}, '^\\d+\\.', '')"

    def part(text: str, pattern: str, factor: int) -> str:
        found = f"try_cast(nullif(regexp_extract({text}, '{pattern}', 1), '') AS BIGINT)"
        return f"coalesce({found}, 0) * {factor}"

    return (
        f"({part(column, '^(\\d+)\\.', 1440)} + {part(rest, '^(\\d+):', 60)}"
        f" + {part(rest, ':(\\d+):', 1)})"
    )


def _counted(columns: list[str]) -> str:
    return "(" + " + ".join(f"({c} IS NOT NULL)::INT" for c in columns) + ")"


def _time_features(column: str) -> str:
    moment = f"try_cast({column} AS TIMESTAMP)"
    hour = f"coalesce(hour({moment}), 12)"
    rush = f"({hour} BETWEEN 6 AND 9 OR {hour} BETWEEN 17 AND 20)"
    return (
        f"{hour} AS {column}_hour, coalesce(isodow({moment}), 0) AS {column}_weekday,"
        f" {rush}::INT AS {column}_business_time"
    )


ROUTE_KEY = (
    f"{LEG0}departureFrom_airport_iata || '_' || {LEG0}arrivalTo_airport_iata || '__' ||"
    f" {LEG1}departureFrom_airport_iata || '_' || {LEG1}arrivalTo_airport_iata"
)

_MINUTE_COLUMNS = {
    "legs0_duration": "m0",
    "legs1_duration": "m1",
    f"{LEG0}duration": "m00",
    "legs0_segments1_duration": "m01",
    f"{LEG1}duration": "m10",
    "legs1_segments1_duration": "m11",
}


def row_tables(source: str = "offers") -> list[str]:
    """Two tables, ``minuted`` and ``rowf``: the offers of ``source`` with per-row features."""
    times = ("legs0_departureAt", "legs0_arrivalAt", "legs1_departureAt", "legs1_arrivalAt")
    minuted = f"""minuted AS (
  SELECT *, {", ".join(f"{minutes(c)} AS {m}" for c, m in _MINUTE_COLUMNS.items())},
    {_counted([f"{LEG0}duration", "legs0_segments1_duration"])} AS n_segments_leg0,
    {_counted([f"{LEG1}duration", "legs1_segments1_duration"])} AS n_segments_leg1,
    coalesce(miniRules0_monetaryAmount, 0) + coalesce(miniRules1_monetaryAmount, 0) AS total_fees,
    coalesce({LEG0}baggageAllowance_quantity, 0) + coalesce({LEG1}baggageAllowance_quantity, 0)
      AS baggage_total,
    length(coalesce(frequentFlyer, '')) - length(replace(coalesce(frequentFlyer, ''), '/', ''))
      + (coalesce(frequentFlyer, '') <> '')::INT AS n_ff_programs
  FROM {source}
)"""
    rowf = f"""rowf AS (
  SELECT * EXCLUDE ({", ".join([*_MINUTE_COLUMNS.values(), *_MINUTE_COLUMNS])}),
    {", ".join(f"{m} AS {c}" for c, m in _MINUTE_COLUMNS.items())},
    n_segments_leg0 + n_segments_leg1 AS total_segments,
    totalPrice / nullif(taxes + 1, 0) AS price_per_tax,
    taxes / nullif(totalPrice + 1, 0) AS tax_rate,
    ln(1 + totalPrice) AS log_price,
    m0 + m1 AS total_duration,
    CASE WHEN m1 > 0 THEN m0::DOUBLE / (m1 + 1) ELSE 1.0::DOUBLE END AS duration_ratio,
    (m1 = 0 OR {LEG1}departureFrom_airport_iata IS NULL)::INT AS is_one_way,
    {_counted([f"{LEG0}marketingCarrier_code", f"{LEG1}marketingCarrier_code"])} AS l0_seg,
    ({LEG0}marketingCarrier_code IN ('SU', 'S7', 'U6'))::INT AS is_major_carrier,
    (corporateTariffCode IS NOT NULL)::INT AS has_corporate_tariff,
    (pricingInfo_isAccessTP = 1)::INT AS has_access_tp,
    (searchRoute IN ('MOWLED/LEDMOW', 'LEDMOW/MOWLED', 'MOWLED', 'LEDMOW', 'MOWAER/AERMOW'))::INT
      AS is_popular_route,
    (isVip = 1 OR n_ff_programs > 0)::INT AS is_vip_freq,
    (baggage_total > 0)::INT AS has_baggage,
    (total_fees > 0)::INT AS has_fees,
    total_fees / (totalPrice + 1) AS fee_rate,
    list_avg([{LEG0}cabinClass, {LEG1}cabinClass])
      AS avg_cabin_class,
    coalesce({LEG0}cabinClass, 0) - coalesce({LEG1}cabinClass, 0) AS cabin_class_diff,
    (n_segments_leg0 = 1)::INT AS is_direct_leg0,
    CASE WHEN m1 = 0 OR {LEG1}departureFrom_airport_iata IS NULL THEN 0
      ELSE (n_segments_leg1 = 1)::INT END AS is_direct_leg1,
    ((n_segments_leg0 = 1) AND NOT (m1 = 0 OR {LEG1}departureFrom_airport_iata IS NULL)
      AND (n_segments_leg1 = 1))::INT AS both_direct,
    {", ".join(_time_features(c) for c in times)},
    {ROUTE_KEY} AS round_trip_route
  FROM minuted
)"""
    return [minuted, rowf]


ROWS = row_tables()


def group_table(group: str = "ranker_id") -> str:
    """``grpf``: the row features with those of the session."""
    whole = f"OVER (PARTITION BY {group})"

    def average_rank(value: str) -> str:
        return (
            f"(rank() OVER (PARTITION BY {group} ORDER BY {value} NULLS LAST)"
            f" + (count(*) OVER (PARTITION BY {group}, {value}) - 1) / 2.0)::DOUBLE"
        )

    return f"""grpf AS (
  SELECT *,
    count(Id) {whole} AS group_size,
    ln(1 + count(Id) {whole}) AS group_size_log,
    {average_rank("totalPrice")} AS price_rank,
    {average_rank("total_duration")} AS duration_rank,
    {average_rank("totalPrice")} / count(totalPrice) {whole} AS price_pct_rank,
    (totalPrice = min(totalPrice) {whole})::INT AS is_cheapest,
    (totalPrice - median(totalPrice) {whole}) / (stddev_samp(totalPrice) {whole} + 1)
      AS price_from_median,
    (l0_seg = min(l0_seg) {whole})::INT AS is_min_segments,
    coalesce((is_direct_leg0 = 1 AND totalPrice =
      min(totalPrice) FILTER (is_direct_leg0 = 1) {whole})::INT, 0) AS is_direct_cheapest
  FROM rowf
)"""


# Session outcomes of the fixed score: size, and rank of the best-placed chosen offer.
RANKED = """ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY ranker_id
    ORDER BY pred_score DESC NULLS LAST, Id) AS INT) AS rank,
    count(*) OVER (PARTITION BY ranker_id) AS n_rows
  FROM offers
)"""
OUTCOMES = """outcomes AS (
  SELECT ranker_id, count(*) AS group_size, min(rank) FILTER (selected = 1) AS best_rank
  FROM ranked GROUP BY ranker_id
)"""
LARGE = "large AS (SELECT * FROM outcomes WHERE group_size > 10)"

SPLIT = """session_times AS (
  SELECT ranker_id, min(requestDate) AS session_time FROM offers GROUP BY ranker_id
),
parted AS (
  SELECT offers.*, CASE WHEN session_time <= (
    SELECT quantile_disc(session_time, 0.9) FROM session_times) THEN 'train' ELSE 'valid' END
    AS part
  FROM offers JOIN session_times USING (ranker_id)
),
trainset AS (SELECT * FROM parted WHERE part = 'train')"""


def lookups(source: str) -> str:
    """``pop0``, ``pop1`` and ``routes``, fitted on a table."""
    pops = ",\n".join(
        f"pop{leg} AS (SELECT {c} AS carrier, avg(selected) AS pop FROM {source} GROUP BY 1)"
        for leg, c in ((0, f"{LEG0}marketingCarrier_code"), (1, f"{LEG1}marketingCarrier_code"))
    )
    return (
        f"{pops},\nroutes AS (SELECT {ROUTE_KEY} AS route, count(*) AS n FROM {source} GROUP BY 1)"
    )


FULL = f"""fullf AS (
  SELECT grpf.*, coalesce(pop0.pop, 0.0) AS carrier0_pop, coalesce(pop1.pop, 0.0) AS carrier1_pop,
    coalesce(pop0.pop, 0.0) * coalesce(pop1.pop, 0.0) AS carrier_pop_product,
    coalesce(routes.n, 0) AS round_trip_freq
  FROM grpf
  LEFT JOIN pop0 ON pop0.carrier = {LEG0}marketingCarrier_code
  LEFT JOIN pop1 ON pop1.carrier = {LEG1}marketingCarrier_code
  LEFT JOIN routes ON routes.route = grpf.round_trip_route
)"""

# Categories the view does not fill are NULL in every row.
VIEW_CATEGORIES = {
    "nationality": "number",
    "searchRoute": "text",
    "corporateTariffCode": "text",
    "bySelf": "number",
    "sex": "number",
    "companyID": "number",
    f"{LEG0}arrivalTo_airport_iata": "text",
    f"{LEG0}departureFrom_airport_iata": "text",
    f"{LEG0}marketingCarrier_code": "text",
    f"{LEG1}arrivalTo_airport_iata": "text",
    f"{LEG1}departureFrom_airport_iata": "text",
    f"{LEG1}marketingCarrier_code": "text",
}


def codes(source: str) -> str:
    """``codes``: dense ranks from 0 of the filled values of each category of a table."""
    parts = []
    for name in CATEGORIES:
        if name not in VIEW_CATEGORIES:
            parts.append(f"SELECT '{name}' AS feature, 'missing' AS value, 0 AS code")
            continue
        fill = "0" if VIEW_CATEGORIES[name] == "number" else "'missing'"
        parts.append(
            f"SELECT '{name}' AS feature, v::VARCHAR AS value,"
            f" CAST(dense_rank() OVER (ORDER BY v) - 1 AS INT) AS code"
            f" FROM (SELECT DISTINCT coalesce({name}, {fill}) AS v FROM {source})"
        )
    return "codes AS (\n  " + "\n  UNION ALL\n  ".join(parts) + "\n)"


REQUESTS = """flights AS (
  SELECT * EXCLUDE (ranker_id), split_part(Id, '-', 1) AS request_id, ranker_id % 1000 AS ranker_id
  FROM offers
)"""

# The same with a whole session in a request.
SESSION_REQUESTS = """flights AS (
  SELECT * EXCLUDE (ranker_id), coalesce(ranker_id::VARCHAR, 'none') AS request_id, ranker_id % 1000 AS ranker_id
  FROM offers
)"""


def with_tables(select: str, *tables: str) -> str:
    return "WITH " + ",\n".join(tables) + "\n" + select


def offer_type(name: str) -> str:
    kinds = {"string": "VARCHAR", "double": "DOUBLE", "bigint": "BIGINT"}
    return kinds.get(OFFER_SCHEMA[name].dataType.simpleString(), "TIMESTAMP")
