"""One named query per operator, on the order tables, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankwright.functions import columns as C
from rankwright.operators import columns as cols
from rankwright.operators import encode, evaluate, gain, groups, lookups, quality, ranking, rows, split, train
from rankwright.plans import oracles as O
from rankwright.plans.features import (
    Artifacts,
    artifacts_from_counts,
    build_features,
    encode_features,
    fit_artifacts,
    fit_counts,
    load_artifacts,
    load_counts,
    save_artifacts,
    save_counts,
)
from rankwright.plans.recommend import answer_all, recommend, score_requests
from rankwright.schema import CARRIER_COLUMNS, CATEGORIES, OFFER_SCHEMA, REQUEST_SCHEMA, ROUTE_COLUMNS, STRAY_INDEX
from rankwright.session import scratch_path, tune, write_table
from rankwright.sources import readers, tables, writers
from rankwright.streaming.requests import read_request_stream, recommend_stream

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, select: str | None = None, *tables_sql: str) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = lambda spark, folder: run(tune(spark), folder)
        if select is not None:
            ORACLES[name] = O.with_tables(select, O.BASE, O.OFFERS, *tables_sql)
        return run

    return register


def round_fast(value: Column, digits: int = 6) -> Column:
    """Rounding in floating point; ``round`` goes through decimals, at many times the cost."""
    return F.rint(value * 10.0**digits) / 10.0**digits + 0.0


def tidy(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """The named columns, with doubles rounded and negative zero gone."""
    kinds = dict(df.dtypes)
    return df.select(
        *[
            round_fast(F.col(n), digits).alias(n) if kinds[n] in ("double", "float") else n
            for n in names or df.columns
        ]
    )


def rounded(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


# ---------------------------------------------------------------- sources and sinks

_READ = ["Id", "ranker_id", "requestDate", "totalPrice", "searchRoute", "selected"]


@query("read_offers", f"SELECT {', '.join(_READ)} FROM offers")
def _(spark, folder):
    path = scratch_path(spark, "offers")
    tables.offers(spark, folder).withColumn(STRAY_INDEX, F.lit(0).cast("long")).write.parquet(path)
    schema = T.StructType([*OFFER_SCHEMA.fields, T.StructField(STRAY_INDEX, T.LongType())])
    return readers.read_offers(spark, path, schema).select(*_READ)


@query("label_unlabelled", "SELECT Id, ranker_id, CAST(0 AS BIGINT) AS selected FROM base")
def _(spark, folder):
    unlabelled = tables.offers(spark, folder, labelled=False)
    return readers.label_unlabelled(unlabelled).select("Id", "ranker_id", "selected")


@query(
    "union_offers",
    "SELECT Id, ranker_id, CASE WHEN year(requestDate) < 2000 THEN selected ELSE 0 END AS selected"
    " FROM offers",
)
def _(spark, folder):
    view = tables.offers(spark, folder).select("Id", "ranker_id", "selected", "requestDate")
    early = F.year("requestDate") < 2000
    test = readers.label_unlabelled(view.filter(~early))
    return readers.union_offers(view.filter(early), test).drop("requestDate")


def _request_file(requests: DataFrame) -> str:
    """A folder of JSON lines, compressed: the field names are most of the text."""
    path = scratch_path(requests.sparkSession, "requests")
    requests.write.json(path, compression="gzip")
    return path


@query(
    "read_requests",
    "SELECT request_id, ranker_id, Id, totalPrice, legs0_duration FROM flights",
    O.SESSION_REQUESTS,
)
def _(spark, folder):
    path = _request_file(tables.session_requests(spark, folder))
    requests = readers.read_requests(spark, path)
    return readers.request_offers(requests).select(
        "request_id", "ranker_id", "Id", "totalPrice", "legs0_duration"
    )


@query(
    "rejected_requests",
    "SELECT CASE WHEN ranker_id % 7 = 0 THEN 'unreadable' ELSE 'empty' END AS reason,"
    " count(DISTINCT request_id) AS requests FROM flights WHERE ranker_id % 7 < 2 GROUP BY 1",
    O.SESSION_REQUESTS,
)
def _(spark, folder):
    rejected = readers.rejected_requests(spark, _damaged_requests(tables.session_requests(spark, folder)))
    return rejected.groupBy("reason").agg(F.count("*").alias("requests"))


def _damaged_requests(requests: DataFrame) -> str:
    """Requests of which some are cut short and some have lost their offers."""
    path = scratch_path(requests.sparkSession, "damaged")
    kept = F.when(F.col("ranker_id") % 7 == 1, F.filter("flights", lambda f: F.lit(False)))
    requests = requests.withColumn("flights", kept.otherwise(F.col("flights")))
    line = F.to_json(F.struct("request_id", "ranker_id", "flights"))
    cut = F.when(F.col("ranker_id") % 7 == 0, F.substring(line, 1, 40)).otherwise(line)
    requests.select(cut.alias("value")).write.text(path, compression="gzip")
    return path


@query(
    "answer_all",
    "SELECT CASE ranker_id % 7 WHEN 0 THEN 'unreadable' WHEN 1 THEN 'empty' ELSE 'answered' END AS result,"
    " count(DISTINCT request_id) AS requests, count(*) FILTER (ranker_id % 7 > 1) AS offers FROM flights GROUP BY 1",
    O.REQUESTS,
)
def _(spark, folder):
    """One output row for every request line, of which some are cut short and some have no offers."""
    artifacts = _artifacts(spark, folder)
    damaged = _damaged_requests(tables.requests(spark, folder))
    answers = answer_all(spark, damaged, artifacts, fixed_score(), list(FIXED_SCORE_FEATURES))
    counted = answers.groupBy(F.coalesce("reason", F.lit("answered")).alias("result"))
    return counted.agg(F.count("*").alias("requests"), F.sum(F.size("ranked_flights")).alias("offers"))


def _training_part(spark: SparkSession, folder: str) -> DataFrame:
    view = tables.offers(spark, folder)
    parted = split.time_split(view, hot=tables.session_profile(spark, folder))
    return parted.filter(F.col("part") == "train").drop("part")


def _artifacts(spark: SparkSession, folder: str) -> Artifacts:
    return fit_artifacts(_training_part(spark, folder))


def _lookup_rows(artifacts: Artifacts) -> DataFrame:
    """The popularity and route tables in one shape."""
    named = [
        table.toDF("key", "value").select(F.lit(f"carrier{leg}").alias("kind"), "key", "value")
        for leg, table in artifacts.carriers.items()
    ]
    routes = artifacts.routes.toDF("key", "value").select(
        F.lit("route").alias("kind"), "key", F.col("value").cast("double").alias("value")
    )
    return tidy(named[0].unionByName(named[1]).unionByName(routes))


_LOOKUP_SQL = """
SELECT 'carrier0' AS kind, carrier AS key, round(pop, 6) AS value FROM pop0
WHERE carrier IS NOT NULL UNION ALL
SELECT 'carrier1', carrier, round(pop, 6) FROM pop1 WHERE carrier IS NOT NULL UNION ALL
SELECT 'route', route, n::DOUBLE FROM routes WHERE route IS NOT NULL"""


@query("fit_artifacts", _LOOKUP_SQL, O.SPLIT, O.lookups("trainset"))
def _(spark, folder):
    return _lookup_rows(_artifacts(spark, folder))


@query("save_artifacts", _LOOKUP_SQL, O.SPLIT, O.lookups("trainset"))
def _(spark, folder):
    path = scratch_path(spark, "artifacts")
    save_artifacts(_artifacts(spark, folder), path)
    return _lookup_rows(load_artifacts(spark, path))


@query(
    "load_artifacts", "SELECT feature, value, code FROM codes", O.SPLIT, O.codes("trainset")
)
def _(spark, folder):
    path = scratch_path(spark, "artifacts")
    save_artifacts(_artifacts(spark, folder), path)
    return load_artifacts(spark, path).codes


def _from_days(spark: SparkSession, folder: str) -> Artifacts:
    """Lookups of the training part from the saved counts of three parts of it, one counted again."""
    train = _training_part(spark, folder)
    counted = {*CATEGORIES, *ROUTE_COLUMNS, "selected", "requestDate"}
    learned = write_table(train.select(*[c for c in train.columns if c in counted]), "learned")
    path = scratch_path(spark, "days")
    part = F.dayofmonth("requestDate") % 3
    save_counts(fit_counts(learned.filter(part == 0)), path, "again")
    for day in range(3):
        save_counts(fit_counts(learned.filter(part == day)), path, "again" if day == 2 else str(day))
    return artifacts_from_counts(load_counts(spark, path))


@query("merge_counts", _LOOKUP_SQL, O.SPLIT, O.lookups("trainset"))
def _(spark, folder):
    return _lookup_rows(_from_days(spark, folder))


@query("merge_counts_codes", "SELECT feature, value, code FROM codes", O.SPLIT, O.codes("trainset"))
def _(spark, folder):
    return _from_days(spark, folder).codes


@query(
    "write_submission",
    "SELECT Id, ranker_id, rank AS selected FROM ranked",
    O.RANKED,
)
def _(spark, folder):
    hot = tables.session_profile(spark, folder)
    path = scratch_path(spark, "submission")
    writers.write_submission(ranking.make_submission(tables.offers(spark, folder), hot=hot), path)
    schema = "Id string, ranker_id long, selected int"
    return spark.read.schema(schema).option("header", True).csv(path)


def _session_requests(spark: SparkSession, folder: str) -> DataFrame:
    """The scored offers, each session as one request."""
    view = tables.offers(spark, folder)
    return view.withColumn("request_id", F.col("ranker_id").cast("string")).withColumnRenamed(
        "pred_score", "score"
    )


def _flatten(responses: DataFrame) -> DataFrame:
    return responses.select("request_id", "ranker_id", F.posexplode("ranked_flights")).select(
        "request_id", "ranker_id", (F.col("pos") + 1).alias("position"), "col.Id", "col.score"
    )


_FLAT_RANKED = (
    "SELECT ranker_id::VARCHAR AS request_id, ranker_id, rank AS position, Id,"
    " pred_score AS score FROM ranked"
)


def _ranked_responses(spark: SparkSession, folder: str) -> DataFrame:
    hot = tables.session_profile(spark, folder)
    return ranking.rank_requests(
        _session_requests(spark, folder), request="request_id", hot=hot
    )


@query("write_ranked", _FLAT_RANKED, O.RANKED)
def _(spark, folder):
    path = scratch_path(spark, "ranked")
    writers.write_ranked(_ranked_responses(spark, folder), path)
    schema = (
        "request_id string, ranker_id long,"
        " ranked_flights array<struct<Id: string, score: double>>"
    )
    return _flatten(spark.read.schema(schema).json(path))


# ---------------------------------------------------------------- projection, schema, predicates

_ALIGNED = ["Id", "totalPrice", "nationality", "companyID", "isAccess3D", "legs0_segments2_duration"]


@query(
    "align_schema",
    "SELECT Id, totalPrice, nationality, companyID, NULL::DOUBLE AS isAccess3D,"
    " NULL::VARCHAR AS legs0_segments2_duration FROM offers",
)
def _(spark, folder):
    return cols.align_schema(tables.offers(spark, folder)).select(*_ALIGNED)


@query("normalise_strings", "SELECT Id, searchRoute, frequentFlyer, totalPrice FROM offers")
def _(spark, folder):
    view = tables.offers(spark, folder, labelled=False)
    return cols.normalise_strings(view).select("Id", "searchRoute", "frequentFlyer", "totalPrice")


@query(
    "fill_by_type",
    "SELECT Id, round(coalesce(taxes, 0), 6) AS taxes, coalesce(searchRoute, 'missing') AS"
    " searchRoute, coalesce(legs1_segments0_cabinClass, 0) AS legs1_segments0_cabinClass,"
    " coalesce(frequentFlyer, 'missing') AS frequentFlyer FROM offers",
)
def _(spark, folder):
    filled = cols.fill_by_type(tables.offers(spark, folder, labelled=False))
    return tidy(
        filled, "Id", "taxes", "searchRoute", "legs1_segments0_cabinClass", "frequentFlyer"
    )


_FEATURE_COLUMNS = [
    "totalPrice", "searchRoute", "corporateTariffCode", "isVip", "legs0_duration",
    "legs0_segments1_duration", "legs1_segments0_cabinClass", "nationality", "pred_score",
]


@query("select_features", f"SELECT {', '.join(_FEATURE_COLUMNS)} FROM offers")
def _(spark, folder):
    """Identifiers, the label and all columns of third and fourth segments go."""
    late = [
        F.col(c).alias(c.replace("_segments1_", f"_segments{s}_").replace("_segments0_", f"_segments{s}_"))
        for c in ("legs0_segments1_duration", "legs1_segments0_cabinClass")
        for s in (2, 3)
    ]
    view = tables.offers(spark, folder).select(
        "Id", "ranker_id", "selected", "requestDate", "frequentFlyer", *late, *_FEATURE_COLUMNS
    )
    return cols.select_features(view)


@query("validate_features", "SELECT Id, totalPrice, isVip FROM offers")
def _(spark, folder):
    view = tables.offers(spark, folder, labelled=False).select("Id", "totalPrice", "isVip")
    return cols.validate_features(view, ["totalPrice", "isVip"])


@query(
    "numeric_matrix",
    "SELECT Id, totalPrice, isVip, -1.0::DOUBLE AS searchRoute FROM offers",
)
def _(spark, folder):
    view = tables.offers(spark, folder, labelled=False)
    return cols.numeric_matrix(view, ["totalPrice", "isVip", "searchRoute"], keep=["Id"])


@query(
    "keep_large_groups",
    "SELECT Id, ranker_id, n_rows AS group_size FROM ranked WHERE n_rows > 10",
    O.RANKED,
)
def _(spark, folder):
    view = tables.offers(spark, folder, labelled=False)
    hot = tables.session_profile(spark, folder)
    return cols.keep_large_groups(view, 10, hot=hot).select("Id", "ranker_id", "group_size")


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return rows.row_features(cols.align_schema(tables.offers(spark, folder)))


@query(
    "keep_direct",
    "SELECT Id, total_segments, is_direct_leg0 FROM rowf WHERE is_direct_leg0 = 1",
    *O.ROWS,
)
def _(spark, folder):
    return cols.keep_direct(_rows(spark, folder)).select("Id", "total_segments", "is_direct_leg0")


@query(
    "filter_strata",
    "SELECT ranker_id, group_size FROM large WHERE group_size > 12 AND group_size <= 16",
    O.RANKED, O.OUTCOMES, O.LARGE,
)
def _(spark, folder):
    sizes = lookups.group_sizes(tables.offers(spark, folder, labelled=False))
    large = sizes.filter(F.col("group_size") > 10)
    return cols.filter_strata(large, "medium", 12, 16)


@query(
    "label_strata",
    "SELECT ranker_id, group_size, CASE WHEN group_size <= 4 THEN 'small' WHEN group_size <= 10"
    " THEN 'medium' ELSE 'large' END AS stratum FROM outcomes",
    O.RANKED, O.OUTCOMES,
)
def _(spark, folder):
    sizes = lookups.group_sizes(tables.offers(spark, folder, labelled=False))
    return cols.label_strata(sizes, 4, 10)


@query(
    "drop_empty_requests",
    "SELECT request_id, ranker_id, count(*) FILTER (totalPrice > 50000) AS n_flights FROM flights"
    " GROUP BY ALL HAVING n_flights > 0",
    O.SESSION_REQUESTS,
)
def _(spark, folder):
    dear = F.filter("flights", lambda f: f["totalPrice"] > 50000)
    requests = tables.session_requests(spark, folder).withColumn("flights", dear)
    return cols.drop_empty_requests(requests).select(
        "request_id", "ranker_id", F.size("flights").cast("long").alias("n_flights")
    )


# ---------------------------------------------------------------- scalar functions

_c = F.col

SCALARS: dict[str, tuple[Callable[[], Column], str]] = {
    "fn_extract_first": (
        lambda: C.extract_first(_c("legs0_duration"), r"^(\d+)\."),
        r"nullif(regexp_extract(legs0_duration, '^(\d+)\.', 1), '')",
    ),
    "fn_to_whole": (
        lambda: C.to_whole(_c("corporateTariffCode")),
        "try_cast(corporateTariffCode AS BIGINT)",
    ),
    "fn_contains": (
        lambda: C.contains(_c("legs1_duration"), r"^\d+\."),
        r"regexp_matches(legs1_duration, '^\d+\.')",
    ),
    "fn_replace_leading": (
        lambda: C.replace_leading(_c("legs0_duration"), r"\d+\."),
        r"regexp_replace(legs0_duration, '^\d+\.', '')",
    ),
    "fn_count_slashes": (
        lambda: C.count_slashes(_c("frequentFlyer")),
        "CAST(length(frequentFlyer) - length(replace(frequentFlyer, '/', '')) AS INT)",
    ),
    "fn_join_text": (
        lambda: C.join_text(_c("searchRoute"), F.lit("_"), _c("corporateTariffCode")),
        "searchRoute || '_' || corporateTariffCode",
    ),
    "fn_one_of": (
        lambda: C.one_of(_c("legs0_segments0_marketingCarrier_code"), ["SU", "S7", "U6"]),
        "(legs0_segments0_marketingCarrier_code IN ('SU', 'S7', 'U6'))::INT",
    ),
    "fn_present": (
        lambda: C.present(_c("legs1_duration")),
        "(legs1_duration IS NOT NULL)::INT",
    ),
    "fn_or_zero": (
        lambda: C.or_zero(_c("legs1_segments0_cabinClass")),
        "coalesce(legs1_segments0_cabinClass, 0)",
    ),
    "fn_choose": (
        lambda: C.choose(_c("isVip") == 1, F.lit("vip"), _c("searchRoute")),
        "CASE WHEN isVip = 1 THEN 'vip' ELSE searchRoute END",
    ),
    "fn_log_plus_one": (lambda: C.log_plus_one(_c("totalPrice")), "ln(1 + totalPrice)"),
    "fn_total": (
        lambda: C.total([_c("isVip"), _c("nationality"), _c("sex")]),
        "isVip + nationality + sex",
    ),
    "fn_count_present": (
        lambda: C.count_present([_c("taxes"), _c("searchRoute"), _c("frequentFlyer")]),
        "(taxes IS NOT NULL)::INT + (searchRoute IS NOT NULL)::INT"
        " + (frequentFlyer IS NOT NULL)::INT",
    ),
    "fn_mean_present": (
        lambda: C.mean_present(
            [_c("legs0_segments0_cabinClass"), _c("legs1_segments0_cabinClass")]
        ),
        "list_avg([legs0_segments0_cabinClass, legs1_segments0_cabinClass])",
    ),
    "fn_to_moment": (
        lambda: C.to_moment(_c("legs0_departureAt")),
        "try_cast(legs0_departureAt AS TIMESTAMP)",
    ),
    "fn_hour_of": (
        lambda: C.hour_of(C.to_moment(_c("legs0_arrivalAt"))),
        "CAST(hour(try_cast(legs0_arrivalAt AS TIMESTAMP)) AS INT)",
    ),
    "fn_weekday_of": (
        lambda: C.weekday_of(C.to_moment(_c("legs1_arrivalAt"))),
        "CAST(isodow(try_cast(legs1_arrivalAt AS TIMESTAMP)) AS INT)",
    ),
    "fn_ratio": (
        lambda: C.ratio(_c("totalPrice"), _c("sex")),
        "totalPrice / nullif(sex, 0)",
    ),
    "fn_flag": (lambda: C.flag(_c("taxes") > 1000), "(taxes > 1000)::INT"),
    "fn_both": (
        lambda: C.both(C.flag(_c("taxes") > 1000), C.flag(_c("isVip") == 1)),
        "((taxes > 1000)::INT & (isVip = 1)::INT)",
    ),
    "fn_as_text": (lambda: C.as_text(_c("nationality")), "nationality::VARCHAR"),
    "fn_as_number": (lambda: C.as_number(_c("companyID")), "companyID::DOUBLE"),
    "fn_route_origin": (lambda: C.route_origin(_c("searchRoute")), "substring(searchRoute, 1, 3)"),
    "fn_route_destination": (
        lambda: C.route_destination(_c("searchRoute")),
        "substring(searchRoute, 4, 3)",
    ),
    "fn_upper_code": (
        lambda: C.upper_code(F.lower(_c("legs0_segments0_departureFrom_airport_iata"))),
        "upper(lower(legs0_segments0_departureFrom_airport_iata))",
    ),
    "fn_clock_part": (
        lambda: C.clock_part(_c("legs0_duration")),
        "coalesce(nullif(split_part(legs0_duration, '.', 2), ''), legs0_duration)",
    ),
    "fn_minutes_of": (lambda: C.minutes_of(_c("legs1_duration")), O.minutes("legs1_duration")),
}


def _register_scalar(name: str, make: Callable[[], Column], sql: str) -> None:
    numeric = name in ("fn_log_plus_one", "fn_mean_present", "fn_ratio")
    value = f"round({sql}, 6)" if numeric else sql

    @query(name, f"SELECT Id, {value} AS value FROM offers")
    def _(spark, folder):
        view = tables.offers(spark, folder, labelled=False)
        return tidy(view.select("Id", make().alias("value")))


for _name, (_make, _sql) in SCALARS.items():
    _register_scalar(_name, _make, _sql)


# ---------------------------------------------------------------- row and session features

ROW_FAMILIES: dict[str, tuple[list[str], list[str]]] = {
    # query: (columns to compare as they are, columns to round)
    "row_minutes": (
        ["legs0_duration", "legs1_duration", "legs0_segments1_duration",
         "legs1_segments1_duration"], [],
    ),
    "row_price_ratios": ([], ["price_per_tax", "tax_rate", "log_price"]),
    "row_trip_duration": (["total_duration"], ["duration_ratio"]),
    "row_one_way": (["is_one_way"], []),
    "row_carrier_count": (["l0_seg"], []),
    "row_programs": (["n_ff_programs"], []),
    "row_tariff_flags": (["has_corporate_tariff", "has_access_tp"], []),
    "row_baggage_fees": ([], ["baggage_total", "total_fees"]),
    "row_popular_route": (["is_popular_route"], []),
    "row_cabin": ([], ["avg_cabin_class", "cabin_class_diff"]),
    "row_segments": (["n_segments_leg0", "n_segments_leg1", "total_segments"], []),
    "row_direct": (["is_direct_leg0", "is_direct_leg1", "both_direct"], []),
    "row_flags": (["is_vip_freq", "has_baggage", "has_fees"], ["fee_rate"]),
    "row_major_carrier": (["is_major_carrier"], []),
    "row_times": (
        [f"{t}_{part}" for t in ("legs0_departureAt", "legs0_arrivalAt", "legs1_departureAt",
                                 "legs1_arrivalAt")
         for part in ("hour", "weekday", "business_time")], [],
    ),
    "row_route": (["round_trip_route"], []),
}

GROUP_FAMILIES: dict[str, tuple[list[str], list[str]]] = {
    "group_size": (["group_size"], ["group_size_log"]),
    "group_ranks": ([], ["price_rank", "duration_rank"]),
    "group_pct_rank": ([], ["price_pct_rank"]),
    "group_cheapest": (["is_cheapest"], []),
    "group_from_median": ([], ["price_from_median"]),
    "group_min_segments": (["is_min_segments"], []),
    "group_direct_cheapest": (["is_direct_cheapest"], []),
    "group_features": (
        ["group_size", "is_cheapest", "is_min_segments", "is_direct_cheapest"],
        ["group_size_log", "price_rank", "duration_rank", "price_pct_rank", "price_from_median"],
    ),
}


def _select_list(exact: Sequence[str], doubles: Sequence[str]) -> str:
    return ", ".join(["Id", *exact, *([rounded(*doubles)] if doubles else [])])


def _grouped(spark: SparkSession, folder: str) -> DataFrame:
    return groups.group_features(_rows(spark, folder), hot=tables.session_profile(spark, folder))


def _register_family(name: str, exact: list[str], doubles: list[str], grouped: bool) -> None:
    sql = [*O.ROWS, O.group_table()] if grouped else O.ROWS
    source = "grpf" if grouped else "rowf"

    @query(name, f"SELECT {_select_list(exact, doubles)} FROM {source}", *sql)
    def _(spark, folder):
        made = _grouped(spark, folder) if grouped else rows.row_features(
            cols.align_schema(tables.offers(spark, folder, labelled=False))
        )
        return tidy(made, "Id", *exact, *doubles)


for _name, (_exact, _doubles) in ROW_FAMILIES.items():
    _register_family(_name, _exact, _doubles, grouped=False)
for _name, (_exact, _doubles) in GROUP_FAMILIES.items():
    _register_family(_name, _exact, _doubles, grouped=True)


@query("rank_in_group", "SELECT Id, ranker_id, rank FROM ranked", O.RANKED)
def _(spark, folder):
    view = tables.offers(spark, folder, labelled=False)
    ranked = ranking.rank_in_group(view, hot=tables.session_profile(spark, folder))
    return ranked.select("Id", "ranker_id", "rank")


# ---------------------------------------------------------------- aggregations

for _leg, _carrier in ((0, "legs0_segments0_marketingCarrier_code"),
                       (1, "legs1_segments0_marketingCarrier_code")):

    @query(
        f"carrier_popularity_leg{_leg}",
        f"SELECT {_carrier}, round(avg(selected), 6) AS carrier{_leg}_pop FROM offers GROUP BY 1",
    )
    def _(spark, folder, leg=_leg):
        return tidy(lookups.carrier_popularity(tables.offers(spark, folder), leg))


@query(
    "route_frequency",
    "SELECT route AS round_trip_route, n AS rt_route_count FROM routes",
    O.lookups("offers"),
)
def _(spark, folder):
    return lookups.route_frequency(tables.offers(spark, folder, labelled=False))


@query(
    "cheapest_direct",
    "SELECT ranker_id, min(totalPrice) AS min_direct FROM rowf WHERE is_direct_leg0 = 1 GROUP BY 1",
    *O.ROWS,
)
def _(spark, folder):
    return lookups.cheapest_direct(_rows(spark, folder))


@query("group_sizes", "SELECT ranker_id, count(*) AS group_size FROM offers GROUP BY 1")
def _(spark, folder):
    return lookups.group_sizes(tables.offers(spark, folder, labelled=False))


def _outcomes(spark: SparkSession, folder: str) -> DataFrame:
    view = tables.offers(spark, folder)
    return evaluate.session_outcomes(view, hot=tables.session_profile(spark, folder))


@query(
    "session_outcomes",
    "SELECT ranker_id, group_size, CAST(best_rank AS BIGINT) AS best_rank FROM outcomes",
    O.RANKED, O.OUTCOMES,
)
def _(spark, folder):
    return _outcomes(spark, folder).drop("chosen")


@query(
    "size_quantiles",
    "SELECT quantile_disc(group_size, 0.25) AS q25, quantile_disc(group_size, 0.5) AS q50,"
    " quantile_disc(group_size, 0.75) AS q75 FROM outcomes",
    O.RANKED, O.OUTCOMES,
)
def _(spark, folder):
    return evaluate.size_quantiles(_outcomes(spark, folder))


_HIT_SQL = "CAST(coalesce(best_rank <= 3, false) AS BIGINT)"


@query(
    "group_hit",
    f"SELECT ranker_id, group_size, {_HIT_SQL} AS hit FROM outcomes",
    O.RANKED, O.OUTCOMES,
)
def _(spark, folder):
    return evaluate.group_hit(_outcomes(spark, folder))


@query(
    "mean_of_hits",
    f"SELECT round(avg({_HIT_SQL}), 6) AS hitrate FROM outcomes",
    O.RANKED, O.OUTCOMES,
)
def _(spark, folder):
    return tidy(evaluate.mean_of_hits(evaluate.group_hit(_outcomes(spark, folder))))


@query(
    "size_bounds",
    "SELECT min(group_size) AS min_size, max(group_size) AS max_size FROM outcomes",
    O.RANKED, O.OUTCOMES,
)
def _(spark, folder):
    return evaluate.size_bounds(_outcomes(spark, folder))


# ---------------------------------------------------------------- joins

_POPS = ["carrier0_pop", "carrier1_pop", "carrier_pop_product"]


@query(
    "attach_carrier_popularity",
    f"SELECT Id, {rounded(*_POPS)} FROM fullf",
    *O.ROWS, O.group_table(), O.lookups("offers"), O.FULL,
)
def _(spark, folder):
    view = tables.offers(spark, folder)
    stats = write_table(encode.value_stats(view, CARRIER_COLUMNS, "selected"), "values")
    popularity = lookups.popularity_from_stats(stats)
    return tidy(lookups.attach_carrier_popularity(view, popularity), "Id", *_POPS)


@query(
    "attach_route_frequency",
    "SELECT Id, routes.n AS rt_route_count, coalesce(routes.n, 0) AS round_trip_freq FROM rowf"
    " LEFT JOIN routes ON routes.route = rowf.round_trip_route",
    *O.ROWS, O.lookups("offers"),
)
def _(spark, folder):
    view = tables.offers(spark, folder, labelled=False)
    routes = write_table(lookups.route_frequency(view), "routes")
    routed = lookups.attach_route_frequency(rows.with_route(view), routes)
    return routed.select("Id", "rt_route_count", "round_trip_freq")


@query(
    "with_direct_cheapest",
    "SELECT Id, is_direct_cheapest FROM grpf",
    *O.ROWS, O.group_table(),
)
def _(spark, folder):
    hot = tables.session_profile(spark, folder)
    flagged = lookups.with_direct_cheapest(_rows(spark, folder), hot=hot)
    return flagged.select("Id", "is_direct_cheapest")


@query("with_group_size", "SELECT Id, ranker_id, n_rows AS group_size FROM ranked", O.RANKED)
def _(spark, folder):
    view = tables.offers(spark, folder, labelled=False)
    sized = lookups.with_group_size(view, hot=tables.session_profile(spark, folder))
    return sized.select("Id", "ranker_id", "group_size")


@query(
    "attach_offers",
    "SELECT ranker_id, Id, rank, totalPrice, searchRoute FROM ranked",
    O.RANKED,
)
def _(spark, folder):
    view = tables.offers(spark, folder, labelled=False)
    hot = tables.session_profile(spark, folder)
    ranked = ranking.rank_in_group(view, hot=hot).select("ranker_id", "Id", "rank")
    details = view.select("ranker_id", "Id", "totalPrice", "searchRoute")
    return lookups.attach_offers(ranked, details)


# ---------------------------------------------------------------- order and top-k


@query(
    "top_k_per_group",
    "SELECT Id, ranker_id, rank FROM ranked WHERE rank <= 3",
    O.RANKED,
)
def _(spark, folder):
    view = tables.offers(spark, folder, labelled=False)
    return ranking.top_k_per_group(view, 3).select("Id", "ranker_id", "rank")


@query(
    "most_important",
    "SELECT legs0_segments0_marketingCarrier_code || '/' ||"
    " legs1_segments0_marketingCarrier_code AS feature,"
    " round(sum(totalPrice), 2) AS importance FROM offers"
    " WHERE feature IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
)
def _(spark, folder):
    pair = C.join_text(
        F.col("legs0_segments0_marketingCarrier_code"),
        F.lit("/"),
        F.col("legs1_segments0_marketingCarrier_code"),
    )
    view = tables.offers(spark, folder, labelled=False).withColumn("feature", pair)
    sums = view.filter(F.col("feature").isNotNull()).groupBy("feature")
    return ranking.most_important(sums.agg(F.round(F.sum("totalPrice"), 2).alias("importance")))


@query(
    "session_sizes",
    "SELECT DISTINCT ranker_id, n_rows AS group_size FROM ranked",
    O.RANKED,
)
def _(spark, folder):
    view = tables.offers(spark, folder, labelled=False)
    hot = tables.session_profile(spark, folder)
    return evaluate.session_sizes(lookups.with_group_size(view, hot=hot))


# ---------------------------------------------------------------- scoring


@query("rank_requests", _FLAT_RANKED, O.RANKED)
def _(spark, folder):
    return _flatten(_ranked_responses(spark, folder))


@query("rank_requests_first", _FLAT_RANKED + " WHERE rank <= 5", O.RANKED)
def _(spark, folder):
    """The first five offers of each request."""
    hot = tables.session_profile(spark, folder)
    return _flatten(ranking.rank_requests(_session_requests(spark, folder), hot=hot, first=5))


FIXED_SCORE_FEATURES = {
    "is_cheapest": 5.0,
    "price_pct_rank": -3.0,
    "duration_rank": -0.25,
    "total_duration": -0.001,
    "carrier0_pop": 2.0,
    "is_direct_leg0": 1.0,
    "legs0_segments0_marketingCarrier_code": -0.01,
}


def fixed_score() -> Column:
    """A score of known weights over numeric, session, lookup and coded features."""
    return round_fast(C.total([F.col(c) * F.lit(w) for c, w in FIXED_SCORE_FEATURES.items()]))


_FIXED_SQL = " + ".join(
    f"coalesce({c}, 0) * {w}::DOUBLE"
    for c, w in FIXED_SCORE_FEATURES.items()
    if not c.endswith("_code")
)
_SCORED = f"""scored AS (
  SELECT fullf.request_id, fullf.ranker_id, fullf.Id,
    round({_FIXED_SQL} + coalesce(code, -1) * -0.01::DOUBLE, 6) AS score
  FROM fullf LEFT JOIN codes ON feature = 'legs0_segments0_marketingCarrier_code'
    AND value = coalesce(legs0_segments0_marketingCarrier_code, 'missing')
)"""


def _recommend_tables(requests: str) -> list[str]:
    return [
        O.SPLIT,
        O.lookups("trainset"),
        O.codes("trainset"),
        requests,
        *O.row_tables("flights"),
        O.group_table("request_id"),
        O.FULL,
        _SCORED,
    ]


_RECOMMEND_SQL = (
    "SELECT request_id, ranker_id, CAST(row_number() OVER (PARTITION BY request_id"
    " ORDER BY score DESC, Id) AS INT) AS position, Id, score FROM scored"
)


@query("score_requests", "SELECT * FROM scored", *_recommend_tables(O.SESSION_REQUESTS))
def _(spark, folder):
    requests, artifacts = tables.session_requests(spark, folder), _artifacts(spark, folder)
    return score_requests(requests, artifacts, fixed_score(), list(FIXED_SCORE_FEATURES))


@query("recommend", _RECOMMEND_SQL, *_recommend_tables(O.SESSION_REQUESTS))
def _(spark, folder):
    requests, artifacts = tables.session_requests(spark, folder), _artifacts(spark, folder)
    return _flatten(recommend(requests, artifacts, fixed_score(), list(FIXED_SCORE_FEATURES)))


@query("recommend_stream", _RECOMMEND_SQL, *_recommend_tables(O.REQUESTS))
def _(spark, folder):
    out = scratch_path(spark, "responses")
    stream = read_request_stream(spark, _request_file(tables.requests(spark, folder)))
    progress, features = scratch_path(spark, "progress"), list(FIXED_SCORE_FEATURES)
    recommend_stream(
        stream, _artifacts(spark, folder), fixed_score(), out, progress, features
    ).awaitTermination()
    schema = (
        "request_id string, ranker_id long,"
        " ranked_flights array<struct<Id: string, score: double>>, batch long"
    )
    return _flatten(spark.read.schema(schema).json(out))


@query("recommend_stream_once", _RECOMMEND_SQL, *_recommend_tables(O.REQUESTS))
def _(spark, folder):
    """A third of the requests is sent again after the first answers, and the stream started again."""
    out, progress = scratch_path(spark, "responses"), scratch_path(spark, "progress")
    path, artifacts = _request_file(tables.requests(spark, folder)), _artifacts(spark, folder)
    for again in (False, True):
        if again:
            repeated = tables.requests(spark, folder).filter(F.col("ranker_id") % 3 == 0)
            repeated.write.mode("append").json(path, compression="gzip")
        stream = read_request_stream(spark, path)
        features = list(FIXED_SCORE_FEATURES)
        recommend_stream(
            stream, artifacts, fixed_score(), out, progress, features, once_within="1 day"
        ).awaitTermination()
    schema = (
        "request_id string, ranker_id long,"
        " ranked_flights array<struct<Id: string, score: double>>, batch long"
    )
    return _flatten(spark.read.schema(schema).json(out))


@query(
    "present_ranked",
    """SELECT ranker_id, Id, rank AS position, (rank = 1)::INT AS is_best_choice,
  legs0_segments0_marketingCarrier_code AS carrier, substring(searchRoute, 1, 3) AS origin,
  substring(searchRoute, 4, 3) AS destination,
  CASE WHEN legs0_segments0_cabinClass = 2 THEN 'Premium' ELSE 'Economy' END AS cabin,
  coalesce(nullif(split_part(legs0_duration, '.', 2), ''), legs0_duration) AS duration,
  rtrim(rtrim(format('{:,.2f}', totalPrice), '0'), '.') AS price, round(pred_score, 3) AS score
FROM ranked""",
    O.RANKED,
)
def _(spark, folder):
    view = tables.offers(spark, folder, labelled=False)
    ranked = ranking.rank_in_group(view, hot=tables.session_profile(spark, folder))
    return ranking.present_ranked(ranked, score="pred_score")


# ---------------------------------------------------------------- encoding, split, training


@query("fit_codes", "SELECT feature, value, code FROM codes", O.codes("offers"))
def _(spark, folder):
    view = cols.align_schema(tables.offers(spark, folder, labelled=False))
    return encode.fit_codes(cols.fill_by_type(view.select(*CATEGORIES)))


_FIRST_DAYS = "1992-03-01"


@query(
    "extend_codes",
    "SELECT * FROM codes UNION ALL "
    + " UNION ALL ".join(
        f"SELECT '{c}', v::VARCHAR, CAST((SELECT count(DISTINCT coalesce({c}, {fill})) FROM first_days)"
        f" + row_number() OVER (ORDER BY v) - 1 AS INT) FROM (SELECT coalesce({c}, {fill}) AS v FROM offers"
        f" EXCEPT SELECT coalesce({c}, {fill}) FROM first_days)"
        for c, kind in O.VIEW_CATEGORIES.items()
        for fill in ["0" if kind == "number" else "'missing'"]
    ),
    f"first_days AS (SELECT * FROM offers WHERE requestDate < TIMESTAMP '{_FIRST_DAYS}')",
    O.codes("first_days"),
)
def _(spark, folder):
    """Codes of the first days, then of all days, and once more of all: nothing is added twice."""
    view = tables.offers(spark, folder, labelled=False)
    first = fit_artifacts(view.filter(F.col("requestDate") < F.lit(_FIRST_DAYS)), "NULL")
    counts = write_table(fit_counts(view, "NULL"), "values")
    second = artifacts_from_counts(counts, known=first.codes)
    return artifacts_from_counts(counts, known=second.codes).codes


_CODED = ["nationality", "companyID", "searchRoute", "legs1_segments0_marketingCarrier_code"]


@query(
    "apply_codes",
    "SELECT Id, "
    + ", ".join(
        f"coalesce((SELECT code FROM codes WHERE feature = '{c}' AND value ="
        f" coalesce({c}::VARCHAR, '{'0' if O.VIEW_CATEGORIES[c] == 'number' else 'missing'}')), -1)"
        f" AS {c}"
        for c in _CODED
    )
    + " FROM offers",
    O.SPLIT, O.codes("trainset"),
)
def _(spark, folder):
    artifacts = _artifacts(spark, folder)
    filled = cols.fill_by_type(cols.align_schema(tables.offers(spark, folder, labelled=False)))
    coded = encode.apply_codes(filled, artifacts.codes, CATEGORIES, artifacts.dictionaries)
    return coded.select("Id", *_CODED)


@query("time_split", "SELECT Id, ranker_id, part FROM parted", O.SPLIT)
def _(spark, folder):
    view = tables.offers(spark, folder, labelled=False)
    parted = split.time_split(view, hot=tables.session_profile(spark, folder))
    return parted.select("Id", "ranker_id", "part")


_HASH_SQL = "CAST('0x' || substr(md5(Id), 1, 8) AS BIGINT)"


@query(
    "make_pairs",
    f"""SELECT o.ranker_id, o.Id AS other_id, c.Id AS best_id,
  c.totalPrice AS best_totalPrice, o.totalPrice AS other_totalPrice
FROM (SELECT *, {_HASH_SQL} % sum(selected) OVER (PARTITION BY ranker_id) AS slot FROM offers) o
JOIN (SELECT *, row_number() OVER (PARTITION BY ranker_id ORDER BY Id) - 1 AS slot
      FROM offers WHERE selected = 1) c
  ON o.ranker_id = c.ranker_id AND o.slot = c.slot
WHERE o.selected = 0""",
)
def _(spark, folder):
    view = tables.offers(spark, folder)
    return train.make_pairs(view, ["totalPrice"], hot=tables.session_profile(spark, folder))


def _labelled_features(spark: SparkSession, folder: str, by_session: bool = False) -> DataFrame:
    """Features of every offer, from lookups fitted on the training part; split and written once.

    ``by_session`` stores them so that jobs on them need no exchange on the session, unless some
    sessions are oversized.
    """
    hot, parts = tables.session_profile(spark, folder), tables.parts_for(spark, folder)
    parted = split.time_split(tables.offers(spark, folder, parts=parts), hot=hot)
    artifacts = fit_artifacts(parted.filter(F.col("part") == "train").drop("part"))
    built = build_features(parted, artifacts, hot=hot)
    kept = ["part", "Id", "ranker_id", "selected", "pred_score", *train.RANKER_FEATURES]
    if hot or not by_session:
        return write_table(built.select(*kept), "features")
    path = scratch_path(spark, "features")
    table = path.rsplit("/", 1)[1].replace("-", "_")
    # Lookups that were shuffled have moved the offers away from their sessions.
    placed = bool(artifacts.small_routes) and all(artifacts.small_carriers.values())
    writers.write_offers_by_session(built.select(*kept), table, path, parts, hot=hot, placed=placed)
    return readers.read_offers_by_session(spark, table)


def _trained(spark: SparkSession, folder: str):
    features = _labelled_features(spark, folder, by_session=True)
    hot = tables.session_profile(spark, folder)
    return features, train.train_ranker(features.filter(F.col("part") == "train"), hot=hot)


@query("train_ranker")
def _(spark, folder):
    _, model = _trained(spark, folder)
    return train.feature_importance(spark, model)


@query("score")
def _(spark, folder):
    features, model = _trained(spark, folder)
    return train.score(features, model).select("Id", "ranker_id", "part", "score")


@query(
    "score_saved",
    "SELECT Id, ranker_id, part, round(coalesce(totalPrice, 0) * -0.001::DOUBLE + n_rows * 0.5::DOUBLE, 6)"
    " AS score FROM parted JOIN (SELECT Id, n_rows FROM ranked) USING (Id)",
    O.SPLIT, O.RANKED,
)
def _(spark, folder):
    """A pairwise model with known weights, saved, loaded and applied."""
    hot = tables.session_profile(spark, folder)
    parted = split.time_split(tables.offers(spark, folder, labelled=False), hot=hot)
    path = scratch_path(spark, "model")
    train.LinearRanker({"totalPrice": -0.001, "group_size": 0.5}).save(spark, path)
    model = train.LinearRanker.load(spark, path)
    scored = train.score(lookups.with_group_size(parted, hot=hot), model)
    return tidy(scored, "Id", "ranker_id", "part", "score")


@query("train_pointwise")
def _(spark, folder):
    features = _labelled_features(spark, folder)
    model = train.train_pointwise(features.filter(F.col("part") == "train"))
    return train.score(features, model).select("Id", "ranker_id", "part", "score")


@query("train_by_gain")
def _(spark, folder):
    """Quality of the model of equal weights (round 0) and of the rounds weighed by gain."""
    learned = _labelled_features(spark, folder, by_session=True).filter(F.col("part") == "train")
    _, history = gain.train_by_gain(learned, hot=tables.session_profile(spark, folder), stored=True)
    return gain.round_table(learned, history)


@query("boosting_rounds")
def _(spark, folder):
    """Boosting that stops by the sessions of the validation part, with the quality of each round."""
    features = _labelled_features(spark, folder)
    marked = features.withColumn("held", F.col("part") == "valid")
    return quality.boosting_rounds(features, train.train_pointwise(marked, validation="held"))


@query("feature_importance")
def _(spark, folder):
    features = _labelled_features(spark, folder)
    train_rows = features.filter(F.col("part") == "train")
    model = train.train_pointwise(train_rows)
    return ranking.most_important(train.feature_importance(spark, model))


@query("permutation_importance")
def _(spark, folder):
    features, model = _trained(spark, folder)
    valid = features.filter(F.col("part") == "valid")
    hot = tables.session_profile(spark, folder)
    return quality.permutation_importance(valid, model, list(model.weights), hot=hot)


_KNOWN_WEIGHTS = {"price_rank": -0.5, "totalPrice": -0.0001, "taxes": 0.0}


@query(
    "permutation_importance_known",
    """SELECT f AS feature, round((SELECT avg(ndcg) FROM dealt_ndcg WHERE f = '') - avg(ndcg), 6) + 0.0 AS importance
FROM dealt_ndcg WHERE f <> '' GROUP BY f""",
    """dealt AS (
  SELECT *, coalesce(lead(price_rank) OVER w, first(price_rank) OVER w) AS other_rank,
    coalesce(lead(totalPrice) OVER w, first(totalPrice) OVER w) AS other_price
  FROM (SELECT *, rank() OVER (PARTITION BY ranker_id ORDER BY totalPrice)
    + (count(*) OVER (PARTITION BY ranker_id, totalPrice) - 1) / 2.0 AS price_rank FROM offers)
  WINDOW w AS (PARTITION BY ranker_id ORDER BY md5(Id), Id)
),
dealt_rank AS (
  SELECT f, ranker_id, selected, row_number() OVER (PARTITION BY f, ranker_id ORDER BY score DESC, Id) AS rank
  FROM (SELECT *, CASE WHEN f = 'price_rank' THEN other_rank ELSE price_rank END * -0.5::DOUBLE
    + CASE WHEN f = 'totalPrice' THEN other_price ELSE totalPrice END * -0.0001::DOUBLE AS score
    FROM dealt, (VALUES (''), ('price_rank'), ('totalPrice'), ('taxes')) t(f))
),
dealt_ndcg AS (
  SELECT f, ranker_id, CASE WHEN sum(selected) = 0 THEN 1.0::DOUBLE ELSE
    coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 3 AND selected = 1), 0) END AS ndcg
  FROM dealt_rank GROUP BY ALL
)""",
)
def _(spark, folder):
    """A model of known weights, one of them zero."""
    hot = tables.session_profile(spark, folder)
    view = tables.offers(spark, folder)
    ranked = view.withColumn("price_rank", groups.average_rank("totalPrice", "ranker_id"))
    model = train.LinearRanker(_KNOWN_WEIGHTS)
    found = quality.permutation_importance(ranked, model, list(_KNOWN_WEIGHTS), hot=hot)
    return tidy(found, "feature", "importance")


@query("trained_hitrate")
def _(spark, folder):
    features, model = _trained(spark, folder)
    valid = train.score(features.filter(F.col("part") == "valid"), model)
    hot = tables.session_profile(spark, folder)
    return evaluate.hit_summary(valid, score="score", hot=hot)


# ---------------------------------------------------------------- evaluation


def _view(spark: SparkSession, folder: str) -> dict:
    return {
        "df": tables.offers(spark, folder),
        "hot": tables.session_profile(spark, folder),
    }


def _curve_sql(ks: Sequence[int], source: str = "large") -> str:
    values = ", ".join(f"({k})" for k in ks)
    return (
        f"SELECT CAST(k AS INT) AS k, round(avg(coalesce(best_rank <= k, false)::INT), 6) AS"
        f" hitrate FROM {source}, (VALUES {values}) t(k) GROUP BY k"
    )


@query(
    "hitrate_at_k",
    f"SELECT round(avg({_HIT_SQL}), 6) AS hitrate FROM large",
    O.RANKED, O.OUTCOMES, O.LARGE,
)
def _(spark, folder):
    return tidy(evaluate.hitrate_at_k(**_view(spark, folder)))


@query("hitrate_curve", _curve_sql(evaluate.CURVE_KS), O.RANKED, O.OUTCOMES, O.LARGE)
def _(spark, folder):
    return tidy(evaluate.hitrate_curve(**_view(spark, folder)))


@query("hit_summary", _curve_sql(evaluate.SUMMARY_KS), O.RANKED, O.OUTCOMES, O.LARGE)
def _(spark, folder):
    return tidy(evaluate.hit_summary(**_view(spark, folder)))


_POISSON = " + ".join(f"(u >= {step!r}::DOUBLE)::INT" for step in evaluate.poisson_steps())


@query(
    "hitrate_bounds",
    """SELECT k, round(max(hitrate) FILTER (round = 0), 6) AS hitrate, round(max(low), 6) AS low, round(max(high), 6) AS high
FROM (SELECT *, min(CASE WHEN round > 0 AND place >= ceil(round(200 * 0.025, 9)) THEN hitrate END) OVER (PARTITION BY k) AS low,
    min(CASE WHEN round > 0 AND place >= ceil(round(200 * 0.975, 9)) THEN hitrate END) OVER (PARTITION BY k) AS high
  FROM (SELECT *, row_number() OVER (PARTITION BY k, round > 0 ORDER BY hitrate) AS place FROM rates))
GROUP BY k""",
    O.RANKED, O.OUTCOMES, O.LARGE,
    f"""drawn AS (
  SELECT round, best_rank, CASE WHEN round = 0 THEN 1 ELSE {_POISSON} END AS times FROM (
    SELECT round, best_rank,
      ('0x' || substr(md5('bootstrap:' || round || ':' || ranker_id), 1, 8))::BIGINT / 4294967296::DOUBLE AS u
    FROM large, range(201) r(round))
),
rates AS (
  SELECT round, CAST(k AS INT) AS k, sum(times * coalesce(best_rank <= k, false)::INT)::DOUBLE / sum(times) AS hitrate
  FROM drawn, (VALUES (1), (3), (5), (10)) t(k) GROUP BY ALL
)""",
)
def _(spark, folder):
    return tidy(evaluate.hitrate_bounds(**_view(spark, folder)))


_STRATA = """cuts AS (
  SELECT quantile_disc(group_size, 0.25) AS q25, quantile_disc(group_size, 0.75) AS q75 FROM large
),
strata AS (
  SELECT 'all' AS stratum, best_rank FROM large UNION ALL
  SELECT CASE WHEN group_size <= q25 THEN 'small' WHEN group_size <= q75 THEN 'medium'
    ELSE 'large' END, best_rank FROM large, cuts
)"""


@query(
    "hitrate_by_stratum",
    _curve_sql(evaluate.CURVE_KS, "strata")
    .replace("SELECT CAST", "SELECT stratum, CAST")
    .replace("GROUP BY k", "GROUP BY stratum, k"),
    O.RANKED, O.OUTCOMES, O.LARGE, _STRATA,
)
def _(spark, folder):
    return tidy(evaluate.hitrate_by_stratum(**_view(spark, folder)))


_BINS = """logs AS (
  SELECT *, log10(group_size) AS l, log10((SELECT min(group_size) FROM large)) AS lo,
    log10((SELECT max(group_size) FROM large)) AS hi FROM large
),
binned AS (
  SELECT *, CAST(floor((l - lo) / (hi - lo) * 50) AS BIGINT) AS bin_idx FROM logs
)"""


@query(
    "hitrate_by_size_bin",
    """SELECT bin_idx, round((pow(10, lo + least(bin_idx, 49) * (hi - lo) / 50)
  + pow(10, lo + (least(bin_idx, 49) + 1) * (hi - lo) / 50)) / 2, 6) AS bin_center,
  round(avg(coalesce(best_rank <= 3, false)::INT), 6) AS hitrate, count(*) AS n_groups
FROM binned GROUP BY ALL HAVING count(*) >= 3""",
    O.RANKED, O.OUTCOMES, O.LARGE, _BINS,
)
def _(spark, folder):
    return tidy(evaluate.hitrate_by_size_bin(**_view(spark, folder)))


@query(
    "ndcg_at_k",
    """SELECT round(avg(CASE WHEN n = 0 THEN 1.0 ELSE dcg / ideal END), 6) AS ndcg FROM (
  SELECT ranker_id, sum(selected) AS n,
    coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 3 AND selected = 1), 0) AS dcg,
    list_sum(list_slice([1 / log2(2), 1 / log2(3), 1 / log2(4)], 1,
      least(sum(selected), 3)::INT)) AS ideal
  FROM ranked GROUP BY ranker_id)""",
    O.RANKED,
)
def _(spark, folder):
    return tidy(evaluate.ndcg_at_k(**_view(spark, folder)))


@query("make_submission", "SELECT Id, ranker_id, rank AS selected FROM ranked", O.RANKED)
def _(spark, folder):
    return ranking.make_submission(**_view(spark, folder))


# ---------------------------------------------------------------- the whole feature job

_BUILT_EXACT = [
    "total_duration", "is_one_way", "l0_seg", "n_ff_programs", "total_segments",
    "is_direct_leg0", "is_direct_leg1", "group_size", "is_cheapest", "is_min_segments",
    "is_direct_cheapest", "round_trip_freq",
]
_BUILT_DOUBLES = [
    "price_per_tax", "tax_rate", "log_price", "fee_rate", "price_rank", "price_pct_rank",
    "duration_rank", "price_from_median", *_POPS,
]
_BUILT_NULLABLE = [
    "has_access_tp", "is_popular_route", "is_major_carrier", "legs0_segments0_cabinClass",
]


@query(
    "build_features",
    f"SELECT Id, {', '.join(_BUILT_EXACT)}, "
    + ", ".join(f"round(coalesce({c}, 0), 6) + 0.0 AS {c}" for c in _BUILT_DOUBLES)
    + ", "
    + ", ".join(f"coalesce({c}, 0) AS {c}" for c in _BUILT_NULLABLE)
    + " FROM fullf",
    O.SPLIT, *O.ROWS, O.group_table(), O.lookups("trainset"), O.FULL,
)
def _(spark, folder):
    hot = tables.session_profile(spark, folder)
    built = build_features(tables.offers(spark, folder), _artifacts(spark, folder), hot=hot)
    return tidy(built, "Id", *_BUILT_EXACT, *_BUILT_DOUBLES, *_BUILT_NULLABLE)


@query(
    "offers_by_session",
    f"SELECT Id, {', '.join(_BUILT_EXACT)}, round(coalesce(price_rank, 0), 6) + 0.0 AS price_rank FROM fullf",
    O.SPLIT, *O.ROWS, O.group_table(), O.lookups("trainset"), O.FULL,
)
def _(spark, folder):
    """Features of offers that are stored by session."""
    hot = tables.session_profile(spark, folder)
    path = scratch_path(spark, "by_session")
    table = path.rsplit("/", 1)[1].replace("-", "_")
    buckets = tables.parts_for(spark, folder)
    view = tables.offers(spark, folder, parts=buckets)
    writers.write_offers_by_session(view, table, path, buckets, hot=hot, placed=not hot)
    stored = readers.read_offers_by_session(spark, table)
    built = build_features(stored, _artifacts(spark, folder), hot=hot)
    return tidy(built, "Id", *_BUILT_EXACT, "price_rank")


_ENCODED = ["legs0_segments0_marketingCarrier_code", "companyID", "sex"]


@query(
    "encode_features",
    "SELECT Id, is_cheapest, round_trip_freq, "
    + ", ".join(
        f"coalesce((SELECT code FROM codes WHERE feature = '{c}' AND value ="
        f" coalesce({c}::VARCHAR, 'missing')), -1) AS {c}"
        for c in _ENCODED
    )
    + " FROM fullf",
    O.SPLIT, *O.ROWS, O.group_table(), O.lookups("trainset"), O.codes("trainset"), O.FULL,
)
def _(spark, folder):
    hot = tables.session_profile(spark, folder)
    artifacts = _artifacts(spark, folder)
    built = build_features(tables.offers(spark, folder), artifacts, hot=hot)
    return encode_features(built, artifacts).select(
        "Id", "is_cheapest", "round_trip_freq", *_ENCODED
    )


__all__ = ["ORACLES", "QUERIES", "REQUEST_SCHEMA", "fixed_score"]
