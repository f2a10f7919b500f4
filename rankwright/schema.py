"""Declared schemas and the fixed names of the offer data model."""

from __future__ import annotations

from pyspark.sql import types as T

LEGS = (0, 1)
SEGMENTS = (0, 1, 2, 3)

# They must equal the source data's own names and codes.
STRAY_INDEX = "__index_level_0__"
MISSING = "missing"
POPULAR_ROUTES = ["MOWLED/LEDMOW", "LEDMOW/MOWLED", "MOWLED", "LEDMOW", "MOWAER/AERMOW"]
MAJOR_CARRIERS = ["SU", "S7", "U6"]
SEGMENT_TEXT = [
    "aircraft_code",
    "arrivalTo_airport_city_iata",
    "arrivalTo_airport_iata",
    "departureFrom_airport_iata",
    "marketingCarrier_code",
    "operatingCarrier_code",
    "flightNumber",
]
SEGMENT_OTHER_TEXT = ["baggageAllowance_weightMeasurementType", "duration"]
SEGMENT_NUMBERS = ["baggageAllowance_quantity", "cabinClass", "seatsAvailable"]
TIME_COLUMNS = ["legs0_departureAt", "legs0_arrivalAt", "legs1_departureAt", "legs1_arrivalAt"]
SESSION_CATEGORIES = [
    "nationality",
    "searchRoute",
    "corporateTariffCode",
    "bySelf",
    "sex",
    "companyID",
]
NOT_FEATURES = [
    "Id",
    "ranker_id",
    "selected",
    "profileId",
    "requestDate",
    *TIME_COLUMNS,
    "frequentFlyer",
    "pricingInfo_passengerCount",
]


def segment_column(leg: int, segment: int, suffix: str) -> str:
    return f"legs{leg}_segments{segment}_{suffix}"


CATEGORIES = SESSION_CATEGORIES + [
    segment_column(leg, segment, suffix)
    for leg in LEGS
    for segment in SEGMENTS[:2]
    for suffix in SEGMENT_TEXT
]

CONVERTED_DURATIONS = ["legs0_duration", "legs1_duration"] + [
    segment_column(leg, segment, "duration") for leg in LEGS for segment in SEGMENTS[:2]
]

CARRIER_COLUMNS = [segment_column(leg, 0, "marketingCarrier_code") for leg in LEGS]

ROUTE_COLUMNS = [
    segment_column(leg, 0, end)
    for leg in LEGS
    for end in ("departureFrom_airport_iata", "arrivalTo_airport_iata")
]

LATE_SEGMENT_COLUMNS = [
    segment_column(leg, segment, suffix)
    for leg in LEGS
    for segment in SEGMENTS[2:]
    for suffix in SEGMENT_TEXT + SEGMENT_OTHER_TEXT + SEGMENT_NUMBERS
]


def _offer_fields() -> list[T.StructField]:
    text, number, whole = T.StringType(), T.DoubleType(), T.LongType()
    fields = [
        ("Id", text),
        ("ranker_id", whole),
        ("selected", whole),
        ("profileId", whole),
        ("requestDate", T.TimestampNTZType()),
        ("pricingInfo_passengerCount", whole),
        ("totalPrice", number),
        ("taxes", number),
        ("searchRoute", text),
        ("corporateTariffCode", text),
        ("frequentFlyer", text),
        ("nationality", whole),
        ("companyID", whole),
        ("sex", whole),
        ("bySelf", whole),
        ("isVip", number),
        ("isAccess3D", number),
        ("pricingInfo_isAccessTP", number),
    ]
    for rule in (0, 1):
        fields += [
            (f"miniRules{rule}_monetaryAmount", number),
            (f"miniRules{rule}_percentage", number),
            (f"miniRules{rule}_statusInfos", text),
        ]
    for leg in LEGS:
        fields += [(f"legs{leg}_{end}", text) for end in ("duration", "departureAt", "arrivalAt")]
        for segment in SEGMENTS:
            fields += [
                (segment_column(leg, segment, s), text) for s in SEGMENT_TEXT + SEGMENT_OTHER_TEXT
            ]
            fields += [(segment_column(leg, segment, s), number) for s in SEGMENT_NUMBERS]
    return [T.StructField(name, kind) for name, kind in fields]


OFFER_SCHEMA = T.StructType(_offer_fields())

# One offer inside a request: the session id sits on the request itself.
FLIGHT_SCHEMA = T.StructType(
    [f for f in OFFER_SCHEMA.fields if f.name not in ("ranker_id", "selected")]
)

REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("ranker_id", T.LongType()),
        T.StructField("flights", T.ArrayType(FLIGHT_SCHEMA)),
    ]
)
