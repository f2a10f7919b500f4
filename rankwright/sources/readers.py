"""Reading offers, requests and fitted lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankwright.schema import REQUEST_SCHEMA, STRAY_INDEX


def read_offers(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    stray: str = STRAY_INDEX,
) -> DataFrame:
    """Offers from parquet, without the stray index column.

    With ``schema`` nothing is inferred, and columns absent from the files read as NULL.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path).drop(stray)


def read_offers_by_session(spark: SparkSession, table: str) -> DataFrame:
    """Offers stored by ``write_offers_by_session``: windows over a session need no exchange."""
    return spark.table(table)


def label_unlabelled(df: DataFrame, label: str = "selected") -> DataFrame:
    """Give rows without a known choice the label 0."""
    return df.withColumn(label, F.lit(0).cast("long"))


def union_offers(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.unionByName(test)


def with_request_key(requests: DataFrame, file: str = "_file") -> DataFrame:
    """Make an id, from the file and the row's place in it, for requests that came without one."""
    made = F.concat_ws(
        "-",
        F.lit("made"),
        F.hex(F.xxhash64(file)),
        F.monotonically_increasing_id().cast("string"),
    )
    return requests.withColumn("request_id", F.coalesce("request_id", made)).drop(file)


_BROKEN = "_broken"


def parse_requests(lines: DataFrame, *carry: str) -> DataFrame:
    """The requests in lines of JSON text; ``_broken`` has the lines with an unreadable field.

    Blank lines are no requests. ``carry`` are more columns of the lines to keep.
    """
    schema = T.StructType([*REQUEST_SCHEMA.fields, T.StructField(_BROKEN, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}
    lines = lines.filter(F.trim("value") != "")
    parsed = lines.withColumn("_request", F.from_json("value", schema, options))
    return parsed.select("_request.*", "_file", *carry)


def _request_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumn("_file", F.col("_metadata.file_path"))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """The readable ranking requests, one JSON object per line, with a request id on each.

    A request with a field that can't be read as declared isn't ranked on what is left of it; see
    ``rejected_requests``.
    """
    parsed = parse_requests(_request_lines(spark, path))
    return with_request_key(parsed.filter(F.col(_BROKEN).isNull()).drop(_BROKEN))


def rejected_requests(spark: SparkSession, path: str) -> DataFrame:
    """``request_id, ranker_id, reason, text`` of the requests that get no response.

    The reason is ``unreadable`` (broken JSON or a field of another type; ``text`` is the line) or
    ``empty`` (no offers).
    """
    parsed = parse_requests(_request_lines(spark, path))
    empty = F.coalesce(F.size("flights"), F.lit(0)) <= 0
    reason = F.when(F.col(_BROKEN).isNotNull(), "unreadable").when(empty, "empty")
    return parsed.select(
        "request_id", "ranker_id", reason.alias("reason"), F.col(_BROKEN).alias("text")
    ).filter(F.col("reason").isNotNull())


def request_offers(requests: DataFrame, *carry: str) -> DataFrame:
    """One row per offer, carrying the id and the session of its request."""
    return requests.select(*carry, "request_id", "ranker_id", F.inline("flights"))

