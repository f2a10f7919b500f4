"""Session settings that the operators over long texts are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows in a batch that is handed to Python; long texts make batches of the usual size too large.
BATCH_ROWS = "1000"


def tune(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark
