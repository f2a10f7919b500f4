import pytest


@pytest.fixture(autouse=True, scope="package")
def few_partitions(spark):
    """The inputs here are tiny: fewer tasks, less waiting."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
