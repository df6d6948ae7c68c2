"""Steps of operators that run as several jobs."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from recallscope import session

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def last_reader(spark: SparkSession):
    """For a job whose shuffles nothing reads again: Spark deletes their files when it
    ends (otherwise they stay on the executors' disks until the driver collects garbage)."""
    old = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, old)


def materialize(df: DataFrame) -> DataFrame:
    """``df`` computed once into the checkpoint folder; its lineage and shuffle files go."""
    with last_reader(df.sparkSession):
        return session.materialize(df)
