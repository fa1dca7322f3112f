"""Reading the driver's tables and the settings the operators count on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import tune

BATCH, SMALL_BATCH = "8m", "2m"


def batches_of(spark: SparkSession, size: str) -> None:
    """Whole texts travel to Python in batches of this many bytes, not of 10,000 rows.

    Buffers of a batch stay with the executor and with its Python workers after it is done:
    steps that make no less of small batches take ``SMALL_BATCH``.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def read(spark: SparkSession, sf_dir: str, name: str, batch: str = BATCH) -> DataFrame:
    tune(spark)
    batches_of(spark, batch)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
