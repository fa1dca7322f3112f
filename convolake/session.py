"""Session settings the operators count on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join even where an aggregate on the same key follows it
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Parquet writers look at their size from the first row on, not after a hundred long prompts
    "parquet.page.size.row.check.min": "1",
    "parquet.block.size.row.check.min": "1",
    # and keep no copies of whole prompts as the least and greatest of every page and row group (a
    # file has none of this length in its statistics), nor as dictionary entries
    "parquet.column.statistics.enabled#prompt": "false",
    "parquet.enable.dictionary#prompt": "false",
}


_written: list[str] = []  # folders of ``write_down`` that nobody has removed yet


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings every job here relies on."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the configured one, else one in the warehouse folder.

    Both lie on a file system that all executors share; local folders are never used.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if configured is None:
            configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_convolake"
        sc.setCheckpointDir(configured)
    return configured or sc.getCheckpointDir()


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and go on from the written rows.

    Used where two consumers must see identical rows (generated positions, model
    answers) and where a loop would otherwise grow its lineage.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_down(df: DataFrame) -> DataFrame:
    """Like ``pin``, as a Parquet table: for rows read again column by column.

    Model answers go through here, so that reading them twice asks no model twice.
    """
    return read_folders(df, [write_folder(df)])


def write_folder(df: DataFrame) -> str:
    """The new folder to which ``df`` was written as a Parquet table."""
    folder = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/convolake-{uuid.uuid4().hex}"
    _written.append(folder)
    df.write.parquet(folder)
    return folder


def read_folders(like: DataFrame, folders: list[str]) -> DataFrame:
    """The rows of all ``folders``, which hold tables with the columns of ``like``, as one scan."""
    return like.sparkSession.read.schema(like.schema).parquet(*folders)


def forget_folder(spark: SparkSession, folder: str) -> None:
    """Remove one table of ``write_folder`` that nobody reads any more."""
    _written.remove(folder)
    _remove(spark, folder)


def forget_written(spark: SparkSession) -> int:
    """Remove all tables of ``write_down`` once their results are stored; returns how many."""
    n = len(_written)
    while _written:
        _remove(spark, _written.pop())
    return n


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
