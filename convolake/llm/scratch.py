"""Intermediate tables in the shared checkpoint folder, removed by whoever wrote them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

_results: list[str] = []


class Scratch:
    """Tables that live as long as the ``with`` block; only ``result`` outlives it.

    Every table is Parquet in the folder that all executors share, so a lost executor
    costs the tasks it ran, never finished rows, and a loop starts each round from a scan.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
        self._written: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for folder in self._written:
            remove(self.spark, folder)

    def path(self) -> str:
        """A new folder that the end of the block removes."""
        self._written.append(f"{self.folder}-{len(self._written)}")
        return self._written[-1]

    def table(self, df: DataFrame) -> DataFrame:
        """``df`` written once; what comes back reads the written rows."""
        folder = self.path()
        df.write.parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def drop(self, df: DataFrame) -> None:
        """Remove a table before the block ends."""
        for folder in df.inputFiles()[:1]:
            name = folder.rsplit("/", 1)[0].rsplit("/", 1)[1]
            for known in [k for k in self._written if k.rsplit("/", 1)[1] == name]:
                remove(self.spark, known)

    def result(self, df: DataFrame) -> DataFrame:
        """The rows to return: kept until ``forget_results``, all other tables go."""
        folder = f"{self.folder}-result"
        df.write.parquet(folder)
        _results.append(folder)
        return self.spark.read.schema(df.schema).parquet(folder)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget_results(spark: SparkSession) -> int:
    """Remove the results written so far in this process; returns how many."""
    n = len(_results)
    while _results:
        remove(spark, _results.pop())
    return n
