"""Which log files were read, and in what state: a stored ledger instead of a clock.

A file is read when the ledger does not hold its present size and modification time.  So a
restart opens no file it knows, a file that grew is read again, and one that is copied in with an
old date is not passed over.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session_logs import LOG_FILES, read_files
from .tables import write_table

NAME = "ledger"
_FILE = "file_path string, size long, modified timestamp"


def list_files(spark: SparkSession, root: str, pattern: str = LOG_FILES) -> DataFrame:
    """``file_path, size, modified`` of the log files under ``root``; no file is opened."""
    folders, name = pattern.rsplit("/", 1)
    try:  # folders are listed, as a path of its own each file would be looked up again
        files = spark.read.format("binaryFile").option("pathGlobFilter", name).load(f"{root}/{folders}")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], _FILE)
        raise
    return files.select(F.col("path").alias("file_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    """``file_path, size, modified`` as each file was when it was read last."""
    try:
        stored = spark.read.schema(f"{_FILE}, batch long").parquet(f"{root}/{NAME}")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], _FILE)
        raise
    latest = stored.groupBy("file_path").agg(F.max_by(F.struct("size", "modified"), "batch").alias("f"))
    return latest.select("file_path", "f.size", "f.modified")


def write_ledger(seen: DataFrame, root: str, batch: int) -> None:
    """Note the files of a run that has stored their messages."""
    write_table(seen, root, NAME, batch)


def read_changed_logs(spark: SparkSession, root: str, ledger: DataFrame, pattern: str = LOG_FILES) -> tuple[DataFrame, DataFrame]:
    """(the rows of ``read_session_logs`` of new and changed files, ``file_path, size, modified`` of these).

    What is noted of a file is its state before it was read: one that grows meanwhile is read
    again next time.  The names of the changed files come to the driver, as every file that Spark
    reads is listed there; only they are opened.  A folder without a known file is read as a
    folder, so that its files are not looked up one by one.
    """
    listed, state = list_files(spark, root, pattern), ["file_path", "size", "modified"]
    changed = listed.join(ledger, state, "left_anti").collect()
    seen = spark.createDataFrame(changed, _FILE)
    folder = F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1).alias("folder")
    mixed = {row["folder"] for row in listed.join(ledger, state, "left_semi").select(folder).distinct().collect()}
    folders, names = set(), []
    for row in changed:
        above = row["file_path"].rpartition("/")[0]
        if above in mixed:
            names.append(_as_it_is(row["file_path"]))
        else:
            folders.add(_as_it_is(above))
    raw = read_files(spark, root, names, sorted(folders), pattern.rsplit("/", 1)[1])
    if not folders:
        return raw, seen
    # what came into such a folder after it was listed is left to the next time
    same = raw.withColumn("_path", _plain("file_path")).join(
        F.broadcast(seen.select(_plain("file_path").alias("_path")).distinct()), "_path", "left_semi")
    return same.drop("_path"), seen


def _as_it_is(path: str) -> str:
    """Paths are taken as they are, not as patterns."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _plain(path: str) -> Column:
    """``file:/a`` and ``file:///a`` alike."""
    return F.regexp_replace(path, "^([A-Za-z0-9+.-]+):/+", "$1:/")
