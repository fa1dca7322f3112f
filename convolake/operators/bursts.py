"""Bursts of change events: runs without a pause longer than ``gap``."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 1 << 16  # of a block

_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def gap_microseconds(gap: str) -> int:
    match = re.fullmatch(r"\s*(\d+)\s+(second|minute|hour|day)s?\s*", gap)
    if not match or int(match[1]) == 0:
        raise ValueError(f"cannot read the gap {gap!r}")
    return int(match[1]) * _UNITS[match[2]] * 1_000_000


def change_bursts(events: DataFrame, gap: str = "30 seconds", key: str | None = None,
                  file: str = "file") -> DataFrame:
    """(key, burst_start, last_change, n_changes, n_files) of events (ts, file).

    A burst is due ``gap`` after ``last_change``.  Events first shrink to cells of
    one gap's width: two events in one cell are always in the same burst.  Cells are
    numbered in blocks of ``CELLS`` and the blocks by their sums, so a key of many cells,
    or all events without a key, are many tasks.  A file changed often within a burst counts once.
    """
    width = gap_microseconds(gap)
    kind = events.schema["ts"].dataType
    keyed = events.select(
        (F.col(key) if key else F.lit("all")).alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        F.col(file).alias("file"),
    ).withColumn("cell", F.floor(F.col("at") / width))
    per_file = keyed.groupBy("key", "cell", "file").agg(
        F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high"))
    cells = per_file.groupBy("key", "cell").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    blocked = cells.withColumn("block", F.floor(F.col("cell") / CELLS))
    in_block = Window.partitionBy("key", "block").orderBy("cell")
    blocks = Window.partitionBy("key").orderBy("block")  # one row for each block
    ends = blocked.groupBy("key", "block").agg(F.max("high").alias("end")).select(
        "key", "block", F.lag("end").over(blocks).alias("before"))
    starts = F.col("low") - F.coalesce(F.lag("high").over(in_block), F.col("before")) > width
    marked = blocked.join(ends, ["key", "block"]).withColumn("_new", F.coalesce(starts, F.lit(True)).cast("int"))
    sums = marked.groupBy("key", "block").agg(F.sum("_new").alias("n")).select(
        "key", "block", F.coalesce(F.sum("n").over(blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    numbered = marked.join(sums, ["key", "block"]).withColumn(
        "burst", F.col("earlier") + F.sum("_new").over(in_block.rowsBetween(Window.unboundedPreceding, 0)))
    sizes = numbered.groupBy("key", "burst").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n_changes"))
    files = (
        per_file.select("key", "cell", "file").join(numbered.select("key", "cell", "burst"), ["key", "cell"])
        .select("key", "burst", "file").distinct()
        .groupBy("key", "burst").agg(F.count("*").alias("n_files"))
    )
    return sizes.join(files, ["key", "burst"]).select(
        "key", F.timestamp_micros("low").cast(kind).alias("burst_start"),
        F.timestamp_micros("high").cast(kind).alias("last_change"), "n_changes", "n_files")


def burst_windows(events: DataFrame, gap: Column | str = "30 seconds", key: str | None = None,
                  delay: str = "0 seconds", file: str = "file") -> DataFrame:
    """The same bursts for a stream, emitted when they close (append mode).

    The watermark lags the newest event by ``delay``.  A stream needs a grouping
    column besides the window, so a constant one stands in when there is no key.
    """
    keyed = events.withWatermark("ts", delay).withColumn("key", F.col(key) if key else F.lit("all"))
    return keyed.groupBy("key", F.session_window("ts", gap).alias("w")).agg(
        F.count("*").alias("n_changes"), F.max("ts").alias("last_change"), F.size(F.collect_set(file)).alias("n_files"),
    ).select("key", F.col("w.start").alias("burst_start"), "last_change", "n_changes", "n_files")
