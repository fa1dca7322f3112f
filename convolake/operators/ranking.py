"""Positions in an order, computed without putting a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import pin

_ROW_BITS = 33  # rows within a partition use the lower 33 bits of a generated id


def global_index(df: DataFrame, *order: Column | str, name: str = "idx") -> DataFrame:
    """Add a dense 0-based position of each row in the total order ``order``.

    A range-partitioned sort spreads even a single hot group over many tasks.  The
    sorted rows are written once, so that the per-partition counts and the rows
    that use them agree; the counts are one row per partition.
    """
    sorted_rows = pin(
        df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", _ROW_BITS)
    sizes = sorted_rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    # one row per sort partition: its size is bounded by the number of shuffle partitions
    return (
        sorted_rows.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + within)
        .drop("_part", "_at", "_offset")
    )


def group_index(df: DataFrame, group: str, *order: Column | str, name: str = "idx") -> DataFrame:
    """0-based position of each row inside its group, safe for groups of any size."""
    indexed = global_index(df, F.col(group), *order, name="_global")
    first = indexed.groupBy(group).agg(F.min("_global").alias("_first"))
    return (
        indexed.join(first.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g")))
        .withColumn(name, F.col("_global") - F.col("_first"))
        .drop("_g", "_global", "_first")
    )


def first_n(df: DataFrame, group: str | list[str], n: int, *order: Column | str,
            name: str = "rank") -> DataFrame:
    """First ``n`` rows of each group with their 1-based rank.

    Spark keeps at most ``n`` rows per group in every task before the shuffle
    (WindowGroupLimit), so a hot group is never gathered.
    """
    keys = [group] if isinstance(group, str) else group
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)
