"""Row filters that the reports share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_fold, like_ci, like_pattern


def like_filter(df: DataFrame, col: str, text: str | None, literal: bool = False) -> DataFrame:
    """Rows whose ``col`` contains ``text``; all rows when there is no text."""
    return df if not text else df.where(like_ci(F.col(col), text, literal))


def project_filter(df: DataFrame, project: str | None = None,
                   project_equals: str | None = None) -> DataFrame:
    """Rows of projects matching a part of the path, or of exactly one project."""
    df = like_filter(df, "project_path", project)
    return df if project_equals is None else df.where(F.col("project_path") == project_equals)


def by_id_prefix(df: DataFrame, col: str, id_text: str) -> DataFrame:
    """The row with this id, else the smallest id starting with it; at most one row."""
    exact = F.col(col) == id_text
    prefix = ascii_fold(F.col(col)).like(like_pattern(id_text)[1:])
    return df.where(exact | prefix).orderBy(F.when(exact, 0).otherwise(1), F.col(col)).limit(1)
