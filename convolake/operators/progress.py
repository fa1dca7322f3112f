"""High-water marks per (session, project), and what is new beyond them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import project_filter

_BLOCK = 1024  # message positions per pre-aggregated row


def incremental_messages(messages: DataFrame, sessions: DataFrame, progress: DataFrame,
                         project: str | None = None, full: bool = False,
                         project_equals: str | None = None) -> DataFrame:
    """Messages past their session's mark (all of them when ``full``), with the project."""
    owned = project_filter(
        sessions.where(F.col("project_path").isNotNull()), project, project_equals
    ).select("session_id", "project_path", "created_at")
    if not full:
        marks = progress.select("session_id", "project_path", "last_message_id")
        owned = owned.join(marks, ["session_id", "project_path"], "left")
    fresh = messages.where(F.col("user_text").isNotNull()).join(owned, "session_id")
    if not full:
        fresh = fresh.where(
            F.col("last_message_id").isNull() | (F.col("msg_seq") > F.col("last_message_id"))
        ).drop("last_message_id")
    return fresh


def stale_projects(messages: DataFrame, sessions: DataFrame, progress: DataFrame,
                   compat: bool = False) -> DataFrame:
    """Projects with work left.

    ``compat`` reproduces a looser rule: any message whose position is not the
    mark of some session of the project makes the project stale.
    """
    if not compat:
        return incremental_messages(messages, sessions, progress).select("project_path").distinct()
    owned = sessions.where(F.col("project_path").isNotNull()).select("session_id", "project_path")
    # distinct positions per session first: the text of the messages is never shuffled
    positions = messages.select("session_id", "msg_seq").join(owned, "session_id").select(
        "project_path", F.col("msg_seq").alias("last_message_id")
    ).distinct()
    marks = progress.select("project_path", "last_message_id").distinct()
    return (
        positions.join(marks, ["project_path", "last_message_id"], "left_anti")
        .select("project_path").distinct()
    )


def advance_watermark(progress: DataFrame, processed: DataFrame,
                      as_of: Column | None = None) -> DataFrame:
    """Raise marks to the largest processed position; marks never fall.

    ``processed`` has (session_id, project_path, last_message_id).
    """
    as_of = F.current_timestamp() if as_of is None else as_of
    both = progress.select(
        "session_id", "project_path", "last_message_id", "distilled_at"
    ).unionByName(
        processed.select("session_id", "project_path", "last_message_id",
                         as_of.cast("timestamp").alias("distilled_at"))
    )
    return both.groupBy("session_id", "project_path").agg(
        F.max("last_message_id").alias("last_message_id"), F.max("distilled_at").alias("distilled_at")
    )


def session_counts(sessions: DataFrame, messages: DataFrame, progress: DataFrame) -> DataFrame:
    """Per session: messages with a prompt, and how many of them lie below the mark.

    Messages shrink to one row per 1,024 positions before they meet the marks; only
    the block a mark falls into looks at single positions.  A session holding a
    large part of all messages is thus spread over its blocks.
    """
    blocks = (
        messages.where(F.col("user_text").isNotNull())
        .groupBy("session_id", F.floor(F.col("msg_seq") / _BLOCK).alias("block"))
        .agg(F.count("*").alias("n"), F.min("msg_seq").alias("low"), F.max("msg_seq").alias("high"),
             F.collect_list("msg_seq").alias("positions"))
    )
    marks = progress.select("session_id", "project_path", "last_message_id")
    mark = F.col("last_message_id")
    below = (
        F.when(mark.isNull() | F.col("n").isNull() | (F.col("low") > mark), F.lit(0))
        .when(F.col("high") <= mark, F.col("n"))
        .otherwise(F.size(F.filter("positions", lambda p: p <= mark)))
    )
    return (
        sessions.select("session_id", "project_path")
        .join(marks, ["session_id", "project_path"], "left")
        .join(blocks, "session_id", "left")
        .select("session_id", "project_path", F.coalesce("n", F.lit(0)).alias("n"),
                below.cast("long").alias("below"))
        .groupBy("session_id", "project_path")
        .agg(F.sum("n").alias("messages"), F.sum("below").alias("distilled"))
    )


def project_progress(sessions: DataFrame, messages: DataFrame, progress: DataFrame,
                     skills: DataFrame, project: str | None = None) -> DataFrame:
    """Per project: sessions, messages, distilled, remaining, percent, skills; plus a total row."""
    owned = project_filter(sessions.where(F.col("project_path").isNotNull()), project)
    per_project = (
        session_counts(owned, messages, progress)
        .groupBy("project_path")
        .agg(F.count("*").alias("total_sessions"), F.sum("messages").alias("total_messages"),
             F.sum("distilled").alias("distilled"))
    )
    known = skills.groupBy("project_path").agg(F.count("*").alias("n_skills"))
    counted = per_project.join(known, "project_path", "left")
    total, done = F.sum("total_messages"), F.sum("distilled")
    return (
        counted.rollup("project_path")
        .agg(
            F.grouping("project_path").cast("int").alias("is_total"),
            F.sum("total_sessions").alias("total_sessions"), total.alias("total_messages"),
            done.alias("distilled"), (total - done).alias("remaining"),
            F.when(total > 0, F.round(done / total * 100, 6)).otherwise(F.lit(0.0)).alias("pct"),
            F.coalesce(F.sum("n_skills"), F.lit(0)).alias("skills"),
        )
        .orderBy("is_total", F.desc("total_messages"), "project_path")
    )
