"""Read-only reports over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_name, display_path, epoch_ms_date, like_ci, preview
from .filters import by_id_prefix, like_filter, project_filter


def status_totals(**tables: DataFrame) -> DataFrame:
    """Row count of each named table, one row per table."""
    counts = [df.agg(F.count("*").alias("total")).select(F.lit(name).alias("table_name"), "total")
              for name, df in tables.items()]
    out = counts[0]
    for one in counts[1:]:
        out = out.unionByName(one)
    return out


def top_projects(sessions: DataFrame, limit: int = 5) -> DataFrame:
    return (
        sessions.where(F.col("project_path").isNotNull())
        .groupBy("project_path").agg(F.count("*").alias("sessions"))
        .orderBy(F.desc("sessions"), "project_path").limit(limit)
    )


def project_picker(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions and messages per project; messages count whether or not they have text."""
    per_session = messages.groupBy("session_id").agg(F.count("*").alias("n"))
    return (
        sessions.where(F.col("project_path").isNotNull()).select("session_id", "project_path")
        .join(per_session, "session_id", "left")
        .groupBy("project_path")
        .agg(F.count("*").alias("sessions"), F.coalesce(F.sum("n"), F.lit(0)).alias("messages"))
        .orderBy(F.desc("sessions"), "project_path")
    )


def skills_per_project(skills: DataFrame, keep_null: bool = False) -> DataFrame:
    kept = skills if keep_null else skills.where(F.col("project_path").isNotNull())
    return (
        kept.groupBy("project_path").agg(F.count("*").alias("skills"))
        .orderBy(F.desc("skills"), F.asc_nulls_first("project_path"))
    )


def list_sessions(sessions: DataFrame, messages: DataFrame, project: str | None = None,
                  limit: int = 20, home: str | None = None) -> DataFrame:
    """Latest sessions with their message count and date.

    The top ``limit`` sessions are chosen first; only their messages are counted.
    """
    order = [F.desc_nulls_last("last_message_at"), F.asc("session_id")]
    top = like_filter(sessions, "project_path", project).orderBy(*order).limit(limit)
    chosen = F.broadcast(top.select("session_id"))  # at most `limit` rows
    counts = messages.select("session_id").join(chosen, "session_id", "left_semi").groupBy(
        "session_id").agg(F.count("*").alias("n"))
    shown = F.coalesce(F.col("project_path"), F.lit(""))
    shown = F.replace(shown, F.lit(home), F.lit("~")) if home else shown
    return top.join(counts, "session_id", "left").orderBy(*order).select(
        "session_id", preview(F.col("session_id"), 12).alias("short_id"),
        F.coalesce("n", F.lit(0)).alias("messages"), shown.alias("project"),
        epoch_ms_date(F.col("last_message_at")).alias("last_date"),
    )


def session_transcript(sessions: DataFrame, messages: DataFrame, session: str,
                       limit: int = 50, width: int = 500) -> DataFrame:
    """Messages of one session (id or start of an id) in order, responses shortened."""
    chosen = by_id_prefix(sessions, "session_id", session).select("session_id")
    response = F.col("response_summary")
    shown = F.when(F.length(response) > width,
                   F.concat(preview(response, width), F.lit("…"))).otherwise(response)
    return (
        messages.join(F.broadcast(chosen), "session_id", "left_semi")  # one row at most
        .orderBy(F.asc_nulls_first("ts"), "msg_seq").limit(limit)
        .select("session_id", "msg_seq", "ts", "user_text", shown.alias("response"))
    )


def grep_history(messages: DataFrame, sessions: DataFrame, text: str, project: str | None = None,
                 limit: int = 20, literal: bool = False) -> DataFrame:
    """Latest messages whose prompt or response contains ``text``."""
    hit = like_ci(F.col("user_text"), text, literal) | like_ci(F.col("response_summary"), text, literal)
    owned = like_filter(sessions, "project_path", project).select("session_id", "project_path")
    return (
        messages.where(hit)
        .select("session_id", "msg_seq", "ts", preview(F.col("user_text"), 150).alias("prompt"),
                preview(F.coalesce("response_summary", F.lit("")), 200).alias("response"))
        .join(owned, "session_id")
        .orderBy(F.desc_nulls_last("ts"), "session_id", "msg_seq").limit(limit)
        .select("session_id", "msg_seq", "ts", "prompt", "response",
                base_name(F.col("project_path"), "unknown").alias("project"))
    )


def list_skills(skills: DataFrame, project: str | None = None) -> DataFrame:
    return (
        like_filter(skills, "project_path", project)
        .orderBy(F.desc_nulls_last("created_at"), "skill_id")
        .select("skill_id", preview(F.col("skill_id"), 10).alias("short_id"), "title", "tags",
                preview(F.coalesce("description", F.lit("")), 50).alias("summary"),
                display_path(F.col("project_path")).alias("project"))
    )


def skill_detail(skills: DataFrame, skill: str) -> DataFrame:
    """One skill (id or start of an id) as readable text."""
    def listed(label: str, column: str):
        joined = F.array_join(column, ", ")
        return F.when(F.coalesce(joined, F.lit("")) != "",
                      F.concat(F.lit(f"{label}: "), joined, F.lit("\n"))).otherwise(F.lit(""))

    narrative = F.when(F.coalesce("narrative", F.lit("")) != "",
                       F.concat(F.lit("\n\nContext:\n"), "narrative")).otherwise(F.lit(""))
    body = F.concat(
        F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("description", F.lit("")),
        F.lit("\n\nType: "), F.coalesce("obs_type", F.lit("workflow")),
        F.lit("\nTags: "), F.coalesce("tags", F.lit("")),
        F.lit("\nProject: "), F.coalesce("project_path", F.lit("global")), F.lit("\n\n"),
        listed("Facts", "facts"), listed("Concepts", "concepts"),
        listed("Files read", "files_read"), listed("Files modified", "files_modified"),
        F.lit("\nSteps:\n"), F.coalesce("steps", F.lit("")), narrative,
    )
    return by_id_prefix(skills, "skill_id", skill).select("skill_id", body.alias("detail"))


def list_rules(rules: DataFrame, project: str | None = None) -> DataFrame:
    return project_filter(rules, project).orderBy("project_path", "created_at", "rule_seq")


def mark_one_off(skills: DataFrame, chosen: DataFrame) -> DataFrame:
    """Clear ``recurring`` on the skills whose id is in ``chosen`` (skill_id)."""
    ids = chosen.select("skill_id", F.lit(True).alias("_chosen")).distinct()
    once = F.when(F.col("_chosen"), F.lit(False)).otherwise(F.col("recurring"))
    return skills.join(ids, "skill_id", "left").withColumn("recurring", once).drop("_chosen")
