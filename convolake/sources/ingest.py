"""From raw session logs to session, message and path tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import responses as R
from ..functions import variants as V
from ..functions.text import FENCE, has_code, has_paths, is_blank, preview
from ..operators.paths import path_counts, path_references, upsert_paths
from ..schemas import MESSAGES, SESSIONS, conform


@dataclass
class IngestResult:
    new_sessions: DataFrame
    new_messages: DataFrame
    sessions: DataFrame
    messages: DataFrame
    path_counts: DataFrame
    stats: DataFrame

    def upsert_paths(self, paths: DataFrame, as_of: Column | None = None) -> DataFrame:
        return upsert_paths(paths, self.path_counts, as_of)


def _parsed(raw: DataFrame) -> DataFrame:
    """Readable files with at least one request, one per session.

    A session id that is no text, or an empty one, gives way to the file's name.  When files
    repeat a session id the smallest file path stays; only ids and names are compared.
    """
    stem = F.regexp_extract("file_path", r"([^/]*?)(?:\.json)?$", 1)
    parsed = raw.withColumn("log", F.try_parse_json("body")).select(
        "file_path", "workspace_id", "project_path", "log",
        F.expr(V.items_of("log", "$.requests")).alias("requests"),
        F.coalesce(F.nullif(F.expr(V.string_at("log", "$.sessionId")), F.lit("")), stem).alias("session_id"),
    ).where(F.size("requests") > 0)
    names = parsed.select("session_id", "file_path")
    repeated = (
        names.groupBy("session_id").agg(F.min("file_path").alias("kept"), F.count("*").alias("n"))
        .where(F.col("n") > 1)
    )
    losers = names.join(repeated, "session_id").where(F.col("file_path") != F.col("kept"))
    return parsed.join(losers.select("file_path"), "file_path", "left_anti")


def normalize_sessions(raw: DataFrame, as_of: Column | None = None,
                       known: DataFrame | None = None, caps: R.ResponseCaps = R.CAPS) -> tuple[DataFrame, DataFrame]:
    """(sessions, messages) of raw logs; ``msg_seq`` is the position of the request.

    Sessions in ``known (session_id)`` are left out before their requests are flattened.
    ``caps`` bound the stored responses; ``responses.WHOLE`` stores them whole.
    """
    as_of = F.current_timestamp() if as_of is None else as_of
    parsed = _parsed(raw)
    if known is not None:
        parsed = parsed.join(known, "session_id", "left_anti")
    sessions = parsed.select(
        "session_id", "workspace_id", "project_path",
        F.try_variant_get("log", "$.creationDate", "long").alias("created_at"),
        F.try_variant_get("log", "$.lastMessageDate", "long").alias("last_message_at"),
        as_of.alias("ingested_at"),
    )
    requests = parsed.select("session_id", F.posexplode("requests").alias("msg_seq", "request"))
    texts = requests.select(
        "session_id", F.col("msg_seq").cast("long").alias("msg_seq"),
        R.user_text("request").alias("user_text"),
        R.response_text("request", caps).alias("response"),
        F.try_variant_get("request", "$.timestamp", "long").alias("ts"),
    ).where(~is_blank(F.col("user_text")))
    messages = texts.select(
        "session_id", "msg_seq", "user_text",
        preview(F.col("response"), caps.response).alias("response_summary"), "ts",
        has_code(F.col("user_text"), F.col("response")).alias("has_code"),
        has_paths(F.col("user_text")).alias("has_paths"),
    )
    return conform(sessions, SESSIONS), conform(messages, MESSAGES)


def message_flags(messages: DataFrame) -> DataFrame:
    """Fence and path flags recomputed from stored messages."""
    return messages.select(
        "session_id", "msg_seq",
        has_code(F.col("user_text"), F.col("response_summary")).alias("has_code"),
        has_paths(F.col("user_text")).alias("has_paths"),
        F.coalesce(F.regexp_count("user_text", F.lit(FENCE)), F.lit(0)).alias("fences"),
    )


def ingest(raw: DataFrame, sessions: DataFrame, messages: DataFrame, grain: str = "session",
           force: bool = False, as_of: Column | None = None, caps: R.ResponseCaps = R.CAPS) -> IngestResult:
    """New sessions and messages of ``raw`` against the stored tables.

    ``grain="session"`` skips known sessions wholly; ``grain="message"`` also takes
    requests appended to them.  ``force`` ignores what is stored: the result then
    replaces the tables, and paths are to be counted from nothing.  ``caps`` bound the stored
    responses.
    """
    if force:
        sessions, messages = sessions.limit(0), messages.limit(0)
    known = sessions.select("session_id")
    seen_sessions, seen_messages = normalize_sessions(raw, as_of, known if grain == "session" else None, caps)
    new_sessions = seen_sessions if grain == "session" else seen_sessions.join(known, "session_id", "left_anti")
    if grain == "session":
        new_messages = seen_messages
        stored = sessions
    elif grain == "message":
        new_messages = seen_messages.join(
            messages.select("session_id", "msg_seq"), ["session_id", "msg_seq"], "left_anti")
        later = seen_sessions.select("session_id", F.col("last_message_at").alias("_later"))
        stored = (
            sessions.join(later, "session_id", "left")
            .withColumn("last_message_at", F.greatest("last_message_at", "_later")).drop("_later")
        )
    else:
        raise ValueError(f"grain must be session or message, not {grain!r}")
    new_sessions, new_messages = conform(new_sessions, SESSIONS), conform(new_messages, MESSAGES)
    all_sessions = conform(stored, SESSIONS).unionByName(new_sessions)
    refs = path_references(new_messages)
    stats = (
        new_sessions.agg(F.count("*").alias("n")).select(F.lit("sessions_added").alias("stat"), "n")
        .unionByName(new_messages.agg(F.count("*").alias("n")).select(F.lit("messages_added").alias("stat"), "n"))
        .unionByName(refs.agg(F.count("*").alias("n")).select(F.lit("paths_found").alias("stat"), "n"))
    )
    return IngestResult(
        new_sessions, new_messages, all_sessions,
        conform(messages, MESSAGES).unionByName(new_messages),
        path_counts(refs, all_sessions), stats,
    )
