"""Fixed table schemas, and the back-fill of columns an older table lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _B, _TS = T.StringType(), T.LongType(), T.BooleanType(), T.TimestampType()


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


STRINGS = T.ArrayType(_S)
TEMPLATE = _schema(("name", _S), ("template", _S), ("description", _S))

SESSIONS = _schema(
    ("session_id", _S), ("workspace_id", _S), ("project_path", _S),
    ("created_at", _L), ("last_message_at", _L), ("ingested_at", _TS),
)
MESSAGES = _schema(
    ("session_id", _S), ("msg_seq", _L), ("user_text", _S), ("response_summary", _S),
    ("ts", _L), ("has_code", _B), ("has_paths", _B),
)
PROGRESS = _schema(
    ("session_id", _S), ("project_path", _S), ("last_message_id", _L), ("distilled_at", _TS),
)
PATHS = _schema(
    ("path_id", _L), ("path", _S), ("alias", _S), ("project_path", _S),
    ("use_count", _L), ("last_used", _TS),
)
SKILLS = _schema(
    ("skill_id", _S), ("title", _S), ("description", _S), ("steps", _S), ("tags", _S),
    ("project_path", _S), ("source_session_ids", STRINGS), ("created_at", _TS),
    ("obs_type", _S), ("facts", STRINGS), ("concepts", STRINGS), ("files_read", STRINGS),
    ("files_modified", STRINGS), ("narrative", _S), ("recurring", _B),
    ("file_map", T.MapType(_S, STRINGS)), ("command_templates", T.ArrayType(TEMPLATE)),
)
RULES = _schema(
    ("project_path", _S), ("rule_text", _S), ("source", _S), ("created_at", _TS), ("rule_seq", _L),
)

# what a model answer may set on a skill; the rest of a skill row belongs to the table
SKILL_CONTENT = [
    "description", "steps", "tags", "obs_type", "facts", "concepts", "files_read",
    "files_modified", "narrative", "recurring", "file_map", "command_templates",
]

_DEFAULTS = {
    "use_count": "1", "obs_type": "'workflow'", "recurring": "true", "source": "'review'",
    "facts": "array()", "concepts": "array()", "files_read": "array()",
    "files_modified": "array()", "command_templates": "array()", "file_map": "map()",
    "source_session_ids": "array()", "narrative": "''",
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the columns of ``schema``; absent columns and gaps get their default."""
    have, columns = set(df.columns), []
    for field in schema.fields:
        source = F.col(field.name) if field.name in have else F.lit(None)
        source = source.cast(field.dataType)
        if field.name in _DEFAULTS:
            source = F.coalesce(source, F.expr(_DEFAULTS[field.name]).cast(field.dataType))
        columns.append(source.alias(field.name))
    return df.select(*columns)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
