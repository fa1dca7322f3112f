"""Session-log files: ``<root>/<workspace>/chatSessions/*.json`` next to ``workspace.json``."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import variants as V

_FOLDER = "chatSessions"
LOG_FILES = f"*/{_FOLDER}/*.json"
_RAW = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("body", T.StringType())])


def _located(df: DataFrame) -> DataFrame:
    # file paths come percent-encoded; a plus sign is itself
    path = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    return df.select(path.alias("file_path"), F.col("value").alias("body"))


def _read(spark: SparkSession, glob: str, modified_after: str | None = None) -> DataFrame:
    reader = spark.read.option("wholetext", True)
    if modified_after is not None:
        reader = reader.option("modifiedAfter", modified_after)
    try:
        return _located(reader.text(glob))
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], _RAW)
        raise


def _workspace_of(levels_up: int) -> Column:
    return F.element_at(F.split("file_path", "/"), -levels_up)


def resolve_projects(workspaces: DataFrame) -> DataFrame:
    """(workspace_id, project_path) from workspace files; NULL where no folder is named.

    A leading ``file://`` goes, the rest of the address is kept as it is written.
    """
    folder = F.expr(V.string_at("try_parse_json(body)", "$.folder"))
    path = F.nullif(F.regexp_replace(folder, "^file://", ""), F.lit(""))
    return workspaces.select("workspace_id", path.alias("project_path"))


def _with_project(raw: DataFrame, spark: SparkSession, root: str) -> DataFrame:
    files = _read(spark, f"{root}/*/workspace.json").withColumn("workspace_id", _workspace_of(2))
    logs = raw.withColumn("workspace_id", _workspace_of(3))
    return logs.join(resolve_projects(files), "workspace_id", "left")


def read_session_logs(spark: SparkSession, root: str, modified_after: str | None = None) -> DataFrame:
    """One row per log file: workspace_id, file_path, body, project_path.

    With ``modified_after`` (``yyyy-MM-ddTHH:mm:ss``) only files changed since then.
    """
    return _with_project(_read(spark, f"{root}/{LOG_FILES}", modified_after), spark, root)


def read_files(spark: SparkSession, root: str, names: list[str], folders: list[str] = (), pattern: str = "*") -> DataFrame:
    """The rows of ``read_session_logs`` of the named files only, and of the ``pattern`` files of ``folders``."""
    reader = spark.read.option("wholetext", True)
    parts = [_located(reader.text(names))] if names else []
    if folders:
        parts.append(_located(reader.option("pathGlobFilter", pattern).text(folders)))
    raw = parts[0] if parts else spark.createDataFrame([], _RAW)
    for part in parts[1:]:
        raw = raw.unionByName(part)
    return _with_project(raw, spark, root)


def stream_session_logs(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    """The same rows as a stream of newly arriving files."""
    reader = spark.readStream.option("wholetext", True).option("pathGlobFilter", "*.json")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _with_project(_located(reader.text(f"{root}/*/{_FOLDER}")), spark, root)
