"""The stored tables as Parquet, published together by numbered manifests.

A run writes folders that nobody reads yet, then one manifest: a small JSON file that names the
folders of every table.  It appears under its number at once, and only where no other run has
taken that number.  So readers see all tables as one run left them; a run that dies in between
leaves folders that no manifest names.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import project_slug
from ..schemas import MESSAGES, PATHS, PROGRESS, RULES, SESSIONS, SKILLS, conform, empty

APPENDED = {"sessions": SESSIONS, "messages": MESSAGES}
REPLACED = {"paths": PATHS, "skills": SKILLS, "rules": RULES, "progress": PROGRESS}
SCHEMAS = {**APPENDED, **REPLACED}
MANIFESTS = "manifests"


@dataclass
class State:
    sessions: DataFrame
    messages: DataFrame
    paths: DataFrame
    skills: DataFrame
    rules: DataFrame
    progress: DataFrame


def empty_state(spark: SparkSession) -> State:
    return State(**{n: empty(spark, s) for n, s in {**APPENDED, **REPLACED}.items()})


@dataclass(frozen=True)
class Snapshot:
    """Which folders make up each table: all of those an appended table has, one of a replaced one."""
    version: int = 0
    batch: int = -1
    folders: dict[str, list[str]] = field(default_factory=dict)


class RunConflict(RuntimeError):
    """Another run published in the meantime; this one has to be repeated."""


def write_table(df: DataFrame, root: str, name: str, batch: int) -> None:
    """Write one batch of a table that no manifest names; writing the same batch again replaces it."""
    df.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")


class _Files:
    """The file system under ``root``, from the driver."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.hadoop = spark, root, spark._jvm.org.apache.hadoop.fs
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        path = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(path)] if self.fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Make a whole file appear at once; False where there is one already."""
        made, target = (self.fs.makeQualified(self.path(n)) for n in (f"{name}.{uuid.uuid4().hex}.tmp", name))
        out = self.fs.create(made, True)
        out.write(bytearray(text.encode()))
        out.close()
        rename = getattr(self.hadoop, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            self.hadoop.FileContext.getFileContext(target.toUri(), self.conf).rename(made, target, options)
        except Py4JJavaError as error:
            self.fs.delete(made, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def versions(self) -> list[int]:
        return sorted((int(n[:-5]) for n in self.names(MANIFESTS) if re.fullmatch(r"\d+\.json", n)), reverse=True)

    def manifest(self, version: int) -> Snapshot:
        return Snapshot(version, **json.loads(self.read(_manifest(version))))


def _manifest(version: int) -> str:
    return f"{MANIFESTS}/{version:012d}.json"


def read_snapshot(spark: SparkSession, root: str, before: int | None = None) -> Snapshot:
    """The newest published snapshot (of a batch below ``before``).

    Tables written before there were manifests are taken as their ``batch=<number>`` folders say.
    """
    files = _Files(spark, root)
    for version in files.versions():
        snapshot = files.manifest(version)
        if before is None or snapshot.batch < before:
            return snapshot
    found: dict[str, list[int]] = {}
    for name in SCHEMAS:
        numbers = sorted(int(n[6:]) for n in files.names(name) if re.fullmatch(r"batch=\d+", n))
        found[name] = [n for n in numbers if before is None or n < before]
    kept = {name: numbers if name in APPENDED else numbers[-1:] for name, numbers in found.items()}
    newest = max((n for numbers in kept.values() for n in numbers), default=-1)
    return Snapshot(0, newest, {name: [f"batch={n}" for n in numbers] for name, numbers in kept.items()})


def read_stored(spark: SparkSession, root: str, name: str, folders: list[str]) -> DataFrame:
    """A table from its folders, read with its schema: no footer is opened to learn it, and
    columns an older file lacks come back empty.  Of a session its newest row counts."""
    schema = SCHEMAS[name]
    if not folders:
        return empty(spark, schema)
    with_batch = T.StructType([*schema.fields, T.StructField("batch", T.StringType())])
    stored = spark.read.schema(with_batch).option("basePath", f"{root}/{name}").parquet(
        *[f"{root}/{name}/{folder}" for folder in folders])
    if name != "sessions" or len(folders) == 1:
        return conform(stored, schema)
    number = F.split_part("batch", F.lit("-"), F.lit(1)).cast("long")
    rows = conform(stored, schema).columns
    newest = stored.groupBy("session_id").agg(F.max_by(F.struct(*rows), number).alias("s"))
    return conform(newest.select("s.*"), schema)


def load_state(spark: SparkSession, root: str, before: int | None = None) -> State:
    """All tables as one run left them: the newest, or the newest below batch ``before``."""
    folders = read_snapshot(spark, root, before).folders
    return State(**{name: read_stored(spark, root, name, folders.get(name, [])) for name in SCHEMAS})


class Run:
    """The tables as batch ``batch`` finds them, and what it changes; others see it after ``publish``.

    A batch that is run again starts from what was there before it and replaces its own earlier
    result.  One below the newest stored batch is refused: it would undo later runs.
    """

    def __init__(self, spark: SparkSession, root: str, batch: int):
        newest = read_snapshot(spark, root)
        if newest.batch > batch:
            raise ValueError(f"batch {batch} is older than batch {newest.batch}, which {root} holds already")
        self.spark, self.root, self.batch, self.changed = spark, root, batch, False
        base = read_snapshot(spark, root, before=batch)
        self.version = newest.version + 1
        self.folders = {name: list(base.folders.get(name, [])) for name in SCHEMAS}
        self._own = f"batch={batch}-{uuid.uuid4().hex}"

    def table(self, name: str) -> DataFrame:
        return read_stored(self.spark, self.root, name, self.folders[name])

    def state(self) -> State:
        return State(**{name: self.table(name) for name in SCHEMAS})

    def _write(self, name: str, df: DataFrame) -> DataFrame:
        folder = f"{self.root}/{name}/{self._own}"
        df.write.parquet(folder)
        return self.spark.read.schema(SCHEMAS[name]).parquet(folder)

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """Add rows to a table; returns them as written."""
        written = self._write(name, df)
        if not written.isEmpty():
            self.folders[name].append(self._own)
            self.changed = True
        return written

    def replace(self, name: str, df: DataFrame) -> DataFrame:
        """Give a table new rows in place of all it had; tables left alone keep their folder."""
        written = self._write(name, df)
        self.folders[name] = [self._own]
        self.changed = True
        return written

    def publish(self) -> None:
        """Make all changes visible at once; without any there is nothing to publish."""
        if not self.changed:
            return
        manifest = json.dumps({"batch": self.batch, "folders": self.folders})
        if not _Files(self.spark, self.root).create(_manifest(self.version), manifest):
            raise RunConflict(f"version {self.version} of {self.root} was published by another run")


def forget_snapshots(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Remove all but the ``keep`` newest snapshots and the folders that only those named.

    Also what runs that died left behind goes, so call it while no run is writing.  Returns the
    number of removed folders.
    """
    if keep < 1:
        raise ValueError("the newest snapshot has to stay")
    files = _Files(spark, root)
    versions = files.versions()
    if not versions:
        return 0
    kept = [files.manifest(version).folders for version in versions[:keep]]
    for version in versions[keep:]:
        files.delete(_manifest(version))
    gone = [f"{name}/{folder}" for name in SCHEMAS for folder in files.names(name)
            if folder.startswith("batch=") and not any(folder in folders.get(name, []) for folders in kept)]
    for folder in gone:
        files.delete(folder)
    return len(gone)


def write_documents(documents: DataFrame, folder: str) -> None:
    """Document parts as text: one folder per project, one file per part in order."""
    digest = F.substring(F.sha2("project_path", 256), 1, 8)
    (
        documents.select(
            F.concat_ws("-", project_slug(F.col("project_path")), digest).alias("project"),
            F.format_string("%08d", "part_no").alias("part"), _without_last_newline().alias("content"))
        .write.mode("overwrite").partitionBy("project", "part").text(folder)
    )


def write_skill_documents(documents: DataFrame, folder: str) -> None:
    """Skill documents as text: a folder per project and document, named apart by skill id."""
    name = F.concat_ws("-", F.regexp_replace("filename", r"\.md$", ""), "skill_id")
    (
        documents.select("project_slug", F.concat(name, F.lit(".md")).alias("filename"), _without_last_newline().alias("content"))
        .write.mode("overwrite").partitionBy("project_slug", "filename").text(folder)
    )


def _without_last_newline() -> Column:
    """The text writer ends every row with a newline of its own."""
    return F.regexp_replace("content", r"\n\z", "")
