"""File paths mentioned in prompts: extraction, counts, aliases, lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_fold, extract_paths
from ..session import pin
from .filters import like_filter
from .ranking import global_index


GRAM = 4  # characters by which an open key meets paths


def path_references(messages: DataFrame) -> DataFrame:
    """One row per path occurrence; a path repeated in a message counts each time."""
    found = messages.select("session_id", "msg_seq", "ts", extract_paths(F.col("user_text")).alias("p"))
    return found.where(F.size("p") > 0).select(
        "session_id", "msg_seq", "ts", F.posexplode("p").alias("pos", "path")
    )


def path_counts(refs: DataFrame, sessions: DataFrame) -> DataFrame:
    """Occurrences per path and the project that mentioned it first.

    Occurrences collapse to one row per (session, path) before the session's
    project is looked up, so a chatty session costs no more than a quiet one.
    """
    seen_at = F.struct("ts", "session_id", "msg_seq", "pos")
    per_session = refs.groupBy("session_id", "path").agg(
        F.count("*").alias("n"), F.min(seen_at).alias("seen")
    )
    return (
        per_session.join(sessions.select("session_id", "project_path"), "session_id", "left")
        .groupBy("path")
        .agg(F.sum("n").alias("use_count"), F.min_by("project_path", "seen").alias("project_path"))
    )


def path_frequency(counts: DataFrame, project: str | None = None, limit: int = 20) -> DataFrame:
    """Most used paths first; works on stored paths and on fresh counts."""
    kept = like_filter(counts, "project_path", project)
    return kept.orderBy(F.desc("use_count"), "path").limit(limit)


def upsert_paths(paths: DataFrame, counts: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Add counts to known paths, and new paths with fresh ids after the largest one.

    A known path keeps the project that mentioned it first, and its alias.
    """
    as_of = F.current_timestamp() if as_of is None else as_of
    fresh = counts.join(paths.select("path"), "path", "left_anti")
    highest = paths.agg(F.coalesce(F.max("path_id"), F.lit(0)).alias("top")).scalar()
    numbered = global_index(fresh, "path").select(
        (highest + F.col("idx") + 1).alias("path_id"), "path",
        F.lit(None).cast("string").alias("alias"), "project_path", "use_count",
        as_of.alias("last_used"),
    )
    added = counts.select("path", F.col("use_count").alias("_more"))
    known = paths.join(added, "path", "left").select(
        "path_id", "path", "alias", "project_path",
        (F.col("use_count") + F.coalesce("_more", F.lit(0))).alias("use_count"),
        F.when(F.col("_more").isNotNull(), as_of).otherwise(F.col("last_used")).alias("last_used"),
    )
    return known.unionByName(numbered)


def recount_paths(paths: DataFrame, counts: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Set use counts from a full count of the messages, for a reload of everything.

    Ids, aliases and first projects stay; a path no message mentions was added by
    hand and keeps its count.
    """
    fresh = counts.select("path", F.col("use_count").alias("_n"))
    kept = paths.join(fresh, "path", "left").withColumn(
        "use_count", F.coalesce("_n", "use_count")).select(*paths.columns)
    return upsert_paths(kept, counts.join(paths.select("path"), "path", "left_anti"), as_of)


def add_paths(paths: DataFrame, new: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Add paths by hand: (path, alias, project_path); a given alias replaces the old one.

    Of several rows for one path the last alias in (alias) order counts.
    """
    given = new.groupBy("path").agg(F.max("alias").alias("_alias"),
                                    F.max("project_path").alias("project_path"),
                                    F.count("*").alias("use_count"))
    merged = upsert_paths(paths, given.drop("_alias"), as_of)
    aliases = given.select("path", "_alias").where(F.col("_alias").isNotNull())
    return (
        merged.join(aliases, "path", "left")
        .withColumn("alias", F.coalesce("_alias", "alias")).drop("_alias")
        .select(*paths.columns)
    )


def set_alias(paths: DataFrame, changes: dict[str, str]) -> DataFrame:
    """Set aliases by path id (all digits) or by path; unknown keys change nothing."""
    alias = F.col("alias")
    for key, value in changes.items():
        hit = F.col("path_id") == int(key) if key.isdigit() else F.col("path") == key
        alias = F.when(hit, F.lit(value)).otherwise(alias)
    return paths.withColumn("alias", alias)


def resolve_paths(paths: DataFrame, keys: list[str] | DataFrame) -> DataFrame:
    """Path for each key (``lookup``): by id, else by alias, else the most used path containing it.

    Ids and aliases are equality joins.  A key that is still open meets only the paths
    that share the last ``GRAM`` characters of its longest piece without wildcards.
    """
    if not isinstance(keys, DataFrame):
        keys = paths.sparkSession.createDataFrame([(key,) for key in keys], "lookup string")
    keys = keys.select("lookup").where(F.col("lookup").isNotNull()).distinct()
    paths = pin(paths.select("path_id", "path", "alias", "use_count"))  # read by each of the three ways
    numbers = keys.where(F.col("lookup").rlike("^[0-9]+$")).select("lookup", F.expr("try_cast(lookup as bigint)").alias("path_id"))
    by_id = numbers.join(paths.select("path_id", "path"), "path_id").groupBy("lookup").agg(F.min("path").alias("path"))
    left = keys.join(by_id, "lookup", "left_anti")
    by_alias = left.join(paths.select(F.col("alias").alias("lookup"), "path"), "lookup").groupBy("lookup").agg(F.min("path").alias("path"))
    left = left.join(by_alias, "lookup", "left_anti").withColumn("folded", ascii_fold(F.col("lookup")))
    piece = F.reduce(
        F.split("folded", "[%_]", -1), F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
    pattern = F.concat(F.lit("%"), F.replace("folded", F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    open_keys = left.select("lookup", pattern.alias("pattern"), piece.alias("piece")).select(
        "lookup", "pattern", F.substring(F.col("piece"), -GRAM, GRAM).alias("gram"))
    sizes = [r[0] for r in open_keys.select(F.length("gram")).distinct().collect()]  # at most GRAM + 1 numbers
    folded = paths.select("path", "use_count", ascii_fold(F.col("path")).alias("folded"))

    def grams_of(n: int) -> Column:
        begins = F.sequence(F.lit(1), F.greatest(F.length("folded") - (n - 1), F.lit(1))) if n else F.array(F.lit(1))
        return F.transform(begins, lambda at: F.substr("folded", at, F.lit(n)))

    none = F.array().cast("array<string>")
    grams = F.array_distinct(F.flatten(F.array(none, *map(grams_of, sizes))))
    met = folded.withColumn("gram", F.explode(grams)).join(open_keys, "gram").where(F.expr("folded like pattern"))
    by_text = met.groupBy("lookup").agg(F.min(F.struct((-F.col("use_count")).alias("by_use"), "path"))["path"].alias("path"))
    return by_id.unionByName(by_alias).unionByName(by_text)
