"""Render skills: one document per skill, one instruction document per project.

An instruction document is built as rows of text (blocks) with a place in the
document.  Blocks are what the cluster works on; a project with any number of
skills is just more rows.  ``assemble_documents`` joins them into numbered parts of
bounded size, which read one after the other are the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bullets, project_slug, title_slug
from .ranking import first_n, group_index

SYMBOLS_PER_FILE = 8
BLOCKS_PER_PART = 1000

HEADER = (
    "<!-- Generated file, do not edit by hand.\n     Project: {project_name}\n"
    "     Last updated: {timestamp} -->\n\n# Project Skills & Patterns\n\n"
    "> Reusable patterns distilled from past assistant conversations.\n\n"
)

# Section number, heading and closing text in document order.
_SECTIONS = {
    "constants": (1, "## Quick Reference\n\n", "\n---\n\n"),
    "key_files": (2, "## Key Files\n\n", "\n---\n\n"),
    "file_map": (3, "## File Map\n\n| File | Key Symbols |\n|------|-------------|\n", "\n---\n\n"),
    "commands": (4, "## Command Templates\n\n", "---\n\n"),
    "registry": (5, "## Experiment Registry\n\n", "\n---\n\n"),
    "recurring": (6, "## Recurring Workflows\n\n", "\n"),
    "one_off": (7, "## Reference (One-Time Tasks)\n\n"
                   "> These tasks are completed. Included for context only.\n\n", "\n"),
}


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def skill_class() -> Column:
    title = F.lower(_text("title"))
    has_map = F.coalesce(F.size("file_map"), F.lit(0)) > 0
    return (
        F.when(title.contains("constant") | title.contains("quick reference"), F.lit("constants"))
        .when(title.contains("file map") | ((F.col("obs_type") == "discovery") & has_map), F.lit("file_map"))
        .when(title.contains("experiment") & title.contains("registry"), F.lit("registry"))
        .when(F.coalesce("recurring", F.lit(True)), F.lit("recurring"))
        .otherwise(F.lit("one_off"))
    )


def classify_skills(skills: DataFrame) -> DataFrame:
    return skills.withColumn("category", skill_class())


def merge_file_map(skills: DataFrame, symbols: int = SYMBOLS_PER_FILE) -> DataFrame:
    """Per project and file: the first ``symbols`` distinct symbols in skill order, and how many there are."""
    files = skills.where(F.col("project_path").isNotNull()).select(
        "project_path", "created_at", "skill_id", F.explode("file_map").alias("file", "listed"))
    named = files.select(
        "project_path", "created_at", "skill_id", "file", F.posexplode_outer("listed").alias("pos", "symbol"))
    distinct = named.groupBy("project_path", "file", "symbol").agg(
        F.min(F.struct("created_at", "skill_id", "pos")).alias("seen"))
    counts = distinct.groupBy("project_path", "file").agg(F.count("symbol").alias("n_symbols"))
    first = first_n(
        distinct.where(F.col("symbol").isNotNull()), ["project_path", "file"], symbols, "seen", "symbol")
    shown = first.groupBy("project_path", "file").agg(
        F.sort_array(F.collect_list(F.struct("rank", "symbol"))).alias("s"))
    return counts.join(shown, ["project_path", "file"], "left").select(
        "project_path", "file", "n_symbols",
        F.coalesce(F.col("s.symbol"), F.array().cast("array<string>")).alias("symbols"))


def key_files(skills: DataFrame) -> DataFrame:
    """Files read or changed with the title of the first skill naming them, for
    projects where no skill has a file map."""
    owned = skills.where(F.col("project_path").isNotNull())
    mapped = owned.where(F.size("file_map") > 0).select("project_path").distinct()
    named = owned.select(
        "project_path", "created_at", "skill_id", "title",
        F.posexplode(F.concat("files_read", "files_modified")).alias("pos", "file"),
    ).join(mapped, "project_path", "left_anti")
    return named.groupBy("project_path", "file").agg(
        F.min_by("title", F.struct("created_at", "skill_id", "pos")).alias("title"))


def command_templates(skills: DataFrame) -> DataFrame:
    """All usable templates in skill order: (project_path, created_at, skill_id, pos, name, template, description)."""
    listed = skills.where(F.col("project_path").isNotNull()).select(
        "project_path", "created_at", "skill_id", F.posexplode("command_templates").alias("pos", "t"))
    return listed.where(F.coalesce("t.template", F.lit("")) != "").select(
        "project_path", "created_at", "skill_id", "pos",
        F.coalesce("t.name", F.lit("command")).alias("name"), F.col("t.template").alias("template"),
        F.coalesce("t.description", F.lit("")).alias("description"))


def _fact_lines() -> Column:
    return F.array_join(F.transform("facts", lambda f: F.concat(F.lit("- "), f, F.lit("\n"))), "")


def _has(name: str) -> Column:
    return F.coalesce(F.size(name), F.lit(0)) > 0


def _constants_block() -> Column:
    described = F.when(_text("description") != "", F.concat(F.lit("\n"), "description", F.lit("\n")))
    return F.when(_has("facts"), _fact_lines()).otherwise(F.coalesce(described, F.lit("")))


def _registry_block() -> Column:
    described = F.when(_text("description") != "", F.concat("description", F.lit("\n"))).otherwise("")
    steps = F.when(_text("steps") != "", F.concat(F.lit("\n"), "steps", F.lit("\n"))).otherwise("")
    return F.concat(F.when(_has("facts"), _fact_lines()).otherwise(described), steps)


def _compact_block() -> Column:
    """A recurring skill: only parts with content, tags and concepts on one line."""
    def part(test: Column, *pieces) -> Column:
        return F.when(test, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])).otherwise("")

    usable = F.filter("command_templates", lambda t: F.coalesce(t["template"], F.lit("")) != "")
    commands = F.array_join(F.transform(usable, lambda t: F.concat(
        F.lit("- "),
        F.when(F.coalesce(t["name"], F.lit("")) != "", F.concat(t["name"], F.lit(": "))).otherwise(""),
        F.lit("`"), t["template"], F.lit("`\n"))), "")
    meta = F.concat_ws(
        " | ", F.when(_text("tags") != "", F.concat(F.lit("Tags: "), "tags")),
        F.when(_has("concepts"), F.concat(F.lit("Concepts: "), F.array_join("concepts", ", "))))
    return F.concat(
        F.lit("### "), _text("title"), F.lit("\n\n"),
        part(_text("description") != "", _text("description"), "\n\n"),
        part(_has("facts"), "**Facts:**\n", _fact_lines(), "\n"),
        part(_text("steps") != "", "**Steps:**\n", _text("steps"), "\n\n"),
        part(_has("command_templates"), "**Commands:**\n", commands, "\n"),
        part(meta != "", "*", meta, "*\n\n"), F.lit("---\n\n"),
    )


def _one_off_block() -> Column:
    return F.concat(F.lit("- **"), _text("title"), F.lit("**: "), _text("description"), F.lit("\n"))


_PLACE = ["project_path", "section", "step", "created_at", "name", "pos"]


def _placed(df: DataFrame, section: str | Column, name: str, block: Column,
            created: bool = True, pos: str | None = None) -> DataFrame:
    at = F.lit(_SECTIONS[section][0]) if isinstance(section, str) else section
    return df.select(
        "project_path", at.cast("int").alias("section"), F.lit(1).alias("step"),
        (F.col("created_at") if created else F.lit(None).cast("timestamp")).alias("created_at"),
        F.col(name).alias("name"), (F.col(pos) if pos else F.lit(0)).cast("int").alias("pos"),
        block.alias("block"))


def document_blocks(skills: DataFrame, as_of: str) -> DataFrame:
    """Rows (project_path, section, step, created_at, name, pos, block); read in this
    order within a project the blocks make its document.  ``as_of`` is the header's time."""
    owned = skills.where(F.col("project_path").isNotNull())
    classed = classify_skills(owned)
    section_of = F.create_map(*[F.lit(v) for k in ("constants", "registry", "recurring", "one_off")
                                for v in (k, _SECTIONS[k][0])])
    blocks = (
        F.when(F.col("category") == "constants", _constants_block())
        .when(F.col("category") == "registry", _registry_block())
        .when(F.col("category") == "recurring", _compact_block())
        .otherwise(_one_off_block())
    )
    own = _placed(classed.where(F.col("category") != "file_map"), section_of[F.col("category")],
                  "skill_id", blocks)
    mapped = merge_file_map(owned)
    map_block = F.concat(
        F.lit("| `"), "file", F.lit("` | "),
        F.array_join(F.transform("symbols", lambda s: F.concat(F.lit("`"), s, F.lit("`"))), ", "),
        F.lit(" |\n"))
    described = F.when(_text("title") != "", F.concat(F.lit(" — "), "title")).otherwise("")
    file_block = F.concat(F.lit("- `"), "file", F.lit("`"), described, F.lit("\n"))
    about = F.when(F.col("description") != "", F.concat(F.lit(" — "), "description")).otherwise("")
    command_block = F.concat(F.lit("**"), "name", F.lit("**"), about, F.lit("\n```\n"), "template",
                             F.lit("\n```\n\n"))
    commands = command_templates(owned).withColumn("block", command_block)
    body = (
        own.unionByName(_placed(key_files(owned), "key_files", "file", file_block, created=False))
        .unionByName(_placed(mapped, "file_map", "file", map_block, created=False))
        .unionByName(_placed(commands, "commands", "skill_id", F.col("block"), pos="pos"))
    )
    return body.unionByName(_frames(body)).unionByName(_headers(owned, as_of))


def _frames(body: DataFrame) -> DataFrame:
    """Heading and closing text of each section that has content."""
    texts = {number: (heading, closing) for number, heading, closing in _SECTIONS.values()}
    def lookup(i: int) -> Column:
        return F.create_map(*[F.lit(v) for n, t in texts.items() for v in (n, t[i])])[F.col("section")]
    present = body.select("project_path", "section").distinct()
    both = F.explode(F.array(
        F.struct(F.lit(0).alias("step"), lookup(0).alias("block")),
        F.struct(F.lit(2).alias("step"), lookup(1).alias("block"))))
    return present.select("project_path", "section", both.alias("f")).select(
        "project_path", "section", F.col("f.step").alias("step"),
        F.lit(None).cast("timestamp").alias("created_at"), F.lit("").alias("name"),
        F.lit(0).alias("pos"), F.col("f.block").alias("block"))


def _headers(owned: DataFrame, as_of: str) -> DataFrame:
    name = F.substring_index(F.regexp_replace("project_path", "/+$", ""), "/", -1)
    start, rest = HEADER.split("{project_name}")
    block = F.concat(F.lit(start), name, F.lit(rest.replace("{timestamp}", as_of)))
    return owned.select("project_path").distinct().select(
        "project_path", F.lit(0).alias("section"), F.lit(0).alias("step"),
        F.lit(None).cast("timestamp").alias("created_at"), F.lit("").alias("name"),
        F.lit(0).alias("pos"), block.alias("block"))


def assemble_documents(blocks: DataFrame, per_part: int = BLOCKS_PER_PART) -> DataFrame:
    """(project_path, part_no, content): blocks joined in order, ``per_part`` to a part.

    Most documents have one part.  A longer one has several; their contents one
    after the other are the document, and no task holds more than one part.
    """
    placed = group_index(blocks, "project_path", *_PLACE[1:], name="place")
    parts = placed.groupBy("project_path", F.floor(F.col("place") / per_part).alias("part_no"))
    joined = parts.agg(F.sort_array(F.collect_list(F.struct("place", "block"))).alias("b"))
    return joined.select("project_path", "part_no", F.array_join("b.block", "").alias("content"))


def render_instructions(skills: DataFrame, as_of: str, per_part: int = BLOCKS_PER_PART) -> DataFrame:
    """Instruction documents of all projects that have skills."""
    return assemble_documents(document_blocks(skills, as_of), per_part)


def skill_documents(skills: DataFrame) -> DataFrame:
    """One document per skill: (skill_id, project_slug, filename, content)."""
    content = F.concat(
        F.lit("# "), _text("title"), F.lit("\n\n> "), _text("description"),
        F.lit("\n\n**Type:** "), F.coalesce("obs_type", F.lit("workflow")),
        F.lit("\n**Tags:** "), _text("tags"),
        F.lit("\n**Project:** "), F.coalesce(F.nullif("project_path", F.lit("")), F.lit("global")),
        F.lit("\n**Skill ID:** "), F.col("skill_id"),
        F.lit("\n\n## Steps\n\n"), F.coalesce("steps", F.lit("(no steps)")),
        F.lit("\n\n## Facts\n\n"), bullets(F.col("facts")),
        F.lit("\n\n## Concepts\n\n"), bullets(F.col("concepts")),
        F.lit("\n\n## Files\n\n"), bullets(F.col("files_read")), F.lit("\n"),
    )
    return skills.select(
        "skill_id", project_slug(F.col("project_path")).alias("project_slug"),
        title_slug(F.coalesce("title", F.lit("Untitled"))).alias("filename"), content.alias("content"))
