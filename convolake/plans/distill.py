"""Distil skills from fresh conversations with a user-supplied model function."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import batches as B
from ..operators.filters import project_filter
from ..operators.merge import apply_items, resolve_items
from ..operators.model import answer_status, ask_in_turn, ask_model, normalize_skills, parse_items
from ..operators.progress import advance_watermark, incremental_messages
from ..schemas import SKILLS, conform
from ..session import write_down
from ..sources.tables import State

ModelFn = Callable[[list[str]], list[str]]


@dataclass
class Batches:
    rows: DataFrame
    marks: DataFrame


@dataclass
class DistillResult:
    skills: DataFrame
    progress: DataFrame
    answers: DataFrame
    stats: DataFrame


def plan_batches(state: State, project: str | None = None, full: bool = False,
                 project_equals: str | None = None, size: int = B.BATCH_SESSIONS,
                 max_messages: int = B.SESSION_MESSAGES, carry_over: bool = True,
                 caps: B.PromptCaps = B.CAPS) -> Batches:
    """Batches of fresh sessions, and the marks to set when they succeed.

    A session's messages beyond ``max_messages`` come in the next pass (``run_pipeline``
    repeats passes until none is left); without ``carry_over`` they are marked as done with the others and never sent.
    """
    fresh = incremental_messages(
        state.messages, state.sessions, state.progress, project, full, project_equals)
    assigned = B.assign_batches(B.session_marks(fresh), size)
    texts = B.session_texts(fresh, max_messages, carry_over, caps)
    rows = B.batch_rows(assigned, texts, "n_sent" if carry_over else "n_messages")
    return Batches(rows, B.batch_marks(assigned, texts if carry_over else None))


def distill(state: State, model_fn: ModelFn, template: str, project: str | None = None,
            full: bool = False, mode: str = "snapshot", project_equals: str | None = None,
            parallelism: int | None = None, carry_over: bool = True,
            max_prompt_chars: int | None = None, as_of: Column | None = None,
            caps: B.PromptCaps = B.CAPS) -> DistillResult:
    """Run the model over all fresh batches once and merge what it returns.

    One pass sends at most ``SESSION_MESSAGES`` messages of a session; call it again with
    the new marks for the rest, as ``run_pipeline`` does.

    ``snapshot`` shows every prompt the skills as they were at the start: one pass
    over all batches of all projects.  ``sequential`` lets batch k+1 of a project
    see what batch k changed: the batches of a project are asked one after another by
    one task, projects side by side, and their answers merged all at once.
    """
    planned = plan_batches(state, project, full, project_equals, carry_over=carry_over, caps=caps)
    rows = write_down(planned.rows)
    skills = conform(state.skills, SKILLS)

    if mode == "snapshot":
        sections = B.prompt_sections(skills, state.rules)
        answers = write_down(ask_model(rows, sections, template, model_fn, parallelism, max_prompt_chars))
        merged, resolved = _merge(skills, answers, rows, as_of)
    elif mode == "sequential":
        answers, merged, resolved = _in_turn(
            rows, skills, ask_in_turn(rows, skills, state.rules, template, model_fn, parallelism, max_prompt_chars, as_of))
    else:
        raise ValueError(f"mode must be snapshot or sequential, not {mode!r}")

    status = answer_status(answers)
    done = planned.marks.join(
        status.where(~F.col("failed")).select("project_path", "batch_no"),
        ["project_path", "batch_no"], "left_semi")
    progress = advance_watermark(state.progress, done, as_of)
    stats = _stats(state, rows, status, resolved, project, project_equals)
    return DistillResult(merged, progress, answers, stats)


def _merge(skills: DataFrame, answers: DataFrame, rows: DataFrame,
           as_of: Column | None) -> tuple[DataFrame, DataFrame]:
    items = write_down(normalize_skills(parse_items(answers)))
    resolved = resolve_items(skills, items)
    sources = rows.select("project_path", "batch_no", "session_ids")
    return apply_items(skills, items, resolved, sources, as_of), resolved


def _in_turn(rows: DataFrame, skills: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answers, skills and resolved items of batches that were asked in turn.

    Items are merged in the order of batches, which gives what merging batch by batch gives; a new
    skill has the time of its batch.  Results are tables of the size of their files.
    """
    told = write_down(asked)
    answers = told.select("project_path", "batch_no", "raw", "error")
    items = write_down(normalize_skills(parse_items(answers)))
    made = told.select("project_path", "batch_no", F.explode(F.arrays_zip("made_no", "made_id", "made_title")).alias("m")).select(
        "project_path", "batch_no", F.col("m.made_no").alias("item_no"), F.col("m.made_id").alias("skill_id"),
        F.col("m.made_title").alias("title"))
    resolved = write_down(resolve_items(skills, items, made))
    sources = rows.select("project_path", "batch_no", "session_ids").join(
        told.select("project_path", "batch_no", "made_at"), ["project_path", "batch_no"])
    return answers, write_down(apply_items(skills, items, resolved, sources, F.col("made_at"))), resolved


def _stats(state: State, rows: DataFrame, status: DataFrame, resolved: DataFrame,
           project: str | None, project_equals: str | None) -> DataFrame:
    """(stat, n): what the run did."""
    def stat(name: str, df: DataFrame, value: Column) -> DataFrame:
        return df.agg(F.coalesce(value.cast("long"), F.lit(0)).alias("n")).select(F.lit(name).alias("stat"), "n")

    owned = project_filter(
        state.sessions.where(F.col("project_path").isNotNull()), project, project_equals)
    usable = state.messages.where(F.col("user_text").isNotNull()).groupBy("session_id").agg(
        F.count("*").alias("n")).join(owned.select("session_id"), "session_id", "left_semi")
    processed = rows.agg(F.coalesce(F.sum("n_messages"), F.lit(0)).alias("n")).scalar()
    parts = [
        stat("projects", owned, F.count_distinct("project_path")),
        stat("batches", rows, F.count("*")),
        stat("skills_created", resolved, F.sum((F.col("how") == "new").cast("int"))),
        stat("skills_updated", resolved, F.sum((F.col("how") != "new").cast("int"))),
        stat("batches_failed", status, F.sum(F.col("failed").cast("int"))),
        stat("messages_processed", rows, F.sum("n_messages")),
        usable.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).select(
            F.lit("messages_skipped").alias("stat"), (F.col("t") - processed).alias("n")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
