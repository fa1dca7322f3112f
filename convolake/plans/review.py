"""Ask the model what the skills miss, and keep its answers as rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import batches as B
from ..operators.filters import project_filter
from ..operators.model import answer_status, ask_model, parse_items, rule_items
from ..operators.progress import incremental_messages
from ..operators.rules import add_rules, dedup_rules
from ..session import pin, write_down
from ..sources.tables import State
from .distill import ModelFn


@dataclass
class ReviewResult:
    rules: DataFrame
    answers: DataFrame
    stats: DataFrame


def review_batches(state: State, project: str | None = None) -> DataFrame:
    """One row per project with skills: the conversations of its latest sessions."""
    skills = project_filter(state.skills.where(F.col("project_path").isNotNull()), project)
    reviewed = skills.select("project_path").distinct()
    fresh = incremental_messages(state.messages, state.sessions, state.progress, project, full=True)
    fresh = fresh.join(reviewed, "project_path", "left_semi")
    sample = B.review_sample(fresh)
    sampled = fresh.join(sample.select("project_path", "session_id"),
                         ["project_path", "session_id"], "left_semi")
    placed = sample.withColumn("batch_no", F.lit(0).cast("long")).join(
        B.session_marks(sampled).select("project_path", "session_id", "n_messages"),
        ["project_path", "session_id"])
    conversations = B.batch_rows(placed, B.session_texts(sampled, carry_over=False))
    return reviewed.join(conversations, "project_path", "left").select(
        "project_path", F.coalesce("batch_no", F.lit(0)).alias("batch_no"),
        F.coalesce("n_sessions", F.lit(0)).alias("n_sessions"),
        F.coalesce("n_messages", F.lit(0)).alias("n_messages"), "session_ids",
        F.coalesce("conversations", F.lit("")).alias("conversations"))


def review_prompts(state: State, template: str, project: str | None = None,
                   max_prompt_chars: int | None = None) -> DataFrame:
    """One prompt per project with skills: its latest sessions and its skills; the dry run."""
    skills = project_filter(state.skills.where(F.col("project_path").isNotNull()), project)
    return B.build_prompts(review_batches(state, project), skills, state.rules.limit(0), template, max_prompt_chars)


def review(state: State, model_fn: ModelFn, template: str, project: str | None = None,
           parallelism: int | None = None, as_of: Column | None = None) -> ReviewResult:
    sections = B.prompt_sections(project_filter(state.skills, project), state.rules.limit(0))
    answers = write_down(ask_model(write_down(review_batches(state, project)), sections, template, model_fn, parallelism))
    accepted = pin(dedup_rules(state.rules, rule_items(parse_items(answers))))
    rules = add_rules(state.rules, accepted, as_of=as_of)
    reached = answer_status(answers).join(
        answers.where(F.col("error").isNull()).select("project_path"), "project_path", "left_semi"
    ).select("project_path")
    stats = (
        answers.agg(F.count("*").alias("n")).select(F.lit("projects").alias("stat"), "n")
        .unionByName(accepted.agg(F.count("*").alias("n")).select(F.lit("rules_added").alias("stat"), "n"))
        .unionByName(rules.join(reached, "project_path", "left_semi").agg(F.count("*").alias("n"))
                     .select(F.lit("rules_total").alias("stat"), "n"))
    )
    return ReviewResult(rules, answers, stats)
