"""Ingest, distil and render in one run over stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.responses import CAPS as RESPONSE_CAPS
from ..functions.responses import ResponseCaps
from ..operators.batches import CAPS as PROMPT_CAPS
from ..operators.batches import PromptCaps
from ..operators.paths import path_counts, path_references, recount_paths, upsert_paths
from ..operators.progress import incremental_messages, stale_projects
from ..operators.render import render_instructions, skill_documents
from ..session import pin
from ..sources.ingest import ingest
from ..sources.tables import Run, State, load_state, write_documents, write_skill_documents
from .distill import ModelFn, distill
from .review import review


def run_pipeline(spark: SparkSession, root: str, raw: DataFrame, batch: int,
                 model_fn: ModelFn | None = None, template: str | None = None,
                 render: bool = True, documents: str | None = None, grain: str = "session",
                 mode: str = "snapshot", review_template: str | None = None,
                 on_error: Callable[[str, Exception], None] | None = None,
                 response_caps: ResponseCaps = RESPONSE_CAPS, prompt_caps: PromptCaps = PROMPT_CAPS) -> bool:
    """One run over the tables under ``root``; False when there was nothing to do: ``raw`` held
    no new message and the model had none left to distil, or succeeded with none of them.

    The run reads the tables as they were before ``batch`` and publishes what it changed as one
    snapshot (``sources.tables``), so running a batch again gives the same tables, and readers
    see all tables of one run.  Sessions and messages grow by new files; tables that a run
    leaves alone are not written.
    With ``grain="message"`` requests appended to a known session are taken and its row
    is stored anew.  With ``review_template`` the model's review adds rules.
    ``response_caps`` bound what is stored of responses, ``prompt_caps`` what prompts show of
    messages; each of their caps can be lifted with ``None``.

    Distilling repeats until all messages are sent or a pass marks none: a session of any
    length is done in one run.  Batches that fail are asked again with each pass and in
    every later run, also one that brings no new message.

    An error while messages or paths are stored ends the run, which publishes nothing and can
    be repeated; so does ``RunConflict``, when another run published first.  One in distilling
    (``distill``), reviewing (``review``) or rendering (``render``) is reported to ``on_error``
    under the step's name and the other steps go on; its messages stay unmarked for the next
    run.  Without ``on_error`` it is raised; before rendering, nothing is published then.
    """
    run = Run(spark, root, batch)
    state = run.state()
    taken = ingest(raw, state.sessions, state.messages, grain, caps=response_caps)
    added = run.append("messages", taken.new_messages)
    touched = taken.sessions.join(added.select("session_id").distinct(), "session_id", "left_semi")
    run.append("sessions", touched if grain == "message" else taken.new_sessions)
    brought = not added.isEmpty()
    state.sessions, state.messages = run.table("sessions"), run.table("messages")
    if brought:
        counts = path_counts(path_references(added), state.sessions)
        state.paths = run.replace("paths", upsert_paths(state.paths, counts))
    elif model_fn is None or stale_projects(state.messages, state.sessions, state.progress).isEmpty():
        run.publish()
        return False
    changed: set[str] = set()

    def attempt(step: str, work: Callable[[], None]) -> None:
        try:
            work()
        except Exception as error:
            if on_error is None:
                raise
            on_error(step, error)

    def distil() -> None:
        if template is None:
            raise ValueError("a model function needs a prompt template")
        left = _left(state)
        while left:
            result = distill(state, model_fn, template, mode=mode, caps=prompt_caps)
            state.skills, state.progress = pin(result.skills), pin(result.progress)
            before, left = left, _left(state)
            if left == before:
                break
            changed.update(("skills", "progress"))

    def learn() -> None:
        state.rules = pin(review(state, model_fn, review_template).rules)
        changed.add("rules")

    def show() -> None:
        target = documents or f"{root}/documents"
        stamp = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm 'UTC'")).first()[0]
        write_documents(render_instructions(state.skills, stamp), f"{target}/instructions")
        write_skill_documents(skill_documents(state.skills), f"{target}/skills")

    if model_fn is not None:
        attempt("distill", distil)
        if not brought and not changed:
            run.publish()
            return False
        if review_template is not None:
            attempt("review", learn)
    for name in sorted(changed):
        run.replace(name, getattr(state, name))
    run.publish()
    if render:
        attempt("render", show)
    return True


def _left(state: State) -> int:
    """How many messages the model has not had yet."""
    return incremental_messages(state.messages, state.sessions, state.progress).count()


def reload_pipeline(spark: SparkSession, root: str, raw: DataFrame, new_root: str,
                    response_caps: ResponseCaps = RESPONSE_CAPS) -> None:
    """Ingest everything again: tables under ``new_root`` as batch 0, published as one snapshot.

    Skills, rules and aliases are taken over from ``root``, paths are counted anew,
    and no message counts as distilled.
    """
    state = load_state(spark, root)
    taken = ingest(raw, state.sessions, state.messages, force=True, caps=response_caps)
    run = Run(spark, new_root, 0)
    run.append("messages", taken.new_messages)
    run.append("sessions", taken.new_sessions)
    state.sessions, state.messages = run.table("sessions"), run.table("messages")
    counts = path_counts(path_references(state.messages), state.sessions)
    run.replace("paths", recount_paths(state.paths, counts))
    run.replace("skills", state.skills)
    run.replace("rules", state.rules)
    run.publish()
