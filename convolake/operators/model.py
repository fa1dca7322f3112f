"""Run a user-supplied model function over prompts and read its answers."""

from __future__ import annotations

import hashlib
import heapq
import sys
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import plain_answers as P
from ..functions import variants as V
from ..functions.answers import answer_items, answer_objects, rule_text, skill_fields
from .batches import RULES_HEADER, ShownList, fill_parts, skill_line, skill_lines, with_share

_SCHEMA = "project_path string, batch_no long, raw string, error string"
_FIRST = -(1 << 63)  # before all times


def run_model(prompts: DataFrame, model_fn: Callable[[list[str]], list[str]],
              parallelism: int | None = None) -> DataFrame:
    """(project_path, batch_no, raw, error): one answer or one error per prompt.

    ``model_fn`` gets the prompts of one Arrow batch.  An exception in its result
    list fails that prompt only; when the call itself raises, its prompts are
    tried one by one so that one bad prompt does not fail the others.  The result
    is lazy: write it down before reading it twice.
    """
    asked = prompts.select("project_path", "batch_no", "prompt", "error")
    if parallelism:
        asked = asked.repartition(parallelism)

    def answer(batches):
        for frame in batches:
            ready = frame["prompt"].notna() & frame["error"].isna()
            texts = frame.loc[ready, "prompt"].tolist()
            got = _attempt(texts, model_fn) if texts else []
            out = frame[["project_path", "batch_no", "error"]].copy()
            out["raw"] = None
            out.loc[ready, "raw"] = [raw for raw, _ in got]
            out.loc[ready, "error"] = [error for _, error in got]
            yield out[["project_path", "batch_no", "raw", "error"]]

    return asked.mapInPandas(answer, _SCHEMA)


def takes_parts(model_fn):
    """Mark a model function that wants ``batches.Prompt``s instead of whole texts.

    For models that keep what they made of a text they have read: the lists of a project,
    which are most of its prompts, are then neither copied nor read anew for every batch.
    """
    model_fn.takes_parts = True
    return model_fn


def ask_model(batches: DataFrame, sections: DataFrame, template: str, model_fn: Callable[[list[str]], list[str]],
              parallelism: int | None = None, max_prompt_chars: int | None = None) -> DataFrame:
    """``run_model`` for prompts that are put together in the task that sends them.

    The parts of ``sections`` (``batches.prompt_sections``) travel once per ``share`` of a
    project's batches, and a task holds those of one project at a time; the batches of a
    large project are many tasks.  ``model_fn`` gets whole texts, or ``Prompt``s when it is
    marked by ``takes_parts``.  With a limit, a longer prompt is an error of its batch.
    """
    in_parts = getattr(model_fn, "takes_parts", False)
    keys = ["project_path", "share"]
    batches = with_share(batches)
    asked = batches.select(*keys, F.lit("").alias("section"), "batch_no",
                           F.col("conversations").alias("text"), F.lit(1).alias("kind"))
    told = asked.select("project_path", "share").distinct().join(sections, "project_path").select(
        "project_path", "share", "section", F.col("part_no").alias("batch_no"), "text", F.lit(0).alias("kind"))
    rows = asked.unionByName(told)
    rows = rows.repartition(parallelism, *keys) if parallelism else rows.repartition(*keys)

    def answer(frames):
        current, parts, shared = None, {}, None
        for frame in frames:
            ready: list[tuple] = []
            out: list[tuple] = []
            held = 0
            for project, share_no, section, number, text, kind in frame.itertuples(index=False):
                if (project, share_no) != current:
                    current, parts, shared = (project, share_no), {"skills": [], "rules": []}, None
                if kind == 0:
                    parts[section].append(text)
                    continue
                if shared is None:
                    lists = {section: "".join(parts.pop(section)) for section in ("skills", "rules")}
                    shared = {"existing_skills_section": (lists["skills"], lists["rules"]),
                              "skills_text": (lists["skills"],), "rules_text": (lists["rules"],)}
                prompt = fill_parts(template, {"project": project, "conversations": text}, shared)
                if max_prompt_chars is not None and len(prompt) > max_prompt_chars:
                    out.append((project, number, None, "prompt too long"))
                    continue
                ready.append((project, number, prompt if in_parts else str(prompt)))
                held += len(text) if in_parts else len(prompt)
                if len(ready) == 32 or held > 1_000_000:
                    out.extend(_answers(ready, model_fn))
                    ready, held = [], 0
            out.extend(_answers(ready, model_fn))
            yield pd.DataFrame(out, columns=["project_path", "batch_no", "raw", "error"])

    return rows.sortWithinPartitions(*keys, "kind", "section", "batch_no").select(
        *keys, "section", "batch_no", "text", "kind").mapInPandas(answer, _SCHEMA)


class _Skills:
    """The skills of one project while its batches are asked one after another.

    Items are resolved as ``merge.resolve_items`` does it for all at once.  ``shown`` is what
    prompts see: an update that went by title does not show in them.
    """

    def __init__(self, project: str):
        self.project, self.shown = project, None
        self._keys, self._lines = [], []
        self._times: dict[str, set] = {}
        self._titles: dict[str, tuple] = {}  # of each skill; rows of one id may bear several
        self._bearers: dict[str, list] = {}  # heaps of ids, with those that bore the title before

    def known(self, at: int, skill_id: str | None, title: str | None, line: str) -> None:
        """Add a skill of the table; they come in their order in prompts."""
        self._keys.append(_key(at, skill_id))
        self._lines.append(line)
        if skill_id is not None:
            self._times.setdefault(skill_id, set()).add(at)
            self._bear(skill_id, (*self._titles.get(skill_id, ()), title))

    def texts(self) -> tuple[str, ...]:
        if self.shown is None:
            self.shown, self._keys, self._lines = ShownList(self._keys, self._lines), [], []
        return self.shown.texts()

    def _bear(self, skill_id: str, titles: tuple) -> None:
        self._titles[skill_id] = titles
        if titles[-1] is not None:
            heapq.heappush(self._bearers.setdefault(titles[-1], []), skill_id)

    def _bearer(self, title: str) -> str | None:
        heap = self._bearers.get(title, [])
        while heap and title not in self._titles[heap[0]]:
            heapq.heappop(heap)
        return heap[0] if heap else None

    def merge(self, items: list, at: int) -> list[tuple]:
        """Take the items of one answer; (item_no, skill_id, title) of those that no skill fits."""
        unmatched = []
        for number, item in enumerate(items):
            fields = P.shown_fields(item) if isinstance(item, dict) else None
            if fields is None or fields["title"] == "":
                continue
            title, target = fields["title"], fields["skill_id"]
            if target not in self._titles:
                if self._bearer(title) is not None:
                    continue
                text = ":".join((self.project, title, fields["steps"]))
                target = hashlib.sha256(text.encode()).hexdigest()[:16]
                unmatched.append((number, target, title))
            line = skill_line(target, fields)
            if target in self._titles:
                for time_of in self._times[target]:
                    self.shown.replace(_key(time_of, target), line)
            else:
                self._times[target] = {at}
                self.shown.add(_key(at, target), line)
            if self._titles.get(target) != (title,):
                self._bear(target, (title,))
        return unmatched


def _key(at: int, skill_id: str | None) -> tuple:
    return at, skill_id is not None, skill_id or ""


def ask_in_turn(batches: DataFrame, skills: DataFrame, rules: DataFrame, template: str,
                model_fn: Callable[[list[str]], list[str]], parallelism: int | None = None,
                max_prompt_chars: int | None = None, as_of: Column | None = None) -> DataFrame:
    """``ask_model`` batch after batch: each prompt shows what the project's earlier batches changed.

    One task asks for a project, as its calls have to wait for each other anyway.  It holds the
    project's lists, which are in each of its prompts, and one batch at a time.

    Adds to ``run_model``'s columns ``made_at``, the time of a batch's new skills (``as_of``, else
    the clock, which moves on with every batch), and ``made_no``, ``made_id`` and ``made_title``:
    items that no skill fitted and the id each gets, for ``merge.resolve_items``.
    """
    in_parts = getattr(model_fn, "takes_parts", False)
    clocked = as_of is None
    none = F.lit(None).cast("string")

    def micros(time: Column) -> Column:
        return F.coalesce(F.unix_micros(time.cast("timestamp")), F.lit(_FIRST))

    def with_batches(lists: DataFrame) -> DataFrame:
        return lists.where(F.col("project_path").isNotNull()).join(
            batches.select("project_path").distinct(), "project_path", "left_semi")

    first = F.lit(_FIRST).cast("long")
    rows = with_batches(skill_lines(skills, "title")).select(
        "project_path", F.lit(0).alias("kind"), micros(F.col("created_at")).alias("at"), first.alias("number"),
        "skill_id", "title", F.col("line").alias("text"),
    ).unionByName(with_batches(rules).select(
        "project_path", F.lit(1).alias("kind"), micros(F.col("created_at")).alias("at"),
        F.coalesce("rule_seq", first).alias("number"), none.alias("skill_id"), none.alias("title"), F.col("rule_text").alias("text"),
    )).unionByName(batches.select(
        "project_path", F.lit(2).alias("kind"), (first if clocked else micros(as_of)).alias("at"),
        F.col("batch_no").alias("number"), none.alias("skill_id"), none.alias("title"), F.col("conversations").alias("text")))
    keys = ["project_path"]
    rows = rows.repartition(parallelism, *keys) if parallelism else rows.repartition(*keys)

    def answer(frames):
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000))  # for answers nested as deep as may be
        known, rule_no, listed, at = None, 0, [], _FIRST
        for frame in frames:
            out = []
            for project, kind, time_of, number, skill_id, title, text in frame.itertuples(index=False):
                if known is None or known.project != project:
                    known, rule_no, listed, at = _Skills(project), 0, [], _FIRST
                if kind == 0:
                    known.known(time_of, skill_id, title, text)
                    continue
                if kind == 1:
                    rule_no += 1
                    if text is not None:
                        listed.append(f"  {rule_no}. {text}")
                    continue
                if rule_no:
                    listed, rule_no = [RULES_HEADER + "\n".join(listed)], 0
                at = max(time.time_ns() // 1000, at + 1) if clocked else time_of
                lists = known.texts()
                shared = {"existing_skills_section": (*lists, *listed), "skills_text": lists, "rules_text": tuple(listed)}
                prompt = fill_parts(template, {"project": project, "conversations": text}, shared)
                if max_prompt_chars is not None and len(prompt) > max_prompt_chars:
                    out.append((project, number, None, "prompt too long", at, [], [], []))
                    continue
                ((_, _, raw, error),) = _answers([(project, number, prompt if in_parts else str(prompt))], model_fn)
                items = P.answer_items(raw) if error is None and isinstance(raw, str) else []
                made = known.merge(items, at)
                out.append((project, number, raw, error, at, *([m[k] for m in made] for k in range(3))))
                if len(out) == 32:
                    yield pd.DataFrame(out, columns=_TURNS)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=_TURNS)

    order = ["project_path", "kind", F.when(F.col("kind") < 2, F.col("at")), F.when(F.col("kind") > 0, F.col("number")), "skill_id"]
    return rows.sortWithinPartitions(*order).select(
        "project_path", "kind", "at", "number", "skill_id", "title", "text").mapInPandas(
        answer, f"{_SCHEMA}, made_at long, made_no array<long>, made_id array<string>, made_title array<string>",
    ).withColumn("made_at", F.timestamp_micros(F.nullif("made_at", first)))


_TURNS = ["project_path", "batch_no", "raw", "error", "made_at", "made_no", "made_id", "made_title"]


def _answers(ready: list[tuple], model_fn) -> list[tuple]:
    got = _attempt([prompt for _, _, prompt in ready], model_fn) if ready else []
    return [(project, number, raw, error) for (project, number, _), (raw, error) in zip(ready, got)]


def _attempt(texts: list[str], model_fn) -> list[tuple]:
    """(answer, error) of each prompt; a call that fails is tried prompt by prompt."""
    try:
        out = list(model_fn(texts))
        if len(out) != len(texts):
            raise ValueError(f"model gave {len(out)} answers for {len(texts)} prompts")
        return [(None, str(o)[:200]) if isinstance(o, Exception) else (o, None) for o in out]
    except Exception as error:  # a failed call is data here
        if len(texts) > 1:
            return [_attempt([t], model_fn)[0] for t in texts]
        return [(None, str(error)[:200] or type(error).__name__)]


def parse_items(answers: DataFrame) -> DataFrame:
    """One row per object in an answer: (project_path, batch_no, item_no, item)."""
    return (
        answers.where(F.col("error").isNull())
        .select("project_path", "batch_no", F.posexplode(answer_items("raw")).alias("item_no", "item"))
        .where(V.is_kind("item", "object"))
    )


def answer_status(answers: DataFrame) -> DataFrame:
    """(project_path, batch_no, n_items, failed): a batch without any item has failed."""
    n = F.when(F.col("error").isNull(), F.size(answer_objects("raw"))).otherwise(F.lit(0))
    counted = answers.select("project_path", "batch_no", n.alias("n_items"))
    return counted.withColumn("failed", F.col("n_items") == 0)


def normalize_skills(items: DataFrame) -> DataFrame:
    """Items as skill rows; items without a title are left out."""
    rows = items.select(
        "project_path", "batch_no", F.col("item_no").cast("long").alias("item_no"),
        *skill_fields("item"))
    return rows.where(F.col("title") != "")


def rule_items(items: DataFrame) -> DataFrame:
    """Items as rules: those with a non-empty string under ``rule``."""
    return items.select(
        "project_path", rule_text("item").alias("rule_text"),
        (F.col("batch_no") * F.lit(1 << 32) + F.col("item_no")).alias("rule_seq"),
    ).where(F.col("rule_text").isNotNull())
