"""Group fresh sessions into bounded batches and turn them into prompts."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.plain_answers import to_json
from ..functions.text import preview, truncate_salient
from ..session import write_down
from .ranking import first_n, group_index

# Sizes of a batch, of a session's share and of single texts in a prompt.
BATCH_SESSIONS = 5
SESSION_MESSAGES = 30
REVIEW_SESSIONS = 20


@dataclass(frozen=True)
class PromptCaps:
    """Characters of a message that go into a prompt; ``None`` sends all.

    ``response`` is what is looked at, ``short_response`` what is sent, of which a command or
    edit line takes ``salient``, an output line ``output`` and any other ``line`` characters.
    """

    user: int | None = 200
    response: int | None = 2000
    short_response: int | None = 600
    salient: int | None = 300
    output: int | None = 150
    line: int | None = 200


CAPS = PromptCaps()
WHOLE = PromptCaps(None, None, None, None, None, None)

PART_LINES = 100  # skills or rules in one part of a prompt's section
BATCHES_PER_COPY = 64  # batches of a project that share one copy of its sections, at least
COPIES = 16  # copies of a project's sections at most, so that what travels grows with the lists

SKILLS_HEADER = "\n\nSKILLS:\n\n"
RULES_HEADER = "\n\nRULES:\n\n"


def session_marks(fresh: DataFrame) -> DataFrame:
    """Per session: message count, highest position and place in time.  No text."""
    return fresh.groupBy("project_path", "session_id").agg(
        F.count("*").alias("n_messages"), F.max("msg_seq").alias("last_message_id"),
        F.min("created_at").alias("created_at"), F.min(F.struct("ts", "msg_seq")).alias("_first"),
    ).withColumn("first_ts", F.col("_first.ts")).drop("_first")


def session_texts(fresh: DataFrame, max_messages: int = SESSION_MESSAGES,
                  carry_over: bool = True, caps: PromptCaps = CAPS) -> DataFrame:
    """Per session: the text sent for it, how many messages, and the highest position sent.

    Only the first ``max_messages`` messages are gathered, each cut by ``caps`` first; the line-wise shortening runs on those only.  With
    ``carry_over`` messages are taken by position, so that a mark at the last one
    sent leaves out nothing before it and the rest comes in the next pass.
    """
    keys = ["project_path", "session_id"]
    order = [F.asc("msg_seq")] if carry_over else [F.asc_nulls_first("ts"), F.asc("msg_seq")]
    cut = fresh.select(
        *keys, "ts", "msg_seq", preview(F.col("user_text"), caps.user).alias("user"),
        preview(F.col("response_summary"), caps.response).alias("response"),
    )
    short = truncate_salient(F.col("response"), caps.short_response, caps.salient, caps.output, caps.line)
    sent = first_n(cut, keys, max_messages, *order).select(
        *keys, "rank", "msg_seq",
        F.concat_ws(
            "\n", F.concat(F.lit("USER: "), "user"),
            F.when(F.col("response") != "", F.concat(F.lit("RESPONSE: "), short)),
        ).alias("lines"),
    )
    head = F.concat(F.lit("--- Session "), preview(F.col("session_id"), 8), F.lit(" ---\n"))
    return (
        sent.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("rank", "lines"))).alias("parts"),
             F.max("msg_seq").alias("last_sent"), F.count("*").alias("n_sent"))
        .select(*keys, "last_sent", "n_sent",
                F.concat(head, F.array_join("parts.lines", "\n")).alias("session_text"))
    )


def assign_batches(marks: DataFrame, size: int = BATCH_SESSIONS) -> DataFrame:
    """Number sessions within their project by time and cut them into batches of ``size``.

    Works on the narrow rows of ``session_marks``; texts join afterwards.
    """
    placed = group_index(
        marks, "project_path", F.asc_nulls_first("created_at"), F.asc_nulls_first("first_ts"),
        F.asc("session_id"), name="position",
    )
    return placed.withColumn("batch_no", F.floor(F.col("position") / size))


def batch_rows(assigned: DataFrame, texts: DataFrame, counted: str = "n_messages") -> DataFrame:
    """One row per batch: sessions in order, message count and conversation text.

    ``counted`` is ``n_messages`` (all fresh ones) or ``n_sent``.
    """
    session = F.struct("position", "session_id", "session_text")
    return (
        assigned.join(texts, ["project_path", "session_id"])
        .groupBy("project_path", "batch_no")
        .agg(F.sort_array(F.collect_list(session)).alias("s"), F.sum(counted).alias("n_messages"))
        .select("project_path", "batch_no", F.size("s").alias("n_sessions"), "n_messages",
                F.col("s.session_id").alias("session_ids"),
                F.array_join("s.session_text", "\n\n").alias("conversations"))
    )


def batch_marks(assigned: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(project_path, batch_no, session_id, last_message_id) to commit when a batch succeeds.

    A mark covers all messages of a session, sent or not; given ``texts`` made with
    ``carry_over`` it stops at the last one sent.
    """
    if texts is not None:
        sent = texts.select("project_path", "session_id", F.col("last_sent").alias("last_message_id"))
        assigned = assigned.drop("last_message_id").join(sent, ["project_path", "session_id"])
    return assigned.select("project_path", "batch_no", "session_id", "last_message_id")


def review_sample(fresh: DataFrame, last: int = REVIEW_SESSIONS) -> DataFrame:
    """The latest ``last`` sessions of each project, numbered in their own order."""
    per_session = session_marks(fresh).select("project_path", "session_id", "created_at", "first_ts")
    latest = first_n(
        per_session, "project_path", last, F.desc_nulls_last("created_at"),
        F.desc_nulls_last("first_ts"), F.desc("session_id"), name="from_end",
    )
    size = latest.groupBy("project_path").agg(F.count("*").alias("taken"))
    return latest.join(size, "project_path").withColumn(
        "position", F.col("taken") - F.col("from_end")
    ).drop("from_end", "taken")


def gather_text(lines: DataFrame, order: list[str], separator: str, limit: int | None, text: Callable[[Column], Column]) -> DataFrame:
    """(project_path, chars, text) from lines in order: a whole list in one row, for dry runs.

    ``text`` makes the text of the lines where they are gathered, so that a list does not move
    as lines first.  With a ``limit`` the total size is summed first, and a project beyond it
    keeps ``chars`` but gets no text.
    """
    chars = F.sum(F.length("line") + len(separator)).alias("chars")
    listed = F.sort_array(F.collect_list(F.struct(*order, "line"))).alias("l")
    made = text(F.col("l.line")).alias("text")
    if limit is None:
        return lines.groupBy("project_path").agg(chars, listed).select("project_path", "chars", made)
    sizes = lines.groupBy("project_path").agg(chars)
    fits = sizes.where(F.col("chars") <= limit).select("project_path")
    texts = lines.join(fits, "project_path", "left_semi").groupBy("project_path").agg(listed).select("project_path", made)
    return sizes.join(texts, "project_path", "left")


def skill_lines(skills: DataFrame, *also: str) -> DataFrame:
    """One block of prompt text per skill, with the columns ``also``; ``skill_line`` is the same in plain Python."""
    def as_json(name: str, chars: int) -> Column:
        text = preview(F.to_json(name), chars)
        return F.when(F.size(name) > 0, text)

    def labelled(label: str, text: Column) -> Column:
        return F.concat(F.lit(f"  {label}: "), text)

    block = F.concat_ws(
        "\n",
        F.concat(F.lit("[skill_id="), "skill_id", F.lit("] "), F.coalesce("title", F.lit("")),
                 F.lit(" (type="), F.coalesce("obs_type", F.lit("workflow")), F.lit("): "),
                 F.coalesce("description", F.lit(""))),
        labelled("Steps", preview(F.coalesce("steps", F.lit("")), 200)),
        labelled("Tags", F.coalesce("tags", F.lit(""))),
        labelled("Facts", as_json("facts", 200)), labelled("Concepts", as_json("concepts", 150)),
        labelled("FileMap", as_json("file_map", 300)),
        labelled("Commands", as_json("command_templates", 300)),
    )
    return skills.where(F.col("project_path").isNotNull()).select(
        "project_path", "created_at", "skill_id", block.alias("line"), *also)


def skill_line(skill_id: str, fields: dict) -> str:
    """``skill_lines`` of one skill with the fields of an item (``plain_answers.shown_fields``)."""
    lists = (("Facts", "facts", 200), ("Concepts", "concepts", 150), ("FileMap", "file_map", 300),
             ("Commands", "command_templates", 300))
    return "\n".join([
        f"[skill_id={skill_id}] {fields['title']} (type={fields['obs_type']}): {fields['description']}",
        f"  Steps: {fields['steps'][:200]}", f"  Tags: {fields['tags']}",
        *(f"  {label}: {to_json(fields[name])[:chars]}" for label, name, chars in lists if fields[name])])


def format_skills(skills: DataFrame, limit: int | None = None) -> DataFrame:
    return gather_text(skill_lines(skills), ["created_at", "skill_id"], "\n\n", limit, lambda lines: F.concat(
        F.lit(SKILLS_HEADER), F.array_join(lines, "\n\n")))


def format_rules(rules: DataFrame, limit: int | None = None) -> DataFrame:
    def numbered(lines: Column) -> Column:
        return F.transform(lines, lambda rule, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), rule))

    lines = rules.select("project_path", "created_at", "rule_seq", F.col("rule_text").alias("line"))
    return gather_text(lines, ["created_at", "rule_seq"], "\n", limit, lambda lines: F.concat(
        F.lit(RULES_HEADER), F.array_join(numbered(lines), "\n")))


def prompt_sections(skills: DataFrame, rules: DataFrame, per_part: int = PART_LINES) -> DataFrame:
    """(project_path, section, part_no, text): the skill and rule lists of all projects, kept once.

    A part holds at most ``per_part`` lines, so a list of any length is many rows; the texts
    of a section's parts one after the other are the section.
    """
    def parts(lines: DataFrame, section: str, order: list[Column], header: str, separator: str, line: Column) -> DataFrame:
        placed = group_index(lines, "project_path", *order, name="place")
        gathered = placed.withColumn("line", line).groupBy("project_path", F.floor(F.col("place") / per_part).alias("part_no")).agg(
            F.sort_array(F.collect_list(F.struct("place", "line"))).alias("l"))
        head = F.when(F.col("part_no") == 0, F.lit(header)).otherwise(F.lit(separator))
        return gathered.select(
            "project_path", F.lit(section).alias("section"), "part_no", F.concat(head, F.array_join("l.line", separator)).alias("text"))

    first = [F.asc_nulls_first("created_at")]
    numbered = F.concat(F.lit("  "), (F.col("place") + 1).cast("string"), F.lit(". "), "rule_text")
    return parts(
        skill_lines(skills), "skills", [*first, F.asc("skill_id")], SKILLS_HEADER, "\n\n", F.col("line")
    ).unionByName(parts(
        rules.where(F.col("project_path").isNotNull()).select("project_path", "created_at", "rule_seq", "rule_text"),
        "rules", [*first, F.asc("rule_seq")], RULES_HEADER, "\n", numbered))


def with_share(batches: DataFrame) -> DataFrame:
    """Add ``share``: neighbouring batches of a project that read one copy of its sections."""
    last = batches.groupBy("project_path").agg(F.max("batch_no").alias("_last"))
    width = F.greatest(F.lit(BATCHES_PER_COPY), F.ceil((F.col("_last") + 1) / COPIES))
    return batches.join(last, "project_path", "left").withColumn(
        "share", F.floor(F.col("batch_no") / width)).drop("_last")


@dataclass(frozen=True)
class Prompt:
    """A prompt as the texts it consists of, in order.

    The lists that the prompts of a project share are texts of their own and the same objects
    in all of them; ``str`` puts the whole prompt together.
    """

    texts: tuple[str, ...]

    def __str__(self) -> str:
        return "".join(self.texts)

    def __len__(self) -> int:
        return sum(map(len, self.texts))


def fill_parts(template: str, slots: dict[str, str], shared: dict[str, tuple[str, ...]]) -> Prompt:
    """``fill_template`` for ready texts; those of ``shared`` slots are not copied."""
    texts, own = [], []
    for piece in re.split(r"(\{\w+\})", template):
        name = piece[1:-1] if piece.startswith("{") else None
        if name in shared:
            texts.extend(("".join(own), *shared[name]))
            own = []
        else:
            own.append(slots.get(name, piece) or "")
    return Prompt(tuple(t for t in (*texts, "".join(own)) if t))


class ShownList:
    """A project's skill list as prompts show it, of lines that change one by one.

    The lines lie in chunks; a change makes the text of its chunk anew, and all other texts stay
    the same objects from prompt to prompt.  ``keys`` order the lines; equal ones may come.
    """

    def __init__(self, keys: list[tuple], lines: list[str], per_chunk: int = PART_LINES):
        self._size = max(per_chunk, isqrt(len(keys)))
        self._chunks = [(keys[i:i + self._size], lines[i:i + self._size]) for i in range(0, len(keys), self._size)]
        self._texts: list[str | None] = [None] * len(self._chunks)

    def texts(self) -> tuple[str, ...]:
        for i, text in enumerate(self._texts):
            if text is None:
                self._texts[i] = ("\n\n" if i else SKILLS_HEADER) + "\n\n".join(self._chunks[i][1])
        return tuple(self._texts)

    def _at(self, key: tuple, search) -> int:
        return search(self._chunks, key, key=lambda chunk: chunk[0][0])

    def replace(self, key: tuple, line: str) -> None:
        """``line`` for all lines of this key."""
        for i in range(max(self._at(key, bisect_left) - 1, 0), self._at(key, bisect_right)):
            keys, lines = self._chunks[i]
            low, high = bisect_left(keys, key), bisect_right(keys, key)
            if low < high:
                lines[low:high] = [line] * (high - low)
                self._texts[i] = None

    def add(self, key: tuple, line: str) -> None:
        if not self._chunks:
            self._chunks, self._texts = [([key], [line])], [None]
            return
        i = max(self._at(key, bisect_right) - 1, 0)
        keys, lines = self._chunks[i]
        place = bisect_right(keys, key)
        keys.insert(place, key)
        lines.insert(place, line)
        self._texts[i] = None
        if len(keys) > 2 * self._size:
            self._chunks[i:i + 1] = [(keys[:self._size], lines[:self._size]), (keys[self._size:], lines[self._size:])]
            self._texts[i:i + 1] = [None, None]


def fill_template(template: str, slots: dict[str, Column]) -> Column:
    """``{name}`` slots of a template filled in one pass; filled text is not scanned again."""
    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        name = piece[1:-1] if piece.startswith("{") else None
        parts.append(slots[name] if name in slots else F.lit(piece))
    return F.concat(*parts)


def build_prompts(batches: DataFrame, skills: DataFrame, rules: DataFrame, template: str,
                  max_prompt_chars: int | None = None) -> DataFrame:
    """One whole prompt per batch: the dry run.  Runs use ``prompt_sections`` instead.

    The lists travel once per ``share``, and a task holds one prompt at a time; all prompts
    together are as long as batches times lists.

    With a limit, a prompt over ``max_prompt_chars`` is NULL with an ``error``, like a call the
    model refused: its batch fails and its marks stay.
    """
    known = format_skills(skills, max_prompt_chars).select(
        "project_path", F.col("text").alias("_skills"), F.col("chars").alias("_skill_chars"))
    learned = format_rules(rules, max_prompt_chars).select(
        "project_path", F.col("text").alias("_rules"), F.col("chars").alias("_rule_chars"))
    keys = ["project_path", "share"]
    asked = with_share(write_down(batches))
    told = asked.select(*keys).distinct().join(known, "project_path", "left").join(learned, "project_path", "left")
    joined = asked.join(told, keys, "left")
    none = F.lit("")
    chars = (
        F.lit(len(template)) + F.length("conversations")
        + F.coalesce("_skill_chars", F.lit(0)) + F.coalesce("_rule_chars", F.lit(0))
    )
    prompt = fill_template(template, {
        "project": F.col("project_path"), "conversations": F.col("conversations"),
        "existing_skills_section": F.concat(F.coalesce("_skills", none), F.coalesce("_rules", none)),
        "skills_text": F.coalesce("_skills", none), "rules_text": F.coalesce("_rules", none),
    })
    fits = F.lit(True) if max_prompt_chars is None else chars <= max_prompt_chars
    return joined.select(
        "project_path", "batch_no", "n_sessions", "n_messages", "session_ids",
        F.when(fits, prompt).alias("prompt"), chars.alias("prompt_chars"),
        F.when(~fits, F.lit("prompt too long")).alias("error"),
    )
