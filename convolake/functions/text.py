"""Text functions on columns: matching, extraction, truncation, naming."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
_FOLD = str.maketrans(_UPPER, _LOWER)

# The pattern of a path and the mark of a code fence.
PATH_PATTERN = r"(?U)(?:/[\w._-]+){2,}"
FENCE = "```"


def ascii_fold(c: Column) -> Column:
    """Lower-case A-Z only, the folding that the LIKE of the stored data used."""
    return F.translate(c, _UPPER, _LOWER)


def like_pattern(text: str) -> str:
    """``%text%``; % and _ inside the text stay wildcards, a backslash is itself."""
    return "%" + text.translate(_FOLD).replace("\\", "\\\\") + "%"


def like_ci(c: Column, text: str, literal: bool = False) -> Column:
    """ASCII-case-insensitive substring match; ``literal`` turns the wildcards off."""
    if literal:
        return ascii_fold(c).contains(text.translate(_FOLD))
    return ascii_fold(c).like(like_pattern(text))


def is_blank(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(r"(?U)\S")


def strip(c: Column) -> Column:
    """Remove white space of every kind at both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def extract_paths(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(PATH_PATTERN), F.lit(0))


def has_paths(c: Column) -> Column:
    return F.coalesce(c.rlike(PATH_PATTERN), F.lit(False))


def has_code(*columns: Column) -> Column:
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(c.contains(FENCE), F.lit(False))
    return found


def preview(c: Column, n: int | None) -> Column:
    """The first ``n`` characters, or all."""
    return c if n is None else F.substring(c, 1, n)


def truncate_salient(c: Column, max_len: int | None = 600, salient: int | None = 300,
                     output: int | None = 150, other: int | None = 200) -> Column:
    """Shorten a response line by line, favouring command and edit lines.

    ``salient``, ``output`` and ``other`` are the characters kept of a command or edit line, an
    output line and any other; ``None`` keeps whole lines, or as ``max_len`` the whole response.

    A fold over the lines carries the kept lines and their total length.  Nothing
    is added once the total has reached ``max_len``.
    """
    if max_len is None:
        return c
    start = F.struct(
        F.array().cast("array<string>").alias("kept"), F.lit(0).cast("int").alias("size")
    )

    def step(acc, line):
        always = line.startswith("[cmd]") | line.startswith("[edit]")
        is_output = line.startswith("[output")
        cut = (
            F.when(always, preview(line, salient))
            .when(is_output, preview(line, output))
            .otherwise(preview(line, other))
        )
        # a plain line must fit with its whole length, an output line with its cut length
        needs = F.when(is_output, F.length(cut)).otherwise(F.length(line))
        take = (acc["size"] < max_len) & (always | (acc["size"] + needs < max_len))
        return F.when(
            take,
            F.struct(
                F.concat(acc["kept"], F.array(cut)).alias("kept"),
                (acc["size"] + F.length(cut)).alias("size"),
            ),
        ).otherwise(acc)

    folded = F.aggregate(
        F.split(c, "\n", -1), start, step, lambda acc: F.array_join(acc["kept"], "\n")
    )
    return F.when(F.length(c) <= max_len, c).otherwise(folded)


def project_slug(project: Column) -> Column:
    """Last path component with everything but word characters, dot and dash replaced."""
    name = F.regexp_extract(F.regexp_replace(project, "/+$", ""), r"[^/]*$", 0)
    named = F.when(F.coalesce(project, F.lit("")) == "", F.lit("global")).otherwise(name)
    return F.regexp_replace(named, r"(?U)[^\w.-]", "_")


def title_slug(title: Column) -> Column:
    kept = strip(F.regexp_replace(title, r"(?U)[^\w\s-]", ""))
    return F.concat(F.lower(F.replace(kept, F.lit(" "), F.lit("-"))), F.lit(".md"))


def display_path(path: Column, home: str | None = None, width: int = 45) -> Column:
    """Home folder as ``~``; a longer path keeps its last two components only."""
    short = F.replace(path, F.lit(home), F.lit("~")) if home else path
    return F.when(
        F.length(short) > width, F.concat(F.lit("…/"), F.substring_index(short, "/", -2))
    ).otherwise(short)


def base_name(path: Column, missing: str = "") -> Column:
    path = F.coalesce(path, F.lit(""))
    return F.when(path == "", F.lit(missing)).otherwise(F.substring_index(path, "/", -1))


def epoch_ms_date(ms: Column) -> Column:
    return F.when(
        F.coalesce(ms, F.lit(0)) != 0, F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")
    ).otherwise(F.lit(""))


def content_id(project: Column, title: Column, steps: Column) -> Column:
    """Id of a new skill: 16 hex digits of the SHA-256 of ``project:title:steps``."""
    text = F.concat_ws(":", project, title, F.coalesce(steps, F.lit("")))
    return F.substring(F.sha2(text, 256), 1, 16)


def bullets(items: Column, missing: str = "(none)") -> Column:
    lines = F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.when(F.size(items) > 0, lines).otherwise(F.lit(missing))
