"""Merge model items into the skill table, as if they came in one by one.

An item updates the skill it names by id, else the skill of its project that bears
its title at that moment, else it makes a new skill.  Updates by id may change
titles, so what a title means depends on time.  Instead of replaying items in one
task per project, titles get intervals: who bore which title from when to when.
Items look their title up in these intervals, all at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_id
from ..schemas import SKILL_CONTENT, SKILLS, conform
from ..session import pin
from .ranking import global_index

_ITEM_BITS = 32
_BLOCK_BITS = 10  # batches per block when the next event of a skill is looked up
_KEY = ["project_path", "batch_no", "item_no"]


def _ordinal() -> Column:
    return F.shiftleft(F.col("batch_no").cast("long"), _ITEM_BITS) + F.col("item_no")


def _until(events: DataFrame) -> DataFrame:
    """Add ``until``, the next event of the same skill, by blocks of batches.

    A skill updated by a large part of all items spreads over its blocks; the
    second step sees one row per block.
    """
    skill = ["project_path", "skill_id"]
    blocked = events.withColumn(
        "block", F.coalesce(F.shiftright("since", _ITEM_BITS + _BLOCK_BITS), F.lit(-1)))
    within = F.lead("since").over(Window.partitionBy(*skill, "block").orderBy("since"))
    following = F.lead("start").over(Window.partitionBy(*skill).orderBy("block"))
    starts = (
        blocked.groupBy(*skill, "block").agg(F.min("since").alias("start"))
        .select(*skill, "block", following.alias("next_start"))
    )
    return (
        blocked.withColumn("within", within).join(starts, [*skill, "block"])
        .withColumn("until", F.coalesce("within", "next_start"))
        .drop("block", "within", "next_start")
    )


def _first_bearers(points: DataFrame, bearing: DataFrame) -> DataFrame:
    """Per item (``_KEY``, title, at): the smallest ``_bearer`` of its title with since < at < until.

    All times of a shared title are placed in one order.  An interval of places is cut into
    blocks of doubling width, at most two of each, and an item looks into the one block of
    each width that holds it: rows grow with n log n, however many bear or name a title.
    """
    title = ["project_path", "title"]
    points = points.join(bearing.select(*title).distinct(), title, "left_semi")
    ends = bearing.select(*title, F.explode(F.array(
        F.struct(F.lit(2).alias("kind"), F.col("since").alias("time")),
        F.struct(F.lit(0).alias("kind"), F.col("until").alias("time")))).alias("e"))
    times = points.select(F.col("at").alias("time"), F.lit(1).alias("kind")).unionByName(
        ends.where("e.time is not null").select("e.time", "e.kind")).distinct()
    # at equal times: what ends, then items, then what begins
    placed = pin(global_index(times, F.asc("time"), F.asc("kind"), name="place"))
    most = int(placed.agg(F.coalesce(F.max("place"), F.lit(0))).first()[0]) + 1

    def place(kind: int, name: str) -> DataFrame:
        return placed.where(F.col("kind") == kind).select(F.col("time").alias(name), F.col("place").alias(f"{name}_place"))

    spans = bearing.join(place(2, "since"), "since", "left").join(place(0, "until"), "until", "left").select(
        *title, "_bearer", F.coalesce("since_place", F.lit(0)).alias("low"), F.coalesce("until_place", F.lit(most)).alias("high"))

    def blocks(width: Column) -> Column:
        one = F.call_function("shiftleft", F.lit(1).cast("long"), width)
        low, high = F.ceil(F.col("low") / one), F.floor(F.col("high") / one)
        some = low < high
        return F.array(
            F.when(some & (low % 2 == 1), F.struct(width.alias("width"), low.alias("block"))),
            F.when(some & (high % 2 == 1), F.struct(width.alias("width"), (high - 1).alias("block"))))

    widths = F.sequence(F.lit(0), F.lit(most.bit_length()))
    cover = spans.select(*title, "_bearer", F.explode(F.filter(F.flatten(F.transform(widths, blocks)), lambda b: b.isNotNull())).alias("b"))
    least = cover.groupBy(*title, F.col("b.width").alias("width"), F.col("b.block").alias("block")).agg(F.min("_bearer").alias("_bearer"))
    at = points.join(place(1, "at"), "at").select(*_KEY, "title", "at_place", F.explode(widths).alias("width"))
    within = at.withColumn("block", F.expr("shiftright(at_place, width)"))
    return within.join(least, [*title, "width", "block"]).groupBy(*_KEY).agg(F.min("_bearer").alias("_then"))


def _look_up(items: DataFrame, base: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """Resolve items against ``base`` (project_path, skill_id, title, born).

    ``forced`` are further title changes (project_path, skill_id, title, since).
    Adds ``by_id`` (skill named by id) and ``by_title`` (smallest id of a skill
    bearing the title just before the item); both NULL means no skill fits.
    """
    named = base.select(F.col("project_path").alias("_p"), F.col("skill_id").alias("by_id"),
                        F.col("title").alias("_old_title"), F.col("born").alias("_born"))
    alive = F.col("_born").isNull() | (F.col("_born") < F.col("at"))
    matched = items.join(
        named,
        (F.col("project_path") == F.col("_p")) & (F.col("skill_id") == F.col("by_id")) & alive,
        "left",
    ).drop("_p")
    changed = matched.where(F.col("by_id").isNotNull() & (F.col("title") != F.col("_old_title")))
    moved = changed.select("project_path", F.col("by_id").alias("skill_id")).unionByName(
        base.where(F.col("born").isNotNull()).select("project_path", "skill_id"))
    named_at = matched.where(F.col("by_id").isNotNull()).select(
        "project_path", F.col("by_id").alias("skill_id"), "title", F.col("at").alias("since"))
    if forced is not None:
        moved = moved.unionByName(forced.select("project_path", "skill_id"))
        named_at = named_at.unionByName(forced)
    moved = moved.distinct()

    fixed = (
        base.join(moved, ["project_path", "skill_id"], "left_anti")
        .groupBy("project_path", "title").agg(F.min("skill_id").alias("_fixed"))
    )
    events = (
        base.join(moved, ["project_path", "skill_id"], "left_semi")
        .select("project_path", "skill_id", "title", F.col("born").alias("since"))
        .unionByName(named_at.join(moved, ["project_path", "skill_id"], "left_semi"))
    )
    bearing = _until(events).select(
        "project_path", "title", F.col("skill_id").alias("_bearer"), "since", "until")

    by_title = matched.where(F.col("by_id").isNull())
    then = _first_bearers(by_title.select(*_KEY, "title", "at"), bearing)
    columns = [*items.columns, "by_id"]
    looked_up = (
        by_title.select(*columns).join(fixed, ["project_path", "title"], "left")
        .join(then, _KEY, "left")
        .select(*columns, F.least("_fixed", "_then").alias("by_title"))
    )
    direct = matched.where(F.col("by_id").isNotNull()).select(
        *columns, F.lit(None).cast("string").alias("by_title"))
    return direct.unionByName(looked_up)


def _first_makers(unmatched: DataFrame) -> DataFrame:
    """The first item per (project, title) without a skill makes one."""
    return unmatched.groupBy("project_path", "title").agg(
        F.min("at").alias("born"), F.min_by("new_id", "at").alias("skill_id"))


def _unmatched(looked_up: DataFrame) -> DataFrame:
    return looked_up.where(F.col("by_id").isNull() & F.col("by_title").isNull())


def resolve_items(skills: DataFrame, items: DataFrame, made: DataFrame | None = None) -> DataFrame:
    """(project_path, batch_no, item_no, at, title, target, how) for every item.

    ``how`` is id, title or new.  One lookup decides everything unless an item
    names a skill made in this very run, or a new id is taken already; then
    lookups repeat with the skills found so far until nothing changes.  Each item
    depends on earlier items only, so the stable answer is the one-by-one answer.
    They start from ``made`` (project_path, batch_no, item_no, skill_id, title: items that no
    skill fits) where it is known; one lookup then proves it, or goes on from it.
    """
    narrow = items.where(F.col("title") != "").select(
        *_KEY, "skill_id", "title", _ordinal().alias("at"),
        content_id(F.col("project_path"), F.col("title"), F.col("steps")).alias("new_id"),
    )
    base = skills.select("project_path", "skill_id", "title",
                         F.lit(None).cast("long").alias("born"))
    looked_up = pin(_look_up(narrow, base))
    makers = _first_makers(_unmatched(looked_up))
    if _needs_repeat(looked_up, makers, base).isEmpty():
        return _settle(looked_up, makers)
    if made is not None:
        makers = made.select("project_path", "skill_id", "title", _ordinal().alias("born"))
    return _repeat(narrow, base, pin(makers))


def _needs_repeat(looked_up: DataFrame, makers: DataFrame, base: DataFrame) -> DataFrame:
    made = makers.select("project_path", "skill_id", "born")
    named = looked_up.where(F.col("by_id").isNull()).select("project_path", "skill_id", "at")
    refers = named.join(made, ["project_path", "skill_id"]).where(F.col("at") > F.col("born"))
    taken = made.join(base.select("project_path", "skill_id"), ["project_path", "skill_id"], "left_semi")
    return refers.select("project_path").unionByName(taken.select("project_path"))


def _settle(looked_up: DataFrame, makers: DataFrame) -> DataFrame:
    """Targets when skills made in this run keep their title to its end."""
    made = makers.select("project_path", "title", F.col("skill_id").alias("_made"),
                         F.col("born").alias("_born"))
    made_before = F.when(F.col("_born") <= F.col("at"), F.col("_made"))
    return looked_up.join(made, ["project_path", "title"], "left").select(
        *_KEY, "at", "title",
        F.coalesce("by_id", F.least("by_title", made_before)).alias("target"),
        F.when(F.col("by_id").isNotNull(), F.lit("id"))
        .when(F.col("by_title").isNull() & (F.col("_born") == F.col("at")), F.lit("new"))
        .otherwise(F.lit("title")).alias("how"),
    )


def _repeat(narrow: DataFrame, base: DataFrame, makers: DataFrame) -> DataFrame:
    maker = ["project_path", "born"]
    columns = ["project_path", "skill_id", "title", "born"]
    while True:
        # a maker whose id is taken, or was made before, updates that skill instead
        taken = makers.join(base.select("project_path", "skill_id"),
                            ["project_path", "skill_id"], "left_semi").select(*columns)
        earlier = makers.groupBy("project_path", "skill_id").agg(F.min("born").alias("_first"))
        again = makers.join(earlier, ["project_path", "skill_id"]).where(
            F.col("_first") < F.col("born")).select(*columns)
        forced = taken.unionByName(again).distinct()
        free = makers.join(forced.select(*maker), maker, "left_anti").select(*columns)
        looked_up = pin(_look_up(narrow, base.unionByName(free),
                                 forced.withColumnRenamed("born", "since")))
        open_items = _unmatched(looked_up)
        at_maker = makers.select("project_path", F.col("born").alias("at"))
        kept = open_items.join(at_maker, ["project_path", "at"], "left_semi").select(
            "project_path", F.col("new_id").alias("skill_id"), "title", F.col("at").alias("born"))
        added = _first_makers(open_items.join(at_maker, ["project_path", "at"], "left_anti"))
        found = pin(kept.unionByName(added.select(*columns)))
        lost = makers.join(found.select(*maker), maker, "left_anti")
        extra = found.join(makers.select(*maker), maker, "left_anti")
        if lost.isEmpty() and extra.isEmpty():
            updates = forced.select("project_path", F.col("born").alias("at"), F.lit(True).alias("_forced"))
            return looked_up.join(updates, ["project_path", "at"], "left").select(
                *_KEY, "at", "title", F.coalesce("by_id", "by_title", "new_id").alias("target"),
                F.when(F.col("by_id").isNotNull() | F.col("_forced"), F.lit("id"))
                .when(F.col("by_title").isNotNull(), F.lit("title")).otherwise(F.lit("new")).alias("how"),
            )
        makers = found


def apply_items(skills: DataFrame, items: DataFrame, resolved: DataFrame,
                batches: DataFrame | None = None, as_of: Column | None = None) -> DataFrame:
    """The skill table after ``resolved`` items.

    Content comes from the last item of a skill, the title from the last item that
    named it by id; creation time and source sessions from the item that made it.
    Only the winning item of each skill moves with its content.  ``as_of`` may be
    ``made_at``, a column of ``batches`` beside (project_path, batch_no, session_ids).
    """
    as_of = F.current_timestamp() if as_of is None else as_of
    sets_title = F.col("how") != "title"
    changes = resolved.groupBy("project_path", "target").agg(
        F.max("at").alias("_last"), F.min(F.when(F.col("how") == "new", F.col("at"))).alias("_made"),
        F.max_by("title", F.when(sets_title, F.col("at"))).alias("_title"),
    )
    content = [F.col(c).alias(f"_{c}") for c in SKILL_CONTENT]
    winners = items.select("project_path", _ordinal().alias("_last"), *content).join(
        changes, ["project_path", "_last"])
    updates = winners.where(F.col("_made").isNull()).select(
        F.col("target").alias("skill_id"), "_title", F.lit(True).alias("_hit"),
        *[f"_{c}" for c in SKILL_CONTENT])
    kept = skills.join(updates, "skill_id", "left").select(*[
        F.coalesce("_title", "title").alias("title") if f.name == "title"
        else F.when(F.col("_hit"), F.col(f"_{f.name}")).otherwise(F.col(f.name)).alias(f.name)
        if f.name in SKILL_CONTENT else F.col(f.name)
        for f in SKILLS.fields
    ])
    made = winners.where(F.col("_made").isNotNull()).withColumn(
        "batch_no", F.shiftright("_made", _ITEM_BITS))
    if batches is not None:
        made = made.join(
            batches.select("project_path", "batch_no", F.col("session_ids").alias("source_session_ids"),
                           *[c for c in batches.columns if c == "made_at"]),
            ["project_path", "batch_no"], "left")
    made = made.select(
        F.col("target").alias("skill_id"), F.col("_title").alias("title"), "project_path",
        as_of.alias("created_at"), *([] if batches is None else ["source_session_ids"]),
        *[F.col(f"_{c}").alias(c) for c in SKILL_CONTENT])
    return conform(kept, SKILLS).unionByName(conform(made, SKILLS))


def merge_skills(skills: DataFrame, items: DataFrame, batches: DataFrame | None = None,
                 as_of: Column | None = None) -> DataFrame:
    """Skills after merging ``items`` in (batch_no, item_no) order within each project."""
    skills = conform(skills, SKILLS)
    return apply_items(skills, items, resolve_items(skills, items), batches, as_of)
