import hashlib
import random

import pytest
from pyspark.sql import functions as F

from convolake.operators.merge import merge_skills, resolve_items
from convolake.schemas import SKILLS, conform

import fixtures


def new_id(project, title, steps):
    return hashlib.sha256(f"{project}:{title}:{steps}".encode()).hexdigest()[:16]


def one_by_one(skills, items):
    """Merge items one after the other, as a plain loop."""
    table = {s["skill_id"]: dict(s, made=None) for s in skills}
    for item in sorted(items, key=lambda i: (i["project_path"], i["batch_no"], i["item_no"])):
        p, asked = item["project_path"], item["skill_id"]
        mine = {k: s for k, s in table.items() if s["project_path"] == p}
        if asked in mine:
            table[asked].update(title=item["title"], steps=item["steps"])
            continue
        same = [k for k, s in mine.items() if s["title"] == item["title"]]
        if same:
            table[min(same)].update(steps=item["steps"])
            continue
        fresh = new_id(p, item["title"], item["steps"])
        if fresh in table:  # the id is taken: update that skill
            table[fresh].update(title=item["title"], steps=item["steps"])
        else:
            table[fresh] = dict(skill_id=fresh, project_path=p, title=item["title"], steps=item["steps"])
    return {k: (s["project_path"], s["title"], s["steps"]) for k, s in table.items()}


def frames(spark, skills, items):
    known = conform(spark.createDataFrame(
        [(s["skill_id"], s["project_path"], s["title"], s["steps"]) for s in skills] or [],
        "skill_id string, project_path string, title string, steps string"), SKILLS)
    rows = spark.createDataFrame(
        [(i["project_path"], i["batch_no"], i["item_no"], i["skill_id"], i["title"], i["steps"]) for i in items],
        "project_path string, batch_no long, item_no long, skill_id string, title string, steps string")
    defaults = {c: d for c, d in fixtures._ITEM_DEFAULTS.items()}
    return known, rows.select("*", F.lit("").alias("description"), F.lit("").alias("tags"),
                              F.lit("workflow").alias("obs_type"),
                              *[F.expr(d).alias(c) for c, d in defaults.items()])


def check(spark, skills, items):
    known, rows = frames(spark, skills, items)
    merged = merge_skills(known, rows).select("skill_id", "project_path", "title", "steps").collect()
    assert len({r.skill_id for r in merged}) == len(merged)
    assert {r.skill_id: (r.project_path, r.title, r.steps) for r in merged} == one_by_one(skills, items)


def random_case(rng, projects, titles, rename_back):
    skills, items = [], []
    for p in range(projects):
        project = f"/p{p}"
        own = []
        for k in range(rng.randrange(0, 5)):
            title, steps = rng.choice(titles), f"s{k}"
            sid = new_id(project, title, steps) if rename_back else f"id{p}_{k}"
            if sid not in {s["skill_id"] for s in skills}:
                own.append(sid)
                skills.append(dict(skill_id=sid, project_path=project, title=title, steps=steps))
        ids = own + ["new", "unknown", "new"]
        if rename_back:
            ids += [new_id(project, t, f"s{k}") for t in titles[:2] for k in range(2)]
        for n in range(rng.randrange(0, 14)):
            items.append(dict(project_path=project, batch_no=n // 3, item_no=n % 3, skill_id=rng.choice(ids),
                              title=rng.choice(titles), steps=f"s{rng.randrange(3)}"))
    return skills, items


@pytest.mark.parametrize("seed", range(3))
def test_merge_equals_one_by_one_with_renames(spark, seed):
    """Titles move between skills; 150 projects per run, each its own random history."""
    check(spark, *random_case(random.Random(seed), 150, list("abcd"), rename_back=False))


@pytest.mark.parametrize("seed", range(3))
def test_merge_equals_one_by_one_with_ids_of_this_run(spark, seed):
    """Items name skills made in the same run, and new ids hit skills renamed before."""
    check(spark, *random_case(random.Random(100 + seed), 120, list("abc"), rename_back=True))


def test_long_history_of_one_skill_spans_blocks(spark):
    items = []
    for n in range(3000):
        items.append(dict(project_path="/p", batch_no=n, item_no=0, skill_id="x", title=f"t{n % 7}", steps=f"s{n}"))
        items.append(dict(project_path="/p", batch_no=n, item_no=1, skill_id="new", title=f"t{(n * 3) % 7}", steps=f"n{n}"))
    check(spark, [dict(skill_id="x", project_path="/p", title="t0", steps="")], items)


def test_sources_creation_and_outcome(spark):
    skills = [dict(skill_id="x", project_path="/p", title="old", steps="s")]
    items = [dict(project_path="/p", batch_no=0, item_no=0, skill_id="new", title="n", steps="a"),
             dict(project_path="/p", batch_no=1, item_no=0, skill_id="new", title="n", steps="b"),
             dict(project_path="/p", batch_no=1, item_no=1, skill_id="x", title="old2", steps="c"),
             dict(project_path="/p", batch_no=1, item_no=2, skill_id="x", title="", steps="ignored")]
    known, rows = frames(spark, skills, items)
    batches = spark.createDataFrame([("/p", 0, ["s1"]), ("/p", 1, ["s2"])],
                                    "project_path string, batch_no long, session_ids array<string>")
    got = {r.title: r for r in merge_skills(known, rows, batches).collect()}
    assert got["n"].source_session_ids == ["s1"] and got["n"].steps == "b" and got["n"].created_at is not None
    assert got["old2"].skill_id == "x" and got["old2"].source_session_ids == [] and got["old2"].steps == "c"
    how = {(r.batch_no, r.item_no): r.how for r in resolve_items(known, rows).collect()}
    assert how == {(0, 0): "new", (1, 0): "title", (1, 1): "id"}


def test_many_bearers_of_one_title(spark):
    n = 20_000
    base = spark.range(n).select(
        F.format_string("k%05d", "id").alias("skill_id"), F.lit("/p").alias("project_path"),
        F.concat(F.lit("Own "), "id").alias("title"), F.lit("s").alias("steps"))
    renames = spark.range(n).select(F.lit("/p").alias("project_path"), F.lit(0).cast("long").alias("batch_no"), F.col("id").alias("item_no"),
                                    F.format_string("k%05d", n - 1 - F.col("id")).alias("skill_id"), F.lit("Shared").alias("title"))
    named = spark.range(n).select(F.lit("/p").alias("project_path"), F.lit(1).cast("long").alias("batch_no"), F.col("id").alias("item_no"),
                                  F.lit("new").alias("skill_id"), F.lit("Shared").alias("title"))
    between = named.limit(10).withColumn("batch_no", F.lit(0).cast("long")).withColumn("item_no", F.col("item_no") * 1000 + n)
    items = conform_items(renames.unionByName(named).unionByName(between))
    found = resolve_items(conform(base, SKILLS), items)
    got = found.groupBy("batch_no", "how", "target").agg(F.count("*").alias("n")).where("how = 'title'").collect()
    assert {(r.batch_no, r.target, r.n) for r in got} == {(0, "k00000", 10), (1, "k00000", n)}


def conform_items(rows):
    """Items with the remaining columns of normalised ones."""
    text = {c: F.lit("") for c in ("description", "steps", "tags", "narrative")}
    lists = {c: F.array().cast("array<string>") for c in ("facts", "concepts", "files_read", "files_modified")}
    return rows.withColumns({**text, **lists, "obs_type": F.lit("workflow"), "recurring": F.lit(True)})
