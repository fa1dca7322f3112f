from convolake.operators import render as R
from convolake.schemas import SKILLS, conform

COLUMNS = ("skill_id string, project_path string, title string, description string, steps string, tags string, obs_type string,"
           "recurring boolean, facts array<string>, concepts array<string>, files_read array<string>, files_modified array<string>,"
           "file_map map<string,array<string>>, command_templates array<struct<name:string,template:string,description:string>>")


def skills(spark, *rows):
    full = [dict(skill_id=f"k{i}", project_path="/p/app", title=f"T{i}", description="", steps="", tags="", obs_type="workflow",
                 recurring=True, facts=[], concepts=[], files_read=[], files_modified=[], file_map={}, command_templates=[]) | r
            for i, r in enumerate(rows)]
    return conform(spark.createDataFrame(full, COLUMNS), SKILLS)


def document(spark, *rows, per_part=1000):
    parts = R.render_instructions(skills(spark, *rows), "NOW", per_part).orderBy("part_no").collect()
    text = "".join(p.content for p in parts)
    head = R.HEADER.format(project_name="app", timestamp="NOW")
    assert text.startswith(head)
    return text[len(head):], len(parts)


def test_classes(spark):
    df = skills(spark, {"title": "CONSTANTS"}, {"title": "My Quick Reference"}, {"title": "The File Map"},
                {"obs_type": "discovery", "file_map": {"a": []}}, {"obs_type": "discovery"},
                {"title": "Registry of Experiments"}, {"title": "Experiment"}, {"recurring": False})
    got = [r.category for r in R.classify_skills(df).orderBy("skill_id").collect()]
    assert got == ["constants", "constants", "file_map", "file_map", "recurring", "registry", "recurring", "one_off"]


def test_sections_appear_only_with_content(spark):
    text, _ = document(spark, {"recurring": False, "title": "Once", "description": "done"})
    assert text == ("## Reference (One-Time Tasks)\n\n> These tasks are completed. Included for context only.\n\n"
                    "- **Once**: done\n\n")
    text, _ = document(spark, {"title": "File map", "obs_type": "workflow"})
    assert text == ""


def test_constants_registry_and_files(spark):
    text, _ = document(
        spark, {"title": "Constants", "facts": ["a", "b"], "description": "unused"},
        {"title": "Constants 2", "description": "plain", "files_read": ["z.py", "a.py"]},
        {"title": "experiment registry", "description": "d", "steps": "1\n2", "files_modified": ["a.py"]})
    assert text == (
        "## Quick Reference\n\n- a\n- b\n\nplain\n\n---\n\n"
        "## Key Files\n\n- `a.py` — Constants 2\n- `z.py` — Constants 2\n\n---\n\n"
        "## Experiment Registry\n\nd\n\n1\n2\n\n---\n\n")


def test_file_map_merges_in_skill_order(spark):
    text, _ = document(
        spark, {"title": "File map", "file_map": {"b.py": ["s2", "s1"], "a.py": []}, "files_read": ["x"]},
        {"title": "File map", "file_map": {"b.py": ["s1", "s3"] + [f"m{i}" for i in range(9)]}})
    assert text == ("## File Map\n\n| File | Key Symbols |\n|------|-------------|\n| `a.py` |  |\n"
                    "| `b.py` | `s2`, `s1`, `s3`, `m0`, `m1`, `m2`, `m3`, `m4` |\n\n---\n\n")
    counts = R.merge_file_map(skills(spark, {"file_map": {"b.py": [f"m{i}" for i in range(11)]}})).first()
    assert counts.n_symbols == 11 and len(counts.symbols) == 8


RECURRING = {"title": "W", "description": "desc", "steps": "do", "tags": "x", "facts": ["f"], "concepts": ["c1", "c2"],
             "command_templates": [("n", "run", "about"), (None, "bare", None), ("empty", "", None)]}


def test_recurring_and_commands(spark):
    text, _ = document(spark, RECURRING, {"title": "Bare"})
    assert text == (
        "## Command Templates\n\n**n** — about\n```\nrun\n```\n\n**command**\n```\nbare\n```\n\n---\n\n"
        "## Recurring Workflows\n\n### W\n\ndesc\n\n**Facts:**\n- f\n\n**Steps:**\ndo\n\n"
        "**Commands:**\n- n: `run`\n- `bare`\n\n*Tags: x | Concepts: c1, c2*\n\n---\n\n### Bare\n\n---\n\n\n")


def test_long_documents_come_in_parts_that_join(spark):
    rows = [{"title": f"One {i}", "recurring": False} for i in range(40)]
    whole, one = document(spark, *rows)
    parts, many = document(spark, *rows, per_part=7)
    assert one == 1 and many == 7 and parts == whole


def test_skill_documents(spark):
    row = R.skill_documents(skills(spark, RECURRING | {"title": "Fix: It (now)"})).first()
    assert row.project_slug == "app" and row.filename == "fix-it-now.md"
    assert row.content == (
        "# Fix: It (now)\n\n> desc\n\n**Type:** workflow\n**Tags:** x\n**Project:** /p/app\n**Skill ID:** k0\n\n## Steps\n\ndo\n\n"
        "## Facts\n\n- f\n\n## Concepts\n\n- c1\n- c2\n\n## Files\n\n(none)\n")
