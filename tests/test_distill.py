import pytest
from pyspark.sql import functions as F

from convolake.operators import batches as B
from convolake.operators import model as M
from convolake.operators.progress import advance_watermark, incremental_messages, project_progress, stale_projects
from convolake.plans.distill import distill, plan_batches
from convolake.plans.review import review
from convolake.schemas import MESSAGES, PATHS, PROGRESS, RULES, SESSIONS, SKILLS, conform, empty
from convolake.sources.tables import State

TEMPLATE = "P={project}\n{conversations}{existing_skills_section}"


def make_state(spark, sessions, messages):
    s = spark.createDataFrame(sessions, "session_id string, project_path string, created_at long")
    m = spark.createDataFrame(messages, "session_id string, msg_seq long, user_text string, response_summary string, ts long")
    return State(conform(s, SESSIONS), conform(m, MESSAGES), empty(spark, PATHS), empty(spark, SKILLS),
                 empty(spark, RULES), empty(spark, PROGRESS))


def seven_sessions(spark):
    sessions = [(f"s{i}", "/p/one", 100 - i) for i in range(7)] + [("t0", "/p/two", 5), ("n0", None, 1)]
    messages = [(s, k, f"ask {s} {k}", f"got {k}" if k else None, 1000 + k) for s, _, _ in sessions for k in range(3)]
    return make_state(spark, sessions, messages)


def keep(spark, df, schema):
    return spark.createDataFrame(df.collect(), schema)


def test_batches_follow_time_and_size(spark):
    rows = plan_batches(seven_sessions(spark)).rows.orderBy("project_path", "batch_no").collect()
    assert [(r.project_path, r.batch_no, r.session_ids) for r in rows] == [
        ("/p/one", 0, ["s6", "s5", "s4", "s3", "s2"]), ("/p/one", 1, ["s1", "s0"]), ("/p/two", 0, ["t0"])]
    assert rows[2].conversations == (
        "--- Session t0 ---\nUSER: ask t0 0\nUSER: ask t0 1\nRESPONSE: got 1\nUSER: ask t0 2\nRESPONSE: got 2")
    assert [r.n_messages for r in rows] == [15, 6, 3]


def test_messages_beyond_the_first_thirty_come_next(spark):
    state = make_state(spark, [("s", "/p", 1)], [("s", k, f"m{k}.", None, 1000 - k) for k in range(35)])
    seen = []
    for _ in range(3):
        planned = plan_batches(state)
        rows = planned.rows.collect()
        if not rows:
            break
        assert rows[0].n_messages == rows[0].conversations.count("USER:")
        seen += [k for k in range(35) if f"m{k}." in rows[0].conversations]
        state.progress = keep(spark, advance_watermark(state.progress, planned.marks), PROGRESS)
    assert sorted(seen) == list(range(35))
    state.progress = state.progress.limit(0)
    marked = plan_batches(state, carry_over=False)  # the first in time, and all count as done
    text = marked.rows.first().conversations
    assert text.count("USER:") == 30 and "m34." in text and "m4." not in text
    assert marked.marks.first().last_message_id == 34


def test_long_lists_travel_in_parts(spark):
    state = seven_sessions(spark)
    big = "d" * 1_000_000
    skills = spark.createDataFrame([(f"k{i}", "/p/two", f"T{i}", big) for i in range(9)],
                                   "skill_id string, project_path string, title string, description string")
    state.skills = conform(skills, SKILLS)
    rules = conform(spark.createDataFrame([("/p/two", f"rule {i}", i) for i in range(25)],
                                          "project_path string, rule_text string, rule_seq long"), RULES)
    state.rules = rules
    parts = B.prompt_sections(state.skills, rules, per_part=10).orderBy("section", "part_no").collect()
    assert [(p.section, p.part_no) for p in parts] == [("rules", 0), ("rules", 1), ("rules", 2), ("skills", 0)]
    assert "".join(p.text for p in parts[:3]).endswith("  24. rule 23\n  25. rule 24")
    rows = plan_batches(state).rows
    whole = {(r.project_path, r.batch_no): r.prompt for r in B.build_prompts(rows, state.skills, rules, TEMPLATE).collect()}

    def measure(prompts):
        return [f'[{{"title": "T", "steps": "{len(p)} {hash(p[:2000] + p[-2000:])}"}}]' for p in prompts]

    answers = M.ask_model(rows, B.prompt_sections(state.skills, rules), TEMPLATE, lambda ps: [str(len(p)) for p in ps])
    assert {(r.project_path, r.batch_no): r.raw for r in answers.collect()} == {k: str(len(p)) for k, p in whole.items()}
    assert max(map(len, whole.values())) > 9_000_000
    result = distill(state, measure, TEMPLATE)
    assert {r.stat: r.n for r in result.stats.collect()}["batches_failed"] == 0
    limited = distill(state, measure, TEMPLATE, max_prompt_chars=100_000)
    assert {r.stat: r.n for r in limited.stats.collect()}["batches_failed"] == 1


def test_prompt_holds_skills_and_rules(spark):
    state = seven_sessions(spark)
    skills = conform(spark.createDataFrame(
        [("k1", "/p/two", "T", "D", "S", "x,y", ["f1"], {"a.py": ["s"]})],
        "skill_id string, project_path string, title string, description string, steps string, tags string,"
        "facts array<string>, file_map map<string,array<string>>"), SKILLS)
    rules = conform(spark.createDataFrame([("/p/two", "be kind", 1), ("/p/two", "be brief", 2)],
                                          "project_path string, rule_text string, rule_seq long"), RULES)
    prompts = B.build_prompts(plan_batches(state).rows, skills, rules, TEMPLATE)
    got = {(r.project_path, r.batch_no): r for r in prompts.collect()}
    two = got["/p/two", 0].prompt
    assert "[skill_id=k1] T (type=workflow): D\n  Steps: S\n  Tags: x,y\n  Facts: [\"f1\"]\n  FileMap: {\"a.py\":[\"s\"]}" in two
    assert two.endswith("  1. be kind\n  2. be brief")
    one = got["/p/one", 0].prompt
    assert one.startswith("P=/p/one\n--- Session s6 ---") and "skill_id" not in one
    limited = B.build_prompts(plan_batches(state).rows, skills, rules, TEMPLATE, max_prompt_chars=250)
    flags = {(r.project_path, r.batch_no): (r.prompt is None, r.error) for r in limited.collect()}
    assert flags["/p/one", 0] == (True, "prompt too long") and flags["/p/one", 1] == (False, None)


def test_filled_text_is_not_filled_again(spark):
    got = spark.range(1).select(B.fill_template("{a}-{b}-{c}", {"a": F.lit("{b}"), "b": F.lit("x")})).first()[0]
    assert got == "{b}-x-{c}"


def make_stub():
    def stub(prompts):
        import json as j
        out = []
        for p in prompts:
            if "Session t0 -" in p:
                raise RuntimeError("no answer")
            out.append(j.dumps([{"title": "Common", "steps": f"{len(p)}"}, {"title": "Has s6" if "Session s6 -" in p else "Other"}]))
        return out
    return stub


@pytest.mark.parametrize("mode", ["snapshot", "sequential"])
def test_distill_merges_and_moves_marks(spark, mode):
    state = seven_sessions(spark)
    stub_fn = make_stub()
    result = distill(state, stub_fn, TEMPLATE, mode=mode)
    skills = {r.title: r for r in result.skills.collect()}
    assert set(skills) == {"Common", "Has s6", "Other"}
    assert skills["Common"].source_session_ids == ["s6", "s5", "s4", "s3", "s2"]
    stats = {r.stat: r.n for r in result.stats.collect()}
    assert stats == {"projects": 2, "batches": 3, "skills_created": 3, "skills_updated": 1, "batches_failed": 1,
                     "messages_processed": 24, "messages_skipped": 0}
    marks = {r.session_id: r.last_message_id for r in result.progress.collect()}
    assert marks == {f"s{i}": 2 for i in range(7)}  # the failed batch keeps its marks
    state.skills, state.progress = keep(spark, result.skills, SKILLS), keep(spark, result.progress, PROGRESS)
    again = distill(state, stub_fn, TEMPLATE, mode=mode)
    stats = {r.stat: r.n for r in again.stats.collect()}
    assert stats["batches"] == 1 and stats["messages_processed"] == 3 and stats["messages_skipped"] == 21
    assert again.skills.count() == 3


def test_sequential_prompts_see_earlier_batches(spark):
    state = seven_sessions(spark)

    def tell(prompts):
        import json as j
        return [j.dumps([{"title": "seen" if "Steps: first" in p else "fresh", "steps": "first"}]) for p in prompts]

    sequential = distill(state, tell, TEMPLATE, mode="sequential", project="one").skills.collect()
    assert sorted(r.title for r in sequential) == ["fresh", "seen"]
    snapshot = distill(state, tell, TEMPLATE, project="one").skills.collect()
    assert [r.title for r in snapshot] == ["fresh"]


def test_rounds_start_from_tables_of_known_size(spark):
    """Spark's size estimate of a table does not multiply from round to round."""
    state = make_state(spark, [(f"s{i:02}", "/p", i) for i in range(16)], [(f"s{i:02}", 0, "x", None, i) for i in range(16)])
    result = distill(state, lambda prompts: ['[{"title": "T", "steps": "x"}]' for _ in prompts], TEMPLATE, mode="sequential")
    sizes = [len(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for df in (result.skills, result.answers)]
    assert max(sizes) < 12
    assert [r.title for r in result.skills.collect()] == ["T"] and result.answers.count() == 4


def test_model_runs_once_per_prompt(spark, tmp_path):
    state, folder = seven_sessions(spark), str(tmp_path)

    def counted(prompts):
        import os
        import uuid
        for _ in prompts:
            open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        return ['[{"title": "T"}]' for _ in prompts]

    result = distill(state, counted, TEMPLATE)
    result.skills.count(), result.progress.count(), result.stats.count()
    assert len(list(tmp_path.iterdir())) == 3


def test_nothing_to_do(spark):
    state = make_state(spark, [("s", None, 1)], [("s", 0, "x", None, 1)])
    for mode in ("snapshot", "sequential"):
        result = distill(state, lambda prompts: [], TEMPLATE, mode=mode)
        assert result.skills.count() == 0 and result.progress.count() == 0


def test_marks_never_fall(spark):
    old = spark.createDataFrame([("a", "/p", 5, None), ("b", "/p", 1, None)], PROGRESS)
    new = spark.createDataFrame([("a", "/p", 3), ("b", "/p", 4), ("c", "/p", 0)],
                                "session_id string, project_path string, last_message_id long")
    got = {r.session_id: r.last_message_id for r in advance_watermark(old, new).collect()}
    assert got == {"a": 5, "b": 4, "c": 0}


def test_progress_with_marks_inside_blocks(spark):
    messages = [("s", k, "x", None, k) for k in range(0, 5000, 2)] + [("u", 0, None, None, 0)]
    state = make_state(spark, [("s", "/p", 1), ("u", "/p", 1), ("e", "/q", 1)], messages)
    marks = spark.createDataFrame([("s", "/p", 2501, None)], PROGRESS)
    got = {r.project_path: r for r in project_progress(state.sessions, state.messages, marks, state.skills).collect()}
    assert (got["/p"].total_sessions, got["/p"].total_messages, got["/p"].distilled) == (2, 2500, 1251)
    assert got["/q"].pct == 0 and got["/q"].total_sessions == 1
    assert got[None].is_total == 1 and got[None].remaining == 1249
    left = incremental_messages(state.messages, state.sessions, marks)
    assert left.count() == 1249
    assert [r.project_path for r in stale_projects(state.messages, state.sessions, marks).collect()] == ["/p"]


def test_review_adds_rules(spark):
    state = seven_sessions(spark)
    state.skills = conform(spark.createDataFrame([("k1", "/p/one", "T"), ("k2", "/p/none", "U")],
                                                 "skill_id string, project_path string, title string"), SKILLS)
    state.rules = conform(spark.createDataFrame([("/p/one", "Keep tests", 4)],
                                                "project_path string, rule_text string, rule_seq long"), RULES)

    def answer(prompts):
        import json as j
        return [j.dumps([{"rule": " keep TESTS "}, {"rule": "new"}, {"rule": 5}, {"rule": "new"}, {}, "x"]) for _ in prompts]

    result = review(state, answer, "R {project} {conversations} {skills_text}")
    got = sorted((r.project_path, r.rule_text, r.rule_seq > 4, r.source) for r in result.rules.collect())
    assert got == [("/p/none", " keep TESTS ", False, "review"), ("/p/none", "new", False, "review"), ("/p/one", "Keep tests", False, "review"), ("/p/one", "new", True, "review")]
    assert {r.stat: r.n for r in result.stats.collect()} == {"projects": 2, "rules_added": 3, "rules_total": 4}


def test_lists_of_a_prompt_are_read_once(spark):
    """A model that takes parts gets the same prompts, with one object for the lists of all batches of a copy."""
    batches = spark.createDataFrame([("p", n, f"talk {n}") for n in range(40)], "project_path string, batch_no long, conversations string")
    sections = spark.createDataFrame(
        [("p", "skills", n, f"\nskill {n}") for n in range(3)] + [("p", "rules", 0, "\nrule")],
        "project_path string, section string, part_no long, text string")
    told = "{project}: {conversations}{existing_skills_section} end {x}"

    def whole(prompts):
        return [str(p) for p in prompts]

    @M.takes_parts
    def parts(prompts):
        shared = {id(text) for p in prompts for text in p.texts[1:3]}
        return [f"{p}|{len(p) == len(str(p))}|{len(shared)}" for p in prompts]

    asked = {r.batch_no: r.raw for r in M.ask_model(batches, sections, told, whole).collect()}
    assert asked[7] == "p: talk 7\nskill 0\nskill 1\nskill 2\nrule end {x}" and len(asked) == 40
    assert {r.batch_no: r.raw for r in M.ask_model(batches, sections, told, parts).collect()} == {
        n: f"{text}|True|2" for n, text in asked.items()}


def test_copies_of_lists_do_not_grow_with_batches(spark):
    few = B.with_share(spark.range(200).selectExpr("'p' project_path", "id batch_no"))
    assert few.select("share").distinct().count() == 4
    many = B.with_share(spark.range(50_000).selectExpr("'p' project_path", "id batch_no"))
    assert many.select("share").distinct().count() == B.COPIES


def test_long_prompts_leave_the_writer_at_once(spark, tmp_path):
    """Twenty rows of eight million characters are not gathered before the writer looks at its size."""
    import pyarrow.parquet as pq

    spark.range(20, numPartitions=1).selectExpr("id", "concat_ws(',', transform(sequence(0, 999999), x -> hash(x, id))) t").select(
        "id", "t").write.parquet(str(tmp_path / "p"))
    file = next((tmp_path / "p").glob("*.parquet"))
    assert pq.ParquetFile(file).num_row_groups > 1


def sessions_in_a_row(spark, n):
    return make_state(spark, [(f"s{i:03}", "/p", i) for i in range(n)], [(f"s{i:03}", 0, "x", None, i) for i in range(n)])


def test_sequential_jobs_do_not_grow_with_batches(spark):
    def jobs(n):
        spark.sparkContext.setJobGroup(f"turns {n}", "")
        result = distill(sessions_in_a_row(spark, n), lambda ps: ['[{"title": "T", "steps": "x"}]' for _ in ps], TEMPLATE, mode="sequential")
        assert result.answers.count() == -(-n // 5) and [r.title for r in result.skills.collect()] == ["T"]
        spark.sparkContext.setJobGroup("other", "")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"turns {n}"))

    assert jobs(60) <= jobs(10) + 5  # twelve batches and two


def test_items_in_turn(spark):
    """Renames by id, updates by title, taken ids and skills of the same run, as prompts show them and as they are stored."""
    state = sessions_in_a_row(spark, 40)
    state.skills = conform(spark.createDataFrame(
        [("b", "/p", "B", "was b"), ("a", "/p", "A", "was a"), ("a", "/p", "A", "was a"), ("z", "/q", "A", "other")],
        "skill_id string, project_path string, title string, steps string"), SKILLS)
    answers = [
        '[{"skill_id": "a", "title": "B", "steps": "a1"}]',
        '[{"title": "B", "steps": "by title"}, {"title": "A", "steps": "new a"}, 5, {"steps": "no title"}]',
        '[{"skill_id": "b", "title": "C", "facts": ["x"]}, {"title": "B", "steps": "a2"}]',
        "no answer",
        '```json\n[{"title": "A", "steps": "not shown"}, {"title": "D", "steps": "d"}, {"title": "D", "steps": "d2"}]\n```',
        '[{"skill_id": "DID", "title": "E", "steps": "e"}, {"title": "D", "steps": "d"}]',
        '[{"skill_id": "DID", "title": "F", "steps": "f"}, {"title": "D", "steps": "d"}]',
        "[]"]

    def model(prompts):
        import re as r
        out = []
        for p in prompts:
            turn = int(r.search(r"Session s(\d+)", p)[1]) // 5
            seen = sorted(r.findall(r"\[skill_id=\w+\] (\w+) \(type=workflow\): \n  Steps: (.*)", p))
            d = r.search(r"\[skill_id=(\w+)\] [DEF] ", p)
            out.append(answers[turn].replace("DID", d[1] if d else "DID").replace("[{", '[{"narrative": "%s"}, {' % seen, 1))
        return out

    result = distill(state, model, TEMPLATE, mode="sequential")
    told = {r.batch_no: r.raw for r in result.answers.collect()}
    shown = {k: eval(v.split('"')[3]) if "narrative" in v else None for k, v in told.items()}
    start = [("A", "was a"), ("A", "was a"), ("B", "was b")]
    assert shown[0] == start
    assert shown[1] == [("B", "a1"), ("B", "a1"), ("B", "was b")]
    assert shown[2] == [("A", "new a"), ("B", "a1"), ("B", "a1"), ("B", "was b")]
    assert shown[4] == [("A", "new a"), ("B", "a1"), ("B", "a1"), ("C", "")]
    assert shown[5] == [("A", "new a"), ("B", "a1"), ("B", "a1"), ("C", ""), ("D", "d")]
    # the skill named E has the id that D with these steps would get: it is D again
    assert shown[6] == [("A", "new a"), ("B", "a1"), ("B", "a1"), ("C", ""), ("D", "d")]
    skills = sorted((r.project_path, r.title, r.steps, tuple(r.source_session_ids)) for r in result.skills.collect())
    sessions = [tuple(f"s{i:03}" for i in range(k * 5, k * 5 + 5)) for k in range(8)]
    assert skills == [("/p", "A", "not shown", sessions[1]), ("/p", "B", "a2", ()), ("/p", "B", "a2", ()), ("/p", "C", "", ()),
                      ("/p", "D", "d", sessions[4]), ("/q", "A", "other", ())]
    made = {r.title: r.created_at for r in result.skills.where("created_at is not null").collect()}
    assert made["A"] < made["D"]
    stats = {r.stat: r.n for r in result.stats.collect()}
    assert (stats["batches"], stats["batches_failed"], stats["skills_created"]) == (8, 2, 2)


def test_shown_list_of_many_changes():
    import random
    rand, lines = random.Random(3), {}
    keys = sorted((rand.randrange(9), True, f"k{i}") for i in range(50))
    shown = B.ShownList(list(keys), [f"was {k}" for k in keys], per_chunk=4)
    lines = {k: f"was {k}" for k in keys}
    for i in range(400):
        key = rand.choice(list(lines)) if i % 2 else (rand.randrange(-1, 11), True, f"n{i}")
        (shown.replace if key in lines else shown.add)(key, f"line {i}")
        lines[key] = f"line {i}"
        if i % 20 == 0:
            before = shown.texts()
            assert "".join(before) == B.SKILLS_HEADER + "\n\n".join(lines[k] for k in sorted(lines))
    shown.replace(key, "last")
    assert sum(a is b for a, b in zip(before, shown.texts())) > 5  # most texts are the same objects
    assert B.ShownList([], []).texts() == ()


def test_writers_keep_no_copies_of_prompts(spark, tmp_path):
    """Least and greatest values and dictionaries are kept for all columns but the prompt."""
    import pyarrow.parquet as pq

    spark.range(100, numPartitions=1).selectExpr("concat('text ', id % 2) other", "concat('text ', id % 2) prompt").write.parquet(str(tmp_path / "p"))
    group = pq.ParquetFile(next((tmp_path / "p").glob("part-*"))).metadata.row_group(0)
    other, prompt = group.column(0), group.column(1)
    assert other.statistics.has_min_max and other.has_dictionary_page
    assert (prompt.statistics is None or not prompt.statistics.has_min_max) and not prompt.has_dictionary_page
