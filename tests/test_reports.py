from convolake.operators import filters as X
from convolake.operators import reports as R
from convolake.schemas import MESSAGES, SESSIONS, SKILLS, conform


def tables(spark):
    sessions = conform(spark.createDataFrame(
        [("abc1", "/h/u/One", 10), ("abc2", "/h/u/Two", None), ("ab", None, 20)],
        "session_id string, project_path string, last_message_at long"), SESSIONS)
    messages = conform(spark.createDataFrame(
        [("abc1", 0, "Find THIS", None, 5), ("abc1", 1, "x", "r" * 600, None), ("ab", 0, None, "has this", 7)],
        "session_id string, msg_seq long, user_text string, response_summary string, ts long"), MESSAGES)
    return sessions, messages


def test_session_lists(spark):
    sessions, messages = tables(spark)
    got = [(r.session_id, r.messages, r.project, r.last_date) for r in R.list_sessions(sessions, messages, home="/h/u").collect()]
    assert got == [("ab", 1, "", "1970-01-01"), ("abc1", 2, "~/One", "1970-01-01"), ("abc2", 0, "~/Two", "")]
    assert [r.session_id for r in R.list_sessions(sessions, messages, "one", limit=1).collect()] == ["abc1"]


def test_transcript_finds_exact_id_first(spark):
    sessions, messages = tables(spark)
    assert [r.session_id for r in X.by_id_prefix(sessions, "session_id", "ab").collect()] == ["ab"]
    rows = R.session_transcript(sessions, messages, "ABC").collect()
    assert [r.msg_seq for r in rows] == [1, 0]  # a message without a time comes first
    assert rows[0].response == "r" * 500 + "…"
    assert R.session_transcript(sessions, messages, "zz").count() == 0


def test_grep(spark):
    sessions, messages = tables(spark)
    got = [(r.session_id, r.project, r.prompt) for r in R.grep_history(messages, sessions, "this").collect()]
    assert got == [("ab", "unknown", None), ("abc1", "One", "Find THIS")]
    assert R.grep_history(messages, sessions, "th_s").count() == 2
    assert R.grep_history(messages, sessions, "th_s", literal=True).count() == 0
    assert R.grep_history(messages, sessions, "this", project="one").count() == 1


def test_counts_and_skills(spark):
    sessions, messages = tables(spark)
    skills = conform(spark.createDataFrame([("k1", "/h/u/One", "T", ["f"]), ("k2", None, "U", None)],
                                           "skill_id string, project_path string, title string, facts array<string>"), SKILLS)
    assert {r.table_name: r.total for r in R.status_totals(a=sessions, b=messages).collect()} == {"a": 3, "b": 3}
    assert [(r.project_path, r.skills) for r in R.skills_per_project(skills, keep_null=True).collect()] == [(None, 1), ("/h/u/One", 1)]
    assert R.skills_per_project(skills).count() == 1
    assert {r.project_path: (r.sessions, r.messages) for r in R.project_picker(sessions, messages).collect()} == {
        "/h/u/One": (1, 2), "/h/u/Two": (1, 0)}
    assert "Facts: f\n" in R.skill_detail(skills, "k1").first().detail
    assert "Project: global" in R.skill_detail(skills, "k2").first().detail
    marked = R.mark_one_off(skills, skills.where("skill_id = 'k1'").select("skill_id"))
    assert {r.skill_id: r.recurring for r in marked.collect()} == {"k1": False, "k2": True}
