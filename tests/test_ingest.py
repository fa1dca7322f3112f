import json

from pyspark.sql import functions as F
import pytest

from convolake.schemas import MESSAGES, PATHS, SESSIONS, empty
from convolake.sources.ingest import ingest, normalize_sessions
from convolake.sources.session_logs import read_session_logs

import logs


def nothing(spark):
    return empty(spark, SESSIONS), empty(spark, MESSAGES)


def test_workspaces_resolve_to_projects(spark, tmp_path):
    folders = {"a": {"folder": "file:///a/b"}, "b": {"folder": "/a/b"}, "c": {"folder": "file:///a%20b"},
               "d": {"folder": ""}, "e": {"folder": None}, "f": {}, "g": "bad json", "h": None}
    for name, body in folders.items():
        if body is not None:
            logs.workspace(tmp_path, name, body)
        logs.write(tmp_path, name, "s", logs.session(f"s-{name}"))
    raw = read_session_logs(spark, str(tmp_path))
    got = {r.workspace_id: r.project_path for r in raw.collect()}
    assert got == {"a": "/a/b", "b": "/a/b", "c": "/a%20b", "d": None, "e": None, "f": None, "g": None, "h": None}


def test_empty_root_reads_nothing(spark, tmp_path):
    assert read_session_logs(spark, str(tmp_path)).count() == 0


def test_files_to_sessions_and_messages(spark, tmp_path):
    logs.workspace(tmp_path, "w", {"folder": "/p"})
    logs.write(tmp_path, "w", "good", logs.session("s1", 3))
    logs.write(tmp_path, "w", "stem name", logs.session(None, 1))
    logs.write(tmp_path, "w", "broken", "{not json")
    logs.write(tmp_path, "w", "none", {"sessionId": "x", "requests": []})
    logs.write(tmp_path, "w", "other", {"sessionId": "y"})
    logs.write(tmp_path, "w", "blank", {"sessionId": "blank", "requests": [{"message": {"text": " \n"}}, {"message": None}]})
    logs.write(tmp_path, "w", "twin-b", logs.session("twin", 2))
    logs.write(tmp_path, "w", "twin-a", logs.session("twin", 1))
    sessions, messages = normalize_sessions(read_session_logs(spark, str(tmp_path)))
    assert {r.session_id for r in sessions.collect()} == {"s1", "stem name", "blank", "twin"}
    rows = messages.orderBy("session_id", "msg_seq").collect()
    assert [(r.session_id, r.msg_seq) for r in rows] == [("s1", 0), ("s1", 1), ("s1", 2), ("stem name", 0), ("twin", 0)]
    first = rows[0]
    assert first.user_text == "do 0 in /data/x/0.csv" and first.response_summary == "answer 0"
    assert first.has_paths and not first.has_code and first.ts == 1_700_000_000_000


def test_flags_see_the_whole_response(spark, tmp_path):
    body = {"sessionId": "s", "requests": [{"message": {"text": "q"}, "response": [
        {"kind": "markdownContent", "value": "x" * 6000 + "```"}]}]}
    logs.write(tmp_path, "w", "f", body)
    row = normalize_sessions(read_session_logs(spark, str(tmp_path)))[1].first()
    assert len(row.response_summary) == 5000 and row.has_code


def test_increments_by_session_and_by_message(spark, tmp_path):
    logs.write(tmp_path, "w", "one", logs.session("s1", 2))
    raw = read_session_logs(spark, str(tmp_path))
    first = ingest(raw, *nothing(spark))
    assert {r.stat: r.n for r in first.stats.collect()} == {"sessions_added": 1, "messages_added": 2, "paths_found": 2}
    sessions, messages = spark.createDataFrame(
        first.sessions.collect(), SESSIONS), spark.createDataFrame(first.messages.collect(), MESSAGES)
    again = ingest(raw, sessions, messages)
    assert again.new_messages.count() == 0 and again.new_sessions.count() == 0
    logs.write(tmp_path, "w", "one", logs.session("s1", 4))
    logs.write(tmp_path, "w", "two", logs.session("s2", 1))
    raw = read_session_logs(spark, str(tmp_path))
    by_session = ingest(raw, sessions, messages)
    assert [(r.session_id, r.msg_seq) for r in by_session.new_messages.collect()] == [("s2", 0)]
    by_message = ingest(raw, sessions, messages, grain="message")
    assert sorted((r.session_id, r.msg_seq) for r in by_message.new_messages.collect()) == [("s1", 2), ("s1", 3), ("s2", 0)]
    last = {r.session_id: r.last_message_at for r in by_message.sessions.collect()}
    assert last["s1"] == 1_700_000_004_000 and len(last) == 2
    everything = ingest(raw, sessions, messages, force=True)
    assert everything.messages.count() == 5
    with pytest.raises(ValueError):
        ingest(raw, sessions, messages, grain="file")


def test_paths_upsert_keeps_ids_aliases_and_first_project(spark):
    from convolake.operators import paths as P
    messages = spark.createDataFrame(
        [("s1", 0, 1, "see /a/b and /a/b"), ("s2", 0, 0, "see /a/b /c/d"), ("s3", 0, 5, "/e/f")],
        "session_id string, msg_seq long, ts long, user_text string")
    sessions = spark.createDataFrame([("s1", "/p1"), ("s2", "/p2"), ("s3", None)], "session_id string, project_path string")
    counts = P.path_counts(P.path_references(messages), sessions)
    stored = P.upsert_paths(empty(spark, PATHS), counts)
    got = {r.path: (r.path_id, r.use_count, r.project_path) for r in stored.collect()}
    assert got == {"/a/b": (1, 3, "/p2"), "/c/d": (2, 1, "/p2"), "/e/f": (3, 1, None)}
    named = P.set_alias(stored, {"1": "main", "/c/d": "3"})
    more = P.add_paths(named, spark.createDataFrame(
        [("/a/b", None, "/zz"), ("/g/h", "new", "/p9")], "path string, alias string, project_path string"))
    got = {r.path: (r.path_id, r.alias, r.use_count, r.project_path) for r in more.collect()}
    assert got == {"/a/b": (1, "main", 4, "/p2"), "/c/d": (2, "3", 1, "/p2"), "/e/f": (3, None, 1, None),
                   "/g/h": (4, "new", 1, "/p9")}
    answers = {r.lookup: r.path for r in P.resolve_paths(more, ["3", "main", "A/", "99", "x"]).collect()}
    assert answers == {"3": "/e/f", "main": "/a/b", "A/": "/a/b"}  # an id goes before an alias
    many = spark.range(2000).select(
        (F.col("id") + 10).alias("path_id"), F.format_string("/data/set_%04d/x.csv", "id").alias("path"),
        F.lit(None).cast("string").alias("alias"), F.col("id").alias("use_count"))
    keys = many.select(F.expr("upper(substr(path, 7, 10))").alias("lookup"))  # one key for each stored path
    found = P.resolve_paths(many, keys)
    assert found.count() == 2000 and found.where("upper(path) not like concat('%', lookup, '%')").count() == 0
    wild = {r.lookup: r.path for r in P.resolve_paths(many, ["set%_1999", "%", "_et_0007", "", "no\\pe"]).collect()}
    assert wild == {"set%_1999": "/data/set_1999/x.csv", "%": "/data/set_1999/x.csv", "_et_0007": "/data/set_0007/x.csv", "": "/data/set_1999/x.csv"}


def test_caps_can_be_lifted(spark):
    from convolake.functions.responses import CAPS, WHOLE
    from convolake.operators import batches
    from convolake.functions.text import truncate_salient

    long = "z" * 7000
    items = [{"kind": "thinking", "value": long}, {"kind": "markdownContent", "value": long},
             {"kind": "toolInvocationSerialized", "toolId": "t", "resultDetails": {"input": "i", "output": [{"value": long}]}},
             {"kind": "toolInvocationSerialized", "toolSpecificData": {
                 "kind": "terminal", "commandLine": {"original": "ls"}, "terminalCommandOutput": {"text": long}}}]
    body = json.dumps({"sessionId": "s", "requests": [{"message": {"text": "q"}, "response": items}]})
    raw = spark.createDataFrame([("w", "f.json", body, "p")], "workspace_id string, file_path string, body string, project_path string")
    whole = normalize_sessions(raw, caps=WHOLE)[1].first()["response_summary"]
    assert whole == "\n".join([f"[thinking] {long}", long, "[tool:t] input: i", f"[tool-output] {long}", "[cmd] ls", f"[output] {long}"])
    assert len(normalize_sessions(raw, caps=CAPS)[1].first()["response_summary"]) == 5000
    text = spark.createDataFrame([(f"[cmd] {long}\n[output] {long}\n{long}",)], "c string")
    assert text.select(truncate_salient(F.col("c"), None)).first()[0] == text.first()[0]
    assert text.select(truncate_salient(F.col("c"), 10**6, None, None, None)).first()[0] == text.first()[0]
    assert len(text.select(truncate_salient(F.col("c"))).first()[0]) == 300 + 1 + 150
    assert batches.WHOLE.user is None and batches.CAPS.user == 200
