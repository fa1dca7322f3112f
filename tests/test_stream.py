import datetime as dt
import time
import uuid

import pytest

from convolake.operators.bursts import burst_windows, change_bursts
from convolake.operators.render import render_instructions, skill_documents
from convolake.plans.pipeline import reload_pipeline, run_pipeline
from convolake.sources.session_logs import read_session_logs, stream_session_logs
from convolake.schemas import SESSIONS, SKILLS, conform
from convolake.sources.tables import (
    Run, RunConflict, forget_snapshots, load_state, read_snapshot, write_documents, write_skill_documents, write_table)
from convolake.sources import ledger
from convolake.streaming.pipeline import poll_logs, start_pipeline

import logs

TEMPLATE = "{project}\n{conversations}{existing_skills_section}"


def answer_fn():
    def answer(prompts):
        return ['[{"title": "Work", "steps": "go"}]' for _ in prompts]
    return answer


def fill(root):
    logs.workspace(root, "w1", {"folder": "file:///proj/one"})
    logs.write(root, "w1", "a", logs.session("a", 2))


def texts(folder):
    return {p.parent.name: p.read_text() for p in sorted(folder.rglob("*.txt"))}


def test_stream_takes_new_files_once(spark, tmp_path):
    source, store = tmp_path / "logs", tmp_path / "store"
    fill(source)

    def run():
        stream = stream_session_logs(spark, str(source))
        query = start_pipeline(stream, str(store), str(tmp_path / "check"), model_fn=answer_fn(), template=TEMPLATE)
        query.awaitTermination(120)
        assert query.exception() is None
        return load_state(spark, str(store))

    state = run()
    assert state.messages.count() == 2 and state.sessions.count() == 1
    assert [(r.title, r.project_path) for r in state.skills.collect()] == [("Work", "/proj/one")]
    assert [(r.session_id, r.last_message_id) for r in state.progress.collect()] == [("a", 1)]
    assert {r.path: r.use_count for r in state.paths.collect()} == {"/data/x/0.csv": 1, "/data/x/1.csv": 1}
    pages = texts(store / "documents" / "instructions")
    assert len(pages) == 1 and "### Work" in list(pages.values())[0]
    assert run().messages.count() == 2  # nothing new
    logs.write(source, "w1", "b", logs.session("b", 1))
    state = run()
    assert state.messages.count() == 3 and state.skills.count() == 1
    assert {r.path: r.use_count for r in state.paths.collect()}["/data/x/0.csv"] == 2


def test_running_a_batch_again_changes_nothing(spark, tmp_path):
    source, store = tmp_path / "logs", str(tmp_path / "store")
    fill(source)
    raw = read_session_logs(spark, str(source))
    for _ in range(2):
        assert run_pipeline(spark, store, raw, 0, answer_fn(), TEMPLATE)
        state = load_state(spark, store)
        assert state.messages.count() == 2 and state.skills.count() == 1 and state.paths.count() == 2
    assert not run_pipeline(spark, store, raw, 1, answer_fn(), TEMPLATE)
    assert load_state(spark, store).skills.count() == 1


def test_reload_keeps_skills_and_counts_paths_anew(spark, tmp_path):
    source, store, again = tmp_path / "logs", str(tmp_path / "store"), str(tmp_path / "again")
    fill(source)
    run_pipeline(spark, store, read_session_logs(spark, str(source)), 0, answer_fn(), TEMPLATE, render=False)
    logs.write(source, "w1", "a", logs.session("a", 3))
    reload_pipeline(spark, store, read_session_logs(spark, str(source)), again)
    state = load_state(spark, again)
    assert state.messages.count() == 3 and state.skills.count() == 1 and state.progress.count() == 0
    assert {r.path: (r.path_id, r.use_count) for r in state.paths.collect()} == {
        "/data/x/0.csv": (1, 1), "/data/x/1.csv": (2, 1), "/data/x/2.csv": (3, 1)}


def test_a_failed_step_loses_nothing(spark, tmp_path):
    source, store = tmp_path / "logs", tmp_path / "store"
    fill(source)
    seen = []

    def run(model_fn):
        query = start_pipeline(
            stream_session_logs(spark, str(source)), str(store), str(tmp_path / "check"), model_fn=model_fn,
            template=TEMPLATE, on_error=lambda number, error: seen.append((number, type(error).__name__)))
        query.awaitTermination(120)
        return load_state(spark, str(store))

    state = run("no function")
    assert state.progress.count() == 0 and state.paths.count() == 2 and state.messages.count() == 2
    logs.write(source, "w1", "b", logs.session("b", 1))
    state = run(answer_fn())  # the first run's messages are distilled, its paths were counted
    assert {r.path: r.use_count for r in state.paths.collect()} == {"/data/x/0.csv": 2, "/data/x/1.csv": 1}
    assert sorted((r.session_id, r.last_message_id) for r in state.progress.collect()) == [("a", 1), ("b", 0)]


def test_steps_fail_apart(spark, tmp_path):
    source, store = tmp_path / "logs", str(tmp_path / "store")
    fill(source)
    seen = []
    run_pipeline(spark, store, read_session_logs(spark, str(source)), 0, answer_fn(), None,
                 on_error=lambda step, error: seen.append((step, type(error).__name__)))
    assert seen == [("distill", "ValueError")]
    assert load_state(spark, store).paths.count() == 2 and (tmp_path / "store" / "documents" / "skills").exists()


def test_one_run_distils_a_long_session(spark, tmp_path):
    source, store = tmp_path / "logs", str(tmp_path / "store")
    logs.workspace(source, "w1", {"folder": "file:///proj/one"})
    logs.write(source, "w1", "a", logs.session("a", 100))
    raw = read_session_logs(spark, str(source))
    sent = tmp_path / "sent"
    sent.mkdir()

    def answer(prompts):
        for prompt in prompts:
            (sent / uuid.uuid4().hex).write_text(prompt)
        return ['[{"title": "Work", "steps": "go"}]' for _ in prompts]

    assert run_pipeline(spark, store, raw, 0, answer, TEMPLATE, render=False)
    assert [(r.session_id, r.last_message_id) for r in load_state(spark, store).progress.collect()] == [("a", 99)]
    lines = [line for p in sent.iterdir() for line in p.read_text().split("\n") if line.startswith("USER: ")]
    assert sorted(lines) == sorted(f"USER: do {i} in /data/x/{i}.csv" for i in range(100))
    assert not run_pipeline(spark, store, raw, 1, answer, TEMPLATE, render=False)


def test_an_idle_run_asks_failed_batches_again(spark, tmp_path):
    source, store = tmp_path / "logs", str(tmp_path / "store")
    fill(source)
    raw = read_session_logs(spark, str(source))
    run_pipeline(spark, store, raw, 0, lambda prompts: ["no items" for _ in prompts], TEMPLATE, render=False)
    assert load_state(spark, store).progress.count() == 0
    assert not run_pipeline(spark, store, raw, 1, lambda prompts: ["no items" for _ in prompts], TEMPLATE, render=False)
    assert run_pipeline(spark, store, raw, 2, answer_fn(), TEMPLATE, render=False)
    state = load_state(spark, store)
    assert [(r.session_id, r.last_message_id) for r in state.progress.collect()] == [("a", 1)]
    assert state.skills.count() == 1 and state.paths.count() == 2 and state.messages.count() == 2


def test_requests_appended_to_a_known_file(spark, tmp_path):
    source, store = tmp_path / "logs", str(tmp_path / "store")
    fill(source)
    run_pipeline(spark, store, read_session_logs(spark, str(source)), 0, grain="message")
    first = load_state(spark, store).sessions.collect()
    logs.write(source, "w1", "a", logs.session("a", 5))
    run_pipeline(spark, store, read_session_logs(spark, str(source), modified_after="2020-01-01T00:00:00"), 1, grain="message")
    state = load_state(spark, store)
    assert state.messages.count() == 5 and len(first) == state.sessions.count() == 1
    assert state.sessions.first().last_message_at >= first[0].last_message_at
    assert read_session_logs(spark, str(source), modified_after="2100-01-01T00:00:00").count() == 0


def test_polling_takes_grown_files(spark, tmp_path):
    source, store = tmp_path / "logs", str(tmp_path / "store")
    fill(source)
    query = poll_logs(spark, str(source), store, str(tmp_path / "check"), "1 second", render=False)
    try:
        for n in (2, 4):
            logs.write(source, "w1", "a", logs.session("a", n))
            for _ in range(60):
                if load_state(spark, store).messages.count() == n:
                    break
                time.sleep(1)
            assert load_state(spark, store).messages.count() == n
    finally:
        query.stop()


def test_written_documents_are_their_content(spark, tmp_path):
    columns = "skill_id string, project_path string, title string"
    skills = conform(spark.createDataFrame([("k1", "/a/web", "Fix it"), ("k2", "/b/web", "Fix it"), ("k3", "/b/web/", "Fix it")], columns), SKILLS)
    made = skill_documents(skills)
    write_skill_documents(made, str(tmp_path / "skills"))
    assert sorted(p.read_text() for p in (tmp_path / "skills").rglob("*.txt")) == sorted(r.content for r in made.collect())
    pages = render_instructions(skills, "now")
    write_documents(pages, str(tmp_path / "pages"))
    assert sorted(p.read_text() for p in (tmp_path / "pages").rglob("*.txt")) == sorted(r.content for r in pages.collect())


T0 = dt.datetime(2024, 1, 1)
EVENTS = [(0, "f1", "a"), (10, "f1", "a"), (39, "f2", "a"), (70, "f3", "a"), (5, "f9", "b"), (200, "f1", "a"), (230, "f1", "a")]


def event_rows():
    return [(T0 + dt.timedelta(seconds=s), f, k) for s, f, k in EVENTS]


def test_bursts(spark):
    df = spark.createDataFrame(event_rows(), "ts timestamp, file string, k string")
    got = sorted((r.key, (r.burst_start - T0).seconds, (r.last_change - T0).seconds, r.n_changes, r.n_files)
                 for r in change_bursts(df, "30 seconds", "k").collect())
    assert got == [("a", 0, 39, 3, 2), ("a", 70, 70, 1, 1), ("a", 200, 230, 2, 1), ("b", 5, 5, 1, 1)]
    everything = sorted((r.burst_start - T0).seconds for r in change_bursts(df, "30 seconds").collect())
    assert everything == [0, 70, 200]


def test_streamed_bursts_equal_batch_bursts(spark, tmp_path):
    folder = str(tmp_path / "events")
    closing = [(T0 + dt.timedelta(seconds=9999), "end", "z")]
    schema = "ts timestamp, file string, k string"
    spark.createDataFrame(event_rows(), schema).coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(schema).parquet(folder)
    sink, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        burst_windows(stream, "30 seconds", "k").writeStream.format("parquet").option(
            "checkpointLocation", check).trigger(availableNow=True).start(sink).awaitTermination(120)

    run()
    spark.createDataFrame(closing, schema).coalesce(1).write.mode("append").parquet(folder)
    run()
    got = sorted((r.key, r.burst_start, r.last_change, r.n_changes) for r in spark.read.parquet(sink).collect())
    batch = change_bursts(spark.createDataFrame(event_rows(), schema), "30 seconds", "k")
    assert got == sorted((r.key, r.burst_start, r.last_change, r.n_changes) for r in batch.collect())


def test_the_ledger_knows_what_was_read(spark, tmp_path):
    import os

    source, store = tmp_path / "logs", str(tmp_path / "store")
    fill(source)
    logs.write(source, "w1", "odd [x] {1,2} 100%+é", logs.session("b", 1))

    def poll(number):
        raw, seen = ledger.read_changed_logs(spark, str(source), ledger.read_ledger(spark, store))
        names = sorted(r["file_path"].rsplit("/", 1)[1] for r in seen.collect())
        assert sorted(r["file_path"].rsplit("/", 1)[1] for r in raw.collect()) == names
        run_pipeline(spark, store, raw, number, grain="message")
        if names:
            ledger.write_ledger(seen, store, number)
        return names, load_state(spark, store).messages.count()

    assert poll(0) == (["a.json", "odd [x] {1,2} 100%+é.json"], 3)
    assert poll(1) == ([], 3)  # as after a restart: nothing is kept outside the ledger
    logs.write(source, "w1", "a", logs.session("a", 5))
    logs.write(source, "w1", "old", logs.session("c", 4))
    os.utime(source / "w1" / "chatSessions" / "old.json", (1_500_000_000, 1_500_000_000))
    assert poll(2) == (["a.json", "old.json"], 10)
    assert poll(3) == ([], 10)
    raw, seen = ledger.read_changed_logs(spark, str(tmp_path / "none"), ledger.read_ledger(spark, str(tmp_path / "none")))
    assert raw.count() == seen.count() == 0


def rows_of(state):
    return {name: sorted(map(repr, getattr(state, name).collect())) for name in vars(state)}


def test_a_run_that_stops_after_any_write_shows_nothing(spark, tmp_path, monkeypatch):
    source, store = tmp_path / "logs", str(tmp_path / "store")
    fill(source)
    run_pipeline(spark, store, read_session_logs(spark, str(source)), 0, answer_fn(), TEMPLATE, render=False)
    old = rows_of(load_state(spark, store))
    logs.write(source, "w1", "b", logs.session("b", 3))
    raw = read_session_logs(spark, str(source))
    write = Run._write
    for allowed in range(5):  # messages, sessions, paths, progress, skills
        done = []

        def stopping(self, name, df):
            written = write(self, name, df)
            done.append(name)
            if len(done) > allowed:
                raise RuntimeError("stopped")
            return written

        monkeypatch.setattr(Run, "_write", stopping)
        with pytest.raises(RuntimeError, match="stopped"):
            run_pipeline(spark, store, raw, 1, answer_fn(), TEMPLATE, render=False)
        assert rows_of(load_state(spark, store)) == old and read_snapshot(spark, store).version == 1
    monkeypatch.setattr(Run, "_write", write)
    held = load_state(spark, store)  # a reader that goes on while the next run publishes
    assert run_pipeline(spark, store, raw, 1, answer_fn(), TEMPLATE, render=False)
    assert rows_of(held) == old
    state = load_state(spark, store)
    assert state.messages.count() == 5 and state.sessions.count() == 2 and state.progress.count() == 2
    new = rows_of(state)
    assert forget_snapshots(spark, store, keep=1) > 5 and rows_of(load_state(spark, store)) == new
    assert forget_snapshots(spark, store, keep=1) == 0


def test_of_two_runs_at_once_one_is_refused(spark, tmp_path):
    store = str(tmp_path / "store")
    session = spark.range(1).selectExpr("'a' session_id", "'/p' project_path")
    runs = [Run(spark, store, 0), Run(spark, store, 1)]
    for run in runs:
        run.append("sessions", conform(session, SESSIONS))
    runs[0].publish()
    with pytest.raises(RunConflict):
        runs[1].publish()
    assert read_snapshot(spark, store).batch == 0 and load_state(spark, store).sessions.count() == 1
    assert not list((tmp_path / "store" / "manifests").glob("*.tmp"))
    Run(spark, store, 4).publish()  # nothing changed, nothing published
    assert read_snapshot(spark, store).version == 1
    later = Run(spark, store, 4)
    later.append("sessions", conform(session.selectExpr("session_id", "'/q' project_path"), SESSIONS))
    later.publish()
    assert [r.project_path for r in load_state(spark, store).sessions.collect()] == ["/q"]
    assert [r.project_path for r in load_state(spark, store, before=4).sessions.collect()] == ["/p"]
    with pytest.raises(ValueError, match="older"):
        Run(spark, store, 3)
    with pytest.raises(ValueError):
        forget_snapshots(spark, store, keep=0)


def test_tables_without_manifest_are_taken_over(spark, tmp_path):
    store = str(tmp_path / "store")
    for batch, project in ((2, "/p"), (10, "/q")):
        session = spark.range(1).selectExpr("'a' session_id", f"'{project}' project_path")
        write_table(conform(session, SESSIONS), store, "sessions", batch)
        write_table(conform(spark.range(1).selectExpr(f"'k{batch}' skill_id"), SKILLS), store, "skills", batch)
    state = load_state(spark, store)
    assert [r.project_path for r in state.sessions.collect()] == ["/q"]
    assert [r.skill_id for r in state.skills.collect()] == ["k10"]
    run = Run(spark, store, 11)
    run.append("sessions", conform(spark.range(1).selectExpr("'b' session_id"), SESSIONS))
    run.publish()
    assert load_state(spark, store).sessions.count() == 2 and load_state(spark, store).skills.count() == 1


def test_new_folders_are_read_as_folders(spark, tmp_path, monkeypatch):
    """Files of a folder without a known file are not named one by one; in other folders new ones are."""
    asked = []
    read = ledger.read_files

    def spy(spark, root, names, folders=(), pattern="*"):
        asked.append((len(names), len(folders)))
        return read(spark, root, names, folders, pattern)

    monkeypatch.setattr(ledger, "read_files", spy)
    store, source = str(tmp_path / "store"), tmp_path / "logs"

    def put(folder, name):
        (source / folder / "chatSessions").mkdir(parents=True, exist_ok=True)
        (source / folder / "chatSessions" / name).write_text(f"{folder} {name}")

    def poll(batch):
        raw, seen = ledger.read_changed_logs(spark, str(source), ledger.read_ledger(spark, store))
        ledger.write_ledger(seen, store, batch)
        return sorted(r.body for r in raw.collect())

    for n in range(5):
        put("w 1%", f"a+{n}.json")
    put("w 1%", "other.txt")
    assert poll(0) == [f"w 1% a+{n}.json" for n in range(5)]
    put("w 1%", "b[1].json")
    put("w{2}", "c.json")
    assert poll(1) == ["w 1% b[1].json", "w{2} c.json"]
    assert poll(2) == []
    assert asked == [(0, 1), (1, 1), (0, 0)]
