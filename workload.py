"""Every registered query: the Spark job, and the same result as DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import fixtures as X
from convolake.functions.answers import json_list, json_map
from convolake.functions.responses import WHOLE
from convolake.functions.text import content_id, truncate_salient
from convolake.operators import batches as B
from convolake.operators import bursts, merge, model, paths, progress, render, reports, rules, search
from convolake.plans.distill import distill, plan_batches
from convolake.plans.pipeline import reload_pipeline, run_pipeline
from convolake.plans.review import review, review_prompts
from convolake.schemas import PATHS, empty
from convolake.session import ensure_checkpoint_dir, tune
from convolake.sources import ingest as I
from convolake.sources import ledger
from convolake.sources.tables import State, load_state, read_snapshot

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

AS_OF = "2024-02-01 00:00 UTC"
SEARCH_TEXT = "That onesen erblest eranenes whou"
GREP_TEXT = "Onesen"
TEMPLATE = "Project {project}\n\n{conversations}{existing_skills_section}\n\nAnswer with a JSON array."
REVIEW_TEMPLATE = "Review {project}\n\n{conversations}{skills_text}"


class Tables:
    """The input tables of one scale, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = tune(spark), sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("skills", "incoming", "rules", "session_logs", "model_output"):
            return getattr(X, name)(self.spark, self.sf_dir)
        if f"f_{name}" in X.TABLES:
            return X.table(self.spark, self.sf_dir, f"f_{name}")
        return X.driver_table(self.spark, self.sf_dir, name)

    def state(self) -> State:
        marked = F.current_timestamp()
        return State(self.sessions, self.messages, empty(self.spark, PATHS), self.skills, self.rules,
                     self.progress.withColumn("distilled_at", marked))


def query(sql: str | None = None, needs: str = ""):
    """Register a job under its name; ``needs`` are the derived tables its SQL reads."""
    def register(job: Callable[[Tables], DataFrame]):
        QUERIES[job.__name__] = lambda spark, sf_dir: job(Tables(spark, sf_dir))
        if sql is not None:
            head = X.duckdb_with(*needs.split()) if needs else ""
            body = sql.strip()
            if head and body.startswith("with "):
                body = "," + body[len("with "):]
            SQL[job.__name__] = f"{head}\n{body}" if head else body
        return job
    return register


# -- progress and reports -----------------------------------------------------

@query("""
with p as (
  select s.project_path, count(distinct s.session_id) ts, count(m.session_id) tm,
    count(case when m.msg_seq <= g.last_message_id then 1 end) td
  from f_sessions s left join f_messages m on m.session_id = s.session_id and m.user_text is not null
    left join f_progress g on g.session_id = s.session_id and g.project_path = s.project_path
  where s.project_path is not null group by s.project_path),
k as (select project_path, count(*) n from f_skills group by project_path)
select p.project_path, cast(grouping(p.project_path) as integer) is_total, cast(sum(ts) as bigint) total_sessions,
  cast(sum(tm) as bigint) total_messages, cast(sum(td) as bigint) distilled,
  cast(sum(tm) - sum(td) as bigint) remaining,
  case when sum(tm) > 0 then round(sum(td) / sum(tm) * 100, 6) else 0 end pct,
  cast(coalesce(sum(n), 0) as bigint) skills
from p left join k on k.project_path = p.project_path group by rollup (p.project_path)
""", "f_sessions f_messages f_progress f_skills")
def project_progress(t):
    return progress.project_progress(t.sessions, t.messages, t.progress, t.skills)


@query("""
with p as (select count(*) n from (select distinct unnest(regexp_extract_all(user_text, '(?:/[\\p{L}\\p{N}_.-]+){2,}')) from f_messages))
select 'sessions' table_name, count(*) total from f_sessions union all
select 'messages', count(*) from f_messages union all
select 'skills', count(*) from f_skills union all select 'paths', n from p
""", "f_sessions f_messages f_skills")
def status_totals(t):
    found = paths.path_references(t.messages).select("path").distinct()
    return reports.status_totals(sessions=t.sessions, messages=t.messages, skills=t.skills, paths=found)


@query("""
select project_path, count(*) sessions from f_sessions where project_path is not null
group by project_path order by 2 desc, 1 limit 5""", "f_sessions")
def top_projects(t):
    return reports.top_projects(t.sessions)


@query("""
select s.project_path, count(distinct s.session_id) sessions, count(m.session_id) messages
from f_sessions s left join f_messages m on m.session_id = s.session_id
where s.project_path is not null group by s.project_path""", "f_sessions f_messages")
def project_picker(t):
    return reports.project_picker(t.sessions, t.messages)


@query("""
select session_id, substr(session_id, 1, 12) short_id,
  (select count(*) from f_messages m where m.session_id = s.session_id) messages,
  replace(coalesce(project_path, ''), '/home/dev', '~') project,
  strftime(make_timestamp(last_message_at * 1000), '%Y-%m-%d') last_date
from f_sessions s order by last_message_at desc nulls last, session_id limit 20""", "f_sessions f_messages")
def sessions_list(t):
    return reports.list_sessions(t.sessions, t.messages, home="/home/dev")


@query("""
with c as (select session_id from f_sessions where session_id = 's00000' or session_id like 's00000%'
  order by session_id <> 's00000', session_id limit 1)
select m.session_id, msg_seq, ts, user_text,
  case when length(response_summary) > 500 then concat(substr(response_summary, 1, 500), '…') else response_summary end response
from f_messages m semi join c on m.session_id = c.session_id order by ts nulls first, msg_seq limit 50
""", "f_sessions f_messages")
def session_transcript(t):
    return reports.session_transcript(t.sessions, t.messages, "s00000")


@query(f"""
select m.session_id, msg_seq, ts, substr(user_text, 1, 150) prompt, substr(coalesce(response_summary, ''), 1, 200) response,
  case when coalesce(project_path, '') = '' then 'unknown' else regexp_extract(project_path, '[^/]*$') end project
from f_messages m join f_sessions s on s.session_id = m.session_id
where lower(user_text) like '%{GREP_TEXT.lower()}%' or lower(response_summary) like '%{GREP_TEXT.lower()}%'
order by ts desc nulls last, m.session_id, msg_seq limit 20""", "f_sessions f_messages")
def history_grep(t):
    return reports.grep_history(t.messages, t.sessions, GREP_TEXT)


@query("""
select skill_id, substr(skill_id, 1, 10) short_id, title, tags, substr(description, 1, 50) summary, project_path project
from f_skills where project_path like '%proj_%'""", "f_skills")
def skills_list(t):
    return reports.list_skills(t.skills, "PROJ_")


@query("select project_path, count(*) skills from f_skills group by project_path", "f_skills")
def skills_per_project(t):
    return reports.skills_per_project(t.skills)


@query("""
select skill_id, concat(title, chr(10), chr(10), description, chr(10), chr(10), 'Type: ', obs_type, chr(10), 'Tags: ', tags, chr(10),
  'Project: ', project_path, chr(10), chr(10),
  case when len(facts) > 0 then concat('Facts: ', array_to_string(facts, ', '), chr(10)) else '' end,
  'Concepts: ', array_to_string(concepts, ', '), chr(10), 'Files read: ', array_to_string(files_read, ', '), chr(10),
  'Files modified: ', array_to_string(files_modified, ', '), chr(10), chr(10), 'Steps:', chr(10), steps) detail
from f_skills where skill_id like 'a%' order by skill_id limit 1""", "f_skills")
def skill_detail(t):
    return reports.skill_detail(t.skills, "a")


# -- ingest -------------------------------------------------------------------

@query("""
select s.session_id, s.workspace_id, s.project_path, s.created_at, s.last_message_at
from f_sessions s anti join f_progress p on p.session_id = s.session_id
where s.session_id in (select session_id from f_messages)""", "f_sessions f_messages f_progress")
def new_sessions(t):
    known = t.sessions.join(t.progress, "session_id", "left_semi")
    taken = I.ingest(t.session_logs, known, t.messages.limit(0))
    return taken.new_sessions.drop("ingested_at")


@query("""
select session_id, workspace_id, project_path, created_at, last_message_at
from f_sessions where session_id in (select session_id from f_messages)""", "f_sessions f_messages")
def ingest_sessions(t):
    return I.normalize_sessions(t.session_logs)[0].drop("ingested_at")


_TRIMMED = "substr(regexp_replace(ntext, '^\\s+|\\s+$', '', 'g'), 1, 500)"
_FLATTENED = f"""case when nrole = 'assistant' and conv_id % 3 = 0 then
  concat('[cmd] python run_', conv_id % 5, '.py --n ', msg_seq, chr(10), '[output exit=0] ', {_TRIMMED}, chr(10),
         '[edit] /data/set_', conv_id % 13, '/run.py (1 change(s))', chr(10), ntext)
  when nrole = 'assistant' then ntext end"""


@query(f"""
select session_id, (row_number() over (partition by session_id order by msg_seq)) - 1 msg_seq, user_text,
  substr({_FLATTENED}, 1, 5000) response_summary, ts,
  contains(user_text, '```') or coalesce(contains({_FLATTENED}, '```'), false) has_code,
  regexp_matches(user_text, '(?:/[\\p{{L}}\\p{{N}}_.-]+){{2,}}') has_paths
from f_messages""", "f_messages")
def ingest_messages(t):
    return I.normalize_sessions(t.session_logs)[1]


_WHOLE = _FLATTENED.replace("substr(", "", 1).replace(", 1, 500)", "", 1)


@query(f"""
select session_id, (row_number() over (partition by session_id order by msg_seq)) - 1 msg_seq, {_WHOLE} response_summary
from f_messages""", "f_messages")
def ingest_messages_whole(t):
    """Responses stored without any cap."""
    return I.normalize_sessions(t.session_logs, caps=WHOLE)[1].select("session_id", "msg_seq", "response_summary")


@query(f"""
with halves as (select m.session_id, m.conv_id, row_number() over (partition by m.session_id order by msg_seq) - 1 msg_seq, m.user_text
  from f_messages m)
select session_id, msg_seq, user_text, cast(1 + conv_id % 2 as integer) poll, cast(0 as bigint) reopened from halves""", "f_messages")
def logs_polled(t):
    """Log files written in two waves, polled after each with the ledger of the polls before, and once more."""
    root = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/logs-{uuid.uuid4().hex}"
    store = f"{root}-store"
    odd = F.substring("session_id", 2, 20).cast("long") % 2
    bodies = t.session_logs.select(F.regexp_extract("file_path", r"([^/]+)\.json$", 1).alias("session_id"), "body")
    polled = []
    for wave in (0, 1, None):
        if wave is not None:
            one_each = bodies.where(odd == wave).select(F.col("body").alias("value")).repartition(
                max(8, t.spark.sparkContext.defaultParallelism))
            # tasks put their files in place themselves, not the driver one by one
            one_each.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(f"{root}/w{wave}/chatSessions")
        raw, seen = ledger.read_changed_logs(t.spark, root, ledger.read_ledger(t.spark, store), "*/chatSessions/*.txt")
        if wave is not None:
            ledger.write_ledger(seen, store, wave)
            polled.append(I.normalize_sessions(raw)[1].select("session_id", "msg_seq", "user_text", F.lit(wave + 1).alias("poll")))
        else:
            reopened = raw.count()
    return polled[0].unionByName(polled[1]).withColumn("reopened", F.lit(reopened))


@query("""
with n as (select m.* from f_messages m anti join f_progress p on p.session_id = m.session_id)
select 'sessions_added' stat, count(distinct session_id) n from n union all
select 'messages_added', count(*) from n union all
select 'paths_found', cast(sum(len(regexp_extract_all(user_text, '(?:/[\\p{L}\\p{N}_.-]+){2,}'))) as bigint) from n
""", "f_messages f_progress")
def ingest_stats(t):
    known = t.sessions.join(t.progress, "session_id", "left_semi")
    return I.ingest(t.session_logs, known, t.messages.limit(0)).stats


@query("""
select session_id, msg_seq, contains(user_text, '```') or coalesce(contains(response_summary, '```'), false) has_code,
  regexp_matches(user_text, '(?:/[\\p{L}\\p{N}_.-]+){2,}') has_paths,
  cast(len(regexp_extract_all(user_text, '```')) as integer) fences
from f_messages""", "f_messages")
def message_flags(t):
    return I.message_flags(t.messages)


# -- paths --------------------------------------------------------------------

_REFS = """refs as (select session_id, msg_seq, ts, unnest(range(len(p))) pos, unnest(p) path
  from (select *, regexp_extract_all(user_text, '(?:/[\\p{L}\\p{N}_.-]+){2,}') p from f_messages))"""
_COUNTS = """(select path, count(*) use_count,
  arg_min(coalesce(project_path, '?'), (ts, r.session_id, msg_seq, pos)) project_path
  from refs r join f_sessions s on s.session_id = r.session_id {where} group by path)"""


@query(f"with {_REFS} select session_id, msg_seq, ts, cast(pos as integer) pos, path from refs", "f_messages")
def extract_paths(t):
    return paths.path_references(t.messages)


@query(f"""
with {_REFS}, c as {_COUNTS.format(where='')}
select path, use_count, nullif(project_path, '?') project_path from c order by use_count desc, path limit 20
""", "f_messages f_sessions")
def path_frequency(t):
    return paths.path_frequency(paths.path_counts(paths.path_references(t.messages), t.sessions))


def _path_table(t) -> DataFrame:
    """Paths of the distilled sessions first, then those of the other sessions on top."""
    refs = paths.path_references(t.messages)
    first = paths.path_counts(refs.join(t.progress, "session_id", "left_semi"), t.sessions)
    then = paths.path_counts(refs.join(t.progress, "session_id", "left_anti"), t.sessions)
    return paths.upsert_paths(paths.upsert_paths(empty(t.spark, PATHS), first), then)


_PATH_TABLE = f"""{_REFS},
a as {_COUNTS.format(where='where r.session_id in (select session_id from f_progress)')},
b as {_COUNTS.format(where='where r.session_id not in (select session_id from f_progress)')},
pt as (
  select row_number() over (order by a.path) path_id, a.path, nullif(a.project_path, '?') project_path,
    a.use_count + coalesce(b.use_count, 0) use_count
  from a left join b on a.path = b.path
  union all
  select (select count(*) from a) + row_number() over (order by b.path), b.path, nullif(b.project_path, '?'), b.use_count
  from b anti join a on a.path = b.path)"""


@query(f"with {_PATH_TABLE} select path_id, path, project_path, use_count from pt", "f_messages f_sessions f_progress")
def path_upsert(t):
    return _path_table(t).select("path_id", "path", "project_path", "use_count")


@query(f"""
with {_PATH_TABLE}, al as (select *, case path_id when 2 then 'second' when 5 then '3' end alias from pt),
k as (select * from (values ('3'), ('second'), ('SET_1'), ('part_2'), ('missing'), ('99999')) v(lookup)),
h as (select lookup, path, use_count,
  case when lookup = cast(path_id as varchar) then 1 when lookup = alias then 2
       when contains(lower(path), lower(lookup)) or (lookup like '%!_%' escape '!' and lower(path) like '%' || lower(lookup) || '%') then 3 end tier
  from k, al)
select lookup, arg_min(path, (tier, case tier when 3 then -use_count else 0 end, path)) path
from h where tier is not null group by lookup""", "f_messages f_sessions f_progress")
def path_resolve(t):
    named = paths.set_alias(_path_table(t), {"2": "second", "5": "3"})
    return paths.resolve_paths(named, ["3", "second", "SET_1", "part_2", "missing", "99999"])


@query(f"with {_PATH_TABLE} select path_id, path, project_path, use_count from pt", "f_messages f_sessions f_progress")
def paths_recounted(t):
    """A reload must not count twice: counted again on top, then set right."""
    counts = paths.path_counts(paths.path_references(t.messages), t.sessions)
    doubled = paths.upsert_paths(_path_table(t), counts)
    return paths.recount_paths(doubled, counts).select("path_id", "path", "project_path", "use_count")


@query(f"""
with {_PATH_TABLE}, given as (select path, max(alias) alias, max(project) project, count(*) n from (
    select path, null alias, null project from pt where path_id % 2 = 0
    union all select concat('/new', path), concat('alias ', path_id), '/home/dev' from pt) group by path)
select cast(coalesce(path_id, (select max(path_id) from pt) + row_number() over (partition by path_id is null order by given.path)) as bigint) path_id,
  coalesce(pt.path, given.path) path, given.alias, case when path_id is null then project else project_path end project_path,
  cast(coalesce(use_count, 0) + coalesce(n, 0) as bigint) use_count
from pt full join given on given.path = pt.path""", "f_messages f_sessions f_progress")
def paths_added(t):
    stored = _path_table(t)
    again = stored.where("path_id % 2 = 0").selectExpr("path", "cast(null as string) alias", "cast(null as string) project_path")
    new = stored.selectExpr("concat('/new', path) path", "concat('alias ', path_id) alias", "'/home/dev' project_path")
    return paths.add_paths(stored, again.unionByName(new)).drop("last_used")


# -- stored tables --------------------------------------------------------------

def _stored(t) -> str:
    """Tables of two runs, the second one run twice: the distilled sessions first, then the others."""
    root = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    done = t.progress.select("session_id")
    raw = t.session_logs.withColumn("session_id", F.regexp_extract("file_path", r"([^/]+)\.json$", 1))
    for batch, how in ((0, "left_semi"), (1, "left_anti"), (1, "left_anti")):
        run_pipeline(t.spark, root, raw.join(done, "session_id", how).drop("session_id"), batch, render=False)
    return root


@query(f"with {_PATH_TABLE} select path_id, path, project_path, use_count, cast(3 as bigint) version from pt",
       "f_messages f_sessions f_progress")
def run_published(t):
    """The path table as the newest manifest names it, after a run that was repeated."""
    root = _stored(t)
    version = F.lit(read_snapshot(t.spark, root).version).cast("long")
    return load_state(t.spark, root).paths.select("path_id", "path", "project_path", "use_count", version.alias("version"))


@query(f"""
with {_PATH_TABLE},
p as (select coalesce(s.project_path, '?') project_path, count(distinct s.session_id) sessions, count(*) messages
  from f_sessions s join f_messages m on m.session_id = s.session_id group by all),
u as (select coalesce(project_path, '?') project_path, count(*) paths, cast(sum(use_count) as bigint) uses, cast(sum(path_id) as bigint) ids from pt group by all)
select p.project_path, sessions, messages, coalesce(paths, 0) paths, coalesce(uses, 0) uses, coalesce(ids, 0) ids
from p left join u on u.project_path = p.project_path""", "f_messages f_sessions f_progress")
def reload_published(t):
    """Totals per project of everything ingested again into a new root; path ids stay."""
    root = _stored(t)
    reload_pipeline(t.spark, root, t.session_logs, f"{root}-again")
    state = load_state(t.spark, f"{root}-again")
    project = F.coalesce("project_path", F.lit("?")).alias("project_path")
    each = state.messages.groupBy("session_id").agg(F.count("*").alias("n"))
    owned = state.sessions.join(each, "session_id").groupBy(project).agg(
        F.count("*").alias("sessions"), F.sum("n").alias("messages"))
    used = state.paths.groupBy(project).agg(
        F.count("*").alias("paths"), F.sum("use_count").alias("uses"), F.sum("path_id").alias("ids"))
    return owned.join(used, "project_path", "left").fillna(0, ["paths", "uses", "ids"])


# -- watermarks and batches ---------------------------------------------------

_FRESH = """fresh as (
  select m.session_id, m.msg_seq, m.user_text, m.response_summary, m.ts, s.project_path, s.created_at
  from f_messages m join f_sessions s on s.session_id = m.session_id
    left join f_progress p on p.session_id = s.session_id and p.project_path = s.project_path
  where s.project_path is not null and m.user_text is not null
    and (p.last_message_id is null or m.msg_seq > p.last_message_id))"""
_NEEDS = "f_messages f_sessions f_progress"


@query(f"with {_FRESH} select * from fresh", _NEEDS)
def incremental_messages(t):
    fresh = progress.incremental_messages(t.messages, t.sessions, t.progress)
    return fresh.select("session_id", "msg_seq", "user_text", "response_summary", "ts", "project_path", "created_at")


@query(f"with {_FRESH} select distinct project_path from fresh", _NEEDS)
def stale_projects(t):
    return progress.stale_projects(t.messages, t.sessions, t.progress)


@query("""
select distinct s.project_path from f_sessions s join f_messages m on m.session_id = s.session_id
where s.project_path is not null and not exists (
  select 1 from f_progress p where p.project_path = s.project_path and p.last_message_id = m.msg_seq)""", _NEEDS)
def stale_projects_compat(t):
    return progress.stale_projects(t.messages, t.sessions, t.progress, compat=True)


_ASSIGNED = f"""{_FRESH}, per as (
  select project_path, session_id, count(*) filter (r <= 30) n_messages, max(msg_seq) filter (r <= 30) last_message_id,
    max(msg_seq) last_fresh, min(msg_seq) filter (r = 3) third, min(created_at) created_at, min(ts) first_ts
  from (select *, row_number() over (partition by project_path, session_id order by msg_seq) r from fresh) group by project_path, session_id),
asg as (select *, row_number() over (partition by project_path order by created_at nulls first, first_ts nulls first, session_id) - 1 pos from per)"""


@query(f"""
with {_ASSIGNED}
select project_path, cast(floor(pos / 5) as bigint) batch_no, cast(count(*) as integer) n_sessions,
  cast(sum(n_messages) as bigint) n_messages, string_agg(session_id, ',' order by pos) session_ids
from asg group by all""", _NEEDS)
def distill_batches(t):
    rows = plan_batches(t.state()).rows
    return rows.select("project_path", "batch_no", "n_sessions", "n_messages",
                       F.array_join("session_ids", ",").alias("session_ids"))


@query(f"""
with {_ASSIGNED}, u as (select session_id, project_path, last_message_id from f_progress
  union all select session_id, project_path, last_message_id from asg)
select session_id, project_path, max(last_message_id) last_message_id from u group by all""", _NEEDS)
def watermark_upsert(t):
    state = t.state()
    return progress.advance_watermark(state.progress, plan_batches(state).marks).drop("distilled_at")


_MARKS = """
with {assigned}
select project_path, cast(floor(pos / 5) as bigint) batch_no, session_id, {last} last_message_id from asg"""


@query(_MARKS.format(assigned=_ASSIGNED, last="coalesce(third, last_fresh)"), _NEEDS)
def marks_carried_over(t):
    """Three messages of a session at a time: the mark stops at the last one sent."""
    return plan_batches(t.state(), max_messages=3).marks


@query(_MARKS.format(assigned=_ASSIGNED, last="last_fresh"), _NEEDS)
def marks_not_carried_over(t):
    """The mark passes messages that are not sent."""
    return plan_batches(t.state(), max_messages=3, carry_over=False).marks


_SALIENT = """case when length({c}) <= 600 then {c} else
  array_to_string(list_reduce(
    list_transform(string_split({c}, chr(10)), lambda l: {{'kept': [l], 'size': 0}}),
    lambda acc, e: case
      when acc.size < 600 and (starts_with(e.kept[1], '[cmd]') or starts_with(e.kept[1], '[edit]'))
        then {{'kept': list_append(acc.kept, substr(e.kept[1], 1, 300)), 'size': acc.size + length(substr(e.kept[1], 1, 300))}}
      when acc.size < 600 and starts_with(e.kept[1], '[output') and acc.size + length(substr(e.kept[1], 1, 150)) < 600
        then {{'kept': list_append(acc.kept, substr(e.kept[1], 1, 150)), 'size': acc.size + length(substr(e.kept[1], 1, 150))}}
      when acc.size < 600 and not starts_with(e.kept[1], '[output') and not starts_with(e.kept[1], '[cmd]')
        and not starts_with(e.kept[1], '[edit]') and acc.size + length(e.kept[1]) < 600
        then {{'kept': list_append(acc.kept, substr(e.kept[1], 1, 200)), 'size': acc.size + length(substr(e.kept[1], 1, 200))}}
      else acc end,
    {{'kept': cast([] as varchar[]), 'size': cast(0 as bigint)}}).kept, chr(10)) end"""


@query(f"""
select session_id, msg_seq, {_SALIENT.format(c="response_summary")} response
from f_messages where response_summary is not null""", "f_messages")
def truncate_responses(t):
    kept = t.messages.where(F.col("response_summary").isNotNull())
    return kept.select("session_id", "msg_seq", truncate_salient(F.col("response_summary")).alias("response"))


_NL = "chr(10)"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _session_texts(source: str, name: str, order: str = "ts nulls first, msg_seq") -> str:
    """SQL for the prompt text of each session of ``source``: its first 30 messages by ``order``."""
    short = _SALIENT.format(c="substr(response_summary, 1, 2000)")
    return f"""{name}_lines as (
  select project_path, session_id, ts, msg_seq, row_number() over (partition by project_path, session_id order by {order}) rn,
    concat('USER: ', substr(user_text, 1, 200),
      case when substr(coalesce(response_summary, ''), 1, 2000) <> '' then concat({_NL}, 'RESPONSE: ', {short}) else '' end) line
  from {source}),
{name} as (select project_path, session_id,
  concat('--- Session ', substr(session_id, 1, 8), ' ---', {_NL}, string_agg(line, {_NL} order by rn)) session_text
  from {name}_lines where rn <= 30 group by project_path, session_id)"""


_FILE_MAPS = f"""fm as (select skill_id, concat('{{', string_agg(concat('"', file, '":["', replace(symbols, ',', '","'), '"]'), ',' order by n), '}}') file_map
  from (select skill_id, n, file, string_agg(symbol, ',' order by pos) symbols from f_skill_files group by skill_id, n, file) group by skill_id)"""
_SKILL_LINES = f"""{_FILE_MAPS},
sl as (select f.project_path, f.created_min, f.skill_id, concat('[skill_id=', f.skill_id, '] ', title, ' (type=', obs_type, '): ', f.description,
    {_NL}, '  Steps: ', substr(steps, 1, 200), {_NL}, '  Tags: ', tags,
    case when len(facts) > 0 then concat({_NL}, '  Facts: ', substr(concat('["', array_to_string(facts, '","'), '"]'), 1, 200)) else '' end,
    {_NL}, '  Concepts: ', substr(concat('["', array_to_string(concepts, '","'), '"]'), 1, 150),
    case when file_map is not null then concat({_NL}, '  FileMap: ', substr(file_map, 1, 300)) else '' end,
    case when template is not null then concat({_NL}, '  Commands: ', substr(concat('[{{"name":"', name, '","template":"', template,
      '","description":"', ft.description, '"}}]'), 1, 300)) else '' end) line
  from f_skills f left join fm on fm.skill_id = f.skill_id left join f_skill_templates ft on ft.skill_id = f.skill_id),
sk as (select project_path, concat({_literal(B.SKILLS_HEADER)}, string_agg(line, chr(10) || chr(10) order by created_min, skill_id)) text,
  sum(length(line) + 2) chars from sl group by project_path),
ru as (select project_path, concat({_literal(B.RULES_HEADER)}, string_agg(concat('  ', rn, '. ', rule_text), {_NL} order by rn)) text,
  sum(length(rule_text) + 1) chars
  from (select *, row_number() over (partition by project_path order by created_min, rule_seq) rn from f_rules) group by project_path)"""
_PROMPT_NEEDS = f"{_NEEDS} f_skills f_skill_files f_skill_templates f_rules"


@query(f"""
with {_ASSIGNED}, {_session_texts("fresh", "tx", "msg_seq")}, {_SKILL_LINES},
ba as (select a.project_path, floor(pos / 5) batch_no, count(*) n_sessions, sum(n_messages) n_messages,
    string_agg(a.session_id, ',' order by pos) session_ids, string_agg(session_text, {_NL} || {_NL} order by pos) conversations
  from asg a join tx on tx.project_path = a.project_path and tx.session_id = a.session_id group by a.project_path, floor(pos / 5))
select ba.project_path, cast(batch_no as bigint) batch_no, cast(n_sessions as integer) n_sessions, cast(n_messages as bigint) n_messages, session_ids,
  concat('Project ', ba.project_path, {_NL}, {_NL}, conversations, coalesce(sk.text, ''), coalesce(ru.text, ''),
    {_NL}, {_NL}, 'Answer with a JSON array.') prompt,
  cast({len(TEMPLATE)} + length(conversations) + coalesce(sk.chars, 0) + coalesce(ru.chars, 0) as bigint) prompt_chars
from ba left join sk on sk.project_path = ba.project_path left join ru on ru.project_path = ba.project_path
""", _PROMPT_NEEDS)
def distill_prompts(t):
    state = t.state()
    prompts = B.build_prompts(plan_batches(state).rows, state.skills, state.rules, TEMPLATE)
    return prompts.withColumn("session_ids", F.array_join("session_ids", ",")).drop("error")


def _section_sql(section: str, lines: str, line: str, order: str, header: str, separator: str) -> str:
    """SQL for the parts of 100 lines of one section of all projects."""
    return f"""
select project_path, '{section}' section, cast(floor(n / 100) as bigint) part_no,
  concat(case when floor(n / 100) = 0 then {_literal(header)} else {separator} end, string_agg({line}, {separator} order by n)) text
from (select *, row_number() over (partition by project_path order by {order}) - 1 n from {lines} where project_path is not null)
group by project_path, floor(n / 100)"""


@query(f"""
with {_ASSIGNED}, {_session_texts("fresh", "tx", "msg_seq")}, {_SKILL_LINES}
{_section_sql("skills", "sl", "line", "created_min, skill_id", B.SKILLS_HEADER, f"{_NL} || {_NL}")}
union all
{_section_sql("rules", "f_rules", "concat('  ', n + 1, '. ', rule_text)", "created_min, rule_seq", B.RULES_HEADER, _NL)}
union all
select a.project_path, 'conversations', cast(floor(pos / 5) as bigint), string_agg(session_text, {_NL} || {_NL} order by pos)
from asg a join tx on tx.project_path = a.project_path and tx.session_id = a.session_id group by a.project_path, floor(pos / 5)""",
       _PROMPT_NEEDS)
def distill_prompt_parts(t):
    """What prompts are put together from: each list once, in parts, and the batches' conversations."""
    state = t.state()
    batches = plan_batches(state).rows.select(
        "project_path", F.lit("conversations").alias("section"), F.col("batch_no").alias("part_no"), F.col("conversations").alias("text"))
    return B.prompt_sections(state.skills, state.rules).unionByName(batches)


@query(f"""
with {_ASSIGNED}, f as (
  select s.project_path, s.session_id, s.created_at, min(m.ts) first_ts from f_messages m
    join f_sessions s on s.session_id = m.session_id
  where s.project_path is not null and m.user_text is not null group by all),
r as (select *, row_number() over (partition by project_path order by created_at desc nulls last, first_ts desc nulls last, session_id desc) d from f)
select project_path, session_id, created_at, first_ts,
  cast(row_number() over (partition by project_path order by d desc) - 1 as bigint) "position"
from r where d <= 20""", _NEEDS)
def review_sample(t):
    fresh = progress.incremental_messages(t.messages, t.sessions, t.progress, full=True)
    sample = B.review_sample(fresh)
    return sample.select("project_path", "session_id", "created_at", "first_ts", F.col("position").cast("long").alias("position"))


@query(f"""
with al as (select m.*, s.project_path, s.created_at from f_messages m join f_sessions s on s.session_id = m.session_id
  where s.project_path in (select project_path from f_skills) and m.user_text is not null),
f as (select project_path, session_id, created_at, min(ts) first_ts, count(*) n from al group by all),
r as (select *, row_number() over (partition by project_path order by created_at desc nulls last, first_ts desc nulls last, session_id desc) d from f),
{_session_texts("al", "tx")}, {_SKILL_LINES},
ba as (select r.project_path, count(*) n_sessions, sum(n) n_messages, string_agg(session_text, {_NL} || {_NL} order by d desc) conversations
  from r join tx on tx.project_path = r.project_path and tx.session_id = r.session_id where d <= 20 group by r.project_path)
select sk.project_path, cast(coalesce(n_sessions, 0) as integer) n_sessions, cast(coalesce(n_messages, 0) as bigint) n_messages,
  concat('Review ', sk.project_path, {_NL}, {_NL}, coalesce(conversations, ''), sk.text) prompt
from sk left join ba on ba.project_path = sk.project_path""", _PROMPT_NEEDS)
def review_prompts_built(t):
    return review_prompts(t.state(), REVIEW_TEMPLATE).select("project_path", "n_sessions", "n_messages", "prompt")


# -- rules --------------------------------------------------------------------

@query("""
with recursive o as (
  select project_path, rule_seq, rule_text, lower(rule_text) low,
    row_number() over (partition by project_path order by rule_seq) n from f_new_rules where rule_text <> ''),
walk(project_path, n, acc, took) as (
  select p.project_path, cast(0 as bigint), coalesce((select list(lower(r.rule_text)) from f_rules r where r.project_path = p.project_path), []), false
  from (select distinct project_path from f_new_rules) p
  union all
  select w.project_path, o.n,
    case when list_contains(list_transform(w.acc, lambda x: trim(x)), trim(o.low))
      or len(list_filter(w.acc, lambda x: contains(x, substr(o.low, 1, 50)))) > 0 then w.acc else list_append(w.acc, o.low) end,
    not (list_contains(list_transform(w.acc, lambda x: trim(x)), trim(o.low))
      or len(list_filter(w.acc, lambda x: contains(x, substr(o.low, 1, 50)))) > 0)
  from walk w join o on o.project_path = w.project_path and o.n = w.n + 1)
select o.project_path, o.rule_text, o.rule_seq from o join walk w on w.project_path = o.project_path and w.n = o.n where w.took
""".replace("with recursive ", "with "), "f_rules f_new_rules")
def rules_dedup(t):
    return rules.dedup_rules(t.rules, t.new_rules)


SQL["rules_dedup"] = SQL["rules_dedup"].replace("with ", "with recursive ", 1)


@query("select project_path, rule_text, source, rule_seq from f_rules where project_path like '%proj_%'", "f_rules")
def rules_list(t):
    return reports.list_rules(t.rules, "proj").drop("created_at")


@query("""
select project_path, rule_text, source, rule_seq from f_rules
union all
select project_path, 'Check twice', 'manual',
  1 + coalesce((select max(rule_seq) from f_rules r where r.project_path = p.project_path), 0)
from (select min(project_path) project_path from f_sessions where lower(project_path) like '%proj_%') p
""", "f_sessions f_rules")
def rules_added(t):
    return rules.add_rule(t.rules, t.sessions, "PROJ_", "Check twice").drop("created_at")


@query("select project_path, rule_text, source, rule_seq from f_rules where project_path not like '%/proj_1%'", "f_rules")
def rules_cleared(t):
    return rules.clear_rules(t.rules, "/PROJ_1").drop("created_at")


# -- skills -------------------------------------------------------------------

@query("select project_path, title, substr(sha256(concat(project_path, ':', title, ':', steps)), 1, 16) new_id from f_incoming", "f_incoming")
def skill_ids(t):
    return t.incoming.select(
        "project_path", "title", content_id(F.col("project_path"), F.col("title"), F.col("steps")).alias("new_id"))


_RESOLVED = """
i as (select *, batch_no * 4294967296 + item_no ord, substr(sha256(concat(project_path, ':', title, ':', steps)), 1, 16) new_id
  from f_incoming where title <> ''),
m as (select i.*, k.skill_id by_id, k.title old_title from i left join f_skills k
  on k.skill_id = i.skill_id and k.project_path = i.project_path),
ev as (select project_path, skill_id, title, cast(-1 as bigint) since from f_skills
  union all select project_path, by_id, title, ord from m where by_id is not null),
iv as (select project_path, title, skill_id, since, lead(since) over (partition by project_path, skill_id order by since) until from ev),
h as (select m.project_path, m.ord, min(iv.skill_id) by_title from m join iv on iv.project_path = m.project_path and iv.title = m.title
  and iv.since < m.ord and (iv.until is null or m.ord < iv.until) where m.by_id is null group by all),
lk as (select m.*, h.by_title from m left join h on h.project_path = m.project_path and h.ord = m.ord),
mk as (select project_path, title, min(ord) born, arg_min(new_id, ord) made from lk where by_id is null and by_title is null group by all),
rs as (select lk.*, case when by_id is not null then by_id when mk.born <= lk.ord then least(by_title, mk.made) else by_title end target,
    case when by_id is not null then 'id' when by_title is null and mk.born = lk.ord then 'new' else 'title' end how
  from lk left join mk on mk.project_path = lk.project_path and mk.title = lk.title)"""


@query(f"""
with {_RESOLVED},
ch as (select project_path, target, max(ord) last_at, bool_or(how = 'new') is_new,
    arg_max(title, ord) filter (where how <> 'title') new_title, arg_max(description, ord) d, arg_max(steps, ord) s, arg_max(obs_type, ord) o
  from rs group by all)
select k.skill_id, k.project_path, coalesce(new_title, k.title) title, coalesce(d, k.description) description,
  coalesce(s, k.steps) steps, coalesce(o, k.obs_type) obs_type
from f_skills k left join ch on ch.target = k.skill_id
union all
select target, project_path, new_title, d, s, o from ch where is_new""", "f_skills f_incoming")
def skill_merge(t):
    merged = merge.merge_skills(t.skills, t.incoming)
    return merged.select("skill_id", "project_path", "title", "description", "steps", "obs_type")


@query(f"with {_RESOLVED} select how, count(*) items, count(distinct target) skills from rs group by how", "f_skills f_incoming")
def merge_outcomes(t):
    resolved = merge.resolve_items(t.skills, t.incoming)
    return resolved.groupBy("how").agg(F.count("*").alias("items"), F.count_distinct("target").alias("skills"))


@query("""
select skill_id, title, recurring and title not like 'Workflow%' recurring from f_skills""", "f_skills")
def skill_prune(t):
    chosen = t.skills.where(F.col("title").startswith("Workflow")).select("skill_id")
    return reports.mark_one_off(t.skills, chosen).select("skill_id", "title", "recurring")


@query("""
select skill_id, case when lower(title) like '%constant%' or lower(title) like '%quick reference%' then 'constants'
  when lower(title) like '%file map%' or (obs_type = 'discovery' and pidx < 4 and doc_id % 3 > 0) then 'file_map'
  when lower(title) like '%experiment%' and lower(title) like '%registry%' then 'registry'
  when recurring then 'recurring' else 'one_off' end category from f_skills""", "f_skills")
def classify_skills(t):
    return render.classify_skills(t.skills).select("skill_id", "category")


# -- model answers ------------------------------------------------------------

_FORM = "(conv_id + msg_seq) % 8"
_ITEMS = f"""items as (
  select session_id, msg_seq, user_text, conv_id, 0 item_no, case when {_FORM} = 4 then 'other' else 'skill' end kind
  from f_messages where {_FORM} <= 4
  union all
  select session_id, msg_seq, user_text, conv_id, case {_FORM} when 0 then 1 else 2 end, 'other' from f_messages where {_FORM} in (0, 3))"""


@query(f"""
with {_ITEMS}, c as (select session_id, msg_seq, count(*) n from items group by all)
select conv_id * 1000 + m.msg_seq batch_no, cast(coalesce(n, 0) as integer) n_items, n is null failed
from f_messages m left join c on c.session_id = m.session_id and c.msg_seq = m.msg_seq""", "f_messages")
def parse_model_output(t):
    return model.answer_status(t.model_output).drop("project_path")


@query(f"""
with {_ITEMS}
select conv_id * 1000 + msg_seq batch_no, cast(item_no as bigint) item_no, 'new' skill_id,
  case kind when 'skill' then concat('Skill ', session_id, '-', msg_seq) else 'Other' end title,
  case kind when 'skill' then concat(user_text, chr(10), 'check') else user_text end steps,
  case kind when 'skill' then concat(session_id, ',tag') else '' end tags,
  case kind when 'skill' then 'bugfix' else 'workflow' end obs_type, kind = 'other' recurring,
  case kind when 'skill' then 'a.py' else '' end files
from items""", "f_messages")
def normalize_skills(t):
    rows = model.normalize_skills(model.parse_items(t.model_output))
    return rows.select("batch_no", "item_no", "skill_id", "title", "steps", "tags", "obs_type", "recurring",
                       F.array_join("files_read", ",").alias("files"))


def _kept(read):
    """``read`` of all texts of a prompt, kept for the texts of the prompt that was read last."""
    kept = {}

    def of(texts):
        nonlocal kept
        kept = {text: kept[text] if text in kept else read(text) for text in texts}
        return [kept[text] for text in texts]
    return of


def _stub():
    """A model stand-in: one skill named after the first session of a prompt, one shared by all."""
    def sessions_of(text):
        import re
        return re.findall(r"^--- Session (\S+) ---$", text, re.M)
    in_list = _kept(sessions_of)

    def answer(prompts):
        import json
        out = []
        for prompt in prompts:
            own, *lists = prompt.texts  # no line reaches over an end of these texts
            sessions = [*sessions_of(own), *(s for found in in_list(lists) for s in found)]
            out.append(json.dumps([{"title": f"From {sessions[0]}", "steps": ["first", sessions[0]]},
                                   {"title": "Shared", "steps": sessions[-1], "tags": ["stub"], "type": "bugfix"}]))
        return out
    return model.takes_parts(answer)


_DISTILLED = f"""{_ASSIGNED}, b as (
  select project_path, floor(pos / 5) bn, sum(n_messages) n, arg_min(session_id, pos) s0, arg_max(session_id, pos) s1 from asg group by all)"""


@query(f"""
with {_DISTILLED},
tot as (select count(*) n from f_messages m join f_sessions s on s.session_id = m.session_id where s.project_path is not null)
select 'projects' stat, count(distinct project_path) n from f_sessions where project_path is not null
union all select 'batches', count(*) from b
union all select 'batches_failed', 0
union all select 'skills_created', count(*) + count(distinct project_path) from b
union all select 'skills_updated', count(*) - count(distinct project_path) from b
union all select 'messages_processed', cast(sum(n) as bigint) from b
union all select 'messages_skipped', cast((select n from tot) - sum(n) as bigint) from b""", _NEEDS)
def distill_stats(t):
    return distill(t.state(), _stub(), TEMPLATE).stats


_DISTILLED_SKILLS = f"""
with {_DISTILLED}, k as (
  select project_path, concat('From ', substr(s0, 1, 8)) title, concat('first', {_NL}, substr(s0, 1, 8)) steps,
    concat('first', {_NL}, substr(s0, 1, 8)) made_from, '' tags, 'workflow' obs_type from b
  union all
  select project_path, 'Shared', arg_max(substr(s1, 1, 8), bn), arg_min(substr(s1, 1, 8), bn), 'stub', 'bugfix' from b group by project_path)
select substr(sha256(concat(project_path, ':', title, ':', made_from)), 1, 16) skill_id, project_path, title, steps, tags, obs_type from k
union all select skill_id, project_path, title, steps, tags, obs_type from f_skills"""


@query(_DISTILLED_SKILLS, f"{_NEEDS} f_skills")
def distill_snapshot(t):
    return distill(t.state(), _stub(), TEMPLATE).skills.select(
        "skill_id", "project_path", "title", "steps", "tags", "obs_type")


@query(_DISTILLED_SKILLS, f"{_NEEDS} f_skills")
def distill_sequential(t):
    return distill(t.state(), _stub(), TEMPLATE, mode="sequential").skills.select(
        "skill_id", "project_path", "title", "steps", "tags", "obs_type")


def _counting_stub():
    """A model stand-in: one skill per prompt whose steps are the number of skills it was shown."""
    def skills_of(text):
        return text.count("[skill_id=")
    in_list = _kept(skills_of)

    def answer(prompts):
        import json
        import re
        out = []
        for prompt in prompts:
            own, *lists = prompt.texts
            first = re.search(r"^--- Session (.+) ---$", own, re.M)[1]  # conversations come before the lists
            out.append(json.dumps([{"title": f"From {first}", "steps": str(skills_of(own) + sum(in_list(lists)))}]))
        return out
    return model.takes_parts(answer)


_SEEN = """
with {distilled}, n as (select project_path, count(*) n0 from f_skills group by project_path),
k as (select b.project_path, concat('From ', substr(s0, 1, 8)) title, cast(cast(coalesce(n0, 0) + {earlier} as bigint) as varchar) steps
  from b left join n on n.project_path = b.project_path)
select substr(sha256(concat(project_path, ':', title, ':', steps)), 1, 16) skill_id, project_path, title, steps from k"""


@query(_SEEN.format(distilled=_DISTILLED, earlier="0"), f"{_NEEDS} f_skills")
def distill_snapshot_seen(t):
    made = distill(t.state(), _counting_stub(), TEMPLATE).skills.where(F.col("title").startswith("From "))
    return made.select("skill_id", "project_path", "title", "steps")


@query(_SEEN.format(distilled=_DISTILLED, earlier="bn"), f"{_NEEDS} f_skills")
def distill_sequential_seen(t):
    """Each batch sees the skills that the project's earlier batches made."""
    made = distill(t.state(), _counting_stub(), TEMPLATE, mode="sequential").skills.where(F.col("title").startswith("From "))
    return made.select("skill_id", "project_path", "title", "steps")


def _reviewing_stub():
    """A model stand-in: one rule that tells how many sessions the prompt holds."""
    def answer(prompts):
        import json
        return [json.dumps([{"rule": f"Reviewed {p.count('--- Session ')} sessions"}]) for p in prompts]
    return answer


@query("""
with r as (select s.project_path, s.session_id from f_messages m join f_sessions s on s.session_id = m.session_id
  where s.project_path is not null and m.user_text is not null group by all),
n as (select k.project_path, least(20, count(r.session_id)) n from (select distinct project_path from f_skills where project_path is not null) k
  left join r on r.project_path = k.project_path group by k.project_path)
select project_path, rule_text, source from f_rules
union all select project_path, concat('Reviewed ', n, ' sessions'), 'review' from n""", f"{_NEEDS} f_skills f_rules")
def review_rules(t):
    return review(t.state(), _reviewing_stub(), REVIEW_TEMPLATE).rules.select("project_path", "rule_text", "source")


# -- search -------------------------------------------------------------------

_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in search.ENGLISH_STOP_WORDS) + "]"
_TOKENS = "list_filter(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: not list_contains(" + _STOP + ", w))"
_CORPUS = {
    "skills": """select 'skill' type, skill_id id, concat_ws(' ', title, description, steps, tags, array_to_string(facts, ' '),
        array_to_string(concepts, ' ')) text, title, description, project_path project from f_skills""",
    "messages": """select 'message' type, concat_ws('#', m.session_id, msg_seq) id, concat_ws(' ', user_text, response_summary) text,
        substr(user_text, 1, 100) title, substr(coalesce(response_summary, ''), 1, 200) description, project_path project
        from f_messages m join f_sessions s on s.session_id = m.session_id""",
}
_CORPUS["all"] = f"{_CORPUS['skills']} union all {_CORPUS['messages']}"
_SEARCH_NEEDS = "f_skills f_messages f_sessions"


def _search_sql(include: str, text: str, where: str = "") -> str:
    return f"""
with corpus as (select * from ({_CORPUS[include]}) {where}),
docs as (select type, id, text from corpus union all select '', null, '{text}'),
po as (select type, id, term, count(*) tf from (select type, id, unnest({_TOKENS.format(c='text')}) term from docs) group by all),
sz as (select count(*) n from docs),
vo as (select term, ln((n + 1) / (df + 1)) + 1 idf from (select term, sum(tf) total, count(*) df from po group by term
  order by total desc, term limit 5000), sz),
w as (select type, id, term, tf * idf w from po join vo using (term)),
q as (select term, w q from w where type = ''),
sc as (select w.type, w.id, sum(w.w * q.q) / (sqrt(sum(w.w * w.w)) * (select sqrt(sum(q * q)) from q)) score
  from w left join q on q.term = w.term where w.type <> '' group by all)
select c.type, c.id, c.title, c.description, c.project, round(score, 6) score
from sc join corpus c on c.type = sc.type and c.id = sc.id where score >= 0.05
order by round(score, 9) desc, c.type desc, c.id limit 10"""


@query(_search_sql("all", SEARCH_TEXT), _SEARCH_NEEDS)
def search_all(t):
    corpus = search.build_corpus(t.skills, t.messages, t.sessions)
    return search.search(corpus, SEARCH_TEXT, digits=6)


@query(_search_sql("skills", SEARCH_TEXT), _SEARCH_NEEDS)
def search_skills(t):
    corpus = search.build_corpus(t.skills, t.messages, t.sessions, "skills")
    return search.search(corpus, SEARCH_TEXT, digits=6)


@query(_search_sql("messages", SEARCH_TEXT), _SEARCH_NEEDS)
def search_messages(t):
    corpus = search.build_corpus(t.skills, t.messages, t.sessions, "messages")
    return search.search(corpus, SEARCH_TEXT, digits=6)


@query(_search_sql("all", SEARCH_TEXT, "where contains(project, 'proj_1')"), _SEARCH_NEEDS)
def search_project(t):
    corpus = search.build_corpus(t.skills, t.messages, t.sessions)
    return search.search(corpus, SEARCH_TEXT, project="proj_1", digits=6)


# a full refit for every query: its words count in the vocabulary and in the idf
@query(f"""
with corpus as ({_CORPUS['all']}),
po as (select type, id, term, count(*) tf from (select type, id, unnest({_TOKENS.format(c='text')}) term from corpus) group by all),
sz as (select count(*) n from corpus),
te as (select term, sum(tf) total, count(*) df from po group by term),
wd as (select query_id, term, count(*) n from (select item_id query_id, unnest({_TOKENS.format(c='text')}) term from benchmark) group by all),
al as (select b.item_id query_id, term, total, df from te, benchmark b
  union all select query_id, term, n, 1 from wd),
st as (select query_id, term, sum(total) total, sum(df) df from al group by all),
vo as (select query_id, term, ln(((select n from sz) + 2) / (df + 1)) + 1 idf,
    row_number() over (partition by query_id order by total desc, term) r from st qualify r <= 5000),
q as (select query_id, term, wd.n * idf q from wd join vo using (query_id, term)),
qn as (select query_id, sqrt(sum(q * q)) q_norm from q group by query_id),
sc as (select vo.query_id, type, id, sum(tf * idf * q) dot, sum(tf * idf * tf * idf) norm2
  from po join vo using (term) left join q on q.query_id = vo.query_id and q.term = vo.term group by all),
r as (select query_id, type, id, dot / (sqrt(norm2) * q_norm) score from sc join qn using (query_id)),
k as (select *, row_number() over (partition by query_id order by round(score, 9) desc, type desc, id) "rank" from r where score >= 0.05)
select query_id, cast("rank" as integer) "rank", type, id, title, project, round(score, 6) score
from k join corpus using (type, id) where "rank" <= 10""", _SEARCH_NEEDS)
def search_batch(t):
    corpus = search.build_corpus(t.skills, t.messages, t.sessions)
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return search.search_batch(corpus, search.build_index(corpus), asked, digits=6)


# -- JSON text in cells -------------------------------------------------------

@query("""
select event_id, replace(props, ' ', '') as wrapped, '' as emptied, 1 as n_keys,
  concat(replace(props, ' ', ''), '|', event_type, '|True|None') as listed, event_type as invalid
from events""")
def json_cells(t):
    """JSON text columns read leniently: objects, lists and text that is no JSON."""
    cells = t.events.withColumn("list_text", F.expr("concat('[', props, ',\"', event_type, '\", true, null]')"))
    return cells.select(
        "event_id", F.array_join(json_list("props"), "|").alias("wrapped"),
        F.array_join(json_list("props", on_scalar="empty"), "|").alias("emptied"),
        F.size(json_map("props")).alias("n_keys"),
        F.array_join(json_list("list_text"), "|").alias("listed"),
        F.array_join(json_list("event_type", on_invalid="text"), "|").alias("invalid"))


# -- rendering ----------------------------------------------------------------

_MAPPED = """seen as (select project_path, file, symbol, min((created_min, skill_id, pos)) s from f_skill_files group by all),
mapped as (select project_path, file, count(*) n_symbols,
  array_to_string(list_slice(list(symbol order by s), 1, 8), ',') symbols from seen group by all)"""


@query(f"with {_MAPPED} select * from mapped", "f_skill_files")
def file_map_merge(t):
    return render.merge_file_map(t.skills).withColumn("symbols", F.array_join("symbols", ","))


_KEY_FILES = """kf as (select project_path, file, arg_min(title, (created_min, skill_id, pos)) title from (
    select project_path, created_min, skill_id, title, unnest(list_concat(files_read, files_modified)) file,
      unnest(range(len(files_read) + len(files_modified))) pos
    from f_skills) where project_path not in (select project_path from f_skill_files) group by all)"""


@query(f"with {_KEY_FILES} select * from kf", "f_skills f_skill_files")
def key_files(t):
    return render.key_files(t.skills)


@query("select project_path, skill_id, name, template, description from f_skill_templates where template <> ''", "f_skill_templates")
def command_templates(t):
    return render.command_templates(t.skills).drop("created_at", "pos")


_BLOCKS = f"""{_MAPPED}, {_KEY_FILES},
cl as (select f.*, ft.template, ft.name tname, case when lower(title) like '%constant%' or lower(title) like '%quick reference%' then 1
  when lower(title) like '%file map%' or (obs_type = 'discovery' and pidx < 4 and doc_id % 3 > 0) then 0
  when lower(title) like '%experiment%' and lower(title) like '%registry%' then 5
  when recurring then 6 else 7 end section,
  array_to_string(list_transform(facts, lambda x: concat('- ', x, {_NL})), '') fl
  from f_skills f left join f_skill_templates ft on ft.skill_id = f.skill_id),
body as (
  select project_path, section, created_min, skill_id nm, case section
    when 1 then case when len(facts) > 0 then fl else concat({_NL}, description, {_NL}) end
    when 5 then concat(case when len(facts) > 0 then fl else concat(description, {_NL}) end,
                       case when steps <> '' then concat({_NL}, steps, {_NL}) else '' end)
    when 6 then concat('### ', title, {_NL}, {_NL}, description, {_NL}, {_NL},
      case when len(facts) > 0 then concat('**Facts:**', {_NL}, fl, {_NL}) else '' end,
      case when steps <> '' then concat('**Steps:**', {_NL}, steps, {_NL}, {_NL}) else '' end,
      case when template is not null then concat('**Commands:**', {_NL},
        case when template <> '' then concat('- ', tname, ': `', template, '`', {_NL}) else '' end, {_NL}) else '' end,
      '*Tags: ', tags, ' | Concepts: ', array_to_string(concepts, ', '), '*', {_NL}, {_NL}, '---', {_NL}, {_NL})
    else concat('- **', title, '**: ', description, {_NL}) end block
  from cl where section > 0
  union all select project_path, 2, null, file, concat('- `', file, '` — ', title, {_NL}) from kf
  union all select project_path, 3, null, file,
    concat('| `', file, '` | ', array_to_string(list_transform(string_split(symbols, ','), lambda x: concat('`', x, '`')), ', '), ' |', {_NL}) from mapped
  union all select project_path, 4, created_min, skill_id, concat('**', name, '**',
    case when description <> '' then concat(' — ', description) else '' end, {_NL}, '```', {_NL}, template, {_NL}, '```', {_NL}, {_NL})
    from f_skill_templates where template <> ''),
hd as (select * from (values
  (1, '## Quick Reference\n\n', '\n---\n\n'), (2, '## Key Files\n\n', '\n---\n\n'),
  (3, '## File Map\n\n| File | Key Symbols |\n|------|-------------|\n', '\n---\n\n'),
  (4, '## Command Templates\n\n', '---\n\n'), (5, '## Experiment Registry\n\n', '\n---\n\n'),
  (6, '## Recurring Workflows\n\n', '\n'),
  (7, '## Reference (One-Time Tasks)\n\n> These tasks are completed. Included for context only.\n\n', '\n')) v(section, heading, closing)),
pr as (select distinct project_path, section from body),
blocks as (
  select project_path, section, 1 step, created_min, nm, block from body
  union all select project_path, section, 0, null, '', heading from pr join hd using (section)
  union all select project_path, section, 2, null, '', closing from pr join hd using (section)
  union all select distinct project_path, 0, 0, null, '', concat('<!-- Generated file, do not edit by hand.\n     Project: ',
    regexp_extract(project_path, '[^/]*$'), '\n     Last updated: {AS_OF} -->\n\n# Project Skills & Patterns\n\n> Reusable patterns distilled from past assistant conversations.\n\n')
    from f_skills),
placed as (select project_path, block, row_number() over (partition by project_path order by section, step, created_min nulls first, nm) - 1 place from blocks)
""".replace("\\n", "\n")


@query(f"""
with {_BLOCKS}
select project_path, cast(floor(place / 1000) as bigint) part_no, string_agg(block, '' order by place) content
from placed group by all""", "f_skills f_skill_files f_skill_templates")
def render_instructions(t):
    return render.render_instructions(t.skills, AS_OF)


@query(f"""
select skill_id, regexp_replace(regexp_extract(project_path, '[^/]*$'), '[^\\p{{L}}\\p{{N}}_.-]', '_', 'g') project_slug,
  concat(lower(replace(title, ' ', '-')), '.md') filename,
  concat('# ', title, {_NL}, {_NL}, '> ', description, {_NL}, {_NL}, '**Type:** ', obs_type, {_NL}, '**Tags:** ', tags, {_NL},
    '**Project:** ', project_path, {_NL}, '**Skill ID:** ', skill_id, {_NL}, {_NL}, '## Steps', {_NL}, {_NL}, steps,
    {_NL}, {_NL}, '## Facts', {_NL}, {_NL}, case when len(facts) = 0 then '(none)' else concat('- ', array_to_string(facts, {_NL} || '- ')) end,
    {_NL}, {_NL}, '## Concepts', {_NL}, {_NL}, '- ', array_to_string(concepts, {_NL} || '- '),
    {_NL}, {_NL}, '## Files', {_NL}, {_NL}, '- ', array_to_string(files_read, {_NL} || '- '), {_NL}) content
from f_skills""", "f_skills")
def skill_documents(t):
    return render.skill_documents(t.skills)


# -- change events ------------------------------------------------------------

@query("""
with e as (select user_id, ts, event_type, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 30 minute then 0 else 1 end nb from events),
g as (select *, sum(nb) over (partition by user_id order by ts rows unbounded preceding) burst from e)
select user_id "key", min(ts) burst_start, max(ts) last_change, count(*) n_changes, count(distinct event_type) n_files
from g group by user_id, burst""")
def change_bursts(t):
    return bursts.change_bursts(t.events, "30 minutes", "user_id", "event_type")
