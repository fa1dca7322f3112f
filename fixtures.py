"""The library's input tables, derived from the driver's tables.

One SQL text per table serves Spark and DuckDB; the few functions whose names
differ are written with a leading @.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolake.schemas import SKILLS, conform

_DIALECT = {
    "spark": {"@sha(": "sha2(", "@bits": ", 256", "@arr(": "array(", "@none": "cast(array() as array<string>)"},
    "duckdb": {"@sha(": "sha256(", "@bits": "", "@arr(": "list_value(", "@none": "cast([] as varchar[])"},
}


def _title_of(doc: str) -> str:
    return f"""concat(case {doc} % 11 when 0 then 'Project Constants' when 1 then 'File Map'
              when 2 then 'Experiment Registry' when 3 then 'Quick Reference' else 'Workflow' end, ' ', {doc})"""


TABLES = {
    "f_sessions": """
        select concat('s', lpad(cast(conv_id as string), 6, '0')) session_id,
          concat('w', conv_id % 7) workspace_id,
          case when conv_id % 11 = 10 then null else concat('/home/dev/projects/proj_', conv_id % 7) end project_path,
          1700000000000 + conv_id * 3600000 created_at,
          1700000000000 + conv_id * 3600000 + max(turn) * 60000 last_message_at,
          max(turn) last_turn
        from conversations group by conv_id""",
    "f_messages": """
        select concat('s', lpad(cast(conv_id as string), 6, '0')) session_id, turn msg_seq,
          concat(text,
            case when (conv_id + turn) % 4 = 0 then concat(' see /data/set_', conv_id % 13, '/part_', turn % 3, '.csv') else '' end,
            case when (conv_id + turn) % 5 = 0 then concat(chr(10), '```', chr(10), 'x=1', chr(10), '```') else '' end) user_text,
          case when nrole = 'assistant' and conv_id % 3 = 0 then
                 concat('[cmd] python run_', conv_id % 5, '.py --n ', turn, chr(10), '[output exit=0] ', ntext, chr(10),
                        '[edit] /data/set_', conv_id % 13, '/run.py (1 change(s))', chr(10), ntext)
               when nrole = 'assistant' then ntext end response_summary,
          1700000000000 + conv_id * 3600000 + turn * 60000 ts,
          conv_id, nrole, ntext
        from (select c.conv_id, c.turn, c.text, n.role nrole, n.text ntext
          from conversations c left join conversations n on n.conv_id = c.conv_id and n.turn = c.turn + 1
          where c.role = 'user') z""",
    # sessions of five turns or more were distilled before, half of them to the end
    "f_progress": """
        select session_id, project_path,
          case when last_turn % 2 = 0 then last_turn else 2 end last_message_id
        from f_sessions where project_path is not null and last_turn >= 4""",
    "f_skills": f"""
        select substr(@sha(concat(project_path, ':', title, ':', steps)@bits), 1, 16) skill_id, k.*
        from (select doc_id, cast(floor(doc_id / 10) as bigint) % 7 pidx,
            concat('/home/dev/projects/proj_', cast(floor(doc_id / 10) as bigint) % 7) project_path,
            {_title_of("doc_id")} title,
            concat('Notes in ', lang, ' from ', source) description, text steps,
            concat(lang, ',', source) tags,
            case doc_id % 5 when 0 then 'workflow' when 1 then 'bugfix' when 2 then 'feature'
              when 3 then 'decision' else 'discovery' end obs_type,
            doc_id % 4 <> 3 recurring, doc_id % 9 created_min,
            case when doc_id % 3 = 0 then @none else
              @arr(concat('source is ', source), concat('length is ', n_chars)) end facts,
            @arr(lang) concepts,
            @arr(concat('data/in_', doc_id % 20, '.csv')) files_read,
            @arr(concat('src/mod_', doc_id % 10, '.py')) files_modified
          from documents) k""",
    "f_skill_files": """
        select skill_id, project_path, created_min, n, pos,
          concat('src/mod_', (doc_id + n) % 10, '.py') file,
          concat('sym_', case pos when 0 then (doc_id * n) % 13 else (doc_id + n) % 17 end) symbol
        from f_skills cross join (select * from (values (1), (2)) a(n)) a
          cross join (select * from (values (0), (1)) b(pos)) b
        where n <= doc_id % 3 and pidx < 4""",
    "f_skill_templates": """
        select skill_id, project_path, created_min, concat('run ', doc_id % 6) name,
          case when doc_id % 10 = 0 then '' else concat('python run_', doc_id % 6, '.py --n ', doc_id) end template,
          case when doc_id % 4 = 0 then '' else concat('job ', doc_id) end description
        from f_skills where obs_type = 'workflow'""",
    # one item per document: renames by id, updates by title, titles shared by many items,
    # titles a rename brings in, and titles a rename leaves behind
    "f_incoming": f"""
        select project_path, doc_id % 4 batch_no, doc_id item_no,
          case doc_id % 5 when 0 then skill_id else 'new' end skill_id,
          case doc_id % 5 when 0 then concat('Renamed ', doc_id) when 1 then title
            when 2 then concat('Shared ', doc_id % 6)
            when 3 then concat('Renamed ', doc_id - 3) else {_title_of('(doc_id - 4)')} end title,
          concat('Update ', description) description, concat('Then: ', steps) steps, tags, obs_type
        from f_skills""",
    "f_rules": """
        select concat('/home/dev/projects/proj_', item_id % 3) project_path, text rule_text, 'review' source,
          item_id rule_seq, item_id % 5 created_min from benchmark""",
    "f_new_rules": """
        select concat('/home/dev/projects/proj_', item_id % 3) project_path, item_id * 10 + v rule_seq,
          case v when 0 then concat('  ', translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), ' ')
            when 1 then concat(text, ' and more') else concat('Fresh rule ', item_id % 4) end rule_text
        from benchmark cross join (select * from (values (0), (1), (2)) a(v)) a
        union all
        select concat('/home/dev/projects/proj_', conv_id % 3) project_path, 100000000 + conv_id * 1000 + turn rule_seq, text rule_text
        from conversations""",
}

_NEEDS = {
    "f_progress": ["f_sessions"], "f_skill_files": ["f_skills"], "f_skill_templates": ["f_skills"],
    "f_incoming": ["f_skills"],
}


def _translate(text: str, dialect: str) -> str:
    for token, name in _DIALECT[dialect].items():
        text = text.replace(token, name)
    return text


def duckdb_with(*names: str) -> str:
    """A WITH clause that defines the named tables for DuckDB."""
    ordered: list[str] = []
    for name in names:
        for one in [*_NEEDS.get(name, []), name]:
            if one not in ordered:
                ordered.append(one)
    return "with " + ",\n".join(f"{n} as ({_translate(TABLES[n], 'duckdb')})" for n in ordered)


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a Spark DataFrame, with the columns of the SQL text."""
    text = _translate(TABLES[name], "spark")
    sources = {}
    for source in ("conversations", "documents", "benchmark", "f_sessions", "f_skills"):
        if f" {source}" in text.replace("\n", " "):
            sources[source] = (
                table(spark, sf_dir, source) if source in TABLES else driver_table(spark, sf_dir, source))
            text = text.replace(f"from {source}", f"from {{{source}}}").replace(f"join {source}", f"join {{{source}}}")
    return spark.sql(text, **sources)


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``f_skills`` in the library's schema, with its nested columns."""
    raw = table(spark, sf_dir, "f_skills")
    entry = ("struct(concat('src/mod_', (doc_id + n) % 10, '.py') as key,"
             " array(concat('sym_', (doc_id * n) % 13), concat('sym_', (doc_id + n) % 17)) as value)")
    file_map = F.expr(
        f"case when pidx < 4 and doc_id % 3 > 0 then map_from_entries(transform(sequence(1L, doc_id % 3), n -> {entry}))"
        " else cast(map() as map<string,array<string>>) end")
    templates = F.expr(
        "case when obs_type = 'workflow' then array(named_struct('name', concat('run ', doc_id % 6),"
        " 'template', case when doc_id % 10 = 0 then '' else concat('python run_', doc_id % 6, '.py --n ', doc_id) end,"
        " 'description', case when doc_id % 4 = 0 then '' else concat('job ', doc_id) end))"
        " else cast(array() as array<struct<name:string,template:string,description:string>>) end")
    return conform(raw.select(
        "*", file_map.alias("file_map"), templates.alias("command_templates"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("created_min") * 60).alias("created_at")), SKILLS)


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``f_incoming`` with the content columns an item carries."""
    raw = table(spark, sf_dir, "f_incoming")
    names = ["project_path", "batch_no", "item_no"]
    content = conform(raw, SKILLS).columns
    return raw.select(*names, *[
        (F.col(c) if c in raw.columns else F.expr(_ITEM_DEFAULTS[c])).alias(c)
        for c in content if c in raw.columns or c in _ITEM_DEFAULTS if c not in names])


_ITEM_DEFAULTS = {
    "facts": "cast(array() as array<string>)", "concepts": "cast(array() as array<string>)",
    "files_read": "cast(array() as array<string>)", "files_modified": "cast(array() as array<string>)",
    "narrative": "''", "recurring": "true", "file_map": "cast(map() as map<string,array<string>>)",
    "command_templates": "cast(array() as array<struct<name:string,template:string,description:string>>)",
}


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "f_rules").withColumn(
        "created_at", F.timestamp_seconds(F.lit(1704067200) + F.col("created_min") * 60)).drop("created_min")


def session_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``f_messages`` written back as raw session logs, one JSON text per session."""
    messages = table(spark, sf_dir, "f_messages")
    markdown = F.struct(F.lit("markdownContent").alias("kind"), F.col("ntext").alias("value"))
    terminal = F.struct(
        F.lit("toolInvocationSerialized").alias("kind"),
        F.struct(
            F.lit("terminal").alias("kind"),
            F.struct(F.expr("concat('python run_', conv_id % 5, '.py --n ', msg_seq)").alias("original")).alias("commandLine"),
            F.struct(F.concat(F.lit("\x1b[31m"), F.col("ntext"), F.lit("\r\n")).alias("text")).alias("terminalCommandOutput"),
            F.struct(F.lit(0).alias("exitCode")).alias("terminalCommandState"),
        ).alias("toolSpecificData"))
    edit = F.struct(
        F.lit("textEditGroup").alias("kind"),
        F.struct(F.expr("concat('/data/set_', conv_id % 13, '/run.py')").alias("path")).alias("uri"),
        F.array(F.lit(1)).alias("edits"))
    listed = F.concat_ws(",", F.when(F.expr("conv_id % 3 = 0"), F.to_json(terminal)),
                         F.when(F.expr("conv_id % 3 = 0"), F.to_json(edit)), F.to_json(markdown))
    response = F.when(F.col("nrole") == "assistant", F.concat(F.lit("["), listed, F.lit("]"))).otherwise("[]")
    request = F.concat(
        F.lit('{"message":'), F.to_json(F.struct(F.col("user_text").alias("text"))),
        F.lit(',"timestamp":'), F.col("ts").cast("string"), F.lit(',"response":'), response, F.lit("}"))
    per_session = messages.select("session_id", "msg_seq", request.alias("request")).groupBy("session_id").agg(
        F.sort_array(F.collect_list(F.struct("msg_seq", "request"))).alias("r"))
    sessions = table(spark, sf_dir, "f_sessions")
    body = F.concat(
        F.lit('{"sessionId":"'), "session_id", F.lit('","creationDate":'), F.col("created_at").cast("string"),
        F.lit(',"lastMessageDate":'), F.col("last_message_at").cast("string"),
        F.lit(',"requests":['), F.array_join("r.request", ","), F.lit("]}"))
    return per_session.join(sessions, "session_id").select(
        F.concat(F.lit("file:///logs/"), "workspace_id", F.lit("/chatSessions/"), "session_id", F.lit(".json")).alias("file_path"),
        "workspace_id", "project_path", body.alias("body"))


def model_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model answer per prompt message, its form chosen by session and position."""
    messages = table(spark, sf_dir, "f_messages")
    skill = F.to_json(F.struct(
        F.concat(F.lit("Skill "), F.col("session_id"), F.lit("-"), F.col("msg_seq")).alias("title"),
        F.array(F.col("user_text"), F.lit("check")).alias("steps"),
        F.array("session_id", F.lit("tag")).alias("tags"),
        F.lit("bugfix").alias("type"), F.lit(False).alias("recurring"),
        F.array(F.lit("a.py")).alias("files")))
    other = F.to_json(F.struct(F.lit("Other").alias("title"), F.col("user_text").alias("steps"),
                               F.lit("unknown").alias("type"), F.lit("false").alias("recurring")))
    form = F.expr("(conv_id + msg_seq) % 8")
    raw = (
        F.when(form == 0, F.concat(F.lit("["), skill, F.lit(","), other, F.lit("]")))
        .when(form == 1, skill)
        .when(form == 2, F.concat(F.lit("```json\n["), skill, F.lit("]\n```")))
        .when(form == 3, F.concat(F.lit("Here they are: ["), skill, F.lit(", 7, "), other, F.lit("] done")))
        .when(form == 4, F.concat(F.lit("One: "), other, F.lit(" ok")))
        .when(form == 5, F.lit("42")).when(form == 6, F.lit("nothing found")).otherwise(F.lit("[]")))
    return messages.select(
        F.lit("/home/dev/projects/p").alias("project_path"), "session_id", "msg_seq", "user_text",
        F.expr("conv_id * 1000 + msg_seq").alias("batch_no"), raw.alias("raw"),
        F.lit(None).cast("string").alias("error"))
