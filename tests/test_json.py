import json

from pyspark.sql import functions as F

from convolake.functions import answers as A
from convolake.functions import responses as R

CELLS = [None, "", "[]", '["a"]', '[1,"a",true,null]', '"x"', '{"a":1}', "null", "false", "bad"]


def test_json_list_rules(rows):
    listed = ["1", "a", "True", "None"]
    assert rows(CELLS, A.json_list("c")) == [
        [], [], [], ["a"], listed, ["x"], ['{"a":1}'], ["None"], ["False"], ["bad"]]
    assert rows(CELLS, A.json_list("c", on_scalar="empty")) == [
        [], [], [], ["a"], listed, [], [], [], [], ["bad"]]
    assert rows(CELLS, A.json_list("c", on_scalar="text", on_invalid="empty")) == [
        [], [], [], ["a"], listed, ['"x"'], ['{"a":1}'], ["null"], ["false"], []]


def test_json_map(rows):
    values = ['{"a":["x",1],"b":"y","c":3}', "[1]", "bad", None]
    assert rows(values, A.json_map("c")) == [{"a": ["x", "1"], "b": ["y"], "c": []}, {}, {}, {}]


def test_answer_items(rows):
    values = [
        '[{"t":1}]', '{"t":1}', '```json\n[{"t":1},{"t":2}]\n```', 'Sure: [{"t":1}] ok', 'One {"t":1} ok',
        "42", "nothing", "", "[]", None, "text [not json] {\"t\":1}", '"[1]"', "] reversed [",
    ]
    got = rows(values, F.transform(A.answer_items("c"), lambda v: F.to_json(v)))
    assert got == [
        ['{"t":1}'], ['{"t":1}'], ['{"t":1}', '{"t":2}'], ['{"t":1}'], ['{"t":1}'], [], [], [], [], [],
        ['{"t":1}'], ["1"], []]


def skill(spark, item):
    df = spark.createDataFrame([(json.dumps(item),)], "c string").select(F.try_parse_json("c").alias("v"))
    return df.select(*A.skill_fields("v")).first().asDict()


def test_skill_fields_defaults(spark):
    got = skill(spark, {"title": "T"})
    assert got["skill_id"] == "new" and got["title"] == "T" and got["steps"] == "" and got["tags"] == ""
    assert got["obs_type"] == "workflow" and got["recurring"] is True and got["file_map"] == {}
    assert got["facts"] == [] and got["files_read"] == [] and got["command_templates"] == []


def test_skill_fields_shapes(spark):
    got = skill(spark, {
        "skill_id": "abc", "title": ["a", "b"], "steps": ["1", 2], "description": None, "tags": ["x", "y"],
        "facts": '["f"]', "concepts": "plain", "files": ["r"], "file_map": '{"f": "s"}', "type": "bugfix",
        "recurring": "false", "command_templates": [{"name": "n", "template": "t"}, 5]})
    assert got["skill_id"] == "abc" and got["title"] == "a\nb" and got["steps"] == "1\n2"
    assert got["description"] == "" and got["tags"] == "x,y" and got["facts"] == ["f"]
    assert got["concepts"] == ["plain"] and got["obs_type"] == "bugfix"
    assert got["files_read"] == ["r"]  # `files` stands in for a missing files_read
    assert got["file_map"] == {"f": ["s"]} and got["recurring"] is True  # a non-empty string is true
    assert [tuple(t) for t in got["command_templates"]] == [("n", "t", None)]


def test_skill_fields_more_shapes(spark):
    got = skill(spark, {"title": "t", "type": "other", "recurring": 0, "files": ["r"], "files_read": ["q"],
                        "file_map": {"a": ["x"], "b": "y"}, "tags": None, "facts": 3})
    assert got["obs_type"] == "workflow" and got["recurring"] is False and got["files_read"] == ["q"]
    assert got["file_map"] == {"a": ["x"], "b": ["y"]} and got["facts"] == []
    assert skill(spark, {"title": "t", "obs_type": "feature"})["obs_type"] == "feature"


def flatten(spark, items):
    body = json.dumps({"response": items})
    df = spark.createDataFrame([(body,)], "c string").select(F.try_parse_json("c").alias("v"))
    return df.select(R.response_text("v")).first()[0]


def tool(**fields):
    return {"kind": "toolInvocationSerialized", **fields}


def test_response_kinds(spark):
    assert flatten(spark, [{"kind": "markdownContent", "value": "A"}, {"kind": "markdownContent", "content": {"value": "B"}}]) == "A\nB"
    assert flatten(spark, [{"kind": "inlineReference"}, {"value": "x"}, 5, "s", None, []]) is None
    assert flatten(spark, "text") is None
    thinking = [{"kind": "thinking", "value": v} for v in ("", "  ", "t" * 499, "t" * 500)]
    assert flatten(spark, thinking) == "[thinking] " + "t" * 499
    edits = [{"kind": "textEditGroup", "uri": {"path": "/a"}, "edits": []},
             {"kind": "textEditGroup", "edits": [1, 2]}, {"kind": "textEditGroup"}]
    assert flatten(spark, edits) == "[edit] /a (0 change(s))\n[edit] 2 change(s)"


def test_terminal_results(spark):
    def terminal(**fields):
        return tool(toolSpecificData={"kind": "terminal", **fields}, invocationMessage="never")

    noisy = "\x1b[31m red\r\n" + "x" * 600
    assert flatten(spark, [terminal(commandLine={"original": "ls"}, terminalCommandOutput={"text": noisy},
                                    terminalCommandState={"exitCode": 0})]) == (
        "[cmd] ls\n[output exit=0] " + ("red\n" + "x" * 600)[:500])
    assert flatten(spark, [terminal(terminalCommandOutput={"text": "o"})]) == "[output] o"
    assert flatten(spark, [terminal()]) is None


def test_detail_and_message_results(spark):
    assert flatten(spark, [tool(toolId="x", resultDetails={"input": "in", "output": [{"value": " o "}, 3, {"value": ""}]})]) == (
        "[tool:x] input: in\n[tool-output] o")
    assert flatten(spark, [tool(resultDetails={"output": "s" * 400})]) == "[tool-output] " + "s" * 300
    assert flatten(spark, [tool(resultDetails={}, pastTenseMessage={"value": "past"}, invocationMessage="inv")]) == "[tool] past"
    assert flatten(spark, [tool(invocationMessage="inv")]) == "[tool] inv"
    assert flatten(spark, [tool(resultDetails={})]) is None


def test_user_text(spark):
    bodies = [{"message": {"text": "hi"}}, {"message": "plain"}, {"message": 7}, {"message": None}, {}, {"message": {}}]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "i int, c string")
    got = df.select("i", R.user_text("try_parse_json(c)").alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == ["hi", "plain", "7", None, None, None]


def test_plain_answers_read_as_spark_reads(spark):
    """An answer read in plain Python gives the items, fields and prompt lines that Spark makes of it."""
    from convolake.functions import plain_answers as P
    from convolake.operators import batches as B
    from convolake.operators import model as M

    values = ["null", "true", "false", "0", "-0", "1", "1.50", "10.0", "0.00", "1e3", "1.5E10", "1E-7", "1e999", "0.00001", "2e-3",
              "12345678901234567890", "123456789012345678901234567890123456789012", '""', '"x"', '"a,b\\n\\u001b\\u007f\\u00e9\\ud83d\\ude00"',
              '"\\ud800"', '"[1, \\"a\\", null]"', '"{\\"k\\": [true, 1.0]}"', '"bad ["', '"42 x"', '"42x"', '"true,"', '"truex"', '" 7 "', "[]", "{}",
              '[""]', '[1, 2.0, null, "z", {"b": 1, "a": [1.10]}]', '{"b": "s", "a": ["x", 1, null], "\\uffff": 2, "\\ud83d\\ude00": {}}',
              '[{"name": "n", "template": "", "description": 0}, {"template": {"a": []}, "name": null}, 5, {}]', '{"a": 1, "a": 2}', "01", "NaN"]
    fields = ["skill_id", "title", "description", "steps", "tags", "type", "obs_type", "facts", "concepts", "file_map", "command_templates"]
    raws = [f'[{{"title": "t", "{f}": {v}}}]' if f != "title" else f'{{"title": {v}}}' for f in fields for v in values]
    raws += [None, "", "42", " 　[1] x", "\x1c[1]", "```json\n[{\"title\": 1}]\n ``` \nx", "see [{\"title\": 1}] ok", "see [1] {\"title\": 2} ok", "] [",
             '[{"title": 1}, 2, [3]] and', '{"title": [1, "b"], "type": null, "obs_type": "bugfix"}', '{"title": "a", "type": "bugfix"}']
    df = spark.createDataFrame([("p", i, raw, None) for i, raw in enumerate(raws)], "project_path string, batch_no long, raw string, error string")
    items = M.normalize_skills(M.parse_items(df)).withColumn("created_at", F.lit(None).cast("timestamp"))
    want = {(r.batch_no, r.item_no): (r.skill_id, r.title, r.steps, r.line) for r in B.skill_lines(items, "batch_no", "item_no", "title", "steps").collect()}
    read = {(i, j): P.shown_fields(x) for i, raw in enumerate(raws) for j, x in enumerate(P.answer_items(raw)) if isinstance(x, dict)}
    got = {k: (f["skill_id"], f["title"], f["steps"], B.skill_line(f["skill_id"], f)) for k, f in read.items() if f["title"] != ""}
    assert len(want) > 300 and {k: (got.get(k), want.get(k)) for k in want.keys() | got.keys() if got.get(k) != want.get(k)} == {}
